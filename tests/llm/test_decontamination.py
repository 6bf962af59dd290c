import random
import re

from photonlake.llm import decontamination

DOCS, ITEMS = "doc_id long, text string, lang string", "item_id long, text string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w, n=5):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_force(docs, items):
    out = set()
    for i, t in items:
        w = words(t)
        if not w:
            continue
        n = min(5, len(w))
        q = shingles(w, n)
        for d, x in docs:
            k = len(q & shingles(words(x), n))
            if k and k >= 0.8 * len(q):
                out.add((d, i, k, len(q)))
    return out


def corpus():
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))
    items = [(i, text(rnd.randint(1, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "One, two!"), (93, "One, two!")]
    docs = [(i, text(rnd.randint(0, 900))) for i in range(60)]
    for k in range(40):
        i, t = docs[k]
        w, item = t.split(" "), words(rnd.choice(items[:40])[1])
        for _ in range(rnd.randint(0, 3)):
            item[rnd.randrange(len(item))] = "changed"
        at = rnd.randint(0, len(w))
        docs[k] = (i, " ".join([*w[:at], ", ".join(item).upper(), *w[at:]]))
    return [*docs, (70, None), (71, ""), (72, "and one two."), (None, items[3][1])], items


def test_matches_brute_force(spark):
    docs, items = corpus()
    got = decontamination.contaminated(spark.createDataFrame([(*r, None) for r in docs], DOCS), spark.createDataFrame(items, ITEMS))
    want = brute_force(docs, items)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()} == want and len(want) > 20


def test_contaminated_documents_go(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(*r, None) for r in docs], DOCS).selectExpr("*", "1 as key", "2 as h", "3 as b_id", "4 as words")
    out = decontamination.drop_contaminated(df, spark.createDataFrame(items, ITEMS))
    bad = {d for d, *_ in brute_force(docs, items)}
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {d for d, _ in docs} - bad


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f", None)], DOCS), spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == 1
    assert decontamination.drop_contaminated(docs.union(docs), items).count() == 0


def test_a_long_document_is_searched_whole(spark):
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randrange(9999)}" for _ in range(60000))
    items = [(1, "the quick brown fox jumps over the lazy dog today")]
    got = decontamination.contaminated(spark.createDataFrame([(5, f"{long} {items[0][1]}", None)], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in got] == [(5, 1, 1.0)]
