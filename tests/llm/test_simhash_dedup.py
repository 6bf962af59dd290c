import random
from itertools import combinations

import xxhash

from photonlake.llm import simhash_dedup
from photonlake.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64)) if h else 0


def brute_force(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 3:
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{fp[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = f"X{rnd.randrange(99)}é"
            rows.append((200 - i, " ".join(w)))
        else:
            rows.append((200 - i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((1, 2, 3, 40, 400))))))
    return rows + [(500, None), (501, ""), (502, " \t\n"), (None, rows[0][1]), (3, "Ab cD"), (4, "ab\tcd")]


def test_matches_brute_force(spark):
    rows = corpus()
    got = sorted((tuple(r) for r in simhash_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == brute_force(rows)


def test_all_pairs_within_three_bits_are_linked(spark):
    rnd = random.Random(2)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for k in (1, 2, 3, 3, 4, 5):
            values.add(v ^ sum(1 << b for b in rnd.sample(range(64), k)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r.a, r.b) for r in simhash_dedup.linked_pairs(df).collect()}
    assert got == {(min(p), max(p)) for p in combinations(signed, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= 3}


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = frame(spark, rows).selectExpr("*", "1 as fp", "2 as th", "3 as component", "4 as best")
    out = simhash_dedup.keep_one(docs)
    assert out.columns == docs.columns
    groups = {r[2] for r in brute_force(rows) if r[2] is not None}
    assert sorted(r.doc_id for r in out.collect()) == sorted(groups)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert simhash_dedup.keep_one(frame(spark, [])).count() == 0
    out = simhash_dedup.keep_one(frame(spark, [(7, "a b c d"), (7, "a b c d"), (None, "e f g h"), (None, "e f g h"), (None, None)])).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == [(7, "a b c d"), (None, "e f g h"), (None, None)]


def test_long_chains_are_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (1001, 1000)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(range(n + 1), 0) | {1000: 1000, 1001: 1000}
