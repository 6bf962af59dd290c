from fractions import Fraction
from math import ceil

from photonlake.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute_force(docs, weights, default, block_docs, frame_slots):
    """{(source, doc): position} by simulating every slot."""
    sources = {}
    for d, t, s in dict.fromkeys(docs):
        sources.setdefault(s or "", []).append((d is None, d or 0, d, t))
    names = sorted(sources)
    w = {s: weights.get(s, default) for s in names}
    a = {s: max(1, int(frame_slots * w[s] / sum(w.values()) + 0.5)) for s in names}
    n = {s: ceil(len(sources[s]) / block_docs) for s in names}
    out, place, frame, order = {}, 0, 0, []
    while any(n[s] > frame * a[s] for s in names):
        q = {s: max(0, min(a[s], n[s] - frame * a[s])) for s in names}
        total, done = sum(q.values()), dict.fromkeys(names, 0)
        for t in range(total):
            ready = [(-(-(done[s] + 1) * total // q[s]), s) for s in names if done[s] < q[s] and done[s] * total // q[s] <= t]
            s = min(ready)[1]
            assert min(ready)[0] >= t + 1  # no deadline is missed
            order.append(s)
            block = frame * a[s] + done[s]
            for i, (_, _, d, x) in enumerate(sorted(sources[s], key=lambda r: r[:2])[block * block_docs : (block + 1) * block_docs]):
                out[s, d, x] = (place, place * block_docs + i)
            done[s] += 1
            place += 1
            assert all(abs(done[x] - (t + 1) * q[x] / total) < 1 for x in names)  # less than a block from the target
        frame += 1
    return out


def corpus():
    docs = [(i, f"t{i}", f"s{i % 4 if i % 3 else 0}") for i in range(400)]
    return docs + [(i, f"t{i}", None) for i in range(400, 411)] + [(None, "n", "s1"), (7, None, "s2"), (8, "", "s2"), docs[5], docs[5]]


def test_matches_a_simulation(spark):
    for weights, default, block, frame in (({"s0": 3.0, "s1": 0.5}, 1.0, 4, 16), ({}, 1.0, 3, 7), ({"s3": 50.0}, 1.0, 1, 64)):
        docs = corpus()
        got = mixing.mix(spark.createDataFrame(docs, SCHEMA), weights, default_weight=default, block_docs=block, frame_slots=frame).collect()
        want = brute_force(docs, weights, default, block, frame)
        assert len(got) == len(docs)
        assert {((r.source or ""), r.doc_id, r.text): (r.mix_block, r.mix_position) for r in got} == want


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "1 as src", "2 as rn", "3 as mix_block", "4 as place")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "src", "rn", "place", "mix_block", "mix_position"] and out.count() == len(corpus())
    assert mixing.mix(df.limit(0)).count() == 0


def test_every_prefix_is_within_a_block_of_the_weights(spark):
    """Against the flow of the exact weights, over the whole order and past the ends of sources."""
    for names, weights, size in (([f"src{i}" for i in range(20)], {"src0": 3.0, "src1": 2.0}, lambda i: 130 - 6 * i), ([f"src{i}" for i in range(90)], {"src0": 3.0, "src1": 2.0}, lambda i: 30 - i // 9), (["a", "b", "c"], {"a": 0.7, "b": 0.25}, lambda i: 150)):
        docs = [(1000 * i + j, "t", s) for i, s in enumerate(names) for j in range(size(i))]
        got = mixing.mix(spark.createDataFrame(docs, SCHEMA), weights, block_docs=1).collect()
        order = [r.source for r in sorted(got, key=lambda r: r.mix_position)]
        assert sorted(r.mix_position for r in got) == list(range(len(docs)))
        w = {s: Fraction(str(weights.get(s, 1.0))) for s in names}
        left = {s: Fraction(size(i)) for i, s in enumerate(names)}
        flow, done = dict.fromkeys(names, Fraction(0)), dict.fromkeys(names, 0)
        for s in order:
            done[s] += 1
            time = Fraction(1)
            while time > 0 and any(left.values()):
                total = sum(w[x] for x in names if left[x])
                step = min(time, min(left[x] * total / w[x] for x in names if left[x]))
                for x in names:
                    if left[x]:
                        flow[x] += step * w[x] / total
                        left[x] -= step * w[x] / total
                time -= step
            assert all(abs(done[x] - flow[x]) < 1 for x in names)
