import hashlib
import random

import numpy as np

from photonlake.llm import suffix_dedup

SCHEMA = "doc_id long, text string, lang string"


def brute_force(rows):
    """{(doc, text): (removed, runs, sha256)} by looking up every 50-byte string."""
    key = lambda d: (1 << 63) - 1 if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, key(d)), key(d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d, t] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    passages = [text(rnd.randint(30, 120)) for _ in range(6)] + ["ha" * 90, "x" * 70]
    rows = []
    for i in range(60):
        rows.append((100 - i, "".join(rnd.choice([rnd.choice(passages), text(rnd.randint(0, 60)), rnd.choice(passages)[3:70]]) for _ in range(5))))
    return [*rows, (200, rows[0][1]), (201, rows[0][1]), (300, None), (301, ""), (302, "z" * 49), (None, rows[1][1] + "tail"), (None, rows[2][1]), (100, "q" * 60 + "q" * 60), rows[3], rows[3], (400, "é" * 40000)]


def digest(r):
    return r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).selectExpr("*", "1 as runs", "2 as okey", "3 as th")
    want = {}
    for (d, _), v in brute_force(rows).items():
        want.setdefault(d, []).append(v)
    got = {}
    for r in suffix_dedup.remove_repeats(docs).collect():
        got.setdefault(r.doc_id, set()).add(digest(r))
    assert {k: set(v) for k, v in want.items()} == got


def test_small_collections_close_at_anchors(spark, monkeypatch):
    rnd = random.Random(3)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(50, 84))).encode() for _ in range(300)]
    strings += [s[1:] + b"b" for s in strings[:100]]
    low = np.array([rnd.randrange(50) for _ in strings])
    flags = suffix_dedup.repeated_strings(strings, low)
    first = {}
    for s, k in zip(strings, low, strict=True):
        for i in range(len(s) - 49):
            first[s[i : i + 50]] = min(first.get(s[i : i + 50], k), k)
    want = [sum(1 << i for i in range(len(s) - 49) if first[s[i : i + 50]] < k) for s, k in zip(strings, low, strict=True)]
    assert flags.tolist() == want and any(want)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "HELD", 5)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 7)
    test_matches_brute_force(spark)


def test_the_filter_holds_every_anchor(spark):
    rnd = np.random.default_rng(5)
    some = rnd.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    bits, held = suffix_dedup._filter(spark.createDataFrame([(int(h),) for h in some], "h long"))
    has = lambda h: [held[s, p >> 3] >> (7 - (p & 7)) & 1 for s, *ps in zip(*suffix_dedup._places(h, bits), strict=True) for p in map(int, ps)]
    assert all(has(some)) and bits == 1 << 17
    others = np.array(has(rnd.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64))).reshape(-1, 2).all(axis=1)
    assert others.mean() < 0.05


def test_a_very_long_text(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(300_000))
    rows = [(5, text), (3, text[100_000:100_200]), (4, text[50_000:50_049])]
    (got,) = [r for r in suffix_dedup.remove_repeats(spark.createDataFrame([(*r, None) for r in rows], SCHEMA)).collect() if r.doc_id == 5]
    assert [(s.start, s.end) for s in got.spans] == [(100_000, 100_200)] and got.n_bytes == 300_000
