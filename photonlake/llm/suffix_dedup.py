"""Repeated byte strings across documents (operator 9).

Every byte covered by a LENGTH-byte string that also starts in a document with a smaller doc_id is removed. Strings are
compared by a collection's Burrows-Wheeler transform and common prefixes, built column by column: each round puts one
more symbol in front of every string, finds its row by rank in the transform, and passes once through the transform and
the prefixes, which are external files read and written in order (`ColumnwiseCollection`).

Rounds cost a pass over the whole collection, so one collection of whole documents would need as many passes as
the longest document has bytes. The work is cut without losing a match: of the GRAM-byte hashes in a LENGTH-byte string
the least one (the rightmost of equals) is its anchor, which depends on the string alone. So equal strings have equal
anchors, and the strings of a document that share an anchor are one short stretch of under 2 * LENGTH bytes. Anchors
that occur in one document only cannot match: the least and greatest doc_id of each anchor say which do not, and a filter of
bits, of bounded size, leaves most of these out (others are compared in vain). The stretches that are left meet by anchor, equal
ones as one string with their least doc_id, and batches of whole anchors are collections. An anchor with one different
stretch has nothing to be compared with and stays out of the construction.

The rows of an anchor with over HOT stretches are first brought together by content, and the different ones split by the BESIDE bytes
before and those after the hashed bytes: a common string of LENGTH bytes has as many on one side at least, so it is found in
one of the two parts.

Defined results: a null or empty text has no bytes and keeps none; texts shorter than LENGTH keep everything; a null
doc_id counts as greater than any other, and rows with equal doc_id never remove from each other; rows that repeat
doc_id and text are treated alike; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.store import discard, materialise, small_side

LENGTH = 50
GRAM = 24
#: Bytes that a string of LENGTH has beside the hashed ones, on its longer side at least.
BESIDE = (LENGTH - GRAM + 1) // 2
#: Stretches above which an anchor's rows are brought together by content first and split by what stands beside.
HOT = 1 << 10
#: Rows of whole anchors that are held at a time.
HELD = 1 << 15
SLICE_BYTES = 1 << 19
#: Bits of the filter for each shared anchor, and the most it may have (64 MB). Beyond that more rows take the exact test.
FILTER_BITS, MOST_FILTER_BITS, SEGMENTS = 16, 1 << 29, 256
#: Different stretches after which a collection is closed at the next anchor; its rounds stay in a core's cache.
COLLECTION = 1 << 12
LAST = (1 << 63) - 1

_PRIME = 0x9E3779B97F4A7C15


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, put together from hashes of 1, 2, 4, .. bytes."""
    part, size, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while done < GRAM:
        if GRAM & size:
            out = part if out is None else out[: len(out) - size] * np.uint64(pow(_PRIME, size, 1 << 64)) + part[done : done + len(out) - size]
            done += size
        if done < GRAM:
            part = part[:-size] * np.uint64(pow(_PRIME, size, 1 << 64)) + part[size:]
            size *= 2
    return out


def anchors(data: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, n, at) of every stretch: n strings that start from byte `first` on have the same anchor, hashed from byte `at` on.

    doc: the document of each byte.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = _grams(data)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_PRIME)
    h ^= h >> np.uint64(32)
    least, at, width, window = h, np.arange(len(h), dtype=np.int32), 1, length - GRAM + 1
    while width < window:
        step = min(width, window - width)
        left, right = least[:-step], least[step:]
        at = np.where(right <= left, at[step:], at[:-step])
        least = np.minimum(left, right)
        width += step
    start = np.flatnonzero(doc[: len(at)] == doc[length - 1 :])
    at = at[start]
    if not len(at):
        return none, none, none, none
    edge = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])) + 1])
    return h[at[edge]].view(np.int64), start[edge], np.diff(np.append(edge, len(at))), at[edge]


def _slices(pdf: pd.DataFrame) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first row, texts, document of each byte) for about SLICE_BYTES at a time."""
    texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends, i = np.cumsum(sizes), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, SLICE_BYTES + (ends[i - 1] if i else 0), side="right")))
        yield i, texts[i:j], np.repeat(np.arange(j - i, dtype=np.int32), sizes[i:j])
        i = j


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, okey) of every anchor."""
    for pdf in batches:
        keys = pdf["okey"].to_numpy()
        for i, texts, doc in _slices(pdf):
            h, start, _, _ = anchors(np.frombuffer(b"".join(texts), np.uint8), doc)
            if len(h):
                yield pd.DataFrame({"h": h, "okey": keys[i:][doc[start]]})


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment of the filter that a hash belongs to, and its two bits there. Anchors are least hashes, so only low bits are spread evenly."""
    u, size = h.view(np.uint64), np.uint64(bits // SEGMENTS)
    return (u & np.uint64(SEGMENTS - 1)).astype(np.int64), ((u * np.uint64(_PRIME)) >> np.uint64(20)) % size, (u >> np.uint64(8)) % size


def _segment(bits: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        segment, one, two = _places(pdf["h"].to_numpy(), bits)
        row = np.zeros(bits // SEGMENTS, np.uint8)
        row[one], row[two] = 1, 1
        return pd.DataFrame({"segment": [int(segment[0])], "bits": [np.packbits(row).tobytes()]})

    return build


def _filter(shared: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bytes) of a filter that holds every h of a materialised table; SEGMENTS rows come to the driver."""
    wanted = max(1, shared.count()) * FILTER_BITS
    bits = min(MOST_FILTER_BITS, max(1 << 16, 1 << (wanted - 1).bit_length()))
    segment = F.col("h").bitwiseAND(F.lit(SEGMENTS - 1))
    out = np.zeros((SEGMENTS, bits // SEGMENTS // 8), np.uint8)
    # a group holds a 256th of the anchors: it is built from parts, or'ed here
    parts = shared.select("h", segment.alias("segment"), F.pmod(F.xxhash64("h"), F.lit(1 + wanted // (SEGMENTS << 22))).alias("part"))
    for r in parts.groupBy("segment", "part").applyInPandas(_segment(bits), "segment int, bits binary").toLocalIterator():
        out[r["segment"]] |= np.frombuffer(r["bits"], np.uint8)
    return bits, out


def _stretch_rows(shared):
    """One row (h, okey, th, run, s) per stretch whose anchor passes the filter; run is its place in the text, that of the hashed bytes in it and its number of strings, s its bytes."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, held = shared.value
        for pdf in batches:
            keys, hashes = pdf["okey"].to_numpy(), pdf["th"].to_numpy()
            for i, texts, doc in _slices(pdf):
                data = b"".join(texts)
                h, start, n, at = anchors(np.frombuffer(data, np.uint8), doc)
                if not len(h):
                    continue
                segment, one, two = _places(h, bits)
                on = lambda p: held[segment, (p >> np.uint64(3)).astype(np.int64)] >> (7 - (p & np.uint64(7))).astype(np.uint8) & 1  # noqa: B023, E731
                pick = np.flatnonzero(on(one) & on(two))
                if not len(pick):
                    continue
                h, start, n, at = h[pick], start[pick], n[pick], at[pick]
                whole = [data[a:b] for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)]
                d = doc[start]
                first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[d]
                yield pd.DataFrame({"h": h, "okey": keys[i:][d], "th": hashes[i:][d], "run": (start - first) << 16 | (at - start) << 8 | n, "s": whole})

    return rows_of


class ColumnwiseCollection:
    """Burrows-Wheeler transform and common prefixes of many strings, one symbol of each string a round.

    The transform (a byte a row, zero where a string begins) and the common prefixes with the row before (a byte a row, as
    strings are short) are external files; a round reads both in order and writes both anew.
    """

    def __init__(self, strings: list[bytes], folder: Path):
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.n = len(strings)
        self.files = tuple(open(folder / name, "w+b", buffering=0) for name in ("bwt", "lcp"))
        text = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)  # zero is the end of a string; UTF-8 has no byte 255
        self.text, self.ends = text, np.cumsum(self.sizes)
        self._write(self._symbol(np.arange(self.n), 1), np.zeros(self.n, np.uint8))
        self._build()

    def close(self) -> None:
        for f in self.files:
            f.close()

    def _symbol(self, who: np.ndarray, back: int) -> np.ndarray:
        """The symbol that is `back` places from the end of each string; zero before its first."""
        return np.where(self.sizes[who] >= back, self.text[np.maximum(self.ends[who] - back, 0)], 0).astype(np.uint8)

    def _write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        for f, values in zip(self.files, (bwt, lcp), strict=True):  # files only grow
            f.seek(0)
            f.write(values.data)
        self.rows_now = len(bwt)

    def _read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for f in self.files:
            values = np.empty(self.rows_now, np.uint8)
            f.seek(0)
            f.readinto(values.data)
            out.append(values)
        return tuple(out)

    def _build(self) -> None:
        row = np.arange(self.n)  # of the last suffix put in, for each string that goes on
        who = np.arange(self.n)
        for back in range(1, int(self.sizes.max(initial=0)) + 1):
            on = self.sizes[who] >= back
            who, row = who[on], row[on]
            bwt, lcp = self._read()
            order = np.argsort(bwt, kind="stable")  # the rows by symbol: the order of the suffixes that these symbols begin
            order = order[np.count_nonzero(bwt == 0) :]
            chosen = np.zeros(len(bwt), bool)
            chosen[row] = True
            new = chosen[order]
            at = np.flatnonzero(new)  # the ranks of the new suffixes
            mine = np.empty(len(row), np.int64)
            mine[np.lexsort((row, bwt[row]))] = at
            # common prefixes of the new rows with the row of the same first symbol before and after
            new[1:] |= chosen[order[:-1]]
            touched = np.flatnonzero(new)
            before, here = order[touched - 1], order[touched]
            same = (touched > 0) & (bwt[before] == bwt[here])
            common = np.zeros(len(touched), np.uint8)
            if same.any():
                pairs = np.stack([before[same] + 1, here[same] + 1], axis=1).ravel()
                common[same] = np.minimum.reduceat(np.append(lcp, 0), pairs)[::2] + 1
            # rows of the new suffixes stand after the ends of all strings
            into = at + self.n - np.arange(len(at))
            next_bwt, next_lcp = np.insert(bwt, into, 0), np.insert(lcp, into, 0)
            next_bwt[mine + self.n] = self._symbol(who, back + 1)
            next_lcp[touched + self.n] = common
            self._write(next_bwt, next_lcp)
            row = mine + self.n

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, strings, rows) of the suffixes of each length, from the files."""
        bwt, _ = self._read()
        order = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
        place = np.zeros(len(bwt), np.int64)
        place[order] = np.arange(len(order)) + self.n
        who, row = np.arange(self.n), np.arange(self.n)
        for size in range(1, int(self.sizes.max(initial=0)) + 1):
            on = self.sizes[who] >= size
            who, row = who[on], place[row[on]]
            yield size, who, row

    def groups(self, length: int) -> np.ndarray:
        """For each row, a number that rows with `length` symbols in common share."""
        _, lcp = self._read()
        return np.cumsum(lcp < length)


def repeated_strings(strings: list[bytes], low: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A bit for each start in each string: set if its `length` bytes also start in a string with a smaller `low`."""
    flags = np.zeros(len(strings), np.int64)
    if not len(strings):
        return flags
    with tempfile.TemporaryDirectory(prefix="columnwise-") as folder:
        built = ColumnwiseCollection(strings, Path(folder))
        group = built.groups(length)
        whole = [(size, who, group[row]) for size, who, row in built.rows() if size >= length]
        built.close()
    who, number = np.concatenate([w for _, w, _ in whole]), np.concatenate([g for _, _, g in whole])
    order = np.lexsort((low[who], number))
    first = np.concatenate([[True], number[order][1:] != number[order][:-1]])
    least = np.empty(len(who), np.int64)
    least[order] = low[who][order][first][np.cumsum(first) - 1]
    start = np.concatenate([built.sizes[w] - size for size, w, _ in whole])
    hit = least < low[who]
    np.bitwise_or.at(flags, who[hit], np.int64(1) << start[hit])
    return flags


def _compared(h: np.ndarray, strings: list[bytes], low: np.ndarray) -> np.ndarray:
    """flags of different strings that meet by h, in collections of whole groups; a group of one has nothing to be compared with."""
    flags = np.zeros(len(strings), np.int64)
    order = np.argsort(h, kind="stable")
    _, first, size = np.unique(h[order], return_index=True, return_counts=True)
    first, size = first[size > 1], size[size > 1]
    i = 0
    while i < len(first):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), COLLECTION, side="right")))
        who = np.concatenate([order[a : a + n] for a, n in zip(first[i:j], size[i:j], strict=True)])
        flags[who] = repeated_strings([strings[k] for k in who], low[who])
        i = j
    return flags


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of HELD rows and more that hold whole groups, from batches that come sorted by key."""
    held, size = [], 0
    for pdf in batches:
        if held and size >= HELD:
            last = held[-1][key].iloc[-1]
            same = int((pdf[key] == last).sum())  # sorted: those that go on with the last group come first
            held.append(pdf.iloc[:same])
            pdf = pdf.iloc[same:]
            if len(pdf):
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if len(pdf):
            held.append(pdf)
            size += len(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _judge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(okey, th, run, flags) of the stretches with something to remove, from rows (h, okey, th, run, s) sorted by h."""
    for rows in _whole_groups(batches, "h"):
        which, strings = pd.factorize(rows["s"].to_numpy(object))  # equal stretches have equal anchors
        okey = rows["okey"].to_numpy(np.int64)
        low, h = np.full(len(strings), LAST), np.zeros(len(strings), np.int64)
        np.minimum.at(low, which, okey)
        h[which] = rows["h"].to_numpy(np.int64)
        flags = _compared(h, list(strings), low)[which]
        # of equal stretches only the first keeps what no other stretch has before it
        rows["flags"] = np.where(okey > low[which], -1, flags)
        yield rows.loc[rows["flags"] != 0, ["okey", "th", "run", "flags"]]


def _judge_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, sh, flags) of different stretches (g, h, sh, low, s) sorted by g."""
    for rows in _whole_groups(batches, "g"):
        rows["flags"] = _compared(rows["g"].to_numpy(np.int64), list(rows["s"]), rows["low"].to_numpy(np.int64))
        yield rows.loc[rows["flags"] != 0, ["h", "sh", "flags"]]


def _removed(n_bytes: int, run: np.ndarray | None, flags: np.ndarray | None) -> np.ndarray:
    """Starts and ends of the maximal removed runs."""
    edge = np.zeros(n_bytes + 1, np.int64)
    if run is not None and len(run):
        first, n = run >> 16, run & 255
        whole = flags == -1
        np.add.at(edge, first[whole], 1)
        np.add.at(edge, first[whole] + n[whole] + LENGTH - 1, -1)
        part, bit = np.nonzero(flags[~whole][:, None] >> np.arange(LENGTH) & 1)
        start = first[~whole][part] + bit
        np.add.at(edge, start, 1)
        np.add.at(edge, start + LENGTH, -1)
    covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(covered)).reshape(-1, 2)


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text, run, flags in zip(pdf["doc_id"], pdf["text"], pdf["run"], pdf["flags"], strict=True):
            data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            spans = _removed(len(data), run, flags)
            edges = [0, *spans.ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc, len(data), [{"start": int(a), "end": int(b)} for a, b in spans], kept))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"]).astype({"doc_id": "Int64"})


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"okey": F.coalesce("doc_id", F.lit(LAST).cast("long")), "th": F.xxhash64("text")})


MARKS = "okey long, th long, run long, flags long"


def _judge_hot(rows: DataFrame) -> DataFrame:
    """As _judge_rows, for anchors with many rows: equal stretches become one row first, and different ones meet in two parts.

    Within a part all strings have GRAM + BESIDE bytes in common.
    """
    rows = rows.withColumns({"sh": F.xxhash64("s"), "at": F.expr("cast(shiftright(run, 8) & 255 as int)")})
    different = rows.groupBy("h", "sh").agg(F.min("okey").alias("low"), F.first("s").alias("s"), F.first("at").alias("at"))
    different = materialise(different, "hot-stretches")
    before = F.expr(f"CASE WHEN at >= {BESIDE} THEN xxhash64(h, 0, substring(s, at - {BESIDE - 1}, {BESIDE})) END")
    after = F.expr(f"CASE WHEN length(s) >= at + {GRAM + BESIDE} THEN xxhash64(h, 1, substring(s, at + {GRAM + 1}, {BESIDE})) END")
    sides = F.filter(F.array(before, after), lambda g: g.isNotNull())
    parts = different.select("h", "sh", "low", "s", F.explode(sides).alias("g"))
    judged = parts.repartition("g").sortWithinPartitions("g").select("g", "h", "sh", "low", "s").mapInPandas(_judge_parts, "h long, sh long, flags long")
    judged = judged.groupBy(F.col("h").alias("j_h"), F.col("sh").alias("j_sh")).agg(F.bit_or("flags").alias("flags"))
    known = different.select("h", "sh", "low").join(judged, (F.col("h") == F.col("j_h")) & (F.col("sh") == F.col("j_sh")), "left")
    known = materialise(known.select(F.col("h").alias("l_h"), F.col("sh").alias("l_sh"), "low", F.coalesce("flags", F.lit(0).cast("long")).alias("flags")), "hot-judged")
    marked = rows.join(small_side(known), (F.col("h") == F.col("l_h")) & (F.col("sh") == F.col("l_sh")))
    flags = F.when(F.col("okey") > F.col("low"), F.lit(-1).cast("long")).otherwise(F.col("flags"))
    return marked.select("okey", "th", "run", flags.alias("flags")).filter("flags <> 0")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (byte offsets of the maximal removed runs), kept (the bytes that stay)."""
    keyed = _keyed(docs)
    long_enough = keyed.select("okey", "th", "text").filter(f"octet_length(text) >= {LENGTH}")
    found = long_enough.select("okey", "text").mapInPandas(_anchor_rows, "h long, okey long")
    shared = found.groupBy("h").agg(F.min("okey").alias("low"), F.max("okey").alias("high"), F.count("*").alias("n")).filter("low < high").select("h", "n")
    shared = materialise(shared, "anchors")
    held = docs.sparkSession.sparkContext.broadcast(_filter(shared))
    stretches = materialise(long_enough.mapInPandas(_stretch_rows(held), "h long, okey long, th long, run long, s binary"), "stretches", "zstd")
    hot = small_side(materialise(shared.filter(F.col("n") > HOT).select(F.col("h").alias("hot_h")), "hot-anchors"))
    is_hot = F.col("h") == F.col("hot_h")
    cold = stretches.join(hot, is_hot, "left_anti").select("h", "okey", "th", "run", "s")
    marked = cold.repartition("h").sortWithinPartitions("h").mapInPandas(_judge_rows, MARKS)
    marked = materialise(marked, "marks")
    marked = marked.union(materialise(_judge_hot(stretches.join(hot, is_hot, "left_semi")), "hot-marks"))
    discard(shared, stretches)
    cuts = marked.groupBy(F.col("okey").alias("r_okey"), F.col("th").alias("r_th")).agg(F.collect_set(F.struct("run", "flags")).alias("runs"))
    cuts = materialise(cuts.select("r_okey", "r_th", F.col("runs.run").alias("r_run"), F.col("runs.flags").alias("r_flags")), "cuts")
    whole = keyed.join(cuts, (F.col("okey") == F.col("r_okey")) & (F.col("th") == F.col("r_th")), "left")
    return whole.select("doc_id", "text", F.col("r_run").alias("run"), F.col("r_flags").alias("flags")).mapInPandas(_cut, KEPT)
