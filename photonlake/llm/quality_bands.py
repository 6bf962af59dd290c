"""Compression bands as quality rules (operator 2).

A text that zstandard shrinks far more than prose of its length is repetitive; one that it hardly shrinks is noise. The
ratio of compressed to plain bytes is taken over the whole document and over fixed chunks of CHUNK_BYTES. Short
texts compress worse, so the limits depend on length. The rest behind the last full chunk is a chunk too, with the band
of a document of its length. A document is rejected when its own ratio is outside the band of its length, or when more
than MAX_CHUNK_SHARE of its bytes are in chunks outside their bands.

Bands are fitted to the corpus: over all documents that pass the base rules, for each half octave of length, the band reaches
from BELOW spreads under the median ratio to ABOVE spreads over it (a spread is the quartile distance over 1.349, LEAST_SPREAD at
least; the full chunks are a class of their own). Symbol junk compresses only a tenth better than prose of its length, so a band for
all corpora could not tell it. A class with under MIN_CLASS members takes the fixed BANDS.

The base counts (words, symbols, repeated lines, repeated 8-word windows) are exact; windows are compared by a rolling
hash first and word by word where hashes meet.

Defined results: a null or empty text has no words and fails the base rules; its ratio is null. Texts of any length are
measured whole. Ties, repeated rows and a null doc_id need no care, as each row is measured alone and counts once in the bands;
an empty table gives an empty result; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake.llm.store import materialise

LEVEL = 3
CHUNK_BYTES = 2048
CHUNK_BAND = (0.25, 0.80)
MAX_CHUNK_SHARE = 0.2
#: (least bytes, lowest ratio, highest ratio) of a whole document.
BANDS = (
    (0, 0.0, float("inf")),
    (64, 0.60, 1.30),
    (128, 0.50, 1.05),
    (512, 0.45, 0.90),
    (1024, 0.42, 0.80),
    (2048, 0.40, 0.78),
    (4096, 0.38, 0.76),
    (8192, 0.36, 0.75),
    (16384, 0.33, 0.75),
)
BELOW, ABOVE, LEAST_SPREAD, MIN_CLASS = 3.0, 6.0, 0.004, 30
#: The class of full chunks; documents have that of their length.
CHUNKS = -1
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = " \t\n\x0b\x0c\r"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,
            ratio double, n_chunks long, n_bad_chunks long, reason string"""


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """Words covered by windows of `window` words that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    meet = np.zeros(n, bool)
    meet[order[1:][same]] = meet[order[:-1][same]] = True
    at = np.flatnonzero(meet)
    keys = [ids[i : i + window].tobytes() for i in at]
    seen = Counter(keys)
    starts = np.array([i for i, k in zip(at, keys, strict=True) if seen[k] > 1], dtype=np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen = Counter(text.split("\n"))
    repeats = sum(k - 1 for line, k in seen.items() if k > 1 and _HAS_WORD.search(line))
    return len(words), len(text) - sum(text.count(c) for c in _SPACES), len(_SYMBOLS.findall(text)), repeats, repeated_words(words)


def band(n_bytes: int) -> tuple[float, float]:
    """The lowest and highest ratio for a document of n_bytes."""
    return next((low, high) for least, low, high in reversed(BANDS) if n_bytes >= least)


def _within(ratio: float, limits: tuple[float, float]) -> bool:
    return limits[0] <= ratio <= limits[1]


def length_class(n_bytes: int) -> int:
    """Half octaves of length."""
    return int(2 * np.log2(n_bytes))


def limits_of(n_bytes: int, fitted: dict[int, tuple[float, float]] | None, chunk: bool = False) -> tuple[float, float]:
    """The band of a document, or of a chunk, of n_bytes."""
    full = chunk and n_bytes == CHUNK_BYTES
    found = (fitted or {}).get(CHUNKS if full else length_class(n_bytes))
    return found or (CHUNK_BAND if full else band(n_bytes))


def ratios(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple[int, float | None, list[tuple[int, float]]]:
    """(bytes, ratio, [(bytes, ratio) of each chunk])."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0, None, []
    chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    return len(data), len(compressor.compress(data)) / len(data), [(len(c), len(compressor.compress(c)) / len(c)) for c in chunks]


def verdict(n_bytes: int, ratio: float | None, chunks: list[tuple[int, float]], fitted: dict | None = None) -> tuple[int, str | None]:
    """(chunks outside their band, reason for rejection or None)."""
    if ratio is None:
        return 0, None
    low, high = limits_of(n_bytes, fitted)
    bad = [n for n, r in chunks if not _within(r, limits_of(n, fitted, True))]
    return len(bad), "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks" if sum(bad) > MAX_CHUNK_SHARE * n_bytes else None


def compression_verdict(text: str | None, compressor: zstandard.ZstdCompressor, fitted: dict | None = None) -> tuple[float | None, int, int, str | None]:
    """(ratio, chunks, chunks outside their band, reason for rejection or None)."""
    n, ratio, chunks = ratios(text, compressor)
    bad, reason = verdict(n, ratio, chunks, fitted)
    return ratio, len(chunks), bad, reason


MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, size_class int, ratio double, chunks array<struct<n:int,r:double>>"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            text = text if isinstance(text, str) else None
            n, chars, symbols, lines, repeats = base_counts(text)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            size, ratio, chunks = ratios(text, compressor)
            rows.append((doc, n, chars, symbols, lines, repeats, failed, size, length_class(size) if size else 0, ratio, [{"n": k, "r": r} for k, r in chunks]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURED.split(", ")]).astype({"doc_id": "Int64"})


def fit(measured: DataFrame) -> dict[int, tuple[float, float]]:
    """The bands of the length classes, from a histogram of all ratios in thousandths; a row a class comes to the driver."""
    good = measured.filter("NOT base_failed AND ratio IS NOT NULL")
    whole = good.select(F.col("size_class").alias("class"), "ratio")
    full = good.select(F.explode("chunks").alias("c")).filter(F.col("c.n") == CHUNK_BYTES).select(F.lit(CHUNKS).alias("class"), F.col("c.r").alias("ratio"))
    counts = whole.union(full).groupBy("class", F.round("ratio", 3).alias("r")).agg(F.count("*").alias("k"))
    each = Window.partitionBy("class")
    ranked = counts.withColumn("upto", F.sum("k").over(each.orderBy("r"))).withColumn("n", F.sum("k").over(each))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("r")))
    found = ranked.groupBy("class").agg(F.max("n").alias("n"), quartile(0.25).alias("a"), quartile(0.5).alias("m"), quartile(0.75).alias("b")).filter(F.col("n") >= MIN_CLASS)
    out = {}
    for r in found.collect():
        spread = max((r["b"] - r["a"]) / 1.349, LEAST_SPREAD)
        out[r["class"]] = (r["m"] - BELOW * spread, r["m"] + ABOVE * spread)
    return out


def _decide(fitted: dict[int, tuple[float, float]]):
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [verdict(int(n), None if pd.isna(r) else r, [(c["n"], c["r"]) for c in chunks], fitted) for n, r, chunks in zip(pdf["n_bytes"], pdf["ratio"], pdf["chunks"], strict=True)]
            out = pdf[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio"]].copy()
            failed = pdf["base_failed"].to_numpy(bool)
            out["kept"] = [not f and reason is None for f, (_, reason) in zip(failed, rows, strict=True)]
            out["n_chunks"], out["n_bad_chunks"] = [len(c) for c in pdf["chunks"]], [bad for bad, _ in rows]
            out["reason"] = pd.Series(["base" if f else reason for f, (_, reason) in zip(failed, rows, strict=True)], dtype=object, index=out.index)
            yield out[[c.split()[0] for c in SCHEMA.split(",")]].astype({"doc_id": "Int64"})

    return decide


def judge(docs: DataFrame, fitted: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """One row per row of docs with the base counts, the ratios and the verdict, by bands fitted to docs unless given."""
    measured = materialise(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInPandas(_measure, MEASURED), "measured")
    return measured.mapInPandas(_decide(fit(measured) if fitted is None else fitted), SCHEMA)
