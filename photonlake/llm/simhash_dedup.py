"""SimHash near-duplicates (operator 7).

Fingerprints of 64 bits come from 3-word shingles. A fingerprint is embedded as the bit counts of 32 segments of two
bits. The Manhattan distance of two such count vectors never exceeds the Hamming distance of the fingerprints, so a
range join of the vectors at radius 3 loses no link. The counts are kept in unary (0 -> 00, 1 -> 01, 2 -> 11): the
Manhattan distance is then the bit count of an exclusive or, and stays in generated code.

Grid: the 32 count axes form six bands. Three units of Manhattan distance touch three bands at most, so a linked pair
agrees in all counts of at least three bands; each choice of three bands is one grid and its counts are the cell.
Pairs that meet in a cell pass the Manhattan bound, then the exact Hamming test. Equal fingerprints are one node
before the join, so a group of copies is one row there however large it is.

Defined results: a null or wordless text has fingerprint zero and links like any other; with fewer than three words
the whole word sequence is the only shingle; repeated rows and ties link as equal fingerprints; a null doc_id takes
part and is never the smallest unless a component has no other; an empty table gives an empty result. Only doc_id and
text are read, other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from photonlake.llm.graph import connected_components
from photonlake.llm.store import discard, fresh, materialise, small_side

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
EVEN_BITS = 0x5555555555555555
BANDS = 6


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text as a signed integer."""
    if not text:
        return 0
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def unary_counts(column: str) -> str:
    """SQL for the 32 two-bit segment counts of a fingerprint column, each in unary."""
    return f"((({column}) | shiftrightunsigned({column}, 1)) & {EVEN_BITS}L) | shiftleft(({column}) & shiftrightunsigned({column}, 1) & {EVEN_BITS}L, 1)"


def grid_masks(bands: int = BANDS, distance: int = MAX_DISTANCE) -> list[int]:
    """A mask over the unary counts for each choice of bands that a linked pair may agree in."""
    edges = [round(32 * i / bands) for i in range(bands + 1)]
    band = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(band[i] for i in chosen)) for chosen in combinations(range(bands), bands - distance)]


def linked_pairs(fingerprints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a < b, for all distinct fingerprints `fp` at Hamming distance 1 to `distance`."""
    masks = grid_masks(distance=distance)
    cells = F.expr("array(" + ", ".join(f"named_struct('grid', {k}, 'cell', counts & {m}L)" for k, m in enumerate(masks)) + ")")
    points = fingerprints.select("fp", F.expr(unary_counts("fp")).alias("counts")).select("fp", "counts", F.explode(cells).alias("g"))
    points = points.select("fp", "counts", "g.grid", "g.cell")
    a, b = points.alias("a"), points.alias("b")
    near = (
        (F.col("a.grid") == F.col("b.grid"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.expr("bit_count(a.counts ^ b.counts)") <= distance)
        & (F.expr("bit_count(a.fp ^ b.fp)") <= distance)
    )
    return a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def classes(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(cfp, component, component_id) for each fingerprint of a materialised table (doc_id, fp).

    component is a fingerprint that names the group, component_id the smallest doc_id that links reach.
    """
    nodes = materialise(prints.groupBy(F.col("fp").alias("cfp")).agg(F.min("doc_id").alias("first_doc")), "fingerprints")
    reached = connected_components(linked_pairs(nodes.select(F.col("cfp").alias("fp")), distance))
    named = nodes.join(reached, nodes["cfp"] == reached["node"], "left").select("cfp", "first_doc", F.coalesce("component", "cfp").alias("component"))
    named = materialise(named, "named")
    least = named.groupBy(F.col("component").alias("group")).agg(F.min("first_doc").alias("component_id"))
    return named.join(least, named["component"] == least["group"]).select("cfp", "component", "component_id")


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column("text").alias("fp")), "prints")
    found = classes(prints, distance)
    return prints.join(found, prints["fp"] == found["cfp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id (rows without one last), then the smallest text hash.

    Rows that repeat both doc_id and text are one document and leave one row. All columns of docs are returned.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), fingerprint_column("text").alias("fp"))
    prints = materialise(keyed.groupBy("doc_id", "th", "fp").agg(F.count("*").alias("n")), "prints")
    groups = classes(prints.select("doc_id", "fp"), distance)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "n")
    # one row per fingerprint first, so that a group of copies is small before its rows meet
    per_print = prints.groupBy("fp").agg(F.min(rank).alias("best"))
    best = per_print.join(groups, F.col("fp") == F.col("cfp")).groupBy("component").agg(F.min("best").alias("best"))
    own_id, own_th, copies = fresh(docs, "_pl_id", "_pl_th", "_pl_n")
    stay = materialise(best.select(F.col("best.doc_id").alias(own_id), F.col("best.th").alias(own_th), F.col("best.n").alias(copies)), "stay")
    discard(prints)
    hit = docs["doc_id"].cast("long").eqNullSafe(stay[own_id]) & (F.xxhash64(docs["text"]) == stay[own_th])
    kept = docs.join(small_side(stay), hit, "inner")
    # only rows that repeat both have to meet once more
    own = [docs[c] for c in docs.columns]
    return kept.filter(stay[copies] == 1).select(*own).union(kept.filter(stay[copies] > 1).dropDuplicates([own_id, own_th]).select(*own))
