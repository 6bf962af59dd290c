"""Benchmark decontamination (operator 8), native: no Python on the executors.

Finds short test items inside long documents. Items and texts are runs of lower-cased letter and digit words; an item's
set is its distinct 5-word shingles (its whole word sequence if it has fewer words). A document is contaminated by an
item if it contains at least `min_containment` of that set.

Size-partitioned MinHash containment: hashed shingles are one random permutation. Items are partitioned by the size of
their sets into powers of two. A partition's sketch length follows from its upper size u: at containment c, at most
floor((1 - c) * u) shingles may be missing, so among the floor((1 - c) * u) + 1 smallest hash values of an item (its
bottom-k MinHash sketch) at least one is in every document that contains it: no document is missed, however long it is.
Candidates are the pairs that share a sketch value. Verification counts, for candidate pairs only, the distinct item
shingles that the document has.

Defined results: null, empty or wordless texts and items match nothing; equal items match separately; a null doc_id or
item_id is carried as null; rows that repeat doc_id and text are one document; empty tables give an empty result;
only doc_id, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.store import fresh, materialise, small_side
from photonlake.llm.text import WORD, hash_runs, words_of

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8


def _items(benchmark: DataFrame, n: int) -> DataFrame:
    """(key, item_id, len, size, hs): the hashed shingle set of each item, with the shingle length it takes."""
    b = benchmark.filter(F.col("text").rlike(WORD)).select(F.col("item_id"), F.xxhash64("item_id", "text").alias("key"), words_of("text").alias("words")).dropDuplicates(["key"])
    sized = b.withColumn("len", F.least(F.size("words"), F.lit(n)))
    whole = F.array(F.xxhash64("words"))
    hs = F.when(F.size("words") < n, whole).otherwise(F.array_distinct(F.expr(hash_runs("words", n))))
    return sized.select("key", "item_id", "len", hs.alias("hs")).withColumn("size", F.size("hs"))


def _doc_shingles(docs: DataFrame, lengths: list[int], n: int) -> DataFrame:
    """(doc_id, th, len, h), distinct within a document, for the shingle lengths that items take.

    A shorter run is hashed as an array, as whole short items are; xxhash64 chains over columns and array elements alike.
    """
    d = docs.filter(F.col("text").rlike(WORD)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), words_of("text").alias("words"))
    runs = [f"named_struct('len', {k}, 'hs', {hash_runs('words', k)})" for k in lengths]
    by_len = d.select("doc_id", "th", F.explode(F.expr(f"array({', '.join(runs)})")).alias("r"))
    return by_len.select("doc_id", "th", F.col("r.len").alias("len"), F.explode(F.array_distinct("r.hs")).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_containment: float = MIN_CONTAINMENT, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, th, item_id, n_shared, n_shingles, containment) for each contaminated document and item."""
    items = materialise(_items(benchmark, n), "items")
    lengths = sorted(r[0] for r in items.select("len").distinct().collect()) or [n]  # at most n values
    missing = 1 - min_containment
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size").cast("double"))))
    longest = F.least(F.floor(upper * F.lit(round(missing, 9))) + 1, F.col("size")).cast("int")
    sketch = items.withColumn("sketch", F.slice(F.array_sort("hs"), F.lit(1), longest)).select("key", "len", F.explode("sketch").alias("h"))
    probe = materialise(sketch.distinct(), "sketches")
    runs = _doc_shingles(docs, lengths, n)
    hits = runs.join(small_side(probe), ["len", "h"]).select("doc_id", "th", "key")
    found = materialise(hits.distinct(), "candidate-pairs")
    holders = small_side(materialise(found.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th")).distinct(), "holders"))
    some = docs.select("doc_id", "text").join(holders, docs["doc_id"].cast("long").eqNullSafe(F.col("c_id")) & (F.xxhash64(docs["text"]) == F.col("c_th")), "left_semi")
    full = materialise(items.select("key", "len", F.explode("hs").alias("h")), "item-shingles")
    shared = _doc_shingles(some, lengths, n).join(small_side(full), ["len", "h"]).groupBy("doc_id", "th", "key").agg(F.count_distinct("h").alias("n_shared"))
    p = found.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), F.col("key").alias("p_key"))
    exact = shared.join(p, shared["doc_id"].eqNullSafe(p["p_id"]) & (shared["th"] == p["p_th"]) & (shared["key"] == p["p_key"]), "left_semi")
    sized = exact.join(small_side(materialise(items.select("key", "item_id", F.col("size").cast("long").alias("n_shingles")), "item-sizes")), "key")
    return sized.filter(F.col("n_shared") >= F.lit(min_containment) * F.col("n_shingles")).select(
        "doc_id", "th", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """docs without the contaminated documents, all columns kept."""
    own_id, own_th = fresh(docs, "_pl_id", "_pl_th")
    bad = materialise(contaminated(docs, benchmark, **limits).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th)).distinct(), "contaminated")
    hit = docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_th))
    return docs.join(small_side(bad), hit, "left_anti")
