"""Mixing sources to target weights by Pfair scheduling (operator 10), native: no Python on the executors.

The documents of a source, by doc_id, are cut into blocks. The target is the flow in which every source that still has
blocks moves in proportion to its weight. A frame is the stretch in which a source with blocks left moves by its weight,
as an integer: weights are taken as the decimals they are written as, times their common denominator. If T(k) is the
time at which a source's flow has passed k blocks, its k-th block has release time floor(T(k)) and deadline
ceil(T(k + 1)); while no source ends in a frame of Q slots, T(k) is k * Q / q for the quota q. In each slot the released
block with the earliest deadline goes next (ties: source name). All deadlines are met, so at every slot of the whole
order each source is less than one block from its target.

Frames are independent of each other, since every source is exactly on target at a frame's end. After a source has run
out the others share its slots in proportion. So only frames in which a source ends, and the first after it, differ from
the frame before: at most twice the number of sources, however many blocks there are. A frame has as many slots as the
weights of its sources add up to, so weights of many digits make long frames, each scheduled in one task.

With `frame_slots`, quotas are instead rounded to a frame of about that length, a last quota is spread over its frame, and
the target is that of the rounded quotas.
Each kind of frame is scheduled once, by a fold over its slots; the place of any block then follows by arithmetic.

Ranks within a source come from a range partition with per-partition offsets, so a source that holds a third of the rows
is spread over many tasks.

Defined results: every row is kept; a null source is a source of its own, named by the empty string; a null doc_id sorts
last; rows that repeat source, doc_id and text take one place; a source without a target weight gets `default_weight`;
a weight that is not above 0 is an error unless `frame_slots` is given;
null and empty texts count as any other; an empty table gives an empty result. Other columns are carried unchanged.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake.llm.store import BROADCAST_BYTES, materialise

BLOCK_DOCS = 8
#: Target weights of the registered query; every source not named here has weight 1.
TARGET_WEIGHTS = {"src0": 3.0, "src1": 2.0}


def _units(docs: DataFrame) -> DataFrame:
    """(src, doc_id, th), distinct."""
    return docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).distinct()


def _ranked(units: DataFrame) -> DataFrame:
    """units with rn, the rank from 0 within a source, counted in range partitions."""
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("th")]
    placed = materialise(units.repartitionByRange("src", *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("src", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("src").alias("o_src"), F.col("part").alias("o_part"), F.coalesce(before, F.lit(0)).alias("offset"))
    inside = placed.withColumn("i", F.row_number().over(Window.partitionBy("src", "part").orderBy(*order)) - 1)
    joined = inside.join(offsets, (F.col("src") == F.col("o_src")) & (F.col("part") == F.col("o_part")))
    return joined.select("src", "doc_id", "th", (F.col("offset") + F.col("i")).alias("rn"))


def whole_weights(weights: dict[str, float], default_weight: float) -> tuple[dict[str, int], int]:
    """The least integers in proportion to the weights, and that of default_weight."""
    exact = [Fraction(str(w)) for w in (*weights.values(), default_weight)]
    if min(exact) <= 0:
        raise ValueError("weights must be above 0")
    scale = lcm(*(w.denominator for w in exact))
    least = gcd(*(int(w * scale) for w in exact))
    *named, default = (int(w * scale) // least for w in exact)
    return dict(zip(weights, named, strict=True)), default


def quotas(counts: DataFrame, weights: dict[str, float], default_weight: float, block_docs: int, frame_slots: int | None) -> DataFrame:
    """(src, n, a): blocks and blocks per frame of each source, from its number of documents `docs`."""
    if frame_slots is None:
        whole, default = whole_weights(weights, default_weight)
        named = F.create_map(*[F.lit(x).cast(t) for pair in whole.items() for x, t in zip(pair, ("string", "long"), strict=True)]) if whole else F.lit(None).cast("map<string,bigint>")
        a = F.coalesce(F.try_element_at(named, F.col("src")), F.lit(default).cast("long"))
        return counts.select("src", F.ceil(F.col("docs") / block_docs).cast("long").alias("n"), a.alias("a"))
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
    w = counts.withColumn("w", F.coalesce(F.try_element_at(named, F.col("src")), F.lit(float(default_weight))))
    total = w.agg(F.sum("w").alias("total"))
    share = F.round(F.lit(frame_slots) * F.col("w") / F.col("total")).cast("long")
    return w.join(F.broadcast(total)).select("src", F.ceil(F.col("docs") / block_docs).cast("long").alias("n"), F.greatest(F.lit(1).cast("long"), share).alias("a"))


def _schedules(sources: DataFrame, spread: bool = False) -> DataFrame:
    """(src, first_frame, k, slot, start, slots): the slot of a source's k-th block in each kind of frame.

    sources is one row per source; all of it is folded in one row, as the schedule of a frame needs every source.
    A source that ends in a frame keeps its rate up to its end, or with `spread` has its last blocks spread over the frame.
    """
    every = sources.agg(F.array_sort(F.collect_list(F.struct("src", "n", "a"))).alias("s")).filter("size(s) > 0")
    kinds = every.withColumn("last", F.expr("aggregate(s, 0L, (m, x) -> greatest(m, (x.n + x.a - 1) div x.a))"))
    changes = "filter(array_distinct(concat(array(0L), transform(s, x -> x.n div x.a), transform(s, x -> x.n div x.a + 1))), f -> f < last)"
    kinds = kinds.select("s", F.explode(F.expr(changes)).alias("f"))
    kinds = kinds.select("s", "f", F.expr("transform(s, x -> greatest(0L, least(x.a, x.n - f * x.a)))").alias("q"), F.expr("aggregate(s, 0L, (m, x) -> m + least(x.n, f * x.a))").alias("start"))
    kinds = kinds.withColumn("slots", F.expr("aggregate(q, 0L, (m, x) -> m + x)"))
    # rate: blocks by which a source moves in the frame if it does not end; passed(k): blocks of all sources, times rate, when this one has moved by k
    kinds = kinds.withColumn("rate", F.expr("q" if spread else "transform(s, x -> x.a)"))
    passed = "aggregate(zip_with(q, rate, (y, r) -> least(y * rate[i], r * {k})), 0L, (m, v) -> m + v)"
    spans = f"transform(q, (x, i) -> transform(CASE WHEN x > 0 THEN sequence(0L, x - 1) ELSE array() END, k -> named_struct('release', {passed.format(k='k')} div rate[i], 'deadline', ({passed.format(k='(k + 1)')} + rate[i] - 1) div rate[i])))"
    kinds = kinds.withColumn("spans", F.expr(spans))
    pick = """array_min(transform(q, (x, i) -> CASE WHEN st.done[i] < x AND spans[i][cast(st.done[i] as int)].release <= t
              THEN struct(spans[i][cast(st.done[i] as int)].deadline AS deadline, i AS i) END))"""
    step = f"""transform(array({pick}), p -> named_struct(
                 'done', transform(st.done, (d, j) -> CASE WHEN j = p.i THEN d + 1L ELSE d END),
                 'plan', concat(st.plan, array(named_struct('i', p.i, 'k', st.done[p.i])))))[0]"""
    fold = f"""aggregate(sequence(0L, slots - 1),
                 named_struct('done', transform(q, x -> 0L), 'plan', cast(array() AS array<struct<i: int, k: bigint>>)),
                 (st, t) -> {step}, st -> st.plan)"""
    plan = kinds.select("s", "f", "start", "slots", F.posexplode(F.expr(fold)).alias("slot", "p"))
    return plan.select(F.expr("s[p.i].src").alias("src"), F.col("f").alias("first_frame"), F.col("p.k").alias("k"), F.col("slot").cast("long").alias("slot"), "start", "slots")


def _small(sources: DataFrame, name: str) -> DataFrame:
    """A broadcast hint if the materialised table, which has the column `name` and long ones, has at most BROADCAST_BYTES."""
    size = sources.agg(F.sum(F.octet_length(name) + 8 * len(sources.columns) + 24)).first()[0] or 0
    return F.broadcast(sources) if size <= BROADCAST_BYTES else sources


def positions(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, block_docs: int = BLOCK_DOCS, frame_slots: int | None = None) -> DataFrame:
    """(src, doc_id, th, mix_block, mix_position), one row per distinct document: the slot of its block, and its place in the whole order."""
    ranked = materialise(_ranked(_units(docs)), "ranked")
    counts = ranked.groupBy("src").agg(F.count("*").alias("docs"))
    sources = materialise(quotas(counts, weights or {}, default_weight, block_docs, frame_slots), "sources")
    plan = materialise(_schedules(sources, frame_slots is not None), "schedules")
    firsts = plan.select("first_frame").distinct().agg(F.sort_array(F.collect_list("first_frame")).alias("firsts"))  # two for each source at most
    known = _small(materialise(sources.select(F.col("src").alias("b_src"), "a"), "rates"), "b_src").join(F.broadcast(firsts))
    # a document's block, its frame and its place in that follow from its rank by arithmetic
    placed = ranked.join(known, F.col("src") == F.col("b_src")).withColumn("block", F.expr(f"rn div {block_docs}"))
    placed = placed.withColumn("frame", F.expr("block div a")).withColumn("k", F.expr("block % a")).withColumn("first_frame", F.expr("array_max(filter(firsts, f -> f <= frame))"))
    slots = _small(plan, "src").select(F.col("src").alias("p_src"), F.col("first_frame").alias("p_first"), F.col("k").alias("p_k"), "start", "slots", "slot")
    placed = placed.join(slots, (F.col("src") == F.col("p_src")) & (F.col("first_frame") == F.col("p_first")) & (F.col("k") == F.col("p_k")))
    place = F.col("start") + (F.col("frame") - F.col("first_frame")) * F.col("slots") + F.col("slot")
    return placed.select("src", "doc_id", "th", place.alias("mix_block"), (place * block_docs + F.expr(f"rn % {block_docs}")).alias("mix_position"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, **limits) -> DataFrame:
    """docs with mix_block and mix_position; reading in the order of mix_position gives the target weights. A column of docs with one of these names is replaced."""
    p = positions(docs, weights, **limits).select(F.col("src").alias("p_src"), F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), "mix_block", "mix_position")
    hit = docs["doc_id"].cast("long").eqNullSafe(p["p_id"]) & (F.xxhash64(docs["text"]) == p["p_th"]) & (F.coalesce(docs["source"].cast("string"), F.lit("")) == p["p_src"])
    names = [c for c in docs.columns if c not in ("mix_block", "mix_position")]
    return docs.join(p, hit).select(*[docs[c] for c in names], p["mix_block"], p["mix_position"])
