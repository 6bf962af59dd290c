"""Queries over the virtual sensor and the other tables, one for each operator; plans/oracle.py has the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.operators import layout, metadata, normalize, opcodes, predict, render, stats, stencil
from photonlake.plans import virtual
from photonlake.session import table

DARK = [(0, 1), (62, 63)]
SEED = 100
CHANNELS = 3
COLUMNS = 21
MATRIX = [1.5, -0.25, -0.125, -0.5, 1.75, -0.25, 0.0625, -0.75, 1.875]
GRID = {"rows": 2, "columns": 3, "planes": 1, "spacing": (0.5, 0.25), "origin": (0.25, 0.25), "gains": [1.0, 1.5, 2.0, 0.5, 0.75, 1.25]}
PROFILE = {"points": (2, 2, 3), "spacing": (0.5, 0.5), "origin": (0.25, 0.25), "weights": (0.25, 0.5, 0.125, 0.0625, 0.0625), "gamma": 2.0, "gains": [1 + i / 8 for i in range(12)]}


def levels(height: int) -> normalize.Levels:
    """Repeating black levels with row and column deltas over an active area one sample inside the image."""
    black = [10.0 * r + 5 * k + 3 * c for r in range(2) for k in range(3) for c in range(CHANNELS)]
    area = (1, 1, height - 1, COLUMNS - 1)
    return normalize.Levels((2, 3), CHANNELS, black, area, [2600.0, 2700.0, 2800.0], [float(x * 7 % 5 - 2) for x in range(COLUMNS - 2)], None)


def lut():
    """A short table, built by rule: entry i is i * i / 1024 rounded down, for 2,048 entries."""
    return F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: F.floor(i * i / 1024))


def _linear(spark: SparkSession, d: str) -> DataFrame:
    return virtual.interleaved(spark, d).withColumn("v", F.col("code") / 4096.0)


def _opcode(spark: SparkSession, d: str, *ops: opcodes.Opcode) -> DataFrame:
    stage = (0, 0, virtual.height(spark, d), COLUMNS)
    out, bounds = opcodes.apply_list(_linear(spark, d), ops, stage)
    # a shift below the last digit keeps exact halves from rounding by each engine's own rule
    return opcodes.inside(out, bounds).select("y", "x", "channel", F.round(F.col("v") + 1e-9, 6).alias("v"))


def causes(px: DataFrame) -> DataFrame:
    """The virtual defects: a bad pixel where (7 y + 13 x) mod 97 = 0, an autofocus pixel at y mod 8 = 3, x mod 8 = 5."""
    bad = F.when((F.col("y") * 7 + F.col("x") * 13) % 97 == 0, stencil.BAD).otherwise(0)
    focus = F.when(stencil.grid_sites(5, 61, 8, 3, 1 << 40, 8), stencil.AUTOFOCUS).otherwise(0)
    return px.withColumn("causes", bad.bitwiseOR(focus))


def _calibrated(px: DataFrame) -> DataFrame:
    """v (exact: codes over 4,096), causes and clip of each sample."""
    return causes(px).withColumn("v", F.col("code") / 4096.0).withColumn("clip", render.clip_mask(2900))


def _halves(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(virtual.planes(spark, d).filter("plane <> 2")).withColumn("influence", F.col("clip"))


def plane_stats(spark, d):
    return stats.plane_stats(virtual.planes(spark, d)).drop("image_id")


def code_histogram(spark, d):
    return stats.code_histogram(virtual.top(spark, d), DARK).select("code", "n")


def black_level(spark, d):
    found = stats.black_level(stats.code_histogram(virtual.top(spark, d), DARK))
    return found.select("plane", "black", F.round("noise_variance", 6).alias("noise_variance"))


def normalize_plane(spark, d):
    px = virtual.top(spark, d)
    black = stats.black_level(stats.code_histogram(px, DARK))
    return normalize.black_white(px, black, virtual.DEPTH).select("y", "x", F.round("v", 6).alias("v"))


def normalized_stats(spark, d):
    """The minimum slice end to end: black level, normalization, then statistics of the result."""
    px = virtual.top(spark, d)
    black = stats.black_level(stats.code_histogram(px, DARK))
    v = normalize.black_white(px, black, virtual.DEPTH)
    return v.groupBy("plane").agg(F.count("*").alias("n"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("greatest"), F.round(F.avg("v"), 6).alias("mean"))


def linearize_lut(spark, d):
    return virtual.top(spark, d).select("y", "x", normalize.linearize(F.col("code"), lut()).alias("v"))


def black_repeat_denominator(spark, d):
    values = levels(virtual.height(spark, d)).denominators()
    return spark.range(CHANNELS).select(F.col("id").alias("channel"), F.element_at(F.array(*map(F.lit, values)), (F.col("id") + 1).cast("int")).alias("denominator"))


def dng_normalize(spark, d):
    out = normalize.normalize(virtual.interleaved(spark, d), levels(virtual.height(spark, d)))
    return out.select("y", "x", "channel", F.round("v", 6).alias("v"))


def sample_flags(spark, d):
    out = normalize.flags(virtual.interleaved(spark, d), levels(virtual.height(spark, d)), virtual.DEPTH)
    return out.select("y", "x", "channel", "flags")


def corrected_flags(spark, d):
    """Flag 8 over a whole image once any of its lists was applied."""
    flagged = normalize.flags(virtual.interleaved(spark, d), levels(virtual.height(spark, d)), virtual.DEPTH)
    state = opcodes.processing(3, 1)
    bit = normalize.CORRECTED if state in ("Applied", "PartiallyApplied") else 0
    return flagged.groupBy(F.col("flags").bitwiseOR(F.lit(bit)).alias("flags")).agg(F.count("*").alias("n"))


def opcode_map_table(spark, d):
    return _opcode(spark, d, opcodes.Opcode("table", params=[(i * 37) % 65536 for i in range(1, 60000, 600)]))


def opcode_map_table_codes(spark, d):
    px = virtual.interleaved(spark, d).withColumn("v", F.col("code").cast("double"))
    out, _ = opcodes.apply_list(px, [opcodes.Opcode("table", params=[(i * 11) % 5000 for i in range(3000)])], (0, 0, virtual.height(spark, d), COLUMNS), opcodes.STAGE_CODES)
    return out.select("y", "x", "channel", "v")


def opcode_polynomial(spark, d):
    return _opcode(spark, d, opcodes.Opcode("polynomial", params=[-0.25, 0.5, 1.25, -0.5]))


def opcode_gain_map(spark, d):
    return _opcode(spark, d, opcodes.Opcode("gain_map", grid=GRID))


def opcode_row_delta(spark, d):
    n = virtual.height(spark, d)
    return _opcode(spark, d, opcodes.Opcode("row_delta", params=[(y % 9 - 4) / 16 for y in range(n)]))


def opcode_col_delta(spark, d):
    return _opcode(spark, d, opcodes.Opcode("column_delta", params=[(x % 7 - 3) / 8 for x in range(COLUMNS)]))


def opcode_row_scale(spark, d):
    n = virtual.height(spark, d)
    return _opcode(spark, d, opcodes.Opcode("row_scale", params=[1 + (y % 5) / 4 for y in range(n)]))


def opcode_col_scale(spark, d):
    return _opcode(spark, d, opcodes.Opcode("column_scale", params=[0.5 + (x % 6) / 4 for x in range(COLUMNS)]))


def opcode_pitch_area(spark, d):
    area = opcodes.Area((2, 1, 40, 20), plane=1, planes=2, pitch=(3, 2))
    return _opcode(spark, d, opcodes.Opcode("column_scale", area, [2.0 - k / 8 for k in range(10)]))


def opcode_trim(spark, d):
    n = virtual.height(spark, d)
    return _opcode(spark, d, opcodes.Opcode("trim", opcodes.Area((1, 2, n - 3, COLUMNS - 1))))


def opcode_chain(spark, d):
    """A trim, a gain map over what it leaves, a polynomial on two planes and a row scale with a pitch, in order."""
    n = virtual.height(spark, d)
    ops = [
        opcodes.Opcode("trim", opcodes.Area((1, 1, n - 1, COLUMNS - 1))),
        opcodes.Opcode("gain_map", grid=GRID),
        opcodes.Opcode("polynomial", opcodes.Area(planes=2), [0.125, 0.75]),
        opcodes.Opcode("row_scale", opcodes.Area((4, 3, 20, 15), pitch=(4, 1)), [0.5, 0.75, 1.25, 1.5]),
    ]
    return _opcode(spark, d, *ops)


def profile_gain(spark, d):
    n = virtual.height(spark, d)
    wide = _linear(spark, d).groupBy("y", "x").agg(*[F.max(F.when(F.col("channel") == c, F.col("v"))).alias(k) for c, k in enumerate("rgb")])
    row, column = (F.col("y") + 0.5) / n, (F.col("x") + 0.5) / COLUMNS
    return wide.select("y", "x", F.round(opcodes.profile_gain(F.col("r"), F.col("g"), F.col("b"), 1.5, PROFILE, row, column), 4).alias("gain"))


def parity_diff_encode(spark, d):
    return predict.parity_encode(virtual.top(spark, d), SEED).select("y", "x", "d")


def parity_predict_decode(spark, d):
    return predict.parity_decode(predict.parity_encode(virtual.top(spark, d), SEED), SEED).select("y", "x", "code")


def _sof3(kind: int, restart_rows: int | None = None, point: int = 0):
    def query(spark, d):
        diffs = predict.sof3_encode(virtual.top(spark, d), kind, 12, point, restart_rows)
        return predict.sof3_decode(diffs, kind, 12, point, restart_rows).select("y", "x", "code")

    return query


def _sof3_diffs(kind: int):
    def query(spark, d):
        return predict.sof3_encode(virtual.top(spark, d), kind, 12).select("y", "x", "d")

    return query


def _page_bytes(spark, d) -> DataFrame:
    """(page_id, i, b): every byte of every page."""
    pages = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")).filter("length(content) > 0")
    # dealt out by page before they are many rows (a given number, as few bytes would be one task); a character for each byte, cut in one pass: to look one up in a text takes as long as its place
    single = F.slice(F.split(F.decode("content", "ISO-8859-1"), "", -1), 1, F.length("content"))
    flat = pages.repartition(4 * spark.sparkContext.defaultParallelism, "page_id").select("page_id", F.posexplode(single).alias("i", "c"))
    return flat.select("page_id", "i", F.ascii("c").cast("long").alias("b"))


def prefix_byte_decode(spark, d):
    """Bytes from their running differences, summed up per page."""
    b = _page_bytes(spark, d).withColumn("d", F.col("b") - F.coalesce(F.lag("b").over(Window.partitionBy("page_id").orderBy("i")), F.lit(7)))
    out = predict.prefix_bytes(b, ["page_id"], 7)
    return out.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("byte").alias("total"), F.sum(F.col("byte") * (F.col("i") % 251 + 1)).alias("weighted"), F.count_if(F.col("byte") != F.col("b")).alias("wrong"))


def keystream_xor(spark, d):
    """Page bytes under the type-2 keystream, by a join with the table of its whole period; every page starts at another place of it."""
    from photonlake.functions import cipher

    ks = F.broadcast(cipher.keystream_table(spark, cipher.MODULUS))  # the period: a bound fixed by the format, of two narrow columns
    b = _page_bytes(spark, d).withColumn("at", (F.col("i") + F.col("page_id") * 9973) % cipher.MODULUS)
    out = b.join(ks, b["at"] == ks["k"]).withColumn("e", F.col("b").bitwiseXOR(F.col("key")))
    return out.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("e").alias("total"), F.sum(F.col("e") * (F.col("i") % 251 + 1)).alias("weighted"))


def pack_12bit(spark, d):
    codes = virtual.top(spark, d).select(F.col("y").alias("key"), F.col("x").alias("i"), "code")
    return layout.pack_12(codes).select(F.col("key").alias("y"), F.col("i").cast("int").alias("i"), "byte")


def unpack_10bit(spark, d):
    """The bytes of each row of codes, as packed by twelves, read as ten-bit numbers."""
    rows = pack_12bit(spark, d).groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "byte"))), lambda s: s["byte"]).alias("bytes"))
    return layout.unpack_bits(rows, 10, 76).select("y", "i", "code")


def tile_assemble(spark, d):
    n = virtual.height(spark, d)
    tiles = layout.to_tiles(virtual.top(spark, d), 24, 20, 4, padding=999)
    return layout.assemble_tiles(tiles, 24, 20, 4, n, virtual.WIDTH).select("y", "x", "code")


def tile_samples(spark, d):
    """The tiles themselves, padding included."""
    tiles = layout.to_tiles(virtual.top(spark, d), 24, 20, 4, padding=999)
    return tiles.select("tile", F.posexplode("samples").alias("i", "code"))


def uninterleave(spark, d):
    return layout.uninterleave(virtual.top(spark, d), virtual.height(spark, d), virtual.WIDTH, 3, 5).select("y", "x", "code")


def orient_undo(spark, d):
    n = virtual.height(spark, d)
    parts = [layout.unoriented(virtual.top(spark, d).select("image_id", "plane", *(("y", "x") if o < 5 else (F.col("x").cast("long").alias("y"), F.col("y").alias("x"))), "code"), o, n, 64).withColumn("orientation", F.lit(o)) for o in range(1, 9)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("orientation", "y").agg(F.sum(F.col("code") * (F.col("x") + 1)).alias("weighted"))


def defect_map(spark, d):
    px = virtual.top(spark, d).withColumn("causes", F.when(stencil.grid_sites(5, 61, 8, 3, 1 << 40, 8), stencil.AUTOFOCUS).otherwise(0))
    run_list = [1, 1, 99, 3, 98, 0, 2, 2, 97, 0, 11, 5, 1, 60, 1, 0]
    sites = spark.createDataFrame([(0, 2, y, x) for y, x in stencil.run_list_defects(run_list, 1 << 30, 64)], "image_id int, plane int, y long, x int")
    return stencil.mark_sites(px, F.broadcast(sites), stencil.BAD).filter("causes <> 0").select("y", "x", "causes")


def repair_idw(spark, d):
    out = stencil.repair(_calibrated(virtual.top(spark, d)))
    return out.filter("causes <> 0").select("y", "x", F.round("v", 6).alias("v"), "influence")


def clip_mask(spark, d):
    return causes(virtual.top(spark, d)).select("y", "x", render.clip_mask(2900).alias("clip"))


def downsample_2x2(spark, d):
    px = _calibrated(virtual.top(spark, d)).withColumn("influence", F.col("clip"))
    return stencil.downsample(px).select("y", "x", "v", "influence")


def _pairs(spark, d) -> DataFrame:
    """guide (the top plane's sum over 2x2) and source (four times the lower plane's code) at half size."""
    half = virtual.height(spark, d) // 2
    top = virtual.top(spark, d).withColumn("clip", F.when(F.col("code") >= 2900, 1).otherwise(0))
    guide = top.groupBy("image_id", F.expr("y div 2").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.sum("code").alias("guide"), F.max("clip").alias("influence"))
    low = virtual.planes(spark, d).filter("plane <> 2").select("image_id", "plane", "y", "x", (F.col("code") * 4).alias("source"))
    return low.join(guide.filter(F.col("y") < half), ["image_id", "y", "x"])


def local_regression(spark, d):
    out = stencil.local_regression(_pairs(spark, d), "guide", "source", 0.0)
    return out.select("plane", "y", "x", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "influence")


def upsample_bilinear(spark, d):
    n = virtual.height(spark, d)
    return stencil.upsample(_halves(spark, d), ["v"], n, 64).select("plane", "y", "x", F.round("v", 6).alias("v"), "influence")


def _top(spark, d) -> DataFrame:
    return _calibrated(virtual.top(spark, d)).withColumn("influence", F.col("clip"))


def reconstruct_bilinear(spark, d):
    out = render.reconstruct_bilinear(_top(spark, d), _halves(spark, d), virtual.height(spark, d), 64)
    return out.select("y", "x", *[F.round(f"v{p}", 6).alias(f"v{p}") for p in range(3)], "clip")


def reconstruct_guided(spark, d):
    fit = stencil.local_regression(_pairs(spark, d), "guide", "source", 0.0).withColumn("intercept", F.col("intercept") / 16384.0)
    out = render.reconstruct_guided(_top(spark, d), fit, virtual.height(spark, d), 64)
    return out.select("y", "x", *[F.round(f"v{p}", 5).alias(f"v{p}") for p in range(3)], "clip")


def color_matrix(spark, d):
    out = render.reconstruct_bilinear(_top(spark, d), _halves(spark, d), virtual.height(spark, d), 64)
    matrix = render.conversion_matrix(MATRIX, [1.5, 1.0, 2.0], [1.0, 1.25, 0.5], 0.5)
    return render.apply_matrix(out, matrix).select("y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


def rgba(spark, d):
    out = render.reconstruct_bilinear(_top(spark, d), _halves(spark, d), virtual.height(spark, d), 64)
    return render.rgba(out).select("y", "x", F.round("v0", 6).alias("r"), F.round("v1", 6).alias("g"), F.round("v2", 6).alias("b"), "a")


def clip_combined(spark, d):
    out = render.reconstruct_bilinear(_top(spark, d), _halves(spark, d), virtual.height(spark, d), 64)
    return out.groupBy("y").agg(F.sum("clip").alias("clipped"), F.count("*").alias("n"))


def residual_summary(spark, d):
    """The upsampled lower planes against the top plane, per plane, in codes."""
    n = virtual.height(spark, d)
    fine = stencil.upsample(_halves(spark, d), ["v"], n, 64).select("image_id", "plane", "y", "x", F.col("v").alias("u"))
    top = _top(spark, d).filter("causes = 0").select("image_id", "y", "x", "v")
    r = fine.join(top, ["image_id", "y", "x"]).withColumn("r", F.round((F.col("u") - F.col("v")) * 4096, 4))
    out = stats.residual_summary(r, ["plane"])
    return out.select("plane", "n", *[F.round(c, 4).alias(c) for c in ("bias", "rms", "p95")])


def _attributed(spark, d) -> DataFrame:
    px = _top(spark, d)
    return px.withColumn("causes", F.col("causes").bitwiseOR(F.when(F.col("clip") == 1, stencil.ENCODED_MAX).otherwise(0)))


def cause_counts(spark, d):
    return stats.cause_counts(_attributed(spark, d), ["plane"])


def cause_marginals(spark, d):
    return stats.cause_marginals(_attributed(spark, d), ["plane"], {"bad": stencil.BAD, "autofocus": stencil.AUTOFOCUS, "encoded_max": stencil.ENCODED_MAX})


def overlap_ranges(spark, d):
    """Orders as byte ranges, a third of the price long, checked for overlap within each customer."""
    ranges = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") * 100).alias("start"), F.floor(F.col("o_totalprice") / 3).alias("length"))
    return metadata.overlapping(ranges, ["k"]).select("k", "start", "length", "earlier_end")


def tag_budget(spark, d):
    """Pages as retained values under a cumulative byte budget."""
    items = table(spark, d, "pages").select(F.lit(0).alias("image_id"), "page_id", F.octet_length("html").cast("long").alias("size"))
    return metadata.budget_exceeded(items.withColumn("image_id", F.col("page_id") % 10), "image_id", "page_id", "size", 20000).select("image_id", "page_id", "used", "over")


def duplicate_tags(spark, d):
    tags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.lit(0).alias("dir_ord"), F.col("l_linenumber").alias("tag_id"))
    return metadata.duplicate_tags(tags)


def _heads(spark, d) -> DataFrame:
    """Each document's first bytes, after one of five magics by its doc_id."""
    magic = F.element_at(F.array(*[F.lit(m) for m in ("464F5662", "49492A00", "4D4D002A", "4949", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.unhex(magic), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("head"))


def container_probe(spark, d):
    return _heads(spark, d).select("doc_id", metadata.container(F.col("head")).alias("container"))


def white_balance_lookup(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 14).cast("int")).alias("light"), (F.col("o_custkey") % 15).cast("int").alias("setting"))
    return e.select("o_orderkey", metadata.white_balance(F.col("light"), F.col("setting")).alias("preset"))


def status_map(spark, d):
    names = [*metadata.STATUS, "Other"]
    e = table(spark, d, "lineitem").select(F.element_at(F.array(*map(F.lit, names)), (F.col("l_orderkey") % len(names) + 1).cast("int")).alias("error"))
    return e.groupBy("error").agg(F.count("*").alias("n")).select("error", "n", F.coalesce(metadata.lookup(F.col("error"), metadata.STATUS), F.lit(4)).alias("status"))


def codec_names(spark, d):
    e = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, [1, 7, 34892, 52546, 8])), (F.col("p_partkey") % 5 + 1).cast("int")).alias("compression"))
    return e.select("p_partkey", F.coalesce(metadata.lookup(F.col("compression"), metadata.CODEC), F.lit(0)).alias("codec"))


def ifd_pivot(spark, d):
    """The first seven calibration tags, in rows of lineitem; plans/decoded.py has all of them in files."""
    ids = [*metadata.CALIBRATION_TAGS][:7]
    tags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.expr("case when l_linenumber = 7 then 1 else 0 end").alias("dir_ord"), F.element_at(F.array(*map(F.lit, ids)), F.col("l_linenumber")).alias("tag_id"), F.col("l_partkey").alias("value"))
    return metadata.pivot_tags(tags, {t: metadata.CALIBRATION_TAGS[t] for t in ids})


QUERIES = {
    f.__name__: f
    for f in (
        plane_stats, code_histogram, black_level, normalize_plane, normalized_stats, linearize_lut, black_repeat_denominator, dng_normalize, sample_flags,
        corrected_flags, opcode_map_table, opcode_map_table_codes, opcode_polynomial, opcode_gain_map, opcode_row_delta, opcode_col_delta, opcode_row_scale,
        opcode_col_scale, opcode_pitch_area, opcode_trim, opcode_chain, profile_gain, parity_diff_encode, parity_predict_decode, prefix_byte_decode, keystream_xor,
        pack_12bit, unpack_10bit, tile_assemble, tile_samples, uninterleave, orient_undo, defect_map, repair_idw, clip_mask, downsample_2x2, local_regression,
        upsample_bilinear, reconstruct_bilinear, reconstruct_guided, color_matrix, rgba, clip_combined, residual_summary, cause_counts, cause_marginals,
        overlap_ranges, tag_budget, duplicate_tags, container_probe, white_balance_lookup, status_map, codec_names, ifd_pivot,
    )
}
QUERIES |= {f"sof3_predict_{k}": _sof3(k) for k in (1, 2, 3, 4)}
QUERIES |= {"sof3_restart": _sof3(3, restart_rows=16), "sof3_point": _sof3(1, point=2)}
QUERIES |= {f"sof3_diffs_{k}": _sof3_diffs(k) for k in range(1, 8)}
