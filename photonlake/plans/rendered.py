"""Queries of the renderer and its diagnostics over the virtual sensor, whose calibration is read from a calibration section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.operators import metadata, render, restore, stats, stencil
from photonlake.plans import encode, virtual
from photonlake.sources import camf

MATRIX = [1.5, -0.25, -0.125, -0.5, 1.75, -0.25, 0.0625, -0.75, 1.875]
LUMA = [1, 1, 99, 3, 98, 0, 2, 2, 97, 0, 11, 5, 1, 60, 1, 0]
CHROMA = [7, 3, 5, 0, 8, 3, 1, 30, 1, 0]


def size(spark: SparkSession, d: str) -> dict[int, tuple[int, int]]:
    """Rows and columns of the planes, the top one cut to an even number of rows."""
    half = virtual.height(spark, d) // 2
    return {0: (half, 32), 1: (half, 32), 2: (2 * half, 64)}


def grids(geometry: dict) -> dict[str, tuple[int, ...]]:
    rows = geometry[2][0]
    return {"top": (5, 61, 8, 3, rows - 5, 8, 2), "low": (2, 30, 4, 1, rows // 2 - 3, 8, 1)}


def crop(geometry: dict) -> list[int]:
    return [4, 6, 59, geometry[2][0] - 5]


def section(geometry: dict, **other) -> bytes:
    """The virtual camera's calibration, as a section of type 5. other replaces values by name."""
    m = lambda name, kind, values: encode.matrix_entry(name, kind, [len(v := other.get(name, values))], v)
    entries = [
        m("CAMERAID", 1, [40]), m("ActiveImageArea", 1, crop(geometry)), m("DarkShieldColRange", 1, [0, 1, 62, 63]), m("ImageDepth", 1, [12]),
        m("BadPixelsLumaF23", 1, LUMA), m("BadPixelsChromaF23", 1, CHROMA), m("TempGainFact", 3, [1.0, 1.25, 0.5]), m("SensorISO", 1, [100]), m("CaptureISO", 1, [50]),
        encode.property_entry("WhiteBalanceGains", {"Auto": "AutoGain"}), m("AutoGain", 3, [1.5, 1.0, 2.0]),
        encode.property_entry("WhiteBalanceColorCorrections", {"Auto": "AutoMatrix"}), m("AutoMatrix", 3, MATRIX),
    ]
    return encode.calibration_section(b"".join(entries), 5, 77)


def cameras(spark: SparkSession, sections: dict[int, bytes], geometry: dict) -> tuple[DataFrame, DataFrame]:
    """(facts, defect sites), each with image_id."""
    table = spark.createDataFrame([(str(k), bytearray(v)) for k, v in sections.items()], "path string, camf binary")
    entries = camf.entry_table(table)
    named = lambda df: df.withColumn("image_id", F.col("path").cast("int")).drop("path")
    return named(render.facts(entries, "Auto", geometry)), named(render.defect_sites(entries, geometry))


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    geometry = size(spark, d)
    camera, sites = cameras(spark, {0: section(geometry)}, geometry)
    px = virtual.planes(spark, d).filter(F.col("y") < geometry[2][0])
    return render.calibrate(px, camera, sites.filter("error is null"), grids(geometry)), camera, geometry


def calibrated_planes(spark, d):
    layers, _, _ = _layers(spark, d)
    return layers.select("plane", "y", "x", F.round("v", 6).alias("v"), "causes", "clip", "influence", F.round("noise", 9).alias("noise"))


def clipping_planes(spark, d):
    layers, _, _ = _layers(spark, d)
    return render.clipping_planes(layers).drop("image_id")


def _rendered(mode: str):
    def query(spark, d):
        layers, camera, geometry = _layers(spark, d)
        out = render.render(layers, camera, mode, geometry)
        return out.select("y", "x", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in "rgb"], "clip")

    return query


def render_errors(spark, d):
    """One sensor under calibrations with a fault each, and a good one."""
    geometry = size(spark, d)
    faults = [{}, {"CAMERAID": [41]}, {"ActiveImageArea": [9, 6, 4, 20]}, {"DarkShieldColRange": [0, 5, 3, 63]}, {"ImageDepth": [17]}, {"ImageDepth": [8]}, {"BadPixelsLumaF23": [1, 1, 99]}, {"SensorISO": [0]}, {"TempGainFact": [1.0, 1.0]}, {"AutoMatrix": [2000.0] * 9}]
    camera, sites = cameras(spark, {k: section(geometry, **f) for k, f in enumerate(faults)}, geometry)
    one = virtual.planes(spark, d).filter(F.col("y") < geometry[2][0]).drop("image_id")
    px = one.withColumn("image_id", F.explode(F.sequence(F.lit(0), F.lit(len(faults)))))  # the last has no calibration and another geometry
    px = px.filter(f"image_id < {len(faults)} OR x < 30")
    layers = render.calibrate(px, camera, sites.filter("error is null"), grids(geometry))
    return render.render_errors(px, camera, sites, layers, geometry)


def attribute_sources(spark, d):
    layers, _, _ = _layers(spark, d)
    bits = stencil.attribute_sources(layers)
    return bits.groupBy("plane", F.col("influence").alias("causes")).agg(F.count("*").alias("n"))


def _projected(spark, d) -> tuple[DataFrame, dict]:
    layers, _, geometry = _layers(spark, d)
    return render.projection(stencil.attribute_sources(layers), geometry), geometry


def projection(spark, d):
    out, _ = _projected(spark, d)
    return out.select("plane", "y", "x", F.round(F.col("bilinear") + 1e-9, 5).alias("bilinear"), F.round(F.col("guided") + 1e-9, 5).alias("guided"), "causes")


def measure_projection(spark, d):
    out, geometry = _projected(spark, d)
    found = render.measure_projection(out, crop(geometry))
    return found.select("plane", "total", "excluded", *[c if c.endswith("_n") else F.round(F.col(c) + 1e-7, 3).alias(c) for c in found.columns if "_" in c and c != "image_id"])


def diagnostic_counts(spark, d):
    """Cause combinations of two populations that are never added up: whole native planes, and the places that both modes are measured at."""
    layers, _, geometry = _layers(spark, d)
    bits = stencil.attribute_sources(layers)
    (y0, y1), (x0, x1) = (stencil.native_interior(crop(geometry)[i], crop(geometry)[i + 2]) for i in (1, 0))
    native = bits.select(F.lit("native-full-plane").alias("scope"), "plane", F.col("influence").alias("causes"))
    inside = render.projection(bits, geometry).filter(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
    common = inside.select(F.lit("projected-common").alias("scope"), "plane", "causes")
    return stats.cause_counts(native.unionByName(common), ["scope", "plane"])


def _restored(transformed: bool, adaptive: bool):
    def query(spark, d):
        height = virtual.height(spark, d) // 2 * 2
        top = virtual.top(spark, d).filter(F.col("y") < height)
        fine = top.select("image_id", "y", "x", F.col("code").alias("g0"), F.expr("code div 2").alias("g1"), (F.col("code") + 100).alias("g2"), (F.col("code") * 3.0).alias("f"))
        mean = F.avg("code")
        coarse = top.groupBy("image_id", F.expr("y div 2").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(mean.alias("r0"), (mean * 0.5).alias("r1"), (mean * 2.5 + 100).alias("r2"), (mean * 2).alias("c0"), (mean + 300).alias("c1"), (5000 - mean).alias("c2"))
        out = restore.restore(fine, coarse, height, virtual.WIDTH, 4096.0, 0.75, transformed, adaptive)
        return out.select("y", "x", "r", "g", "b", F.round(F.col("gain") + 1e-9, 5).alias("gain"))

    return query


def plane_checksums(spark, d):
    """FNV-1a of each row's samples as single-precision numbers, and a checksum of the plane that does not depend on order."""
    rows = virtual.top(spark, d).groupBy("image_id", "plane", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "code"))), lambda s: s["code"].cast("float")).alias("samples"))
    return rows.select("y", stats.fnv1a("samples").alias("checksum"))


def enum_codes(spark, d):
    """Numbers that stand for byte orders and threshold provenances."""
    e = virtual.table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ["II", "MM", "??"])), (F.col("p_partkey") % 3 + 1).cast("int")).alias("order"), F.element_at(F.array(*map(F.lit, [*metadata.PROVENANCE])), (F.col("p_partkey") % 3 + 1).cast("int")).alias("provenance"))
    return e.select("p_partkey", F.coalesce(metadata.lookup(F.col("order"), metadata.BYTE_ORDER), F.lit(0)).alias("byte_order"), metadata.lookup(F.col("provenance"), metadata.PROVENANCE).alias("provenance"))


def autofocus_grid(spark, d):
    """The sites of the fixed grids, row by row: counts and sums of their columns."""
    rows = spark.range(3776).select(F.col("id").alias("y"), F.explode(F.array(F.lit(0), F.lit(2))).alias("plane")).filter("plane = 2 OR y < 1888")
    px = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.when(F.col("plane") == 2, 5887).otherwise(2943))))
    return px.filter(stencil.autofocus() != 0).groupBy("plane", "y").agg(F.count("*").alias("n"), F.sum("x").alias("columns"))


QUERIES = {f.__name__: f for f in (calibrated_planes, clipping_planes, render_errors, attribute_sources, projection, measure_projection, autofocus_grid, diagnostic_counts, plane_checksums, enum_codes)}
QUERIES |= {"render_guided": _rendered("guided"), "render_bilinear": _rendered("bilinear")}
QUERIES |= {"restore": _restored(False, False), "restore_adaptive": _restored(False, True), "restore_transformed": _restored(True, False)}
