"""Reconstruction of full-size colour from three planes, and clipping provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.operators import stats, stencil
from photonlake.sources.errors import guarded
from photonlake.sources.rows import frame


def clip_mask(threshold: int) -> Column:
    """1 where a code reaches the threshold and the sample is no known defect."""
    return ((F.col("code") >= threshold) & (F.col("causes") == 0)).cast("int")


def pivot_planes(px: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row per pixel with each value of planes 0, 1 and 2 side by side, by conditional aggregation."""
    return px.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("plane") == p, F.col(v))).alias(f"{v}{p}") for v in values for p in (0, 1, 2)])


def reconstruct_bilinear(top: DataFrame, low: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, y, x, v0, v1, v2, clip): the lower planes resampled to the top one; clip where any support is influenced."""
    fine = stencil.upsample(low, ["v"], height, width)
    both = fine.select("image_id", "plane", "y", "x", "v", "influence").unionByName(top.select("image_id", "plane", "y", "x", "v", "influence"))
    wide = pivot_planes(both, ["v", "influence"])
    return wide.select("image_id", "y", "x", "v0", "v1", "v2", F.greatest("influence0", "influence1", "influence2").alias("clip"))


def reconstruct_guided(top: DataFrame, coefficients: DataFrame, height: int, width: int) -> DataFrame:
    """As reconstruct_bilinear, but each lower plane is its resampled slope times the top sample plus its resampled intercept."""
    fine = stencil.upsample(coefficients, ["slope", "intercept"], height, width)
    wide = pivot_planes(fine, ["slope", "intercept", "influence"])
    guide = top.select("image_id", "y", "x", F.col("v").alias("v2"), F.col("influence").alias("own"))
    joined = guide.join(wide, ["image_id", "y", "x"])
    value = lambda p: (F.col(f"slope{p}") * F.col("v2") + F.col(f"intercept{p}")).alias(f"v{p}")
    return joined.select("image_id", "y", "x", value(0), value(1), "v2", F.greatest("own", "influence0", "influence1").alias("clip"))


def conversion_matrix(matrix: Sequence[float], gains: Sequence[float], temperature_gains: Sequence[float], iso_ratio: float) -> list[float]:
    """The 3x3 colour matrix with each column's white balance gain and the sensitivity ratio in it."""
    g = [a * b for a, b in zip(gains, temperature_gains, strict=True)]
    out = [m * g[i % 3] * iso_ratio for i, m in enumerate(matrix)]
    if any(x <= 0 for x in g) or any(abs(x) > 1000 for x in out):
        raise ValueError("invalid colour conversion")
    return out


def not_finite(px: DataFrame) -> DataFrame:
    """(image_id, n): images with a colour that is no finite number, which is an error of the image."""
    wild = F.lit(False)
    for c in "rgb":
        wild = wild | F.coalesce(~(F.abs(c) < float("inf")) | F.isnan(c), F.lit(True))
    return px.filter(wild).groupBy("image_id").agg(F.count("*").alias("n"))


def apply_matrix(px: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """px (v0, v1, v2) with r, g, b."""
    native = [F.col("v0"), F.col("v1"), F.col("v2")]
    dot = lambda c: sum((F.lit(float(matrix[3 * c + i])) * native[i] for i in range(1, 3)), F.lit(float(matrix[3 * c])) * native[0])
    return px.withColumns({"r": dot(0), "g": dot(1), "b": dot(2)})


#: Sizes (rows, columns) of the full-resolution sd Quattro's planes, and its camera number: the only sensor that is rendered.
GEOMETRY, CAMERA = {0: (1888, 2944), 1: (1888, 2944), 2: (3776, 5888)}, 40.0
#: Names of the defect lists by plane.
DEFECTS = {0: "BadPixelsChromaF23", 1: "BadPixelsChromaF23", 2: "BadPixelsLumaF23"}


def facts(entries: DataFrame, white_balance: str, geometry: dict = GEOMETRY, camera: float = CAMERA) -> DataFrame:
    """One row per calibration (path): dark (columns of the top plane), crop [left, top, right, bottom], depth, matrix (nine values), or an error.

    entries is a table of camf.entry_table. Nothing but the rows of a calibration meets in a task.
    """
    wanted = {"camera": ("CAMERAID", 1), "crop": ("ActiveImageArea", 4), "dark": ("DarkShieldColRange", 4), "depth": ("ImageDepth", 1), "warmth": ("TempGainFact", 3), "sensor_iso": ("SensorISO", 1), "capture_iso": ("CaptureISO", 1)}
    matrix = lambda name: F.max(F.when((F.col("name") == name) & (F.col("kind") == "Matrix"), F.col("vals")))
    names = lambda table: F.max(F.when((F.col("name") == table) & (F.col("kind") == "Properties"), F.try_element_at("props", F.lit(white_balance))))
    one = entries.groupBy("path").agg(
        *[matrix(name).alias(k) for k, (name, _) in wanted.items()],
        names("WhiteBalanceGains").alias("gain_name"),
        names("WhiteBalanceColorCorrections").alias("matrix_name"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "Matrix", F.struct("name", "vals")))).alias("all"),
        F.max("error").alias("error"),
    )
    one = one.withColumn("gains", F.try_element_at("all", "gain_name")).withColumn("base", F.try_element_at("all", "matrix_name")).drop("all")
    sizes = {k: n for k, (_, n) in wanted.items()} | {"gains": 3, "base": 9}
    bad = F.lit(False)
    for k, n in sizes.items():
        bad = bad | F.coalesce(F.size(k) != n, F.lit(True))
    height, width = geometry[2]
    whole = lambda c: f"forall({c}, v -> v >= 0 AND v = floor(v))"
    checks = [
        f"camera[0] <> {camera}",
        f"NOT ({whole('crop')}) OR crop[0] > crop[2] OR crop[1] > crop[3] OR crop[2] >= {width} OR crop[3] >= {height}",
        f"NOT ({whole('dark')}) OR exists(dark, v -> v >= {width}) OR dark[0] > dark[1] OR dark[2] > dark[3] OR dark[1] >= dark[2]",
        "depth[0] <> floor(depth[0]) OR NOT depth[0] BETWEEN 1 AND 16",
        "sensor_iso[0] <= 0 OR capture_iso[0] <= 0 OR exists(zip_with(gains, warmth, (a, b) -> a * b), g -> g <= 0 OR NOT g < double('infinity'))",
    ]
    one = one.withColumn("error", F.coalesce("error", F.when(bad, F.lit("InvalidContainer"))))
    for check in checks:
        one = one.withColumn("error", F.coalesce("error", F.when(F.expr(check), F.lit("InvalidContainer"))))
    mixed = F.expr("transform(base, (m, i) -> m * gains[i % 3] * warmth[i % 3] * capture_iso[0] / sensor_iso[0])")
    one = one.withColumn("matrix", F.when(F.col("error").isNull(), mixed))
    wild = F.expr("exists(matrix, m -> NOT abs(m) <= 1000)")
    one = one.withColumn("error", F.coalesce("error", F.when(wild, F.lit("InvalidContainer"))))
    return one.select("path", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("dark", "crop")], F.expr("cast(depth[0] as int)").alias("depth"), "matrix", "error")


def defect_sites(entries: DataFrame, geometry: dict = GEOMETRY) -> DataFrame:
    """(path, plane, y, x, error): the bad pixels of each plane, or a row with the error of a list."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, name, vals in zip(pdf["path"], pdf["name"], pdf["vals"], strict=True):
                for plane in (p for p, n in DEFECTS.items() if n == name):
                    found, error = guarded(stencil.checked_run_list, list(vals), *geometry[plane])
                    rows += [{"path": path, "plane": plane, "error": error}] if error else [{"path": path, "plane": plane, "y": y, "x": x} for y, x in found]
            yield frame(rows, SITES)

    lists = entries.filter((F.col("kind") == "Matrix") & F.col("name").isin(*set(DEFECTS.values())))
    return lists.select("path", "name", "vals").mapInPandas(run, SITES)


SITES = "path string, plane int, y long, x int, error string"


def calibrate(px: DataFrame, camera: DataFrame, sites: DataFrame, grids: dict = stencil.AUTOFOCUS_GRIDS) -> DataFrame:
    """px (image_id, plane, y, x, code) with v between black and white and its defects repaired, causes, clip, influence, noise, black and white.

    camera is facts with an image_id, one row per image; sites are bad pixels (image_id, plane, y, x). The lower planes have half the
    dark columns. Images with an error in camera, or whose black level reaches white, have no rows: see render_errors.
    """
    good = camera.filter("error is null").select("image_id", "dark", "depth")
    scale = F.when(F.col("plane") == 2, 1).otherwise(2)
    edge = lambda i: F.floor(F.element_at("dark", i) / scale)
    dark = px.join(F.broadcast(good), "image_id").filter(F.col("x").between(edge(1), edge(2)) | F.col("x").between(edge(3), edge(4)))
    levels = stats.black_level(dark.groupBy("image_id", "plane", "code").agg(F.count("*").alias("n")))
    white = F.expr("shiftleft(1, depth) - 1")
    levels = levels.join(F.broadcast(good.select("image_id", white.alias("white"))), "image_id").filter("black < white")
    levels = levels.withColumn("noise", F.col("noise_variance") / ((F.col("white") - F.col("black")) * (F.col("white") - F.col("black")))).drop("noise_variance")
    marked = px.withColumn("causes", stencil.autofocus(grids))
    marked = stencil.mark_sites(marked, sites, stencil.BAD)
    out = marked.join(F.broadcast(levels), ["image_id", "plane"])  # three rows an image
    out = out.withColumn("v", (F.col("code") - F.col("black")) / (F.col("white") - F.col("black")))
    out = out.withColumn("clip", ((F.col("code") >= F.col("white")) & (F.col("causes") == 0)).cast("int"))
    return stencil.repair(out)


def clipping_planes(layers: DataFrame) -> DataFrame:
    """(image_id, plane, threshold_code, provenance, width, height, clipped) of calibrated planes; thresholds are encoded maxima, not measured saturation."""
    found = layers.groupBy("image_id", "plane").agg(F.max("white").alias("threshold_code"), (F.max("x") + 1).cast("long").alias("width"), (F.max("y") + 1).cast("long").alias("height"), F.sum("clip").alias("clipped"))
    return found.select("image_id", "plane", "threshold_code", F.lit("EstimatedEncodedMaximum").alias("provenance"), "width", "height", "clipped")


def regression(layers: DataFrame) -> DataFrame:
    """Slopes and intercepts of both lower planes on the 2x2 means of the top plane."""
    guide = stencil.downsample(layers.filter("plane = 2").select("image_id", "plane", "y", "x", "v", "influence", "noise"))
    guide = guide.select("image_id", "y", "x", F.col("v").alias("guide"), F.col("influence").alias("guided_by"), "noise")
    low = layers.filter("plane <> 2").select("image_id", "plane", "y", "x", F.col("v").alias("source"), F.col("influence").alias("own"))
    pairs = low.join(guide, ["image_id", "y", "x"]).withColumn("influence", F.col("own").bitwiseOR(F.col("guided_by")))
    return stencil.local_regression(pairs, "guide", "source", "noise")


def render(layers: DataFrame, camera: DataFrame, mode: str = "guided", geometry: dict = GEOMETRY) -> DataFrame:
    """(image_id, y, x, r, g, b, clip) inside the crop, from calibrated planes; clip tells where any sample that counts was clipped.

    mode is guided or bilinear. No mask is paid for where clip is not selected.
    """
    top, low = layers.filter("plane = 2"), layers.filter("plane <> 2")
    rows, columns = geometry[2]
    if mode == "guided":
        native = reconstruct_guided(top, regression(layers), rows, columns)
    elif mode == "bilinear":
        native = reconstruct_bilinear(top, low, rows, columns)
    else:
        raise ValueError("mode is guided or bilinear")
    cut = native.join(F.broadcast(camera.filter("error is null").select("image_id", "crop", "matrix")), "image_id")
    cut = cut.filter("y BETWEEN crop[1] AND crop[3] AND x BETWEEN crop[0] AND crop[2]")
    dot = lambda c: F.expr(f"matrix[{3 * c}] * v0 + matrix[{3 * c + 1}] * v1 + matrix[{3 * c + 2}] * v2")
    at = [F.expr("cast(y - crop[1] as bigint)").alias("y"), F.expr("cast(x - crop[0] as int)").alias("x")]
    return cut.select("image_id", *at, dot(0).alias("r"), dot(1).alias("g"), dot(2).alias("b"), "clip")


def render_errors(px: DataFrame, camera: DataFrame, sites: DataFrame, layers: DataFrame, geometry: dict = GEOMETRY) -> DataFrame:
    """(image_id, error) of the images that cannot be rendered: a calibration or a defect list with an error, another geometry, a black level at white, or a defect without a donor."""
    sizes = px.groupBy("image_id", "plane").agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("columns"))
    want = F.lit(None).cast("boolean")
    for plane, (rows, columns) in geometry.items():
        want = F.when(F.col("plane") == plane, (F.col("rows") == rows) & (F.col("columns") == columns)).otherwise(want)
    wrong = sizes.withColumn("ok", F.coalesce(want, F.lit(False))).groupBy("image_id").agg((F.bool_and("ok") & (F.count("*") == len(geometry))).alias("ok")).filter("NOT ok")
    dark = px.select("image_id", "plane").distinct().join(layers.select("image_id", "plane").distinct(), ["image_id", "plane"], "left_anti")
    parts = [camera.filter("error is not null").select("image_id", "error"), sites.filter("error is not null").select("image_id", "error")]
    parts += [wrong.select("image_id", F.lit("InvalidGeometry").alias("error")), dark.select("image_id", F.lit("InvalidContainer").alias("error")), stencil.unresolved(layers).select("image_id", F.lit("InvalidContainer").alias("error"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("image_id").agg(F.max("error").alias("error"))  # a wrong geometry is told before what follows from it


def projection(layers: DataFrame, geometry: dict = GEOMETRY) -> DataFrame:
    """(image_id, plane, y, x, v, bilinear, guided, causes): each lower sample against the mean of its four reconstructed places, by both modes.

    layers carry cause bits in `influence` (attribute_sources); causes is what any sample that counts brings along.
    """
    rows, columns = geometry[2]
    top = layers.filter("plane = 2").select("image_id", "y", "x", F.col("v").alias("t"), F.col("influence").alias("top_causes"))
    low = layers.filter("plane <> 2")
    plain = stencil.upsample(low, ["v"], rows, columns).select("image_id", "plane", "y", "x", F.col("v").alias("bilinear"), F.col("influence").alias("low_causes"))
    fitted = stencil.upsample(regression(layers), ["slope", "intercept"], rows, columns)
    both = plain.join(fitted, ["image_id", "plane", "y", "x"]).join(top, ["image_id", "y", "x"])
    both = both.withColumn("guided", F.col("slope") * F.col("t") + F.col("intercept")).withColumn("causes", F.col("top_causes").bitwiseOR(F.col("low_causes")).bitwiseOR(F.col("influence")))
    mean = both.groupBy("image_id", "plane", F.expr("y div 2").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.avg("bilinear").alias("bilinear"), F.avg("guided").alias("guided"), F.bit_or("causes").alias("causes"))
    return low.select("image_id", "plane", "y", "x", "v", "black", "white").join(mean, ["image_id", "plane", "y", "x"])


def measure_projection(projected: DataFrame, crop: Sequence[int]) -> DataFrame:
    """Residuals in codes of both modes, over the samples of the crop's interior without a cause, beside how many there are and are left out."""
    (y0, y1), (x0, x1) = stencil.native_interior(crop[1], crop[3]), stencil.native_interior(crop[0], crop[2])
    inside = projected.filter(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
    unit = stats.codes_per_unit(F.col("black"), F.expr("cast(round(log2(white + 1)) as int)"))
    residual = lambda c: F.when(F.col("causes") == 0, (F.col(c) - F.col("v")) * unit)
    keys = ["image_id", "plane"]
    counts = inside.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("causes") != 0).alias("excluded"))
    out = counts
    for mode in ("bilinear", "guided"):
        summary = stats.residual_summary(inside.select(*keys, residual(mode).alias("r")).filter("r is not null"), keys)
        out = out.join(summary.select(*keys, *[F.col(c).alias(f"{mode}_{c}") for c in ("n", "bias", "rms", "p95")]), keys, "left")
    return out


def rgba(px: DataFrame) -> DataFrame:
    """r, g, b and a constant alpha of one."""
    return px.withColumn("a", F.lit(1.0))
