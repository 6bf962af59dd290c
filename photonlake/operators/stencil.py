"""Neighbourhood operators: defect maps, repair, resampling and local regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAD, AUTOFOCUS, ENCODED_MAX, CLIPPED_DONOR = 1, 2, 4, 8
REPAIR_RADIUS = 8
# Fixed values of the sd Quattro: autofocus sites of the top plane and of the two others, as (x0, x1, dx, y0, y1, dy, rows).
AUTOFOCUS_GRIDS = {"top": (217, 5641, 16, 464, 3312, 32, 2), "low": (108, 2820, 8, 232, 1656, 16, 1)}


def run_list_defects(table: Sequence[int], height: int, width: int) -> list[tuple[int, int]]:
    """(y, x) of a bad-pixel run list: a row, then pairs of column and descriptor up to a zero column, again and again."""
    found, i = [], 0
    while i < len(table):
        y, i = table[i], i + 1
        while i < len(table) and table[i]:
            if table[i] < width and y < height:
                found.append((y, table[i]))
            i += 2
        i += 1
    return found


def mark_sites(px: DataFrame, sites: DataFrame, bit: int, causes: str = "causes") -> DataFrame:
    """px with `bit` set in causes at sites (image_id, plane, y, x)."""
    at = sites.select("image_id", "plane", F.col("y").cast("long").alias("y"), F.col("x").cast("int").alias("x")).distinct().withColumn("hit", F.lit(bit))
    joined = px.join(at, ["image_id", "plane", "y", "x"], "left")
    old = F.col(causes) if causes in px.columns else F.lit(0)
    return joined.withColumn(causes, old.bitwiseOR(F.coalesce("hit", F.lit(0)))).drop("hit")


def grid_sites(x0: int, x1: int, dx: int, y0: int, y1: int, dy: int, rows: int = 1):
    """A predicate for a regular grid of sites: no join is needed."""
    x, y = F.col("x"), F.col("y")
    in_rows = F.lit(False)
    for k in range(rows):
        in_rows = in_rows | ((y - (y0 + k)) % dy == 0) & y.between(y0 + k, y1 + k)
    return x.between(x0, x1) & ((x - x0) % dx == 0) & in_rows


def checked_run_list(table: Sequence[float], height: int, width: int) -> list[tuple[int, int]]:
    """run_list_defects of a table that must be whole, in range and properly ended; ValueError if not."""
    at = 0
    while at < len(table):
        if table[at] != int(table[at]) or not 0 <= table[at] < height:
            raise ValueError("invalid bad-pixel row")
        at += 1
        while True:
            if at >= len(table):
                raise ValueError("truncated bad-pixel list")
            if table[at] == 0:
                break
            if table[at] != int(table[at]) or not 0 <= table[at] < width or at + 1 >= len(table):
                raise ValueError("invalid bad-pixel column")
            at += 2
        at += 1
    return run_list_defects([int(v) for v in table], height, width)


def autofocus(grids: dict[str, tuple[int, ...]] = AUTOFOCUS_GRIDS):
    """AUTOFOCUS at the sites of a plane's grid, else 0: a predicate on plane, y and x."""
    top, low = (grid_sites(*grids[k]) for k in ("top", "low"))
    return F.when(F.when(F.col("plane") == 2, top).otherwise(low), AUTOFOCUS).otherwise(0)


def attribute_sources(px: DataFrame) -> DataFrame:
    """px (causes, clip, influence after repair) with influence as cause bits: the defects, 4 if clipped, 8 for a repaired sample with a clipped donor."""
    clipped = F.when(F.col("clip") != 0, ENCODED_MAX).otherwise(0)
    donor = F.when((F.col("causes") != 0) & (F.col("influence") != 0), CLIPPED_DONOR).otherwise(0)
    return px.withColumn("influence", F.col("causes").bitwiseOR(clipped).bitwiseOR(donor))


def native_interior(first: int, last: int) -> tuple[int, int]:
    """The half-size places [start, end) of a crop first..last whose regression windows and supports lie inside."""
    start, end = -(-first // 2) + 3, -(-last // 2) - 3
    if start >= end:
        raise ValueError("crop too narrow")
    return start, end


def unresolved(px: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, plane, n): repaired planes with samples that no donor within the radius could fill, which is an error of the image."""
    return px.filter((F.col("causes") != 0) & F.col(value).isNull()).groupBy("image_id", "plane").agg(F.count("*").alias("n"))


def repair(px: DataFrame, value: str = "v", radius: int = REPAIR_RADIUS) -> DataFrame:
    """px (.., value, causes, clip) with each marked sample replaced by the inverse-square-distance mean of unmarked ones.

    Donors come from the smallest square ring up to `radius` that has any; all updates read the originals. Only marked
    samples are spread to their neighbourhood, ring by ring, so the join has (2 r + 1)^2 rows for each marked sample left, not
    for each pixel. influence is 1 where a donor, or the sample itself if unmarked, was clipped.
    """
    key = ["image_id", "plane", "y", "x"]
    marked = px.filter("causes <> 0").select(*key)
    donors = px.filter("causes = 0").select("image_id", "plane", F.col("y").alias("dy"), F.col("x").alias("dx"), F.col(value).alias("dv"), F.col("clip").alias("dclip"))
    offsets = f"flatten(transform(sequence(-{radius}, {radius}), i -> transform(sequence(-{radius}, {radius}), j -> named_struct('i', i, 'j', j))))"
    spread = marked.select(*key, F.explode(F.expr(f"filter({offsets}, o -> o.i <> 0 or o.j <> 0)")).alias("o"))
    spread = spread.select(*key, (F.col("y") + F.col("o.i")).alias("dy"), (F.col("x") + F.col("o.j")).cast("int").alias("dx"), F.expr("greatest(abs(o.i), abs(o.j))").alias("ring"), F.expr("1.0D / (o.i * o.i + o.j * o.j)").alias("w"))
    met = spread.join(donors, ["image_id", "plane", "dy", "dx"])
    rings = met.groupBy(*key, "ring").agg(F.sum(F.col("w") * F.col("dv")).alias("s"), F.sum("w").alias("w"), F.max("dclip").alias("c"))
    best = rings.groupBy(*key).agg(F.min_by(F.struct((F.col("s") / F.col("w")).alias("v"), "c"), "ring").alias("best"))
    joined = px.join(best, key, "left")
    new = F.when(F.col("causes") != 0, F.col("best.v")).otherwise(F.col(value))
    influence = F.when(F.col("causes") != 0, F.col("best.c")).otherwise(F.col("clip"))
    return joined.withColumn(value, new).withColumn("influence", influence).drop("best")


def downsample(px: DataFrame, value: str = "v") -> DataFrame:
    """2x2 means with the influence of any of the four; a column `noise`, the variance of a sample, becomes that of a mean."""
    more = [(F.max("noise") / 4).alias("noise")] if "noise" in px.columns else []
    return px.groupBy("image_id", "plane", F.expr("y div 2").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.avg(value).alias(value), F.bit_or("influence").alias("influence"), *more)


def local_regression(px: DataFrame, guide: str, source: str, noise: float | str, radius: int = 2) -> DataFrame:
    """slope and intercept of source on guide in a square window cut off at the borders, and the influence in it.

    The moments are separable: sums along x, then along y. Integer inputs keep them exact, so the order of addition
    does not matter. noise is the variance of the guide, a number or a column that is constant in a plane.
    """
    g, s = F.col(guide), F.col(source)
    terms = {"n": F.lit(1).cast("long"), "sg": g, "ss": s, "sgg": g * g, "sgs": g * s, "inf": F.col("influence"), "noise": F.col(noise) if isinstance(noise, str) else F.lit(float(noise))}
    along = Window.partitionBy("image_id", "plane", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy("image_id", "plane", "x").orderBy("y").rangeBetween(-radius, radius)
    total = lambda name, w: F.bit_or(name).over(w) if name == "inf" else F.max(name).over(w) if name == "noise" else F.sum(name).over(w)
    rows = px.select("image_id", "plane", "y", "x", *[t.alias(k) for k, t in terms.items()])
    rows = rows.select("image_id", "plane", "y", "x", *[total(k, along).alias(k) for k in terms])
    box = rows.select("image_id", "plane", "y", "x", *[total(k, down).alias(k) for k in terms])
    n = F.col("n").cast("double")
    mean_g, mean_s = F.col("sg") / n, F.col("ss") / n
    variance = F.greatest(F.col("sgg") / n - mean_g * mean_g, F.lit(0.0)) + F.greatest(F.col("noise"), F.lit(1e-10))
    slope = (F.col("sgs") / n - mean_g * mean_s) / variance
    return box.select("image_id", "plane", "y", "x", F.col("n").cast("long").alias("n"), slope.alias("slope"), (mean_s - slope * mean_g).alias("intercept"), F.col("inf").alias("influence"))


def upsample(px: DataFrame, values: Sequence[str], height: int, width: int) -> DataFrame:
    """Bilinear 2x upsampling of columns `values` (and influence) at half-pixel alignment, of a plane without gaps.

    A fine sample takes three quarters of its own coarse one and a quarter of the neighbour on its side, first along rows,
    then along columns. Beyond a border the border sample counts again.
    """
    last = {"y": height // 2 - 1, "x": width // 2 - 1}
    names = [*values, "influence"]

    def doubled(df: DataFrame, axis: str, other: str) -> DataFrame:
        line = Window.partitionBy("image_id", "plane", other).orderBy(axis)
        side = lambda f, c: F.coalesce(f(c).over(line), F.col(c))
        half = lambda f: F.struct(*[(F.col(c) * 0.75 + side(f, c) * 0.25).alias(c) for c in values], F.col("influence").bitwiseOR(side(f, "influence")).alias("influence"))
        halves = df.select("image_id", "plane", other, axis, F.array(half(F.lag), half(F.lead)).alias("halves"))
        wide = halves.select("image_id", "plane", other, axis, F.posexplode("halves").alias("half", "s"))
        place = (F.col(axis) * 2 + F.col("half")).cast("long" if axis == "y" else "int")
        return wide.select("image_id", "plane", F.col(other), place.alias(axis), *[F.col(f"s.{c}").alias(c) for c in names])

    inside = px.select("image_id", "plane", "y", "x", *names).filter((F.col("y") <= last["y"]) & (F.col("x") <= last["x"]))
    return doubled(doubled(inside, "x", "y"), "y", "x").select("image_id", "plane", "y", "x", *names)
