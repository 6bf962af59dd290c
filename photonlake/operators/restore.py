"""The restoration model of the diagnostics: colour from coarse samples weighted by place and likeness, and a gain that brings fine detail back."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIXELS = 32 << 20
# Fixed values of the model.
EXPONENT, COLOR_EPSILON = 0.4166666567325592, 1e-4
LEFT, TOP, RIGHT, BOTTOM = 5, 5, 5, 4  # margins without a full neighbourhood


def check(height: int, width: int, k: float, beta: float) -> None:
    """ValueError for a size or a parameter that the model does not take."""
    if min(height, width) < 10 or height % 2 or width % 2 or height * width > MAX_PIXELS:
        raise ValueError("invalid restore geometry")
    if not isfinite(k) or k <= 0 or not 0 <= beta <= 1:
        raise ValueError("invalid restore parameters")


def weighting(most: Column, transformed: bool, adaptive: bool) -> tuple[Column, Column]:
    """How fast weights fall with distance, and the difference at which they halve, by the greatest guide value."""
    if transformed:
        return F.lit(1.0), F.lit(25.0)
    if not adaptive:
        return F.lit(1.0), F.when(most <= 1000, 25.0).otherwise(most * 25.0 / 1000.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (most - 1000) / 9000))
    return t * 3 + (1 - t), (1 - t) * 25 + t * 1000


def transformed_value(value: Column, k: float) -> Column:
    return F.pow(value / k, F.lit(EXPONENT)) * k


def detail_ratio(fine: Column, blue: Column, k: float, transformed: bool) -> Column:
    """The fine sample over the reference's, by the transformed values if asked; one where the reference is not positive."""
    above = F.greatest(fine, F.lit(0.0))
    ratio = (transformed_value(above, k) + 5) / (transformed_value(F.greatest(blue, F.lit(0.0)), k) + 5) if transformed else (above + 5) / (blue + 5)
    ratio = F.when(blue <= 0, F.lit(1.0)).otherwise(ratio)
    if transformed:
        return ratio
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (fine - 11000) / 3000))
    return F.when((fine < 11000) | (ratio >= 1), ratio).otherwise(1 + (1 - t) * (ratio - 1))


def reciprocal_symmetric(ratio: Column, strength: Column) -> Column:
    return F.when(ratio > 1, 1 + strength * (ratio - 1)).otherwise(1 / (1 + strength * (1 / ratio - 1)))


def quantize(value: Column, k: float, transformed: bool) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(65535.0), value))
    rounded = (transformed_value(clamped, k) if transformed else clamped) + 0.5
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), rounded))).cast("int")


def restore(fine: DataFrame, coarse: DataFrame, height: int, width: int, k: float, beta: float, transformed: bool = False, adaptive: bool = False) -> DataFrame:
    """(image_id, y, x, r, g, b, gain): fine has (image_id, y, x, g0, g1, g2, f), coarse at half size (image_id, y, x, r0 to r2, c0 to c2).

    Each coarse sample goes to the 25 places around it, where the neighbourhoods meet as arrays; a fine sample reads the one of its
    place, so no row is made for each of its neighbours. In the margins colours are zero and the gain is f.
    """
    check(height, width, k, beta)
    offsets = F.expr("flatten(transform(sequence(0, 4), i -> transform(sequence(0, 4), j -> named_struct('i', i, 'j', j))))")
    spread = coarse.select("image_id", "y", "x", *[f"{n}{c}" for n in "rc" for c in range(3)], F.explode(offsets).alias("o"))
    entry = F.struct("o.i", "o.j", *[f"{n}{c}" for n in "rc" for c in range(3)])
    around = spread.groupBy("image_id", (F.col("y") + 2 - F.col("o.i")).cast("long").alias("cy"), (F.col("x") + 2 - F.col("o.j")).cast("int").alias("cx")).agg(F.array_sort(F.collect_list(entry)).alias("near"))
    placed = fine.withColumn("cy", F.expr("y div 2").cast("long")).withColumn("cx", F.expr("cast(x div 2 as int)"))
    both = placed.join(around, ["image_id", "cy", "cx"], "left")
    a, tau = weighting(F.greatest("g0", "g1", "g2").cast("double"), transformed, adaptive)
    both = both.withColumn("a", a).withColumn("tau", tau)
    far = "sqrt(pow(1.75D - s.j + (x % 2) * 0.5D, 2) + pow(1.75D - s.i + (y % 2) * 0.5D, 2))"
    weight = f"exp(-a * {far}) / (1 + (abs(s.r0 - g0) + abs(s.r1 - g1) + abs(s.r2 - g2)) / tau)"
    weighted = f"transform(near, s -> named_struct('w', {weight}, 'c0', s.c0, 'c1', s.c1, 'c2', s.c2, 'b', s.r2))"
    both = both.withColumn("weighted", F.expr(weighted))
    total = lambda term: F.expr(f"aggregate(weighted, 0D, (m, s) -> m + {term})")
    own = F.expr("filter(near, s -> s.i = 2 AND s.j = 2)[0]")
    both = both.withColumns({"w": total("s.w"), "own": own} | {c: total(f"s.w * s.{c}") for c in ("c0", "c1", "c2", "b")})
    ratio = detail_ratio(F.col("f"), F.col("b") / F.col("w"), k, transformed)
    chroma = (F.col("own.r0") + F.col("own.r1") - 2 * F.col("own.r2")) / F.greatest(F.col("own.r2"), F.lit(COLOR_EPSILON))
    strength = 1 - beta / (F.exp(7 - 4 * chroma) + 1)
    gain = F.greatest(F.lit(0.001), F.least(F.lit(1000.0), reciprocal_symmetric(ratio, strength)))
    inside = F.col("y").between(TOP, height - BOTTOM - 1) & F.col("x").between(LEFT, width - RIGHT - 1)
    colours = [F.when(inside, quantize(F.col(f"c{c}") / F.col("w"), k, transformed)).otherwise(0).alias(n) for c, n in enumerate("rgb")]
    return both.select("image_id", "y", "x", *colours, F.when(inside, gain).otherwise(F.col("f")).alias("gain"))
