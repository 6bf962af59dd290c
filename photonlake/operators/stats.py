"""Aggregations over samples: plane statistics, black level, residual summaries, cause counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plane_stats(px: DataFrame) -> DataFrame:
    """Size, sum, least and greatest code of each plane."""
    return px.groupBy("image_id", "plane").agg(
        (F.max("x") + 1).cast("long").alias("width"),
        (F.max("y") + 1).cast("long").alias("height"),
        F.sum("code").alias("sum"),
        F.min("code").alias("min"),
        F.max("code").alias("max"),
    )


def code_histogram(px: DataFrame, columns: Sequence[tuple[int, int]]) -> DataFrame:
    """(image_id, plane, code, n) over inclusive column ranges: a partial aggregation in each task, one row per code after."""
    inside = F.lit(False)
    for first, last in columns:
        inside = inside | F.col("x").between(first, last)
    return px.filter(inside).groupBy("image_id", "plane", "code").agg(F.count("*").alias("n"))


def black_level(histogram: DataFrame, noise_range: int = 64) -> DataFrame:
    """(image_id, plane, black, noise_variance): the upper median of a histogram, and the mean square about it within noise_range.

    The window runs over codes, 65,536 rows a plane at most, not over samples.
    """
    key = ["image_id", "plane"]
    running = F.sum("n").over(Window.partitionBy(*key).orderBy("code"))
    total = F.sum("n").over(Window.partitionBy(*key))
    ranked = histogram.withColumn("cum", running).withColumn("total", total)
    median = ranked.filter(F.col("cum") > F.expr("total div 2")).groupBy(*key).agg(F.min("code").alias("black"))
    near = histogram.join(median, key).withColumn("d", F.col("code") - F.col("black")).filter(F.abs("d") <= noise_range)
    return near.groupBy(*key, "black").agg((F.sum(F.col("d") * F.col("d") * F.col("n")) / F.sum("n")).alias("noise_variance"))


def residual_summary(residuals: DataFrame, keys: Sequence[str], value: str = "r") -> DataFrame:
    """Count, bias, RMS and nearest-rank 95th percentile of the absolute residual."""
    return residuals.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("bias"),
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY abs({value}))").alias("p95"),
    )


def cause_counts(px: DataFrame, keys: Sequence[str], causes: str = "causes") -> DataFrame:
    """The histogram of exact cause combinations with, for each, whether it excludes a sample and how many causes meet."""
    counts = px.groupBy(*keys, causes).agg(F.count("*").alias("n"))
    return counts.withColumn("excluded", F.col(causes) != 0).withColumn("n_causes", F.bit_count(causes))


def cause_marginals(px: DataFrame, keys: Sequence[str], bits: dict[str, int], causes: str = "causes") -> DataFrame:
    """Samples excluded, holding each cause, and holding more than one."""
    has = lambda bit: F.count_if(F.col(causes).bitwiseAND(F.lit(bit)) != 0)
    return px.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(causes) != 0).alias("excluded"),
        *[has(bit).alias(name) for name, bit in bits.items()],
        F.count_if(F.bit_count(causes) > 1).alias("overlapping"),
    )


def codes_per_unit(black: Column, depth: Column | int) -> Column:
    """Codes between black and the greatest code."""
    greatest = F.lit((1 << depth) - 1) if isinstance(depth, int) else F.call_function("shiftleft", F.lit(1), depth) - 1
    return greatest - black


def fnv1a(samples: str) -> Column:
    """The FNV-1a checksum (hex) of an array<float> column's bits, little-endian; it depends on the order, so one array is one task's work."""

    @F.pandas_udf("string")
    def checksum(rows: pd.Series) -> pd.Series:
        data = [np.asarray(r, "<f4").view(np.uint8) for r in rows]
        out = np.full(len(data), 0xCBF29CE484222325, np.uint64)
        sizes = np.array([len(r) for r in data])
        for i in range(int(sizes.max(initial=0))):  # all rows a byte further
            on = np.flatnonzero(sizes > i)
            out[on] = (out[on] ^ np.array([data[k][i] for k in on], np.uint64)) * np.uint64(0x100000001B3)
        return pd.Series([f"{h:016x}" for h in out.tolist()])

    return checksum(samples)
