"""Predictive coding as prefix sums over windows, and the differences that undo it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PLANE = ["image_id", "plane"]


def _running(*by: str, order: str):
    return Window.partitionBy(*_PLANE, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def parity_encode(px: DataFrame, seed: int, value: str = "code") -> DataFrame:
    """Differences of a plane under the 2x2 parity predictor: the same parity two to the left, or in the first two columns two above."""
    p = px.withColumn("ypar", F.col("y") % 2).withColumn("xpar", F.col("x") % 2)
    left = F.lag(value).over(Window.partitionBy(*_PLANE, "y", "xpar").orderBy("x"))
    above = F.lag(value).over(Window.partitionBy(*_PLANE, "x", "ypar").orderBy("y"))
    # only the first two columns look up, so only they go through the second window
    head = p.filter("x < 2").withColumn("d", F.col(value) - F.coalesce(above, F.lit(seed)))
    rest = p.withColumn("d", F.col(value) - left).filter("x >= 2")
    return head.select("image_id", "plane", "y", "x", "d").union(rest.select("image_id", "plane", "y", "x", "d"))


def parity_decode(diffs: DataFrame, seed: int) -> DataFrame:
    """Samples from parity differences: the first two columns add up down the plane, the others along the row."""
    p = diffs.withColumn("ypar", F.col("y") % 2).withColumn("xpar", F.col("x") % 2)
    head = p.filter("x < 2").withColumn("d", F.sum("d").over(_running("x", "ypar", order="y")))
    whole = head.union(p.filter("x >= 2"))
    code = F.lit(seed) + F.sum("d").over(_running("y", "xpar", order="x"))
    return whole.select("image_id", "plane", "y", "x", code.alias("code"))


def _segments(px: DataFrame, restart_rows: int | None) -> DataFrame:
    """seg numbers the restart interval of a row and ly the row within it."""
    if not restart_rows:
        return px.withColumn("seg", F.lit(0).cast("long")).withColumn("ly", F.col("y").cast("long"))
    return px.withColumn("seg", F.expr(f"y div {restart_rows}")).withColumn("ly", F.expr(f"cast(y % {restart_rows} as bigint)"))


def sof3_encode(px: DataFrame, kind: int, precision: int, point: int = 0, restart_rows: int | None = None) -> DataFrame:
    """Differences modulo 65,536 under lossless predictor 1 to 7, the first row from the left and the first column from above."""
    s = _segments(px, restart_rows).withColumn("v", F.expr(f"code div {1 << point}"))
    along, down = Window.partitionBy(*_PLANE, "y").orderBy("x"), Window.partitionBy(*_PLANE, "seg", "x").orderBy("ly")
    s = s.withColumn("a", F.lag("v").over(along)).withColumn("b", F.lag("v").over(down))
    s = s.withColumn("c", F.lag("b").over(along))
    general = {1: "a", 2: "b", 3: "c", 4: "a + b - c", 5: "a + shiftright(b - c, 1)", 6: "b + shiftright(a - c, 1)", 7: "shiftright(a + b, 1)"}[kind]
    guess = F.expr(f"CASE WHEN ly = 0 AND x = 0 THEN {1 << (precision - point - 1)}L WHEN ly = 0 THEN a WHEN x = 0 THEN b ELSE {general} END")
    return s.select("image_id", "plane", "y", "x", F.pmod(F.col("v") - guess, F.lit(65536)).alias("d"))


def sof3_decode(diffs: DataFrame, kind: int, precision: int, point: int = 0, restart_rows: int | None = None) -> DataFrame:
    """Samples from lossless differences for predictors 1 to 4, which are prefix sums modulo 65,536.

    1: down the first column, then along rows. 2: along the first row, then down columns. 3: along both borders, then
    down diagonals. 4: along both. Predictors 5 to 7 shift between additions and need the sequential decoder.
    """
    start = 1 << (precision - point - 1)
    s = _segments(diffs, restart_rows)
    row = _running("seg", "ly", order="x")
    column = _running("seg", "x", order="ly")
    if kind == 1:
        s = s.withColumn("c", F.when(F.col("x") == 0, F.sum("d").over(column)).otherwise(F.col("d")))
        v = F.sum("c").over(row)
    elif kind == 2:
        s = s.withColumn("c", F.when(F.col("ly") == 0, F.sum("d").over(row)).otherwise(F.col("d")))
        v = F.sum("c").over(column)
    elif kind == 3:
        s = s.withColumn("c", F.when(F.col("ly") == 0, F.sum("d").over(row)).when(F.col("x") == 0, F.sum("d").over(column)).otherwise(F.col("d")))
        s = s.withColumn("diagonal", F.col("ly") - F.col("x"))
        v = F.sum("c").over(_running("seg", "diagonal", order="ly"))
    elif kind == 4:
        s = s.withColumn("c", F.sum("d").over(row))
        v = F.sum("c").over(column)
    else:
        raise ValueError("predictors 5 to 7 are decoded sequentially")
    return s.select("image_id", "plane", "y", "x", (F.pmod(v + start, F.lit(65536)) * (1 << point)).alias("code"))


def prefix_bytes(diffs: DataFrame, keys: list[str], seed: int, order: str = "i") -> DataFrame:
    """The low byte of a running sum of differences, within each key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return diffs.withColumn("byte", F.pmod(F.lit(seed) + F.sum("d").over(w), F.lit(256)))
