"""Linearization, black and white levels, normalization and sample flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT_OF_CODES, SATURATED, OUTSIDE, CORRECTED = 1, 2, 4, 8


def linearize(value: Column, lut: Column | None) -> Column:
    """Table lookup at round(max(value, 0)), beyond the table its last entry; without a table the value itself."""
    if lut is None:
        return value.cast("double")
    place = F.least(F.round(F.greatest(value, F.lit(0))).cast("int"), F.size(lut) - 1)
    return F.element_at(lut, place + 1).cast("double")


@dataclass(frozen=True)
class Levels:
    """Black levels that repeat over rows and columns, with deltas for each column and row of the active area.

    black is (repeat_rows, repeat_columns, channels) flat; area is [top, left, bottom, right), half open.
    """

    repeat: tuple[int, int]
    channels: int
    black: Sequence[float]
    area: tuple[int, int, int, int]
    white: Sequence[float]
    delta_h: Sequence[float] | None = None
    delta_v: Sequence[float] | None = None

    def _deltas(self, values: Sequence[float] | None, size: int) -> Sequence[float]:
        return values if values is not None else [0.0] * size

    def denominators(self) -> list[float]:
        """White less the greatest black of any repeat phase, for each channel."""
        rows, columns = self.repeat
        top, left, bottom, right = self.area
        h, v = self._deltas(self.delta_h, right - left), self._deltas(self.delta_v, bottom - top)
        worst = lambda values, start, step: max(values[start::step], default=float("-inf"))
        out = []
        for c in range(self.channels):
            most = max(
                self.black[(r * columns + k) * self.channels + c] + worst(h, k, columns) + worst(v, r, rows) for r in range(rows) for k in range(columns)
            )
            out.append(self.white[c] - most)
        if any(not 0 < d < float("inf") for d in out):
            raise ValueError("white level not above black")
        return out


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def base_black(levels: Levels, row: Column, column: Column, channel: Column) -> Column:
    rows, columns = levels.repeat
    place = ((row % rows) * columns + column % columns) * levels.channels + channel
    return F.element_at(_array(levels.black), place.cast("int") + 1)


def black_at(levels: Levels) -> Column:
    """The black level at (y, x, channel); outside the active area that of the nearest sample inside."""
    top, left, bottom, right = levels.area
    row = F.greatest(F.lit(top), F.least(F.col("y"), F.lit(bottom - 1))) - top
    column = F.greatest(F.lit(left), F.least(F.col("x"), F.lit(right - 1))) - left
    black = base_black(levels, row, column, F.col("channel"))
    if levels.delta_h is not None:
        black = black + F.element_at(_array(levels.delta_h), column.cast("int") + 1)
    if levels.delta_v is not None:
        black = black + F.element_at(_array(levels.delta_v), row.cast("int") + 1)
    return black


def normalize(px: DataFrame, levels: Levels, lut: Column | None = None) -> DataFrame:
    """px (y, x, channel, code) with v, the code's unclamped place between black and white."""
    denominator = F.element_at(_array(levels.denominators()), F.col("channel") + 1)
    return px.withColumn("v", (linearize(F.col("code"), lut) - black_at(levels)) / denominator)


def flags(px: DataFrame, levels: Levels, depth: int, lut: Column | None = None) -> DataFrame:
    """px with flags: 1 greatest code, 2 at or above white, 4 outside the active area."""
    top, left, bottom, right = levels.area
    white = F.element_at(_array(levels.white), F.col("channel") + 1)
    bit = lambda test, value: F.when(test, value).otherwise(0)
    outside = ~(F.col("y").between(top, bottom - 1) & F.col("x").between(left, right - 1))
    found = bit(F.col("code") >= (1 << depth) - 1, OUT_OF_CODES) + bit(linearize(F.col("code"), lut) >= white, SATURATED) + bit(outside, OUTSIDE)
    return px.withColumn("flags", found)


def black_white(px: DataFrame, levels: DataFrame, depth: int) -> DataFrame:
    """px with v = (code - black) / (greatest code - black), black from a row for each image and plane."""
    small = F.broadcast(levels.select("image_id", "plane", "black"))  # one row a plane, after an aggregation
    v = (F.col("code") - F.col("black")) / (F.lit((1 << depth) - 1) - F.col("black"))
    return px.join(small, ["image_id", "plane"]).withColumn("v", v).drop("black")
