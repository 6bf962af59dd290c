"""Correction opcodes as projections, folded in list order into one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGE_CODES, STAGE_LINEAR = 1, 2


@dataclass(frozen=True)
class Area:
    """[top, left, bottom, right) with pitches and planes; all zero bounds mean the whole stage."""

    bounds: tuple[int, int, int, int] = (0, 0, 0, 0)
    plane: int = 0
    planes: int = 3
    pitch: tuple[int, int] = (1, 1)

    def resolved(self, stage: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        return stage if self.bounds == (0, 0, 0, 0) else self.bounds

    def covers(self, stage: tuple[int, int, int, int]) -> Column:
        top, left, bottom, right = self.resolved(stage)
        s_top, s_left, s_bottom, s_right = stage
        y, x, c = F.col("y"), F.col("x"), F.col("channel")
        inside = y.between(max(top, s_top), min(bottom, s_bottom) - 1) & x.between(max(left, s_left), min(right, s_right) - 1)
        pitched = ((y - top) % self.pitch[0] == 0) & ((x - left) % self.pitch[1] == 0)
        return inside & pitched & c.between(self.plane, self.plane + self.planes - 1)


@dataclass(frozen=True)
class Opcode:
    """kind: trim, table, polynomial, gain_map, row_delta, column_delta, row_scale or column_scale."""

    kind: str
    area: Area = field(default_factory=Area)
    params: Sequence[float] = ()
    grid: dict | None = None


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _clamp(v: Column, scale: float) -> Column:
    return F.greatest(F.lit(-scale), F.least(F.lit(scale), v))


def grid_gain(grid: dict, stage: tuple[int, int, int, int]) -> Column:
    """Bilinear gain at a pixel's centre; grid has rows, columns, spacing, origin, planes and flat gains [row, column, plane]."""
    top, left, bottom, right = stage
    rows, columns, planes = grid["rows"], grid["columns"], grid["planes"]

    def axis(place: Column, first: int, last: int, k: int, points: int) -> tuple[Column, Column, Column]:
        at = ((place - first + 0.5) / (last - first) - grid["origin"][k]) / grid["spacing"][k] if points > 1 else F.lit(0.0)
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(points - 1)), at))
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.lit(points - 1)), at - low

    r0, r1, fr = axis(F.col("y"), top, bottom, 0, rows)
    c0, c1, fc = axis(F.col("x"), left, right, 1, columns)
    p = F.least(F.col("channel"), F.lit(planes - 1))
    gains = _array(grid["gains"])
    at = lambda r, c: F.element_at(gains, (r * columns + c) * planes + p + 1)
    upper = at(r0, c0) * (1 - fc) + at(r0, c1) * fc
    lower = at(r1, c0) * (1 - fc) + at(r1, c1) * fc
    return upper * (1 - fr) + lower * fr


def mapped(op: Opcode, v: Column, stage: tuple[int, int, int, int], step: int) -> Column:
    """The new value of a sample that the opcode covers."""
    scale = 65535.0 if step == STAGE_CODES else 1.0
    top, left, _, _ = op.area.resolved(stage)
    if op.kind == "table":
        table = _array(op.params)
        unit = 1.0 if step == STAGE_CODES else 65535.0
        place = F.least(F.round(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), v * unit))).cast("int"), F.lit(len(op.params) - 1))
        return F.element_at(table, place + 1) / unit
    if op.kind == "polynomial":
        c = [float(x) for x in op.params]
        size = F.abs(v)
        powers = reduce(lambda acc, k: acc * size + k, reversed(c[1:]), F.lit(0.0)) * size
        return _clamp(F.lit(c[0]) + F.signum(v) * powers, scale)
    if op.kind == "gain_map":
        return F.least(v * grid_gain(op.grid, stage), F.lit(scale))
    row, column = F.expr(f"cast((y - {top}) div {op.area.pitch[0]} as int)"), F.expr(f"cast((x - {left}) div {op.area.pitch[1]} as int)")
    factor = F.element_at(_array(op.params), (row if op.kind.startswith("row") else column) + 1)
    return _clamp(v + factor if op.kind.endswith("delta") else v * factor, scale)


def apply_list(px: DataFrame, ops: Sequence[Opcode], stage: tuple[int, int, int, int], step: int = STAGE_LINEAR, value: str = "v") -> tuple[DataFrame, tuple[int, int, int, int]]:
    """px (y, x, channel, value) after every opcode in order, and the bounds that trims leave.

    The loop runs over the opcodes of a list on the driver; it builds one projection and touches no data.
    """
    for op in ops:
        if op.kind == "trim":
            t, left, b, r = op.area.bounds
            if t < stage[0] or left < stage[1] or b > stage[2] or r > stage[3] or t >= b or left >= r:
                raise ValueError("a trim may only shrink the image")
            stage = op.area.bounds
            continue
        new = mapped(op, F.col(value).cast("double"), stage, step)
        if step == STAGE_CODES:
            new = F.round(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), new)))
        px = px.withColumn(value, F.when(op.area.covers(stage), new).otherwise(F.col(value).cast("double")))
    return px, stage


def inside(px: DataFrame, bounds: tuple[int, int, int, int]) -> DataFrame:
    """The samples within bounds."""
    return px.filter(F.col("y").between(bounds[0], bounds[2] - 1) & F.col("x").between(bounds[1], bounds[3] - 1))


def processing(n_ops: int, n_skipped: int) -> str:
    """The state of an applied list: NotPresent, Applied, SkippedOptional or PartiallyApplied."""
    if not n_ops:
        return "NotPresent"
    return "Applied" if not n_skipped else "SkippedOptional" if n_skipped == n_ops else "PartiallyApplied"


def profile_gain(r: Column, g: Column, b: Column, exposure: float, table: dict, row: Column, column: Column) -> Column:
    """Trilinear gain of a profile gain table at relative image coordinates.

    table has points (rows, columns, n), spacing, origin, weights (5), gamma and flat gains [row, column, n]. The third
    axis is the weighted colour, brought to 0..1 and its gamma, times n; its lower point is at most n - 1.
    """
    rows, columns, n = table["points"]
    w = [float(x) for x in table["weights"]]
    level = (r * w[0] + g * w[1] + b * w[2] + F.least(r, g, b) * w[3] + F.greatest(r, g, b) * w[4]) * exposure
    third = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), level)), F.lit(float(table["gamma"]))) * n
    gains = _array(table["gains"])

    def axis(at: Column, points: int) -> tuple[Column, Column, Column]:
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(points - 1)), at))
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.lit(points - 1)), at - low

    r0, r1, fr = axis((row - table["origin"][0]) / table["spacing"][0], rows)
    c0, c1, fc = axis((column - table["origin"][1]) / table["spacing"][1], columns)
    n0 = F.least(F.floor(third).cast("int"), F.lit(n - 1))
    n1, fn = F.least(n0 + 1, F.lit(n - 1)), third - n0
    at = lambda i, j, k: F.element_at(gains, (i * columns + j) * n + k + 1)
    line = lambda i, j: at(i, j, n0) * (1 - fn) + at(i, j, n1) * fn
    return (line(r0, c0) * (1 - fc) + line(r0, c1) * fc) * (1 - fr) + (line(r1, c0) * (1 - fc) + line(r1, c1) * fc) * fr
