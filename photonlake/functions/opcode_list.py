"""Opcode lists and profile gain tables from bytes, and opcodes over numpy images."""

from __future__ import annotations

import struct
from math import isfinite

import numpy as np

from photonlake.operators.opcodes import STAGE_CODES, Area, Opcode
from photonlake.sources.errors import DecodeError

MAX_OPS, NEWEST = 256, 0x01070100
# Opcode numbers.
TRIM, TABLE, POLYNOMIAL, GAIN_MAP = 6, 7, 8, 9
VECTORS = {10: "row_delta", 11: "column_delta", 12: "row_scale", 13: "column_scale"}


class _Cursor:
    """Big-endian values in order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DecodeError("Truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def many(self, code: str, n: int) -> tuple:
        values = struct.unpack(f">{n}{code}", self.take(n * struct.calcsize(code)))
        if not all(isfinite(v) for v in values):
            raise DecodeError("InvalidTag")
        return values

    def one(self, code: str):
        return self.many(code, 1)[0]

    def end(self) -> None:
        if self.at != len(self.data):
            raise DecodeError("InvalidTag")


def _bounds(c: _Cursor) -> tuple[int, int, int, int]:
    found = c.many("I", 4)
    if max(found) > 0x7FFFFFFF:
        raise DecodeError("InvalidTag")
    return found


def _area(c: _Cursor) -> Area:
    bounds = _bounds(c)
    plane, planes, dy, dx = c.many("I", 4)
    empty = bounds[0] == bounds[2] or bounds[1] == bounds[3]
    if empty and (bounds != (0, 0, 0, 0) or (dy, dx) != (1, 1)):
        raise DecodeError("UnsupportedFeature")
    if bounds[0] > bounds[2] or bounds[1] > bounds[3] or not dy or not dx or not planes or plane + planes > 3:
        raise DecodeError("InvalidTag")
    return Area(bounds, plane, planes, (dy, dx))


def _operation(ident: int, payload: bytes) -> Opcode:
    c = _Cursor(payload)
    if ident == TRIM:
        bounds = _bounds(c)
        if bounds[0] >= bounds[2] or bounds[1] >= bounds[3]:
            raise DecodeError("InvalidGeometry")
        op = Opcode("trim", Area(bounds))
    elif ident == TABLE:
        area, n = _area(c), c.one("I")
        if not 1 <= n <= 65536:
            raise DecodeError("InvalidTag")
        op = Opcode("table", area, c.many("H", n))
    elif ident == POLYNOMIAL:
        area, degree = _area(c), c.one("I")
        if degree > 8:
            raise DecodeError("UnsupportedFeature")
        op = Opcode("polynomial", area, c.many("d", degree + 1))
    elif ident == GAIN_MAP:
        area = _area(c)
        rows, columns = c.many("I", 2)
        spacing, origin, planes = c.many("d", 2), c.many("d", 2), c.one("I")
        if not rows or not columns or min(spacing) <= 0 or not 1 <= planes <= 3:
            raise DecodeError("InvalidTag")
        gains = c.many("f", rows * columns * planes)
        if min(gains) < 0:
            raise DecodeError("InvalidTag")
        op = Opcode("gain_map", area, (), {"rows": rows, "columns": columns, "planes": planes, "spacing": spacing, "origin": origin, "gains": gains})
    elif ident in VECTORS:
        area, n = _area(c), c.one("I")
        axis = ident % 2
        if not n or n != -(-(area.bounds[axis + 2] - area.bounds[axis]) // area.pitch[axis]):
            raise DecodeError("InvalidTag")
        op = Opcode(VECTORS[ident], area, c.many("f", n))
    else:
        raise DecodeError("UnsupportedFeature")
    c.end()
    return op


def parse(data: bytes) -> tuple[list[Opcode], int]:
    """(operations in order, number of optional ones skipped) of an opcode list."""
    c = _Cursor(data)
    count = c.one("I")
    if count > MAX_OPS:
        raise DecodeError("ResourceLimit")
    ops, skipped = [], 0
    for _ in range(count):
        ident, version, flags, length = c.many("I", 4)
        payload = c.take(length)
        if flags & ~3:
            raise DecodeError("UnsupportedFeature")
        try:
            if version > NEWEST:
                raise DecodeError("UnsupportedFeature")
            ops.append(_operation(ident, payload))
        except DecodeError as e:
            if e.kind != "UnsupportedFeature" or not flags & 1:
                raise
            skipped += 1
    c.end()
    return ops, skipped


def _round(v: np.ndarray) -> np.ndarray:
    """Half away from zero."""
    return np.copysign(np.floor(np.abs(v) + 0.5), v)


def _gain_at(grid: dict, bounds: tuple[int, int, int, int], rows: np.ndarray, columns: np.ndarray, channels: np.ndarray) -> np.ndarray:
    def axis(at: np.ndarray, k: int, points: int):
        place = ((at - bounds[k] + 0.5) / (bounds[k + 2] - bounds[k]) - grid["origin"][k]) / grid["spacing"][k]
        place = np.clip(place, 0, points - 1)
        low = np.floor(place).astype(int)
        return low, np.minimum(low + 1, points - 1), place - low

    g = np.asarray(grid["gains"], np.float64).reshape(grid["rows"], grid["columns"], grid["planes"])
    r0, r1, fr = axis(rows, 0, grid["rows"])
    c0, c1, fc = axis(columns, 1, grid["columns"])
    p = np.minimum(channels, grid["planes"] - 1)
    pick = lambda r, c: g[r[:, None, None], c[None, :, None], p[None, None, :]]
    fr, fc = fr[:, None, None], fc[None, :, None]
    return (pick(r0, c0) * (1 - fc) + pick(r0, c1) * fc) * (1 - fr) + (pick(r1, c0) * (1 - fc) + pick(r1, c1) * fc) * fr


def apply_image(image: np.ndarray, ops: list[Opcode], stage: tuple[int, int, int, int], step: int, origin: tuple[int, int] = (0, 0)) -> tuple[int, int, int, int]:
    """Applies opcodes in order to a float image (rows, columns, channels) in place; returns the bounds that trims leave."""
    scale, unit = (65535.0, 1.0) if step == STAGE_CODES else (1.0, 65535.0)
    for op in ops:
        if op.kind == "trim":
            new = op.area.bounds
            if new[0] < stage[0] or new[1] < stage[1] or new[2] > stage[2] or new[3] > stage[3]:
                raise DecodeError("InvalidGeometry")
            stage = new
            continue
        top, left, bottom, right = op.area.resolved(stage)
        dy, dx = op.area.pitch
        rows = np.arange(top, bottom, dy)
        columns = np.arange(left, right, dx)
        rows, columns = rows[(rows >= stage[0]) & (rows < stage[2])], columns[(columns >= stage[1]) & (columns < stage[3])]
        channels = np.arange(op.area.plane, op.area.plane + op.area.planes)
        if not len(rows) or not len(columns):
            continue
        at = np.ix_(rows + origin[0], columns + origin[1], channels)
        v = image[at].astype(np.float64)
        if op.kind == "table":
            place = np.minimum(_round(np.clip(v * unit, 0, 65535)).astype(int), len(op.params) - 1)
            v = np.asarray(op.params, np.float64)[place] / unit
        elif op.kind == "polynomial":
            c, size = op.params, np.abs(v)
            powers = np.zeros_like(v)
            for k in reversed(c[1:]):
                powers = powers * size + k
            v = np.clip(c[0] + np.sign(v) * powers * size, -scale, scale)
        elif op.kind == "gain_map":
            v = np.minimum(v * _gain_at(op.grid, stage, rows, columns, channels), scale)
        else:
            values = np.asarray(op.params, np.float64)
            factor = values[(rows - top) // dy][:, None, None] if op.kind.startswith("row") else values[(columns - left) // dx][None, :, None]
            v = np.clip(v + factor if op.kind.endswith("delta") else v * factor, -scale, scale)
        if step == STAGE_CODES:
            v = _round(np.clip(v, 0, 65535))
        if not np.isfinite(v).all():
            raise DecodeError("InvalidTag")
        image[at] = v.astype(np.float32)
    return stage


def profile_table(ident: int, data: bytes, order: str) -> dict:
    """A profile gain table from tag 52525 (floats) or 52544 (bytes, shorts, halves or floats with a range and gamma)."""
    head = struct.Struct(f"{order}2I4dI5f")
    if len(data) < head.size:
        raise DecodeError("Truncated")
    rows, columns, sy, sx, oy, ox, n, *weights = head.unpack_from(data)
    kind, gamma, low, high, at = 3, 1.0, 0.0, 1.0, head.size
    if ident == 52544:
        if len(data) < at + 16:
            raise DecodeError("Truncated")
        kind, gamma, low, high = struct.unpack_from(f"{order}I3f", data, at)
        at += 16
    if not rows or not columns or not n or min(sy, sx) <= 0 or gamma <= 0 or low > high:
        raise DecodeError("InvalidTag")
    types = {0: "u1", 1: "u2", 2: "f2", 3: "f4"}
    if kind not in types:
        raise DecodeError("UnsupportedFeature")
    body, dtype = data[at:], np.dtype(order + types[kind])
    if len(body) != rows * columns * n * dtype.itemsize:
        raise DecodeError("InvalidTag")
    gains = np.frombuffer(body, dtype).astype(np.float64)
    if kind < 2:
        gains = low + (high - low) * gains / (255 if kind == 0 else 65535)
    if not np.isfinite(gains).all() or (gains.astype(np.float32) <= 0).any():
        raise DecodeError("InvalidTag")
    return {"points": (rows, columns, n), "spacing": (sy, sx), "origin": (oy, ox), "weights": tuple(weights), "gamma": gamma, "gains": gains.astype(np.float32).tolist()}
