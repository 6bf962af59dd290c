"""Calibration sections: decryption or decompression, then named entries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.functions import cipher
from photonlake.functions.entropy import Codebook
from photonlake.sources.errors import DecodeError, guarded
from photonlake.sources.rows import frame

MAX_BYTES, MAX_ENTRIES, MAX_PROPERTIES, MAX_ALL_PROPERTIES, MAX_STRING_BYTES, MAX_VALUES = 32 << 20, 4096, 4096, 65536, 4 << 20, 4 << 20
# Numpy types of matrix element kinds.
ELEMENTS = {0: "<i2", 1: "<u4", 2: "<u4", 3: "<f4", 5: "u1", 6: "<u2"}
ENTRY_SCHEMA = "path string, ord int, name string, kind string, text string, props map<string,string>, dims array<int>, vals array<double>, error string"


def u32(data: bytes, at: int) -> int:
    if at < 0 or at + 4 > len(data):
        raise DecodeError("Truncated")
    return int.from_bytes(data[at : at + 4], "little")


def parity_planes(diffs: np.ndarray, seed: int) -> np.ndarray:
    """Samples of a plane (rows, columns) from 2x2 parity differences: running sums down the first two columns, then along rows."""
    v = diffs.astype(np.int64)
    for parity in (0, 1):
        v[parity::2, :2] = np.cumsum(v[parity::2, :2], axis=0)
    for parity in (0, 1):
        v[:, parity::2] = np.cumsum(v[:, parity::2], axis=1)
    return v + seed


def _book_and_stream(section: bytes, count: int) -> list[int]:
    book = Codebook(section[28:])
    if book.end > 28:
        raise DecodeError("InvalidContainer", "codebook overlaps the stream header")
    size = u32(section, 56)
    stream = section[60 : 60 + size]
    if len(stream) < size:
        raise DecodeError("Truncated")
    book.check_capacity(size, count)
    return book.differences(stream, count)


def decode(section: bytes) -> bytes:
    """The plain bytes of a calibration section of type 2 (cipher), 4 (12-bit parity) or 5 (byte sums)."""
    if section[:4] != b"SECc" or u32(section, 4) != 0x20000:
        raise DecodeError("InvalidContainer", "not a calibration section")
    kind = u32(section, 8)
    if kind == 2:
        seed = u32(section, 24)
        if len(section) - 28 > MAX_BYTES:
            raise DecodeError("ResourceLimit")
        return cipher.decrypt(section[28:], seed)
    size, seed = u32(section, 12), u32(section, 16)
    if not 0 < size <= MAX_BYTES:
        raise DecodeError("InvalidContainer", "invalid size")
    if kind == 5:
        sums = np.cumsum(np.array(_book_and_stream(section, size), np.int64)) + seed
        return (sums & 255).astype(np.uint8).tobytes()
    if kind != 4:
        raise DecodeError("UnsupportedFormat", "unknown calibration type")
    columns, rows = u32(section, 20), u32(section, 24)
    count = (2 * size + 2) // 3
    if columns < 2 or rows < 1 or not count <= columns * rows <= 2 * MAX_BYTES or seed >= 1 << 31:
        raise DecodeError("InvalidContainer", "invalid blocks")
    diffs = np.zeros(-(-count // columns) * columns, np.int64)
    diffs[:count] = _book_and_stream(section, count)
    values = parity_planes(diffs.reshape(-1, columns), seed).ravel()[:count]
    if ((values < 0) | (values > 4095)).any():
        raise DecodeError("InvalidContainer", "sample outside 12 bits")
    pairs = np.append(values, 0)[: count + count % 2].reshape(-1, 2)
    out = np.stack([pairs[:, 0] >> 4, (pairs[:, 0] & 15) << 4 | pairs[:, 1] >> 8, pairs[:, 1] & 255], axis=1)
    return out.astype(np.uint8).tobytes()[:size]


def _string(entry: bytes, at: int, budget: list[int]) -> str:
    end = entry.find(b"\0", at, at + budget[0])
    if not 0 <= at <= len(entry) or end < 0:
        raise DecodeError("InvalidContainer", "property string")
    budget[0] -= end + 1 - at
    return entry[at:end].decode("utf-8")


def _properties(entry: bytes, at: int, budget: list[int], left: list[int]) -> dict[str, str]:
    count, strings = u32(entry, at), u32(entry, at + 4)
    if count > MAX_PROPERTIES or count > left[0] or not at + 8 + 8 * count <= strings <= len(entry):
        raise DecodeError("InvalidContainer", "property table")
    left[0] -= count
    found: dict[str, str] = {}
    for i in range(count):
        name = _string(entry, strings + u32(entry, at + 8 + 8 * i), budget)
        value = _string(entry, strings + u32(entry, at + 12 + 8 * i), budget)
        if name in found:
            raise DecodeError("InvalidTag", "repeated property")
        found[name] = value
    return dict(sorted(found.items()))


def _matrix(entry: bytes, at: int, left: list[int]) -> tuple[list[int], np.ndarray]:
    kind, n, start = u32(entry, at), u32(entry, at + 4), u32(entry, at + 8)
    if not 1 <= n <= 3 or kind not in ELEMENTS or start < at + 12 + 12 * n:
        raise DecodeError("InvalidContainer", "matrix header")
    dims = [u32(entry, at + 12 + 12 * i) for i in range(n)]
    count = int(np.prod([float(d) for d in dims])) if max(dims) > 1 << 20 else int(np.prod(dims))
    left[0] -= count
    if left[0] < 0:
        raise DecodeError("ResourceLimit", "matrix values")
    size = np.dtype(ELEMENTS[kind]).itemsize * count
    if start + size > len(entry):
        raise DecodeError("Truncated")
    values = np.frombuffer(entry[start : start + size], ELEMENTS[kind]).astype(np.float64)
    if not np.isfinite(values).all():
        raise DecodeError("InvalidTag", "non-finite value")
    return dims, values


def entries(data: bytes) -> list[dict]:
    """Every named entry in order: name, kind (Text, Properties or Matrix) and its content."""
    out, at = [], 0
    strings, properties, values = [MAX_STRING_BYTES], [MAX_ALL_PROPERTIES], [MAX_VALUES]
    names: set[str] = set()
    while at < len(data):
        size, name_at, value_at = u32(data, at + 8), u32(data, at + 12), u32(data, at + 16)
        entry = data[at : at + size]
        if size < 20 or len(entry) < size or min(name_at, value_at) < 20 or len(out) >= MAX_ENTRIES:
            raise DecodeError("InvalidContainer", "entry header")
        end = entry.find(b"\0", name_at)
        if end < 0:
            raise DecodeError("Truncated")
        name, kind = entry[name_at:end].decode("utf-8"), entry[:4]
        if name in names:
            raise DecodeError("InvalidTag", "repeated entry")
        names.add(name)
        row = {"ord": len(out), "name": name, "kind": None, "text": None, "props": None, "dims": None, "vals": None}
        if kind == b"CMbT":
            length = u32(entry, value_at)
            if value_at + 4 + length > len(entry):
                raise DecodeError("Truncated")
            row |= {"kind": "Text", "text": entry[value_at + 4 : value_at + 4 + length].decode("utf-8").rstrip("\0")}
        elif kind == b"CMbP":
            row |= {"kind": "Properties", "props": _properties(entry, value_at, strings, properties)}
        elif kind == b"CMbM":
            dims, vals = _matrix(entry, value_at, values)
            row |= {"kind": "Matrix", "dims": dims, "vals": vals.tolist()}
        else:
            raise DecodeError("InvalidContainer", "unknown entry")
        out.append(row)
        at += size
    return out


def entry_table(sections: DataFrame) -> DataFrame:
    """camf_entries of a table (path, camf): one row per entry, or one with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, section in zip(pdf["path"], pdf["camf"], strict=True):
                found, error = guarded(lambda s: entries(decode(bytes(s))), section) if section is not None else (None, "InvalidContainer")
                rows += [{"path": path, "error": error}] if error else [{"path": path, "error": None} | e for e in found]
            yield frame(rows, ENTRY_SCHEMA)

    return sections.select("path", "camf").mapInPandas(run, ENTRY_SCHEMA)


def values_of(entries_df: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """(path, vals, error) of a named matrix of each calibration; with `size` its number of values must be exactly that."""
    found = F.max(F.when((F.col("name") == name) & (F.col("kind") == "Matrix"), F.col("vals")))
    rows = entries_df.groupBy("path").agg(found.alias("vals"), F.max("error").alias("error"))
    fits = F.col("vals").isNotNull() if size is None else F.size("vals") == size
    error = F.coalesce("error", F.when(fits, F.lit(None)).otherwise("InvalidContainer"))
    return rows.select("path", F.when(error.isNull(), F.col("vals")).alias("vals"), error.alias("error"))


def property_of(entries_df: DataFrame, name: str, key: str) -> DataFrame:
    """(path, value, error) of a key of a named property table of each calibration."""
    found = F.max(F.when((F.col("name") == name) & (F.col("kind") == "Properties"), F.try_element_at("props", F.lit(key))))
    rows = entries_df.groupBy("path").agg(found.alias("value"), F.max("error").alias("error"))
    return rows.select("path", "value", F.coalesce("error", F.when(F.col("value").isNull(), F.lit("InvalidContainer"))).alias("error"))
