"""X3F containers: sections, sensor planes and the preview."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from photonlake.functions import exif as jpeg_exif
from photonlake.functions.entropy import Codebook
from photonlake.sources.camf import decode as decode_calibration
from photonlake.sources.camf import parity_planes, u32
from photonlake.sources.errors import DecodeError, guarded
from photonlake.sources.rows import frame

# Fixed values of the format.
VERSIONS = (0x20001, 0x20002, 0x20003, 0x30000, 0x30001, 0x40001, 0x40002)
SENSORS = {(0x20003, 0x1E): "Merrill", (0x30000, 0x1E): "Merrill", (0x30001, 0x1E): "Merrill", (0x40001, 0x23): "Quattro", (0x40002, 0x25): "SdQuattro", (0x40002, 0x27): "SdQuattro"}
GEOMETRY = {
    0x1E: ([(4928, 3264)] * 3, None),
    0x23: ([(2944, 1836)] * 2 + [(6272, 3672)], (5888, 3672)),
    0x25: ([(2944, 1888)] * 2 + [(5888, 3776)], (5888, 3776)),
    0x27: ([(3328, 2240)] * 2 + [(6656, 4480)], (6656, 4480)),
}
MIN_BYTES, MAX_BYTES, MAX_SAMPLES = 44, 512 << 20, 32 << 20
SECTIONS = "path string, version long, raw binary, camf binary, jpeg binary, exif binary, light_source int, sensor string, error string"
SCANLINES = "path string, plane int, y int, width int, samples array<int>, error string"


def sections(data: bytes) -> dict:
    """version, raw, camf and the optional jpeg of a file."""
    if not MIN_BYTES <= len(data) <= MAX_BYTES:
        raise DecodeError("ResourceLimit" if len(data) > MAX_BYTES else "Truncated")
    version, directory = u32(data, 4), u32(data, len(data) - 4)
    if data[:4] != b"FOVb" or version not in VERSIONS:
        raise DecodeError("UnsupportedFormat")
    table = data[directory : len(data) - 4]
    if directory < 40 or table[:4] != b"SECd" or u32(table, 4) != 0x20000:
        raise DecodeError("InvalidContainer", "directory")
    count = u32(table, 8)
    if count > 64 or len(table) != 12 + 12 * count:
        raise DecodeError("InvalidContainer", "directory size")
    found: dict = {"version": version, "raw": None, "camf": None, "jpeg": None}

    def once(key: str, section: bytes) -> None:
        if found[key] is not None:
            raise DecodeError("InvalidContainer", f"two {key} sections")
        found[key] = section

    taken: list[tuple[int, int]] = []
    for i in range(count):
        start, length, kind = struct.unpack_from("<II4s", table, 12 + 12 * i)
        end = start + length
        if start < 40 or end > directory or length < 8 or any(start < b and end > a for a, b in taken):
            raise DecodeError("InvalidOffset", "sections overlap")
        taken.append((start, end))
        section = data[start:end]
        if kind == b"IMA2" or (kind == b"IMAG" and version in VERSIONS[:2]):
            if section[:4] != b"SECi":
                raise DecodeError("InvalidContainer", "image section")
            use = u32(section, 8)
            if use == 3 or (use == 1 and kind == b"IMA2"):
                once("raw", section)
            if kind == b"IMA2" and use == 2 and u32(section, 12) == 0x12 and found["jpeg"] is None:
                if len(section) < 28:
                    raise DecodeError("Truncated")
                found["jpeg"] = section[28:]
        elif kind == b"CAMF":
            if section[:4] != b"SECc":
                raise DecodeError("InvalidContainer", "calibration section")
            once("camf", section)
    if found["raw"] is None or found["camf"] is None:
        raise DecodeError("InvalidContainer", "a section is missing")
    return found


def sensor_format(raw: bytes, version: int) -> str:
    name = SENSORS.get((version, u32(raw, 12))) if u32(raw, 8) == 1 else None
    if name is None:
        raise DecodeError("UnsupportedFormat", "unknown sensor")
    return name


def calibration_kind(raw: bytes, version: int) -> int:
    """The type that a calibration section must have."""
    if version in VERSIONS[:2] and (u32(raw, 8), u32(raw, 12)) == (3, 6):
        return 2
    return 4 if sensor_format(raw, version) == "Merrill" else 5


def planes(raw: bytes, version: int, geometry: dict = GEOMETRY) -> list[np.ndarray]:
    """Bottom, middle and top samples. Every stream's capacity is checked before the first is decoded."""
    if u32(raw, 4) != 0x20000:
        raise DecodeError("UnsupportedFormat", "image section version")
    image = u32(raw, 16), u32(raw, 20)
    merrill = sensor_format(raw, version) == "Merrill"
    sizes = [image] * 3 if merrill else [struct.unpack_from("<HH", raw, 28 + 4 * i) for i in range(3)]
    want, whole = geometry.get(u32(raw, 12), (None, None))
    if want is None or [tuple(s) for s in sizes] != want or (whole and image != whole):
        raise DecodeError("InvalidGeometry")
    seeds = struct.unpack_from("<3H", raw, 28 if merrill else 40)
    book = Codebook(raw, 36 if merrill else 48)
    at = book.end + (0 if merrill else 4)
    lengths = [u32(raw, at + 4 * i) for i in range(3)]
    at += 12
    streams = []
    for (width, height), length in zip(sizes, lengths, strict=True):
        stream = raw[at : at + length]
        if len(stream) < length or not (width >= 2 and height >= 2 and width * height <= MAX_SAMPLES):
            raise DecodeError("Truncated" if len(stream) < length else "InvalidGeometry")
        book.check_capacity(length, width * height)
        streams.append(stream)
        at += (length + 15) & ~15
    out = []
    for (width, height), stream, seed in zip(sizes, streams, seeds, strict=True):
        v = parity_planes(np.array(book.differences(stream, width * height)).reshape(height, width), seed)
        if ((v < 0) | (v > 65535)).any():
            raise DecodeError("InvalidContainer", "sample out of range")
        out.append(v)
    return out


def section_table(files: DataFrame) -> DataFrame:
    """One row per file (path, content) with its sections, preview EXIF and sensor, or the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, error = guarded(sections, bytes(content))
                row = {"path": path, "error": error} | (found or {})
                if found:
                    row["sensor"] = guarded(sensor_format, found["raw"], found["version"])[0]
                    if found["jpeg"] is not None:
                        row["exif"] = guarded(jpeg_exif.exif, found["jpeg"])[0]
                        row["light_source"] = jpeg_exif.light_source(found["jpeg"])
                rows.append(row)
            yield frame(rows, SECTIONS)

    return files.select("path", "content").mapInPandas(run, SECTIONS)


def scanline_table(sections_df: DataFrame, geometry: dict = GEOMETRY) -> DataFrame:
    """Scanlines of the three planes of each file, or one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, version, raw in zip(pdf["path"], pdf["version"], pdf["raw"], strict=True):
                found, error = guarded(planes, bytes(raw), int(version), geometry)
                if error:
                    yield frame([{"path": path, "error": error}], SCANLINES)
                for plane, v in enumerate(found or ()):
                    yield pd.DataFrame({"path": path, "plane": plane, "y": range(len(v)), "width": v.shape[1], "samples": list(v), "error": None})

    return sections_df.filter("error is null").select("path", "version", "raw").mapInPandas(run, SCANLINES)


CALIBRATION = "path string, camf binary, decoded binary, error string"


def calibration_table(sections_df: DataFrame) -> DataFrame:
    """(path, camf, decoded, error): the calibration section and its plain bytes, if its type is the one that the sensor's format has.

    camf.entry_table reads the entries of the rows without an error.
    """

    def checked(raw: bytes, section: bytes, version: int) -> bytes:
        if u32(section, 8) != calibration_kind(raw, version):
            raise DecodeError("InvalidContainer", "calibration type does not match the sensor")
        return decode_calibration(section)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, version, raw, section in zip(pdf["path"], pdf["version"], pdf["raw"], pdf["camf"], strict=True):
                found, error = guarded(checked, bytes(raw), bytes(section), int(version))
                rows.append({"path": path, "camf": None if error else section, "decoded": found, "error": error})
            yield frame(rows, CALIBRATION)

    return sections_df.filter("error is null").select("path", "version", "raw", "camf").mapInPandas(run, CALIBRATION)
