"""Classic TIFF directories of DNG files: a bounded walk, typed tag values, and the facts of the primary raw image."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isfinite

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.sources.errors import DecodeError, Limits, guarded
from photonlake.sources.rows import frame

# Bytes of a component, and its struct code, by TIFF field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, MAKE, MODEL, ORIENTATION = 254, 256, 257, 258, 259, 262, 271, 272, 274
SAMPLES, PLANAR, SUB_IFDS, SAMPLE_FORMAT, DNG_VERSION, BACKWARD_VERSION, COLORIMETRIC = 277, 284, 330, 339, 50706, 50707, 50879
CFA, LINEAR_RAW, MASK = 32803, 34892, 65540
CHILDREN = (34665, 34853, 40965)
LARGE = (52525, 52544, 51008, 51009, 51022)

TAG_SCHEMA = "path string, dir_ord int, ifd_offset long, parent_offset long, tag_ord int, tag_id int, field_type int, count long, data binary, byte_order string, numbers array<double>, text string, error string"
PROBE_SCHEMA = """path string, container string, version long, byte_order string, dng_version array<int>, dng_backward_version array<int>, width long, height long,
    samples_per_pixel int, bits_per_sample array<int>, compression int, photometric int, sample_format array<int>, planar int, has_strips boolean, has_tiles boolean,
    make string, model string, is_linear_raw boolean, error string"""


@dataclass(frozen=True)
class Tag:
    id: int
    kind: int
    count: int
    data: bytes
    order: str

    def numbers(self, kinds: tuple[int, ...] | None = None) -> list[float]:
        """Every component as a number; rationals are divided."""
        if kinds is not None and self.kind not in kinds or self.kind in (2, 7):
            raise DecodeError("InvalidTag")
        if self.kind in (5, 10):
            pairs = struct.unpack(f"{self.order}{2 * self.count}{'I' if self.kind == 5 else 'i'}", self.data)
            if any(d == 0 for d in pairs[1::2]):
                raise DecodeError("InvalidTag")
            return [n / d for n, d in zip(pairs[::2], pairs[1::2], strict=True)]
        values = list(struct.unpack(f"{self.order}{self.count}{CODES[self.kind]}", self.data))
        if not all(isfinite(v) for v in values):
            raise DecodeError("InvalidTag")
        return values

    def integers(self, kinds: tuple[int, ...] = (1, 3, 4)) -> list[int]:
        return [int(v) for v in self.numbers(kinds)]

    def scalar(self, kinds: tuple[int, ...] = (1, 3, 4)) -> int:
        if self.count != 1:
            raise DecodeError("InvalidTag")
        return self.integers(kinds)[0]

    def text(self) -> str:
        """Up to the first NUL."""
        if self.kind != 2:
            raise DecodeError("InvalidTag")
        return self.data.split(b"\0")[0].decode("utf-8")


@dataclass
class Directory:
    offset: int
    parent: int | None
    tags: dict[int, Tag] = field(default_factory=dict)

    def scalar(self, tag: int, default: int | None = None, kinds: tuple[int, ...] = (1, 3, 4)) -> int | None:
        return self.tags[tag].scalar(kinds) if tag in self.tags else default

    def integers(self, tag: int, default: list[int] | None = None, kinds: tuple[int, ...] = (1, 3, 4)) -> list[int] | None:
        return self.tags[tag].integers(kinds) if tag in self.tags else default

    def numbers(self, tag: int, kinds: tuple[int, ...] | None = None) -> list[float] | None:
        return self.tags[tag].numbers(kinds) if tag in self.tags else None

    def text(self, tag: int) -> str | None:
        return self.tags[tag].text() if tag in self.tags else None

    @property
    def is_primary_raw(self) -> bool:
        return self.scalar(SUBFILE) == 0 and self.scalar(PHOTOMETRIC) in (CFA, LINEAR_RAW)


def byte_order(data: bytes) -> str:
    if data[:2] not in (b"II", b"MM"):
        raise DecodeError("UnsupportedFormat")
    return "<" if data[:2] == b"II" else ">"


def _read(data: bytes, order: str, code: str, at: int) -> int:
    if at + struct.calcsize(code) > len(data):
        raise DecodeError("Truncated")
    return struct.unpack_from(order + code, data, at)[0]


def _directory(data: bytes, order: str, offset: int, parent: int | None, limits: Limits) -> tuple[Directory, int]:
    count = _read(data, order, "H", offset)
    if count > limits.max_ifd_entries:
        raise DecodeError("ResourceLimit")
    if offset + 2 + 12 * count + 4 > len(data):
        raise DecodeError("Truncated")
    found = Directory(offset, parent)
    for i in range(count):
        at = offset + 2 + 12 * i
        ident, kind, n = struct.unpack_from(order + "HHI", data, at)
        if ident in found.tags:
            raise DecodeError("InvalidTag")
        if kind not in SIZES:
            continue
        size = SIZES[kind] * n
        if size > (limits.max_profile_gain_table_bytes if ident in LARGE else limits.max_value_bytes):
            raise DecodeError("ResourceLimit")
        start = at + 8 if size <= 4 else _read(data, order, "I", at + 8)
        if start + size > len(data):
            raise DecodeError("InvalidOffset")
        found.tags[ident] = Tag(ident, kind, n, bytes(data[start : start + size]), order)
    return found, _read(data, order, "I", offset + 2 + 12 * count)


def walk(data: bytes, limits: Limits = Limits()) -> list[Directory]:  # noqa: B008
    """All directories in the order of a last-in, first-out work list: of a directory's children, the next one in the chain is pushed last."""
    if len(data) > limits.max_input_bytes:
        raise DecodeError("ResourceLimit")
    order = byte_order(data)
    magic = _read(data, order, "H", 2)
    if magic != 42:
        raise DecodeError("UnsupportedFeature" if magic == 43 else "UnsupportedFormat")
    work: list[tuple[int, int | None]] = [(_read(data, order, "I", 4), None)]
    seen, found, kept = set(), [], 0
    while work:
        offset, parent = work.pop()
        if len(found) >= limits.max_ifds:
            raise DecodeError("ResourceLimit")
        if offset in seen:
            raise DecodeError("InvalidOffset")
        seen.add(offset)
        d, following = _directory(data, order, offset, parent, limits)
        kept += sum(len(t.data) for t in d.tags.values())
        if kept > limits.max_metadata_bytes:
            raise DecodeError("ResourceLimit")
        found.append(d)
        children = [(d.tags[t].scalar((3, 4)), offset) for t in d.tags if t in CHILDREN]
        children = [c for c in children if c[0]]
        if SUB_IFDS in d.tags:
            children += [(c, offset) for c in d.tags[SUB_IFDS].integers((4, 13))]
        if following:
            children.append((following, parent))
        work += children
        if len(work) > limits.max_ifds:
            raise DecodeError("ResourceLimit")
        if len(found) > 1 and COLORIMETRIC in d.tags:
            raise DecodeError("UnsupportedFeature")
    return found


def facts(directories: list[Directory], limits: Limits = Limits()) -> dict:  # noqa: B008
    """The facts of the only primary raw image, and of the root directory."""
    root = directories[0]
    version = root.integers(DNG_VERSION, kinds=(1,))
    if version is None or len(version) != 4 or not any(version):
        raise DecodeError("InvalidContainer")
    raws = [d for d in directories if d.is_primary_raw]
    if len(raws) != 1:
        raise DecodeError("InvalidGeometry")
    raw = raws[0]
    width, height = raw.scalar(WIDTH), raw.scalar(HEIGHT)
    if not width or not height:
        raise DecodeError("InvalidGeometry")
    if width > limits.max_width or height > limits.max_height or width * height > limits.max_pixels:
        raise DecodeError("ResourceLimit")
    samples, bits = raw.scalar(SAMPLES, 1), raw.integers(BITS)
    formats = raw.integers(SAMPLE_FORMAT, [1] * samples)
    compression, planar = raw.scalar(COMPRESSION, 1), raw.scalar(PLANAR, 1)
    if not samples or bits is None or len(bits) != samples or 0 in bits or len(formats) != samples or any(not 1 <= f <= 6 for f in formats):
        raise DecodeError("InvalidTag")
    if not 0 < compression <= 65535 or planar not in (1, 2):
        raise DecodeError("InvalidTag")
    return {
        "byte_order": "II" if root.tags[DNG_VERSION].order == "<" else "MM",
        "dng_version": version,
        "dng_backward_version": root.integers(BACKWARD_VERSION, kinds=(1,)),
        "width": width,
        "height": height,
        "samples_per_pixel": samples,
        "bits_per_sample": bits,
        "compression": compression,
        "photometric": raw.scalar(PHOTOMETRIC),
        "sample_format": formats,
        "planar": planar,
        "has_strips": 273 in raw.tags,
        "has_tiles": 324 in raw.tags,
        "make": root.text(MAKE),
        "model": root.text(MODEL),
        "is_linear_raw": raw.scalar(PHOTOMETRIC) == LINEAR_RAW,
        "raw": raw,
    }


def recognized(data: bytes, limits: Limits = Limits()) -> bool:  # noqa: B008
    """Whether a TIFF's first directory holds a DNG version; never an error."""
    try:
        order = byte_order(data)
        first = _read(data, order, "I", 4)
        count = _read(data, order, "H", first)
        if _read(data, order, "H", 2) not in (42, 43) or count > limits.max_ifd_entries:
            return False
        rows = [struct.unpack_from(order + "HHI4s", data, first + 2 + 12 * i) for i in range(count)]
    except (DecodeError, struct.error):
        return False
    return any(t == DNG_VERSION and k == 1 and n == 4 and any(v) for t, k, n, v in rows)


def probe(data: bytes, limits: Limits = Limits()) -> dict:  # noqa: B008
    """The container of a file and its facts; other files are Unknown, not an error."""
    if len(data) > limits.max_input_bytes:
        raise DecodeError("ResourceLimit")
    if data[:4] == b"FOVb":
        if len(data) < 8:
            raise DecodeError("Truncated")
        return {"container": "X3f", "version": int.from_bytes(data[4:8], "little")}
    if data[:2] in (b"II", b"MM") and recognized(data, limits):
        found = facts(walk(data, limits), limits)
        del found["raw"]
        return {"container": "Dng"} | found
    return {"container": "Unknown"}


def classification(container: str | None, error: str | None) -> str:
    """supported, recognized-unsupported or not recognized, for a probed file."""
    if container == "Unknown" or error == "NotRecognized":
        return "not recognized"
    return "recognized-unsupported" if container == "X3f" or error in ("UnsupportedFormat", "UnsupportedFeature") else "invalid" if error else "supported"


def probe_table(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per file (path, content) with its container facts or error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, error = guarded(probe, bytes(content), limits)
                rows.append({"path": path, "error": error} | (found or {}))
            yield frame(rows, PROBE_SCHEMA)

    return files.select("path", "content").mapInPandas(run, PROBE_SCHEMA)


def _plain_numbers(tag: Tag) -> list[float] | None:
    """The components of a short numeric tag; long ones stay bytes."""
    return guarded(tag.numbers)[0] if tag.count <= 4096 and tag.kind not in (2, 7) else None


def root(tags: DataFrame) -> DataFrame:
    """The tags of each file's first directory."""
    return tags.filter("dir_ord = 0")


def raw(tags: DataFrame) -> DataFrame:
    """The tags of each file's primary raw directories."""
    return tags.withColumn("is_raw", is_raw()).filter("is_raw").select(*tags.columns)


def is_raw() -> Column:
    """Whether a tag's directory is primary and raw, over the tags of each directory: no second pass over the files."""
    number = lambda t: F.max(F.when(F.col("tag_id") == t, F.element_at("numbers", 1))).over(Window.partitionBy("path", "dir_ord"))
    return F.coalesce((number(SUBFILE) == 0) & number(PHOTOMETRIC).isin(CFA, LINEAR_RAW), F.lit(False))


def directory(tags: DataFrame, offset: int) -> DataFrame:
    """The tags of the directory at a file offset."""
    return tags.filter(F.col("ifd_offset") == offset)


def tag(tags: DataFrame, ident: int) -> DataFrame:
    """The rows of one tag."""
    return tags.filter(F.col("tag_id") == ident)


def tag_table(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per tag of every directory in visiting order, or one per file with the error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, error = guarded(walk, bytes(content), limits)
                if error:
                    rows.append({"path": path, "error": error})
                for k, d in enumerate(found or ()):
                    rows += [
                        {"path": path, "dir_ord": k, "ifd_offset": d.offset, "parent_offset": d.parent, "tag_ord": i, "tag_id": t.id, "field_type": t.kind, "count": t.count, "data": t.data, "byte_order": "II" if t.order == "<" else "MM", "numbers": _plain_numbers(t), "text": guarded(t.text)[0] if t.kind == 2 else None, "error": None}
                        for i, t in enumerate(d.tags.values())
                    ]
            yield frame(rows, TAG_SCHEMA)

    return files.select("path", "content").mapInPandas(run, TAG_SCHEMA)
