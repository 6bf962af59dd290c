"""DNG files: layout validation, tile decoding, normalization, opcodes and masks, one image at a time next to the scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from photonlake.functions import opcode_list, sof3
from photonlake.operators.metadata import CODEC
from photonlake.operators.normalize import CORRECTED, OUT_OF_CODES, OUTSIDE, SATURATED, Levels
from photonlake.operators.opcodes import STAGE_CODES, STAGE_LINEAR, Opcode, processing
from photonlake.sources import tiff
from photonlake.sources.errors import DecodeError, Limits, guarded
from photonlake.sources.rows import frame

IMAGE_SCHEMA = """path string, width long, height long, active_area array<int>, valid_area array<int>, crop_origin array<double>, crop_size array<double>, whole_origin array<long>, whole_size array<long>, orientation int,
    states map<string,string>, legacy_error string, error string"""
LINEAR_SCHEMA = "path string, y int, width int, samples array<float>, codes array<int>, flags array<int>"
MASK_SCHEMA = "path string, ifd_offset long, width int, height int, name string, instance_id string, sub_area array<long>, samples binary, error string"
NEWEST = [1, 7, 1, 0]

#: Decoders that need an image codec: compression -> function of (bytes, height, width, channels, limits). None is installed here.
CODECS: dict = {}


@dataclass
class Image:
    data: bytes
    limits: Limits
    facts: dict
    directories: list[tiff.Directory]
    levels: Levels
    lut: list[int] | None
    tile: tuple[int, int]
    ranges: list[tuple[int, int]]
    opcodes: list[tuple[list[Opcode], int] | None]
    area: tuple[int, int, int, int]

    @property
    def size(self) -> tuple[int, int]:
        return self.facts["height"], self.facts["width"]


def _geometry(raw: tiff.Directory, height: int, width: int) -> tuple[int, int, int, int]:
    area = tuple(raw.integers(50829, [0, 0, height, width]))
    if len(area) != 4 or not (0 <= area[0] < area[2] <= height and 0 <= area[1] < area[3] <= width):
        raise DecodeError("InvalidGeometry")
    origin, size = raw.numbers(50719), raw.numbers(50720)
    if size is not None:
        x, y = origin or (0.0, 0.0)
        if min(x, y) < 0 or min(size) <= 0 or x + size[0] > area[3] - area[1] or y + size[1] > area[2] - area[0]:
            raise DecodeError("InvalidGeometry")
    return area


def _levels(raw: tiff.Directory, area: tuple[int, int, int, int], bits: int) -> Levels:
    repeat = tuple(raw.integers(50713, [1, 1]))
    rows, columns = area[2] - area[0], area[3] - area[1]
    if len(repeat) != 2 or not (0 < repeat[0] <= rows and 0 < repeat[1] <= columns):
        raise DecodeError("InvalidTag")
    black = raw.numbers(50714, (3, 4, 5)) or [0.0] * (repeat[0] * repeat[1] * 3)
    white = raw.numbers(50717, (3, 4)) or [float((1 << bits) - 1)] * 3
    h, v = raw.numbers(50715, (10,)), raw.numbers(50716, (10,))
    if len(black) != repeat[0] * repeat[1] * 3 or len(white) != 3 or (h is not None and len(h) != columns) or (v is not None and len(v) != rows):
        raise DecodeError("InvalidTag")
    levels = Levels(repeat, 3, black, area, white, h, v)
    try:
        levels.denominators()
    except ValueError as e:
        raise DecodeError("InvalidTag") from e
    return levels


def _storage(d: tiff.Directory, height: int, width: int) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """Tile size and the byte ranges of all tiles; strips are tiles as wide as the image."""
    if 273 in d.tags:
        if 324 in d.tags or 325 in d.tags:
            raise DecodeError("UnsupportedFeature")
        tile, offsets, sizes = (min(d.scalar(278, height), height), width), d.integers(273), d.integers(279)
    else:
        tile, offsets, sizes = (d.scalar(323, 0), d.scalar(322, 0)), d.integers(324), d.integers(325)
    if not all(tile) or offsets is None or sizes is None or len(offsets) != len(sizes):
        raise DecodeError("UnsupportedFeature")
    return tile, list(zip(offsets, sizes, strict=True))


def _check_ranges(ranges: list[tuple[int, int]], size: int, limits: Limits) -> None:
    ordered = sorted(ranges)
    if any(a + n > size or not n for a, n in ordered):
        raise DecodeError("Truncated")
    if sum(n for _, n in ordered) > limits.max_codec_bytes:
        raise DecodeError("ResourceLimit")
    if any(a + n > b for (a, n), (b, _) in zip(ordered, ordered[1:], strict=False)):
        raise DecodeError("InvalidOffset")


def _tile_budget(tile: tuple[int, int], channels: int, count: int, limits: Limits) -> None:
    """A tile's sides, pixels and samples, and the samples of all tiles together, within the limits."""
    height, width = tile
    if height > limits.max_height or width > limits.max_width or height * width > limits.max_pixels:
        raise DecodeError("ResourceLimit")
    if height * width * channels > limits.max_frame_samples or height * width * channels * count > limits.max_decoded_samples:
        raise DecodeError("ResourceLimit")


def integral_pair(values: list[float] | None) -> list[int] | None:
    """Two numbers as whole ones if both are, else nothing."""
    whole = values is not None and len(values) == 2 and all(v == int(v) and 0 <= v < 1 << 32 for v in values)
    return [int(v) for v in values] if whole else None


def parse(data: bytes, limits: Limits = Limits()) -> Image:  # noqa: B008
    """A validated image, nothing decoded yet."""
    directories = tiff.walk(data, limits)
    facts = tiff.facts(directories, limits)
    root, raw = directories[0], facts["raw"]
    height, width = facts["height"], facts["width"]
    for tag in (266, 317):
        if tag in raw.tags and raw.scalar(tag, kinds=(3,)) != 1:
            raise DecodeError("UnsupportedFeature")
    orientation = root.scalar(tiff.ORIENTATION, raw.scalar(tiff.ORIENTATION))
    if orientation is not None and not 1 <= orientation <= 8:
        raise DecodeError("InvalidTag")
    version, backward = facts["dng_version"], facts["dng_backward_version"]
    bits = facts["bits_per_sample"]
    factors = (raw.scalar(50975, 1), height), (raw.scalar(52547, 1), width)
    supported = (
        facts["is_linear_raw"]
        and facts["compression"] in (1, 7, 34892, 52546)
        and [1, 0, 0, 0] <= version <= NEWEST
        and (backward is None or [1, 0, 0, 0] <= backward <= min(version, NEWEST))
        and facts["make"] == "Apple"
        and not root.scalar(tiff.COLORIMETRIC, 0)
        and raw.integers(50974, [1, 1]) == [1, 1]
        and all(0 < f <= size for f, size in factors)
        and facts["samples_per_pixel"] == 3
        and facts["sample_format"] == [1, 1, 1]
        and len(set(bits)) == 1
        and 8 <= bits[0] <= 16
        and (facts["compression"] != 34892 or bits[0] == 8)
    )
    if not supported:
        raise DecodeError("UnsupportedFeature")
    area = _geometry(raw, height, width)
    levels = _levels(raw, area, bits[0])
    lut = raw.integers(50712, kinds=(3,))
    if lut == []:
        raise DecodeError("InvalidTag")
    lists = [opcode_list.parse(raw.tags[t].data) if t in raw.tags else None for t in (51008, 51009, 51022)]
    tile, ranges = _storage(raw, height, width)
    planes = 3 if facts["planar"] == 2 else 1
    across, down = -(-width // tile[1]), -(-height // tile[0])
    if len(ranges) != across * down * planes:
        raise DecodeError("UnsupportedFeature")
    _tile_budget(tile, 3 // planes, len(ranges), limits)
    _check_ranges(ranges, len(data), limits)
    return Image(data, limits, facts | {"orientation": orientation}, directories, levels, lut, tile, ranges, lists, area)


def unpack(data: bytes, height: int, width: int, channels: int, bits: int, order: str) -> np.ndarray:
    """Samples of uncompressed rows: big-endian bit strings that start anew in each row; 8 and 16 bits are plain."""
    per_row = width * channels
    row_bytes = (per_row * bits + 7) // 8
    if len(data) != row_bytes * height:
        raise DecodeError("Truncated")
    if bits == 16:
        return np.frombuffer(data, order + "u2").astype(np.uint16).reshape(height, width, channels)
    rows = np.frombuffer(data, np.uint8).reshape(height, row_bytes)
    if bits == 8:
        return rows.astype(np.uint16).reshape(height, width, channels)
    flat = np.unpackbits(rows, axis=1)[:, : per_row * bits].reshape(height, per_row, bits)
    weights = 1 << np.arange(bits - 1, -1, -1)
    return (flat @ weights).astype(np.uint16).reshape(height, width, channels)


def decode_tile(data: bytes, compression: int, height: int, width: int, channels: int, bits: int, order: str, limits: Limits) -> np.ndarray:
    if compression == 1:
        return unpack(data, height, width, channels, bits, order)
    if compression == 7:
        frame, samples = sof3.decode(data, limits)
        if samples.shape != (height, width, channels) or frame.precision != bits:
            raise DecodeError("InvalidGeometry")
        return samples
    if compression in CODECS:
        return CODECS[compression](data, height, width, channels, limits)
    raise DecodeError("UnsupportedFeature")


def interleaved_order(length: int, factor: int) -> np.ndarray:
    """The image index of each stored one."""
    return np.concatenate([np.arange(p, length, factor) for p in range(factor)])


def codes(image: Image) -> np.ndarray:
    """Codes (height, width, 3) from all tiles, padding dropped and interleaving undone."""
    (height, width), (th, tw), f = image.size, image.tile, image.facts
    planar = f["planar"] == 2
    order = "<" if f["byte_order"] == "II" else ">"
    across = -(-width // tw)
    per_plane = across * -(-height // th)
    out = np.empty((height, width, 3), np.uint16)
    for i, (start, size) in enumerate(image.ranges):
        plane, k = divmod(i, per_plane)
        y, x = k // across * th, k % across * tw
        rows = min(th, height - y) if 273 in f["raw"].tags else th
        part = decode_tile(image.data[start : start + size], f["compression"], rows, tw, 1 if planar else 3, f["bits_per_sample"][0], order, image.limits)
        channels = slice(plane, plane + 1) if planar else slice(0, 3)
        out[y : y + th, x : x + tw, channels] = part[: height - y, : width - x]
    raw = f["raw"]
    for axis, factor in ((0, raw.scalar(50975, 1)), (1, raw.scalar(52547, 1))):
        if factor > 1:
            to = interleaved_order(out.shape[axis], factor)
            moved = np.empty_like(out)
            if axis == 0:
                moved[to] = out
            else:
                moved[:, to] = out
            out = moved
    return out


def normalized(image: Image, samples: np.ndarray) -> np.ndarray:
    """Samples between black and white in double precision, then narrowed."""
    levels, (top, left, bottom, right) = image.levels, image.area
    rows = np.clip(np.arange(image.size[0]), top, bottom - 1) - top
    columns = np.clip(np.arange(image.size[1]), left, right - 1) - left
    base = np.asarray(levels.black).reshape(*levels.repeat, 3)
    black = base[rows % levels.repeat[0]][:, columns % levels.repeat[1]]
    if levels.delta_h is not None:
        black = black + np.asarray(levels.delta_h)[columns][None, :, None]
    if levels.delta_v is not None:
        black = black + np.asarray(levels.delta_v)[rows][:, None, None]
    out = ((linearized(image, samples) - black) / np.asarray(levels.denominators())).astype(np.float32)
    if not np.isfinite(out).all():
        raise DecodeError("InvalidTag")
    return out


def linearized(image: Image, samples: np.ndarray) -> np.ndarray:
    s = samples.astype(np.float64)
    if image.lut is None:
        return s
    place = np.minimum(np.floor(np.maximum(s, 0) + 0.5).astype(int), len(image.lut) - 1)
    return np.asarray(image.lut, np.float64)[place]


def decode(image: Image, linear: bool = True) -> dict:
    """Codes with their flags, and the linear image unless left out, with the valid area and the state of each correction."""
    samples = codes(image)
    f, (top, left, bottom, right) = image.facts, image.area
    outside = np.ones(image.size, bool)
    outside[top:bottom, left:right] = False
    flags = np.where(samples >= (1 << f["bits_per_sample"][0]) - 1, OUT_OF_CODES, 0) | np.where(linearized(image, samples) >= np.asarray(image.levels.white), SATURATED, 0)
    flags |= np.where(outside, OUTSIDE, 0)[:, :, None]
    valid, states = outlook(image)
    if any(states[f"opcode_list_{k}"] in ("Applied", "PartiallyApplied") for k in (1, 2, 3)):
        flags |= CORRECTED
    done = {"codes": samples, "flags": flags, "valid_area": valid, "states": states}
    if not linear:
        return done
    work = samples.astype(np.float32)
    if image.opcodes[0]:
        opcode_list.apply_image(work, image.opcodes[0][0], (0, 0, *image.size), STAGE_CODES)
    v = normalized(image, work)
    stage = (0, 0, bottom - top, right - left)
    for found in image.opcodes[1:]:
        if found:
            stage = opcode_list.apply_image(v, found[0], stage, STAGE_LINEAR, (top, left))
    return done | {"linear": v}


def _trimmed(ops: list[Opcode], stage: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    for op in ops:
        if op.kind == "trim":
            new = op.area.bounds
            if new[0] < stage[0] or new[1] < stage[1] or new[2] > stage[2] or new[3] > stage[3]:
                raise DecodeError("InvalidGeometry")
            stage = new
    return stage


def outlook(image: Image) -> tuple[tuple[int, int, int, int], dict[str, str]]:
    """The valid area that the opcode lists leave and the state of each correction, without decoding a sample."""
    top, left, bottom, right = image.area
    lists = image.opcodes
    if lists[0]:
        t, le, b, r = _trimmed(lists[0][0], (0, 0, *image.size))
        if t > top or le > left or b < bottom or r < right:
            raise DecodeError("InvalidGeometry")
    stage = (0, 0, bottom - top, right - left)
    for found in lists[1:]:
        if found:
            stage = _trimmed(found[0], stage)
    states = [processing(len(x[0]) + x[1], x[1]) if x else "NotPresent" for x in lists]
    return (stage[0] + top, stage[1] + left, stage[2] + top, stage[3] + left), _states(image, states)


def legacy_gate(image: Image) -> None:
    """The older interface has whole-number geometry only: a trim or a fractional crop is not for it."""
    exact = [image.facts["raw"].numbers(tag) for tag in (50719, 50720)]
    fractional = any(v is not None and integral_pair(v) is None for v in exact)
    if outlook(image)[0] != image.area or fractional:
        raise DecodeError("UnsupportedFeature")


def _states(image: Image, opcode_states: list[str]) -> dict[str, str]:
    raw, root = image.facts["raw"], image.directories[0]
    pending = lambda present: "Unapplied" if present else "NotPresent"
    return {
        "linearization": "Applied" if image.lut is not None else "NotPresent",
        "black_subtraction": "Applied",
        "white_normalization": "Applied",
        "white_balance": "Unapplied",
        "color_conversion": "Unapplied",
        "default_crop": pending({50829, 50719, 50720} & raw.tags.keys()),
        "orientation": pending(image.facts["orientation"] not in (None, 1)),
        "baseline_exposure": pending(50730 in root.tags),
        "profile_tone_curve": pending(50940 in root.tags),
        "demosaic": "NotPresent",
        "opcode_list_1": opcode_states[0],
        "opcode_list_2": opcode_states[1],
        "opcode_list_3": opcode_states[2],
        "profile_gain_table_map": pending(52525 in raw.tags or 52544 in root.tags),
        "semantic_masks": pending(any(d.scalar(tiff.SUBFILE) == tiff.MASK for d in image.directories)),
    }


def preview(directories: list[tiff.Directory], data: bytes) -> bytes | None:
    """The first reduced-size JPEG in visiting order."""
    for d in directories:
        if not (d.scalar(tiff.SUBFILE, 0) & 1):
            continue
        if 513 in d.tags and 514 in d.tags:
            start, size = d.scalar(513), d.scalar(514)
        elif d.scalar(tiff.COMPRESSION) in (6, 7) and d.scalar(tiff.PHOTOMETRIC) in (2, 6) and 273 in d.tags and 279 in d.tags and d.tags[273].count == 1:
            start, size = d.scalar(273), d.scalar(279)
        else:
            continue
        found = data[start : start + size]
        if found[:2] == b"\xff\xd8" and found[-2:] == b"\xff\xd9":
            return found
    return None


def masks(image: Image) -> list[dict]:
    """Semantic masks with their own geometry, name, instance and place in the canvas."""
    out = []
    for d in image.directories:
        if d.scalar(tiff.SUBFILE) != tiff.MASK:
            continue
        width, height = d.scalar(tiff.WIDTH), d.scalar(tiff.HEIGHT)
        if d.scalar(tiff.PHOTOMETRIC) != 52527 or d.integers(tiff.BITS) != [8] or d.scalar(tiff.SAMPLES, 1) != 1 or not width or not height:
            raise DecodeError("UnsupportedFeature")
        if width * height > image.limits.max_pixels:
            raise DecodeError("ResourceLimit")
        (th, tw), ranges = _storage(d, height, width)
        _check_ranges(ranges, len(image.data), image.limits)
        across = -(-width // tw)
        if len(ranges) != across * -(-height // th):
            raise DecodeError("UnsupportedFeature")
        plane = np.empty((height, width), np.uint8)
        for i, (start, size) in enumerate(ranges):
            y, x = i // across * th, i % across * tw
            rows = min(th, height - y) if 273 in d.tags else th
            block, compression = image.data[start : start + size], d.scalar(tiff.COMPRESSION, 1)
            if compression == 7 and frame_marker(block) != 0xC3:
                compression = 34892
            part = decode_tile(block, compression, rows, tw, 1, 8, "<", image.limits)
            plane[y : y + th, x : x + tw] = part[: height - y, : width - x, 0]
        sub = d.integers(52536, kinds=(3, 4))
        if sub is not None and any(sub):
            if len(sub) != 4 or sub[0] + height > sub[3] or sub[1] + width > sub[2]:
                raise DecodeError("InvalidGeometry")
        else:
            sub = None
        out.append({"ifd_offset": d.offset, "width": width, "height": height, "name": d.text(52526), "instance_id": d.text(52528), "sub_area": sub, "samples": plane.tobytes()})
    return out


def image_table(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per file: geometry and the state of each correction, or the error. No sample is decoded.

    legacy_error is what the older interface, which knows whole-number geometry only, says of the file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                image, error = guarded(parse, bytes(content), limits)
                found, error = guarded(outlook, image) if image else (None, error)
                row = {"path": path, "error": error}
                if found:
                    raw = image.facts["raw"]
                    row |= {"width": image.size[1], "height": image.size[0], "active_area": list(image.area), "valid_area": list(found[0]), "states": found[1]}
                    row |= {"crop_origin": raw.numbers(50719), "crop_size": raw.numbers(50720), "whole_origin": integral_pair(raw.numbers(50719)), "whole_size": integral_pair(raw.numbers(50720)), "orientation": image.facts["orientation"]}
                    row |= {"legacy_error": guarded(legacy_gate, image)[1]}
                rows.append(row)
            yield frame(rows, IMAGE_SCHEMA)

    return files.select("path", "content").mapInPandas(run, IMAGE_SCHEMA)


def linear_table(files: DataFrame, limits: Limits = Limits(), linear: bool = True, with_codes: bool = True, with_flags: bool = True) -> DataFrame:  # noqa: B008
    """Scanlines of linear samples, codes and flags, each as asked for; a file that fails has none here and its error in image_table."""
    asked = {"linear": ("samples", linear), "codes": ("codes", with_codes), "flags": ("flags", with_flags)}
    kept = {k: name for k, (name, wanted) in asked.items() if wanted}
    schema = ", ".join(c.strip() for c in LINEAR_SCHEMA.split(",") if c.split()[0] in ("path", "y", "width", *kept.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                image, _ = guarded(parse, bytes(content), limits)
                done = guarded(decode, image, linear)[0] if image else None
                if done:
                    flat = {name: done[k].reshape(image.size[0], -1) for k, name in kept.items()}
                    for y in range(0, image.size[0], 256):  # a few rows at a time
                        part = slice(y, min(y + 256, image.size[0]))
                        more = {name: list(v[part] if name == "samples" else v[part].astype(np.int32)) for name, v in flat.items()}
                        yield pd.DataFrame({"path": path, "y": range(part.start, part.stop), "width": image.size[1]} | more)

    return files.select("path", "content").mapInPandas(run, schema)


DESCRIPTION = "path string, classification string, container string, codec int, width long, height long, channels int, error string"


def description(data: bytes, limits: Limits = Limits()) -> dict:  # noqa: B008
    """What a file is and whether it can be decoded: supported, recognized-unsupported or not recognized; broken files are errors."""
    if data[:4] == b"FOVb":
        return {"classification": "recognized-unsupported", "container": "X3f"}
    if len(data) > limits.max_input_bytes:
        raise DecodeError("ResourceLimit")
    unknown = {"classification": "not recognized", "container": "Unknown"}
    if data[:2] not in (b"II", b"MM"):
        return unknown
    if len(data) < 8:
        raise DecodeError("Truncated")
    if data[:4] in (b"II+\0", b"MM\0+"):
        return unknown
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise DecodeError("InvalidContainer")
    facts = tiff.probe(data, limits)
    if facts["container"] != "Dng":
        return unknown
    _, error = guarded(parse, data, limits)
    if error not in (None, "UnsupportedFormat", "UnsupportedFeature"):
        raise DecodeError(error)
    size = {"width": facts["width"], "height": facts["height"], "channels": facts["samples_per_pixel"], "codec": CODEC.get(facts["compression"], 0)}
    return {"classification": "recognized-unsupported" if error else "supported", "container": "Dng"} | size


def description_table(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per file with its description or error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, error = guarded(description, bytes(content), limits)
                rows.append({"path": path, "error": error} | (found or {}))
            yield frame(rows, DESCRIPTION)

    return files.select("path", "content").mapInPandas(run, DESCRIPTION)


def preview_table(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(path, jpeg, error): the first reduced-size JPEG of each file, null without one."""
    schema = "path string, jpeg binary, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, error = guarded(lambda b: preview(tiff.walk(b, limits), b), bytes(content))
                rows.append({"path": path, "jpeg": found, "error": error})
            yield frame(rows, schema)

    return files.select("path", "content").mapInPandas(run, schema)


GAINS = "path string, dir_ord int, tag_id int, points array<int>, spacing array<double>, origin array<double>, weights array<double>, gamma double, gains array<float>, error string"


def gain_table(tags: DataFrame) -> DataFrame:
    """One row per profile gain table of a tag table, which has the byte order in `byte_order`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, k, ident, data, order in zip(pdf["path"], pdf["dir_ord"], pdf["tag_id"], pdf["data"], pdf["byte_order"], strict=True):
                found, error = guarded(opcode_list.profile_table, int(ident), bytes(data), "<" if order == "II" else ">")
                rows.append({"path": path, "dir_ord": k, "tag_id": ident, "error": error} | {n: list(v) if isinstance(v, tuple) else v for n, v in (found or {}).items()})
            yield frame(rows, GAINS)

    return tags.filter("tag_id IN (52525, 52544)").select("path", "dir_ord", "tag_id", "data", "byte_order").mapInPandas(run, GAINS)


OPCODES = "path string, list int, ord int, kind string, bounds array<long>, plane int, planes int, pitch array<int>, params array<double>, skipped int, error string"


def opcode_table(tags: DataFrame) -> DataFrame:
    """One row per operation of each opcode list of a tag table, or one per list with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ident, data in zip(pdf["path"], pdf["tag_id"], pdf["data"], strict=True):
                which = (51008, 51009, 51022).index(int(ident)) + 1
                found, error = guarded(opcode_list.parse, bytes(data))
                if error:
                    rows.append({"path": path, "list": which, "error": error})
                for k, op in enumerate(found[0] if found else ()):
                    a = op.area
                    rows.append({"path": path, "list": which, "ord": k, "kind": op.kind, "bounds": list(a.bounds), "plane": a.plane, "planes": a.planes, "pitch": list(a.pitch), "params": [float(v) for v in op.params], "skipped": found[1]})
            yield frame(rows, OPCODES)

    return tags.filter("tag_id IN (51008, 51009, 51022)").select("path", "tag_id", "data").mapInPandas(run, OPCODES)


def frame_marker(data: bytes) -> int:
    """The first of the frame markers C0 to C3 of a JPEG."""
    if data[:2] != b"\xff\xd8":
        raise DecodeError("InvalidContainer")
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise DecodeError("InvalidContainer")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            raise DecodeError("Truncated")
        mark, at = data[at], at + 1
        if 0xC0 <= mark <= 0xC3:
            return mark
        if at + 2 > len(data):
            raise DecodeError("Truncated")
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2:
            raise DecodeError("InvalidContainer")
        at += size
    raise DecodeError("Truncated")


def mask_table(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per semantic mask, or one per file with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, error = guarded(lambda b: masks(parse(b, limits)), bytes(content))
                rows += [{"path": path, "error": error}] if error else [{"path": path, "error": None} | m for m in found]
            yield frame(rows, MASK_SCHEMA)

    return files.select("path", "content").mapInPandas(run, MASK_SCHEMA)
