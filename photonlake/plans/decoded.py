"""Queries that run through the real decoders: raw files are built out of the tables, decoded, and compared with these.

The virtual sensor is cut into files of equal height (the largest number of rows up to 32 that divides the sensor's, or all
rows); other files have a row of `part` or 64 rows of `customer` each.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.operators import metadata
from photonlake.plans import encode, virtual
from photonlake.session import table
from photonlake.sources import camf, dng, tiff, x3f
from photonlake.sources.files import plane_bytes

FILES = "path string, content binary"
SEEDS = (100, 2000, 4000)


def file_rows(height: int) -> int:
    return max((k for k in range(2, 33) if height % k == 0), default=height)


def _built(rows: DataFrame, key: str, build: Callable[..., bytes]) -> DataFrame:
    """(path, content): build(key, ...) of each row, path is the key."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(str(r[0]), build(*r)) for r in zip(*[pdf[n] for n in names], strict=True)], columns=["path", "content"])

    return rows.select(key, *[n for n in names if n != key]).mapInPandas(run, FILES) if names[0] == key else _built(rows.select(key, *[n for n in names if n != key]), key, build)


def _sensor_files(spark: SparkSession, d: str, build: Callable[[int, np.ndarray], bytes]) -> DataFrame:
    """A file for each cut of the virtual sensor; a group has file_rows rows."""
    rows = max(1, file_rows(virtual.height(spark, d)))
    codes = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 2048).cast("long"))
    lines = table(spark, d, "embeddings").select(F.expr(f"vec_id div {rows}").alias("image_id"), F.struct(F.col("vec_id").alias("y"), codes.alias("codes")).alias("line"))
    images = lines.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list("line")), lambda r: r["codes"]).alias("codes"))
    return _built(images, "image_id", lambda i, codes: build(int(i), np.array([list(r) for r in codes], np.int64)))


def _keyed_files(spark: SparkSession, d: str, build: Callable[[int], bytes]) -> DataFrame:
    # keys are a few bytes, so a file of them is one task, and what is built of them is not
    keys = table(spark, d, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return _built(keys, "p_partkey", lambda k: build(int(k)))


def _image_id() -> F.Column:
    return F.col("path").cast("long").alias("image_id")


def _flat(lines: DataFrame, samples: str, name: str, *more: str) -> DataFrame:
    """(image_id, .., y, x, channel, value) of scanlines of interleaved samples."""
    out = lines.select(_image_id(), *more, F.col("y").cast("long").alias("y"), F.posexplode(samples).alias("i", name))
    return out.select("image_id", *more, "y", F.expr("cast(i div 3 as int)").alias("x"), F.expr("i % 3").alias("channel"), name)


# -- X3F


def _calibration(i: int) -> bytes:
    return encode.text_entry("Tag", f"image {i}")


def _quattro(i: int, px: np.ndarray) -> bytes:
    raw = encode.raw_section([px[:, 32:], px[:, :32], px], 0x25, SEEDS, False)
    camera = encode.calibration_section(_calibration(i), 5, 77)
    return encode.container([(b"IMA2", raw), (b"CAMF", camera), (b"IMA2", encode.preview_section(encode.preview(None)))], 0x40002)


def _merrill(i: int, px: np.ndarray) -> bytes:
    raw = encode.raw_section([px, 4095 - px, px[::-1]], 0x1E, SEEDS, True)
    return encode.container([(b"IMA2", raw), (b"CAMF", encode.calibration_section(_calibration(i), 4, 77))], 0x30000)


def _planes(files: DataFrame, geometry: dict) -> DataFrame:
    lines = x3f.scanline_table(x3f.section_table(files), geometry).filter("error is null")
    px = lines.select(_image_id(), "plane", F.col("y").cast("long").alias("y"), F.posexplode("samples").alias("x", "code"))
    return px.withColumn("code", F.col("code").cast("long"))


def x3f_planes(spark, d):
    """Three planes of two sizes out of entropy-coded sections."""
    rows = file_rows(virtual.height(spark, d))
    return _planes(_sensor_files(spark, d, _quattro), {0x25: ([(32, rows), (32, rows), (64, rows)], (64, rows))})


def x3f_planes_merrill(spark, d):
    """Three planes of one size."""
    rows = file_rows(virtual.height(spark, d))
    return _planes(_sensor_files(spark, d, _merrill), {0x1E: ([(64, rows)] * 3, None)})


def plane_files(spark, d):
    """The scanlines of the decoded top plane as written out: little-endian 16-bit samples."""
    lines = plane_bytes(x3f_planes(spark, d).filter("plane = 2"))
    return lines.select("image_id", "y", F.hex("bytes").alias("bytes"))


FORMATS = [(0x40002, 0x25), (0x40001, 0x23), (0x30000, 0x1E), (0x40002, 0x27)]


def _sections(k: int) -> bytes:
    version, form = FORMATS[k % 4]
    raw = b"SECi" + encode.u32s(0x20000, 1, form, 64, 64, 0)
    camera = encode.calibration_section(_calibration(k), (4 if form == 0x1E else 5) if k % 5 else 2, k % 256)
    jpeg = encode.preview(k % 13 if k % 3 else None, "<" if k % 2 else ">")
    parts = [(b"IMA2", raw), (b"CAMF", camera), (b"IMA2", encode.preview_section(jpeg))]
    return encode.container(parts if k % 7 else parts[:1], version)


def x3f_sections(spark, d):
    """Version, sensor, sections, EXIF and light source of containers; every seventh lacks its calibration."""
    found = x3f.section_table(_keyed_files(spark, d, _sections))
    size = lambda c: F.octet_length(c).cast("long")
    return found.select(_image_id(), "version", "sensor", size("raw").alias("raw_bytes"), size("jpeg").alias("jpeg_bytes"), size("exif").alias("exif_bytes"), F.col("light_source").cast("long").alias("light_source"), "error")


def x3f_calibration(spark, d):
    """Calibration bytes where the section's type is the one that the sensor has; every fifth file has another."""
    found = x3f.calibration_table(x3f.section_table(_keyed_files(spark, d, _sections)))
    good = camf.entry_table(found.filter("error is null")).select("path", "name", "kind", "text")
    bad = found.filter("error is not null").select("path", "error", F.col("decoded").isNull().alias("empty"))
    both = found.select("path").join(good, "path", "left").join(bad, "path", "left")
    return both.select(_image_id(), "name", "kind", "text", "error", "empty")


# -- calibration entries


def _entries(key: int, keys, names) -> bytes:
    keys, names = np.array(keys, np.int64), list(names)
    entries = [
        encode.text_entry("Head", f"block {key}: {names[0]}"),
        encode.property_entry("Names", {f"k{k}": n for k, n in zip(keys[:9], names[:9], strict=True)}),
        encode.matrix_entry("Keys", 1, [len(keys)], keys),
        encode.matrix_entry("Signed", 0, [len(keys)], keys % 30000 - 15000),
        encode.matrix_entry("Bytes", 5, [len(keys)], keys % 256),
        encode.matrix_entry("Shorts", 6, [1, len(keys)], keys % 65536),
        encode.matrix_entry("Floats", 3, [1, 1, len(keys)], keys / 4),
    ]
    return encode.calibration_section(b"".join(entries), (2, 4, 5)[key % 3], 11 + key % 100)


def _calibrations(spark, d) -> DataFrame:
    """Entries of a calibration section for each 64 customers, of type 2, 4 or 5 in turn."""
    rows = table(spark, d, "customer").select(F.expr("c_custkey div 64").alias("key"), F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")).alias("c"))
    blocks = rows.groupBy("key").agg(F.array_sort(F.collect_list("c")).alias("c"))
    files = _built(blocks.select("key", F.transform("c", lambda c: c["k"]).alias("keys"), F.transform("c", lambda c: c["n"]).alias("names")), "key", _entries)
    return camf.entry_table(files.withColumnRenamed("content", "camf"))


def camf_texts(spark, d):
    found = _calibrations(spark, d)
    return found.select(_image_id(), "ord", "name", "kind", "text", F.size("dims").alias("n_dims"), F.size("vals").alias("n_values"), "error")


def camf_properties(spark, d):
    found = _calibrations(spark, d).filter("kind = 'Properties'")
    return found.select(_image_id(), F.explode("props").alias("key", "value"))


def camf_matrices(spark, d):
    found = _calibrations(spark, d).filter("kind = 'Matrix'")
    return found.select(_image_id(), "name", F.posexplode("vals").alias("i", "value"))


def calibration_values(spark, d):
    """A lookup that wants exactly 64 values: the first and last block have fewer."""
    found = camf.values_of(_calibrations(spark, d), "Keys", 64)
    return found.select(_image_id(), F.aggregate("vals", F.lit(0.0), lambda s, v: s + v).alias("total"), "error")


def calibration_property(spark, d):
    """A key that one block only has."""
    found = camf.property_of(_calibrations(spark, d), "Names", "k65")
    return found.select(_image_id(), "value", "error")


# -- TIFF and DNG


def _probed(k: int) -> bytes:
    width, height, kind = k % 50 + 1, k % 7 + 1, k % 8
    order = ">" if kind == 6 else "<"
    tags = encode.raw_tags(width, height, 16, order=order) | {322: encode.value(4, [width], order), 323: encode.value(4, [height], order)}
    if kind == 2:
        del tags[50706], tags[50707]
    if kind == 7:
        tags[271] = encode.value(2, "Other")
    data = encode.tiff([{"tags": tags, "blocks": [b"\1\2" * (3 * width * height)]}], order)
    return {0: b"FOVb" + encode.u32s(0x40002) + b"rest", 3: b"II+\0" + data[4:], 4: b"plain text", 5: data[:60]}.get(kind, data)


def probe_files(spark, d):
    """Container, facts and classification of files of eight sorts."""
    files = _keyed_files(spark, d, _probed)
    probed = tiff.probe_table(files).select("path", "container", "version", "byte_order", "width", "height", F.col("bits_per_sample")[0].alias("bits"), "is_linear_raw", "has_tiles", "make", F.col("error").alias("probe_error"))
    told = dng.description_table(files).select("path", "classification", "codec", "channels", "error")
    return probed.join(told, "path").select(_image_id(), *[c for c in probed.columns if c != "path"], "classification", "codec", "channels", "error")


def _tagged(k: int) -> bytes:
    order = "<" if k % 2 else ">"
    v = lambda kind, *values: encode.value(kind, values, order)
    root = {254: v(4, 1), 256: v(4, 8), 257: v(4, 4), 271: encode.value(2, "Apple"), 305: encode.value(2, f"part {k}"), 50706: (1, bytes([1, 4, 0, 0])), 50728: v(5, 0.5, 1.0, k % 9 / 4), 50730: v(10, -(k % 7) / 8)}
    raw = encode.raw_tags(k % 40 + 1, 3, 16, order=order) | {50717: v(4, k, k + 1, k + 2), 50719: v(12, k / 8, 0.25), 50720: v(11, 1.5, 2.5)}
    return encode.tiff([{"tags": root}, {"tags": raw, "blocks": [b"x"]}, {"tags": {254: v(4, 4), 256: v(3, k % 300)}}], order, {0: [1, 2]})


def tiff_tags(spark, d):
    """Typed values of every directory's tags: a root, and two directories under it."""
    tags = tiff.tag_table(_keyed_files(spark, d, _tagged)).filter("tag_id IN (254, 256, 271, 305, 50717, 50719, 50720, 50728, 50730)")
    return tags.select(_image_id(), "dir_ord", F.col("parent_offset").isNull().alias("is_root"), "tag_id", "field_type", "count", "byte_order", F.element_at("numbers", -1).alias("last"), "text", "error")


def tiff_lookups(spark, d):
    """The root's, the raw image's and single tags by name."""
    # all look-ups in one pass, for each would build and parse every file again
    tags = tiff.tag_table(_keyed_files(spark, d, _tagged)).select("path", "dir_ord", "ifd_offset", "tag_id", "numbers").withColumn("is_raw", tiff.is_raw())
    pick = lambda where, ident: F.max(F.when(where & (F.col("tag_id") == ident), F.element_at("numbers", 1)))
    root, raw = F.col("dir_ord") == 0, F.col("is_raw")
    found = {"root_width": pick(root, 256), "raw_width": pick(raw, 256), "white": pick(raw, 50717), "n_root": F.count_if(F.col("ifd_offset") == 8)}
    whole = tags.groupBy("path").agg(*[v.alias(n) for n, v in found.items()]).dropna().filter("n_root > 0")
    return whole.select(_image_id(), *found)


def _blocks(px: np.ndarray, height: int, width: int, one: Callable[[np.ndarray], bytes]) -> list[bytes]:
    """Tiles of px (rows, columns, channels) in row order, filled up with their edges."""
    down, across = -(-px.shape[0] // height), -(-px.shape[1] // width)
    full = np.pad(px, ((0, down * height - px.shape[0]), (0, across * width - px.shape[1]), (0, 0)), mode="edge")
    return [one(full[y * height : (y + 1) * height, x * width : (x + 1) * width]) for y in range(down) for x in range(across)]


def _rgb(px: np.ndarray) -> np.ndarray:
    return px[:, :63].reshape(len(px), 21, 3)


def _coded(i: int, px: np.ndarray) -> bytes:
    """One of six ways to store the same samples."""
    rgb, kind = _rgb(px), i % 6
    rows, order = len(rgb), ">" if kind == 2 else "<"
    v = lambda t, *values: encode.value(t, values, order)
    flat = lambda bits: lambda p: encode.plain_rows(p.reshape(len(p), -1), bits, order)
    if kind == 0:  # 12-bit strips
        tags, blocks = encode.raw_tags(21, rows, 12) | {278: v(4, 5)}, [flat(12)(rgb[y : y + 5]) for y in range(0, rows, 5)]
    elif kind == 1:  # 14-bit tiles with padding
        tags, blocks = encode.raw_tags(21, rows, 14) | {322: v(4, 8), 323: v(4, 6)}, _blocks(rgb, 6, 8, flat(14))
    elif kind == 2:  # 16 bits, most significant byte first
        tags, blocks = encode.raw_tags(21, rows, 16, order=order) | {322: v(4, 16), 323: v(4, 16)}, _blocks(rgb, 16, 16, flat(16))
    elif kind == 3:  # planes one after another
        tags, blocks = encode.raw_tags(21, rows, 12, planar=2) | {322: v(4, 10), 323: v(4, 7)}, [b for c in range(3) for b in _blocks(rgb[:, :, c : c + 1], 7, 10, flat(12))]
    elif kind == 4:  # rows by threes and columns by twos
        stored = rgb[dng.interleaved_order(rows, 2 if rows < 3 else 3)][:, dng.interleaved_order(21, 2)]
        tags, blocks = encode.raw_tags(21, rows, 12) | {322: v(4, 21), 323: v(4, rows), 50975: v(4, 2 if rows < 3 else 3), 52547: v(4, 2)}, [flat(12)(stored)]
    else:  # lossless JPEG strips
        tags, blocks = encode.raw_tags(21, rows, 12, 7) | {278: v(4, 4)}, [encode.sof3(rgb[y : y + 4], 12, 4) for y in range(0, rows, 4)]
    return encode.tiff([{"tags": tags, "blocks": blocks}], order)


def dng_codes(spark, d):
    """Samples out of strips, tiles, planes, interleaved rows and columns, of 12 to 16 bits."""
    lines = dng.linear_table(_sensor_files(spark, d, _coded), linear=False, with_flags=False)
    return _flat(lines, "codes", "code").withColumn("code", F.col("code").cast("long"))


def _lossless(i: int, px: np.ndarray) -> bytes:
    """Tiles under predictor 1 to 7 in turn, restarts and a point transform in some."""
    rgb, kind, restart = _rgb(px), i % 7 + 1, (0, 4)[i % 2]
    tags = encode.raw_tags(21, len(rgb), 12, 7) | {322: encode.value(4, [9]), 323: encode.value(4, [8])}
    point = 2 if i % 3 == 2 else 0
    return encode.tiff([{"tags": tags, "blocks": _blocks(rgb, 8, 9, lambda p: encode.sof3(p, 12, kind, restart, point))}])


def dng_lossless(spark, d):
    """Lossless JPEG tiles; a point transform of two bits drops these."""
    lines = dng.linear_table(_sensor_files(spark, d, _lossless), linear=False, with_flags=False)
    return _flat(lines, "codes", "code").withColumn("code", F.col("code").cast("long"))


def _linear(i: int, px: np.ndarray) -> bytes:
    """A linearization table, levels and three opcode lists; every fourth file has a trim, every fifth a fractional crop, every seventh an unknown optional opcode."""
    rgb, v = _rgb(px), lambda t, *values: encode.value(t, values)
    rows = len(rgb)
    table = np.arange(4096) * 2
    polynomial = encode.area((0, 0, 0, 0), 0, 2) + struct.pack(">I2d", 1, 0.0625, 0.75)
    scale = encode.area((0, 0, rows, 21), 1, 2, (1, 1)) + struct.pack(f">I{21}f", 21, *[0.5 + (x % 4) / 8 for x in range(21)])
    codes = encode.area((0, 0, 0, 0), 2, 1) + struct.pack(">I", 4096) + (np.arange(4096) // 2 * 2).astype(">u2").tobytes()
    third = [(8, polynomial)] + ([(99, b"what", 1)] if i % 7 == 0 else [])
    if i % 4 == 0:
        third.append((6, struct.pack(">4I", 0, 1, rows, 20)))
    tags = encode.raw_tags(21, rows, 12) | {322: v(4, 21), 323: v(4, rows), 50712: v(3, *table.tolist()), 50714: v(3, 64, 32, 16), 50717: v(3, 8064, 8032, 8016), 50719: v(5, 0.5 if i % 5 == 0 else 1.0, 0.0), 50720: v(5, 18.0, 1.0)}
    tags |= {51008: (7, encode.opcode_list((7, codes))), 51009: (7, encode.opcode_list((13, scale))), 51022: (7, encode.opcode_list(*third)), 274: v(3, i % 8 + 1)}
    return encode.tiff([{"tags": tags, "blocks": [encode.plain_rows(rgb.reshape(rows, -1), 12)]}])


def dng_linear(spark, d):
    """Linear samples after tables, levels and opcodes."""
    out = _flat(dng.linear_table(_sensor_files(spark, d, _linear), with_codes=False, with_flags=False), "samples", "v")
    # a shift between two values of the grid that the samples lie on, so that single precision rounds alike
    return out.withColumn("v", F.round(F.col("v").cast("double") + 0.00000859375, 4))


def dng_flags(spark, d):
    out = _flat(dng.linear_table(_sensor_files(spark, d, _linear), linear=False, with_codes=False), "flags", "flags")
    return out.groupBy("image_id", "channel", "flags").agg(F.count("*").alias("n"))


def dng_states(spark, d):
    """Geometry and states without decoding, and what the older interface says."""
    found = dng.image_table(_sensor_files(spark, d, _linear))
    state = lambda k: F.element_at("states", F.lit(k)).alias(k)
    area = [F.element_at("valid_area", 2).alias("left"), F.element_at("valid_area", 4).alias("right")]
    states = [state(k) for k in ("linearization", "default_crop", "opcode_list_1", "opcode_list_3", "demosaic")]
    turned = F.element_at("states", F.lit("orientation")).alias("orientation_state")
    return found.select(_image_id(), "width", "height", *area, F.element_at("crop_origin", 1).alias("crop_x"), F.element_at("whole_origin", 1).alias("whole_x"), "orientation", *states, turned, "legacy_error", "error")


def opcode_lists(spark, d):
    """The operations of every list."""
    ops = dng.opcode_table(tiff.tag_table(_sensor_files(spark, d, _linear)))
    return ops.select(_image_id(), "list", "ord", "kind", F.element_at("bounds", 4).alias("right"), "plane", "planes", F.size("params").alias("n_params"), F.round(F.aggregate("params", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), "skipped", "error")


def _with_extras(i: int, px: np.ndarray) -> bytes:
    """A raw image, a preview and a mask, which is lossless JPEG or plain by turns."""
    rgb, v = _rgb(px), lambda t, *values: encode.value(t, values)
    rows, mask = len(rgb), (px & 255)[:, :, None]
    raw = {"tags": encode.raw_tags(21, rows, 16) | {322: v(4, 21), 323: v(4, rows)}, "blocks": [encode.plain_rows(rgb.reshape(rows, -1), 16)]}
    small = {"tags": {254: v(4, 1), 259: v(3, 7), 262: v(3, 6), 278: v(4, 1)}, "blocks": [b"\xff\xd8" + bytes([i % 200]) * (i % 9 + 2) + b"\xff\xd9"]}
    blocks = _blocks(mask, 8, 16, lambda p: encode.sof3(p, 8, 1) if i % 2 else p.astype(np.uint8).tobytes())
    tags = {254: v(4, 65540), 256: v(4, 64), 257: v(4, rows), 258: v(3, 8), 259: v(3, 7 if i % 2 else 1), 262: v(3, 52527), 277: v(3, 1), 322: v(4, 16), 323: v(4, 8), 52526: encode.value(2, "Sky"), 52528: encode.value(2, f"m{i}"), 52536: v(4, i, 2, 66, i + rows)}
    return encode.tiff([raw, small, {"tags": tags, "blocks": blocks}])


def dng_masks(spark, d):
    """Semantic masks sample by sample."""
    found = dng.mask_table(_sensor_files(spark, d, _with_extras))
    values = F.transform(F.sequence(F.lit(1), F.octet_length("samples")), lambda i: F.conv(F.hex(F.substring("samples", i, F.lit(1))), 16, 10).cast("long"))
    flat = found.select(_image_id(), "name", "instance_id", F.element_at("sub_area", 1).alias("top"), "width", F.posexplode(values).alias("i", "v"))
    return flat.select("image_id", "name", "instance_id", "top", F.expr("cast(i div width as bigint)").alias("y"), F.expr("i % width").alias("x"), "v")


def dng_previews(spark, d):
    found = dng.preview_table(_sensor_files(spark, d, _with_extras))
    return found.select(_image_id(), F.hex("jpeg").alias("jpeg"), "error")


def _profiled(k: int) -> bytes:
    order, kind = "<" if k % 2 else ">", k % 4
    gains = {0: [k % 250 + 1 + j for j in range(4)], 1: [100 * (k % 600) + 1000 + j for j in range(4)], 2: [0.5 + j / 4 for j in range(4)], 3: [1 + k / 64 + j for j in range(4)]}[kind]
    data = encode.profile_table((1, 2, 2), (0.5, 0.25), (0.0, 0.125), (0.25, 0.5, 0.125, 0.0625, 0.0625), gains, kind, 1.5, 0.5, 2.5, order)
    tags = encode.raw_tags(4, 4, 16, order=order)
    return encode.tiff([{"tags": tags | {52544: (7, data)}, "blocks": [b"x"]}], order)


def profile_tables(spark, d):
    """Gains stored as bytes, shorts, halves and floats."""
    found = dng.gain_table(tiff.tag_table(_keyed_files(spark, d, _profiled)))
    flat = found.select(_image_id(), F.element_at("points", 3).alias("n"), F.col("spacing")[1].alias("step"), "gamma", F.posexplode("gains").alias("i", "gain"))
    gain, kind = F.col("gain").cast("double"), F.col("image_id") % 4
    stored = F.when(kind == 0, F.round((gain - 0.5) * 127.5)).when(kind == 1, F.round((gain - 0.5) * 32767.5)).otherwise(gain)
    return flat.withColumn("gain", stored)


def _calibrated(k: int) -> bytes:
    """Each calibration tag in two of three files' first directory, and all in the raw image's, which does not count."""
    tags = [*metadata.CALIBRATION_TAGS]
    root = {256: encode.value(4, [8]), 50706: (1, bytes([1, 7, 1, 0]))} | {t: encode.value(10, [k % 16 / 8 - 1, j / 4]) for j, t in enumerate(tags) if (k + j) % 3}
    raw = encode.raw_tags(2, 2, 16) | {t: encode.value(10, [9.0]) for t in tags}
    return encode.tiff([{"tags": root | {254: encode.value(4, [1])}}, {"tags": raw, "blocks": [b"x"]}])


def calibration_tags(spark, d):
    """The fifteen calibration tags of the first directory, side by side."""
    tags = tiff.tag_table(_keyed_files(spark, d, _calibrated)).select(_image_id(), "dir_ord", "tag_id", F.col("numbers").alias("value"))
    wide = metadata.pivot_tags(tags, metadata.CALIBRATION_TAGS)
    return wide.select("image_id", *[F.aggregate(n, F.lit(0.0), lambda s, v: s + v).alias(n) for n in metadata.CALIBRATION_TAGS.values()])


def capabilities(spark, d):
    """The codecs that can be decoded here: bits 1 lossless JPEG, 2 JPEG XL, 4 plain, 8 lossy JPEG; two need an installed codec."""
    built_in = F.lit(1 + 4 + sum({52546: 2, 34892: 8}[c] for c in dng.CODECS)).cast("long")
    return table(spark, d, "region").select("r_regionkey", built_in.alias("bits"))


QUERIES = {
    f.__name__: f
    for f in (
        x3f_planes, x3f_planes_merrill, plane_files, x3f_sections, x3f_calibration, camf_texts, camf_properties, camf_matrices, calibration_values, calibration_property,
        probe_files, tiff_tags, tiff_lookups, dng_codes, dng_lossless, dng_linear, dng_flags, dng_states, opcode_lists, dng_masks, dng_previews, profile_tables, calibration_tags,
        capabilities,
    )
}
