"""Tiles, interleaving, orientation and bit packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_tiles(px: DataFrame, tile_height: int, tile_width: int, tiles_across: int, padding: int = 0) -> DataFrame:
    """(image_id, plane, tile, samples): the samples of each tile in row order, short tiles filled up with `padding`."""
    ty, tx = F.expr(f"y div {tile_height}"), F.expr(f"x div {tile_width}")
    place = (F.col("y") % tile_height) * tile_width + F.col("x") % tile_width
    tiled = px.select("image_id", "plane", (ty * tiles_across + tx).alias("tile"), place.cast("int").alias("i"), "code")
    found = tiled.groupBy("image_id", "plane", "tile").agg(F.collect_list(F.struct("i", "code")).alias("m"))
    # only tiles at a border lack samples
    size = tile_height * tile_width
    lacking = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.transform("m", lambda s: s["i"]))
    filler = F.transform(lacking, lambda i: F.struct(i.alias("i"), F.lit(padding).cast(px.schema["code"].dataType).alias("code")))
    whole = F.array_sort(F.when(F.size("m") == size, F.col("m")).otherwise(F.concat("m", filler)))
    return found.select("image_id", "plane", "tile", F.transform(whole, lambda s: s["code"]).alias("samples"))


def assemble_tiles(tiles: DataFrame, tile_height: int, tile_width: int, tiles_across: int, height: int, width: int) -> DataFrame:
    """Pixels of tiles without their padding; narrow, one pass over the tiles."""
    flat = tiles.select("image_id", "plane", "tile", F.posexplode("samples").alias("i", "code"))
    y = F.expr(f"(tile div {tiles_across}) * {tile_height} + i div {tile_width}")
    x = F.expr(f"(tile % {tiles_across}) * {tile_width} + i % {tile_width}")
    out = flat.select("image_id", "plane", y.cast("long").alias("y"), x.cast("int").alias("x"), "code")
    return out.filter((F.col("y") < height) & (F.col("x") < width))


def interleaved_source(stored: Column, length: int, factor: int) -> Column:
    """The place in the image of a stored index when phases 0..factor-1 stand one after another, each with stride factor."""
    whole, more = divmod(length, factor)  # the first `more` phases have one row more
    head = more * (whole + 1)
    early = F.floor(stored / (whole + 1))
    late = F.floor((stored - head) / whole) + more if whole else F.lit(0)
    phase = F.when(stored < head, early).otherwise(late)
    within = F.when(stored < head, stored - early * (whole + 1)).otherwise(stored - head - (late - more) * whole if whole else F.lit(0))
    return (within * factor + phase).cast("long")


def uninterleave(px: DataFrame, height: int, width: int, row_factor: int, column_factor: int) -> DataFrame:
    """Pixels at the places they had before row and column interleaving; arithmetic only."""
    y, x = interleaved_source(F.col("y"), height, row_factor), interleaved_source(F.col("x"), width, column_factor)
    return px.select("image_id", "plane", y.alias("y"), x.cast("int").alias("x"), "code")


def unoriented(px: DataFrame, orientation: int, height: int, width: int) -> DataFrame:
    """Pixels of an image of height x width (as stored) back from display orientation 1 to 8."""
    y, x = F.col("y"), F.col("x")
    last_y, last_x = height - 1, width - 1
    # display (y, x) -> stored (y, x); from 5 on the display is transposed
    to = {1: (y, x), 2: (y, last_x - x), 3: (last_y - y, last_x - x), 4: (last_y - y, x), 5: (x, y), 6: (last_y - x, y), 7: (last_y - x, last_x - y), 8: (x, last_x - y)}[orientation]
    return px.select("image_id", "plane", to[0].cast("long").alias("y"), to[1].cast("int").alias("x"), "code")


def pack_12(codes: DataFrame) -> DataFrame:
    """(key, i, byte) of 12-bit codes (key, i, code), two to three bytes; a last single code takes two."""
    even = F.col("i") % 2 == 0
    base = F.expr("(i div 2) * 3")
    first = F.when(even, F.array(F.struct(base.alias("i"), F.shiftright("code", 4).alias("b")), F.struct((base + 1).alias("i"), F.shiftleft(F.col("code").bitwiseAND(F.lit(15)), 4).alias("b"))))
    second = F.array(F.struct((base + 1).alias("i"), F.shiftright("code", 8).alias("b")), F.struct((base + 2).alias("i"), F.col("code").bitwiseAND(F.lit(255)).alias("b")))
    parts = codes.select("key", F.explode(F.coalesce(first, second)).alias("p"))
    return parts.groupBy("key", F.col("p.i").alias("i")).agg(F.bit_or("p.b").alias("byte"))


def unpack_bits(rows: DataFrame, bits: int, count: int) -> DataFrame:
    """(.., i, code) from rows of packed bytes `bytes` array<int>, most significant bit first; bits 8 to 16.

    A code spans at most three bytes: they are joined to 24 bits and shifted.
    """
    start = F.col("i") * bits
    first = F.floor(start / 8).cast("int")
    at = lambda k: F.coalesce(F.try_element_at("bytes", first + k), F.lit(0)).cast("long")
    joined = at(1) * 65536 + at(2) * 256 + at(3)
    code = F.call_function("shiftright", F.col("joined"), (F.lit(24 - bits) - start % 8).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))
    keys = [c for c in rows.columns if c != "bytes"]
    wide = rows.select(*keys, "bytes", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")).withColumn("joined", joined)
    return wide.select(*keys, "i", code.alias("code"))
