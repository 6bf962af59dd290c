"""python -m photonlake.inspect PATH [FOLDER]: what X3F files hold; with a folder, their planes and calibration bytes as new files there."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.operators import metadata, stats
from photonlake.session import ship
from photonlake.sources import camf, files, x3f

SHOWN = 12  # values of a matrix that are printed


def sensor(content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything of X3F files (path, content) in one call: scanlines of the planes, calibration with its plain bytes, and sections with EXIF."""
    sections = x3f.section_table(content)
    return x3f.scanline_table(sections), x3f.calibration_table(sections), sections


def samples(lines: DataFrame) -> DataFrame:
    """(path, plane, y, x, code) of scanlines without an error."""
    flat = lines.filter("error is null").select("path", "plane", F.col("y").cast("long").alias("y"), F.posexplode("samples").alias("x", "code"))
    return flat.withColumn("code", F.col("code").cast("long"))


def report(content: DataFrame) -> list[str]:
    """Lines of text: the chosen white balance, the calibration's entries and sums of the planes of each file."""
    lines, calibration, sections = sensor(content)
    entries = camf.entry_table(calibration.filter("error is null"))
    setting = camf.property_of(entries, "CaptureSettings", "WhiteBalance").select("path", F.col("value").cast("int").alias("setting"))
    chosen = sections.select("path", "light_source").join(setting, "path", "left").select("path", metadata.white_balance(F.col("light_source"), F.col("setting")).alias("preset"))
    out = [f"{r['path']}\twhite balance\t{r['preset']}" for r in chosen.orderBy("path").toLocalIterator() if r["preset"]]
    shown = entries.select("path", "ord", "name", F.coalesce("text", F.to_json("props"), F.concat(F.to_json("dims"), F.lit(" "), F.to_json(F.slice("vals", 1, SHOWN)))).alias("value"))
    out += [f"{r['path']}\t{r['name']}\t{r['value']}" for r in shown.orderBy("path", "ord").toLocalIterator()]
    planes = stats.plane_stats(samples(lines).withColumnRenamed("path", "image_id"))
    out += [f"{r['image_id']}\tlayer {r['plane']}\t{r['width']}x{r['height']}, sum={r['sum']}, min={r['min']}, max={r['max']}" for r in planes.orderBy("image_id", "plane").toLocalIterator()]
    errors = lines.filter("error is not null").select("path", "error").unionByName(calibration.filter("error is not null").select("path", "error")).unionByName(sections.filter("error is not null").select("path", "error"))
    return out + [f"{r['path']}\terror\t{r['error']}" for r in errors.distinct().orderBy("path", "error").toLocalIterator()]


def dump(content: DataFrame, folder: str) -> list[str]:
    """Writes each file's planes and calibration bytes to new files; an existing one is an error."""
    lines, calibration, _ = sensor(content)
    base = F.regexp_extract("path", "([^/]*)$", 1)
    rows = files.plane_bytes(samples(lines).withColumnRenamed("path", "image_id"))
    parts = rows.select(F.concat(F.regexp_extract("image_id", "([^/]*)$", 1), F.lit("-layer-"), F.col("plane").cast("string"), F.lit(".u16le")).alias("name"), F.col("y").alias("ord"), "bytes")
    plain = calibration.filter("error is null").select(F.concat(base, F.lit("-calibration.bin")).alias("name"), F.lit(0).cast("long").alias("ord"), F.col("decoded").alias("bytes"))
    return files.write_new(parts.unionByName(plain), folder)


def main(arguments: list[str]) -> int:
    if not 1 <= len(arguments) <= 2:
        print("usage: python -m photonlake.inspect PATH [FOLDER]", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    content = files.read_files(spark, arguments[0])
    for line in dump(content, arguments[1]) if len(arguments) == 2 else report(content):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
