"""Container facts, tag pivots and lookups as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the formats: white balance by EXIF light source and by camera setting, codec numbers, status numbers.
LIGHT_SOURCE = {1: "Sunlight", 2: "Fluorescent", 3: "Incandescent", 4: "Flash", 9: "Sunlight", 10: "Overcast", 11: "Shade"}
CAMERA_SETTING = {1: "Auto", 2: "Sunlight", 3: "Shade", 4: "Overcast", 5: "Incandescent", 6: "Fluorescent", 7: "Flash", 8: "Custom", 12: "AutoLSP"}
CODEC = {7: 1, 52546: 2, 1: 3, 34892: 4}
STATUS = {
    "NotRecognized": 7,
    "UnsupportedFormat": 3,
    "UnsupportedFeature": 3,
    "ResourceLimit": 5,
    "Allocation": 6,
    "InvalidContainer": 4,
    "Truncated": 4,
    "InvalidOffset": 4,
    "InvalidTag": 4,
    "InvalidGeometry": 4,
}
BYTE_ORDER = {"II": 1, "MM": 2}
PROVENANCE = {"Unknown": 0, "EstimatedEncodedMaximum": 1, "Calibrated": 2}
CALIBRATION_TAGS = {
    50727: "analog_balance",
    50728: "as_shot_neutral",
    50729: "as_shot_white_xy",
    50721: "color_matrix_1",
    50722: "color_matrix_2",
    50964: "forward_matrix_1",
    50965: "forward_matrix_2",
    52531: "color_matrix_3",
    52532: "forward_matrix_3",
    50723: "camera_calibration_1",
    50724: "camera_calibration_2",
    52530: "camera_calibration_3",
    50778: "illuminant_1",
    50779: "illuminant_2",
    52529: "illuminant_3",
}


def lookup(key: Column, values: dict) -> Column:
    """A CASE over a few fixed values; null for any other key."""
    out = F.lit(None)
    for k, v in reversed(values.items()):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def white_balance(light_source: Column, camera_setting: Column) -> Column:
    """The photo's light source decides, else the camera's setting; null is an error."""
    return F.coalesce(lookup(light_source, LIGHT_SOURCE), lookup(camera_setting, CAMERA_SETTING))


def overlapping(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Byte ranges (start, length) that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(*keys).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("earlier_end", F.max(F.col("start") + F.col("length")).over(w)).filter(F.col("earlier_end") > F.col("start"))


def container(head: Column) -> Column:
    """The container by a file's first four bytes; a TIFF is a DNG only once its first directory has the version tag."""
    magic = F.hex(F.substring(head, 1, 4))
    return F.when(magic == "464F5662", "X3f").when(magic.isin("49492A00", "4D4D002A"), "Tiff").otherwise("Unknown")


def pivot_tags(tags: DataFrame, names: dict[int, str]) -> DataFrame:
    """One row per image with the value of each named tag of the root directory, by conditional aggregation."""
    return tags.filter(F.col("dir_ord") == 0).groupBy("image_id").agg(*[F.max(F.when(F.col("tag_id") == t, F.col("value"))).alias(n) for t, n in names.items()])


def budget_exceeded(items: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """items with the running total of their sizes and whether it is over budget."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(w)).withColumn("over", F.col("used") > budget)


def duplicate_tags(tags: DataFrame) -> DataFrame:
    """Directories that hold a tag twice."""
    return tags.groupBy("image_id", "dir_ord", "tag_id").agg(F.count("*").alias("n")).filter("n > 1")
