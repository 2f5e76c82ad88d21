"""Image directories as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.ordered import numbered as in_order

#: Extensions in any letter case.
PATTERN = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All images below a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", True).load(folder)


def stream(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", PATTERN).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)


def reading_order(path: Column) -> Column:
    """Sort key of a depth-first walk that reads a folder's files before its subfolders, each by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), p))


def numbered(files: DataFrame, path: str) -> DataFrame:
    """files with their place (from 1) in the reading order of all paths."""
    return in_order(files.withColumn("order_", reading_order(F.col(path))), ["order_"], "place").drop("order_")
