"""File sources and sinks: replay files, match documents, gauge tracks, derived tables, text bundles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAUGE = "t double, gauge_p1 int, gauge_p2 int, assemble_p1 int, assemble_p2 int"


def scan_files(spark, folder: str, pattern: str, limit: int | None = None) -> DataFrame:
    """Files below a folder by name pattern, sorted by path; content stays unread unless selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    listed = files.orderBy("path")
    return listed if limit is None else listed.limit(limit)


def write_documents(documents: DataFrame, folder: str) -> None:
    """The documents as the source of truth, one folder per patch."""
    documents.withColumn("patch", F.coalesce("match.patch", F.lit("unknown"))).write.mode("overwrite").partitionBy("patch").json(folder)


def read_documents(spark, folder: str, schema) -> DataFrame:
    """Documents of a declared schema; unreadable ones keep their text in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder)


def write_slices(spark, rows: DataFrame, folder: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``rows`` touches."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def read_gauge(spark, folder: str) -> DataFrame:
    """Gauge tracks with a declared schema; an empty cell is unknown."""
    return spark.read.schema(GAUGE).option("header", "true").csv(folder)


def write_gauge(rows: DataFrame, folder: str) -> None:
    rows.select("t", "gauge_p1", "gauge_p2", "assemble_p1", "assemble_p2").write.mode("overwrite").option("header", "true").csv(folder)


def write_bundles(lines: DataFrame, folder: str) -> None:
    """Text lines in order, one folder per capture. ``lines(video, id, line)``."""
    ordered = lines.repartitionByRange("video", "id").sortWithinPartitions("video", "id")
    ordered.select("video", F.col("line").alias("value")).write.mode("overwrite").partitionBy("video").text(folder)
