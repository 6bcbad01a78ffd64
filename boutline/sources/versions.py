"""Tables that change together: whole versions behind one manifest.

A store is a folder with a few tables, each cut into buckets by the hash of a key. Every change writes only the buckets it touches, into new
folders, and then publishes a manifest that says where each table's buckets are; the manifest is one small file, and readers take the newest
one, so they see all tables before the change or all after it. Buckets that did not change are shared between versions. A batch is
published under its id, so a batch that runs again changes nothing, and every earlier version can be read and restored."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, batch string, tbl string, bucket int, path string"
BUCKETS = 64


class PartialSweep(ValueError):
    """A sweep that did not process all that is required may not replace what is stored."""


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Every published version, one row a table and bucket."""
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    if not home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{folder}/_manifest")


def current(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """``version, batches`` (ids published so far) and ``paths`` (table -> bucket -> folder) of the newest or a given version. There are
    as many rows as buckets and tables."""
    all_ = manifests(spark, folder)
    heads = {r["version"]: r["batch"] for r in all_.select("version", "batch").distinct().collect()}
    at = max(heads, default=0) if version is None else version
    if at and at not in heads:
        raise KeyError(f"no version {at}")
    paths: dict[str, dict[int, str]] = {}
    for r in all_.filter(F.col("version") == at).filter("tbl is not null").collect():
        paths.setdefault(r["tbl"], {})[r["bucket"]] = r["path"]
    return {"version": at, "newest": max(heads, default=0), "batches": {b for b in heads.values() if b}, "paths": paths}


def _publish(spark: SparkSession, folder: str, version: int, batch: str | None, paths: dict[str, dict[int, str]]) -> int:
    rows = [(version, batch, t, b, p) for t, of in paths.items() for b, p in of.items()] or [(version, batch, None, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").json(f"{folder}/_manifest/{version:012d}")
    return version


def _read(spark: SparkSession, paths, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, folder: str, name: str, schema, version: int | None = None) -> DataFrame:
    """A table of the newest or a given version."""
    return _read(spark, sorted(current(spark, folder, version)["paths"].get(name, {}).values()), schema)


def replace_keys(spark: SparkSession, folder: str, tables: dict[str, DataFrame], key: str, touched: DataFrame, batch: str | None = None, buckets: int = BUCKETS) -> int:
    """All rows of the ``touched`` keys in every one of ``tables`` replaced by the given ones, as one new version; returns its number.
    A key without new rows loses its stored ones. A ``batch`` that was published before changes nothing. Rows of other keys, or of none, in ``tables`` are an error."""
    now = current(spark, folder)
    if batch is not None and batch in now["batches"]:
        return now["version"]
    keys = touched.select(key).distinct()
    slot = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    hit = sorted(r[0] for r in keys.select(slot.alias("b")).distinct().collect())  # ``buckets`` numbers at most
    paths = {name: dict(of) for name, of in now["paths"].items()}
    run = f"v{now['newest'] + 1:012d}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        if not rows.select(key).join(keys, key, "left_anti").isEmpty():
            raise ValueError(f"{name} has rows of keys that are not touched")
        old = _read(spark, [paths[name][b] for b in hit if b in paths.get(name, {})], rows.schema)
        both = old.join(keys, key, "left_anti").unionByName(rows).withColumn("_bucket", slot)
        both.repartition("_bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy("_bucket").parquet(f"{folder}/{name}/{run}")
        there = {r[0] for r in spark.read.schema(both.schema).parquet(f"{folder}/{name}/{run}").select("_bucket").distinct().collect()}
        for b in hit:
            paths.setdefault(name, {}).pop(b, None)
            if b in there:
                paths[name][b] = f"{folder}/{name}/{run}/_bucket={b}"
    return _publish(spark, folder, now["newest"] + 1, batch, paths)


def restore(spark: SparkSession, folder: str, version: int) -> int:
    """An earlier version published again as the newest; what lies between stays readable."""
    old = current(spark, folder, version)
    return _publish(spark, folder, old["newest"] + 1, None, old["paths"])


def overwrite_slices(spark: SparkSession, folder: str, name: str, found: DataFrame, key: str, processed: DataFrame, required: DataFrame | None = None) -> int:
    """What was ``found`` in the ``processed`` slices in place of what is stored of them; other slices stay, the previous version too. Where
    ``required`` slices are named, a sweep that left one of them out is refused before anything is written."""
    if required is not None:
        missing = required.select(key).distinct().join(processed.select(key), key, "left_anti")
        n = missing.count()
        if n:
            raise PartialSweep(f"{n} of the required slices were not processed, the first is {missing.agg(F.min(key)).first()[0]}")
    return replace_keys(spark, folder, {name: found}, key, processed)


def ingest_batch(spark: SparkSession, folder: str, rows: DataFrame, key: str, build, batch: str, buckets: int = BUCKETS) -> int:
    """Raw ``rows`` of a batch join those stored of their keys, and ``build(raw) -> {table: rows}`` derives the tables of these keys
    from all of them, so a match whose rows come in several batches is whole after the last. Raw rows and tables are one version."""
    if batch in current(spark, folder)["batches"]:
        return current(spark, folder)["version"]
    keys = rows.select(key).distinct()
    stored = read_version(spark, folder, "raw", rows.schema).join(keys, key, "left_semi")
    raw = stored.unionByName(rows)
    return replace_keys(spark, folder, {"raw": raw, **build(raw)}, key, keys, batch, buckets)


def ingest_stream(source: DataFrame, folder: str, key: str, build, checkpoint: str, buckets: int = BUCKETS):
    """Every batch of a stream through `ingest_batch`, under the batch's number."""

    def store(rows: DataFrame, number: int) -> None:
        kept = rows.persist()  # read for its keys, its rows and each table
        try:
            if not kept.isEmpty():
                ingest_batch(kept.sparkSession, folder, kept, key, build, f"{checkpoint}#{number}", buckets)
        finally:
            kept.unpersist()

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


