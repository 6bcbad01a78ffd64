"""What the operators share: a folder all executors reach, staged tables, global row numbers, Arrow pieces and joins with hot keys."""

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where nothing is set (tests on
    one machine) a temporary folder is made and set for the session; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="boutline-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/boutline/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written as a table in the shared folder and read again: lineage ends there, and a lost executor
    costs no earlier work."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES):
    """Slices of an Arrow batch of about ``limit`` bytes of text each; one longer text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(text))
    if batch.num_rows == 0:
        return
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


BATCH_BYTES, BATCH_OPTION = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches between executors and Python workers, which both sides hold outside the heap, unless the session
    names a bound. By rows alone a batch of long texts has tens of MB."""
    if BATCH_OPTION not in spark.conf.getAll:
        spark.conf.set(BATCH_OPTION, str(BATCH_BYTES))


def give_back() -> None:
    """Freed memory goes back to the system: a worker stays for later stages, whose workers need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def lean(run):
    """``run`` of a mapInArrow, with what its task freed given back at the end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def arrow_map(df: DataFrame, fn, schema: str, text: str | None = "text") -> DataFrame:
    """``fn(batch) -> dict of columns`` over pieces of bounded size (whole batches where no text is named), its result cast to
    ``schema`` (a DDL string)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text) if text else [batch]:
                out = fn(part)
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in target], schema=target)

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def numbered(df: DataFrame, order: list[str], label: str = "numbered") -> DataFrame:
    """``df`` (narrow rows) with ``_row``, its place from 0 in the order of ``order``. Rows are dealt out by ranges of the
    order and counted within their range; a range's base is the sum of the counts before it (one small row a range)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spark = df.sparkSession

    def count(batches):
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows))], names=[*b.schema.names, "_at"])
            at += b.num_rows

    part = ranged.withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields) + ", `_at` bigint"
    held = staged(part.mapInArrow(lean(count), schema), label)
    sizes = held.groupBy("_part").count()
    bases = prefix(sizes, "_part", {"_base": "count"}, spark)
    return held.join(bases.select("_part", "_base"), "_part").withColumn("_row", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def prefix(sizes: DataFrame, order: str, sums: dict[str, str], spark: SparkSession | None = None) -> DataFrame:
    """Exclusive prefix sums over the rows of a summary (one row a range or part, never a row a document)."""
    from pyspark.sql import Window

    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("*", *[F.coalesce(F.sum(col).over(before), F.lit(0)).cast("bigint").alias(name) for name, col in sums.items()])


HEAVY_KEYS = 2000


def skew_join(big: DataFrame, counted: DataFrame, key: str | list[str], rows: int) -> DataFrame:
    """Inner equi join of ``big`` with ``counted`` (one row a key, column ``_n`` = rows of ``big`` with that key). Keys with
    more than ``rows / HEAVY_KEYS`` rows are at most HEAVY_KEYS many, so they are broadcast; the others are shuffled."""
    least = max(1000, rows // HEAVY_KEYS)
    hot = counted.filter(F.col("_n") > least)
    heavy = big.join(F.broadcast(hot), key)
    keys = [key] if isinstance(key, str) else key
    light = big.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(counted.filter(F.col("_n") <= least), key)
    return heavy.unionByName(light)
