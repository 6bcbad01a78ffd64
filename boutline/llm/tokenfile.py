"""Token ids as flat unsigned integers in files, with 64-bit document offsets, read back through memory maps.

Documents are dealt out by ranges of doc_id, so part files hold ascending, disjoint ranges. Part P has two files:
``part-P.ids``, its documents' ids one after another as unsigned 16-bit integers (32-bit for vocabularies beyond 65,536
ids), and ``part-P.idx``, for each document its doc_id (int64) and where its ids end within the part (uint64, the highest bit set where there
is no doc_id). ``bases``, a small table of one row a part, holds the width of an id and the documents and ids of all parts before it, the
exclusive prefix sums of the parts' totals: a document's global start is its part's base plus its offset there.

A task writes under a name of its own and renames at its end, so a task that runs twice leaves one whole file."""

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.bytesops import text_bytes
from boutline.llm.common import fresh_path, pieces, prefix
from boutline.llm.units import library

NO_ID = np.int64(-(2**63))
ROWS = 16384


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, wide: bool | None = None) -> str:
    """Encodes each whole text (null: empty) with the tokenizers library, adds ``end_id`` and writes the files in ascending doc_id
    order (null ids first, repeated rows beside each other) below ``folder``; returns it. doc_id must be an integer. ``wide`` takes 32 bits
    an id; where it is None the vocabulary decides."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    needs = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) > 1 << 16
    if needs and wide is False:
        raise ValueError("this vocabulary needs 32 bits an id")
    wide = needs if wide is None else wide
    folder = folder or fresh_path(spark, "tokens")
    kind = np.dtype("<u4" if wide else "<u2")

    def write(batches):
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = {x: f"{root}/part-{part:07d}.{x}" for x in ("ids", "idx")}
        n_docs = n_ids = 0
        out = {}
        for batch in batches:
            for some in pieces(batch):
                out = out or {x: fs.open_output_stream(f"{name}.{own}") for x, name in names.items()}
                flat, bounds = library(vocabulary, True).ids(*text_bytes(some.column("text")))
                n = some.num_rows
                ids = np.insert(flat, bounds[1:], end_id).astype(kind)
                index = np.empty((n, 2), "<i8")
                doc_id = some.column("doc_id").cast(pa.int64())
                index[:, 0] = pa.compute.fill_null(doc_id, 0).to_numpy()
                index[:, 1] = n_ids + bounds[1:] + np.arange(1, n + 1)
                index[:, 1] |= np.where(doc_id.is_null().to_numpy(zero_copy_only=False), NO_ID, 0)
                out["ids"].write(ids)
                out["idx"].write(index)
                n_docs, n_ids = n_docs + n, n_ids + len(ids)
        for x, f in out.items():
            f.close()
            fs.move(f"{names[x]}.{own}", names[x])
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_ids": [n_ids]})

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    totals = ranged.mapInArrow(write, "part bigint, n_docs bigint, n_ids bigint")
    totals.write.parquet(f"{folder}/totals")
    held = spark.read.schema(totals.schema).parquet(f"{folder}/totals")
    prefix(held, "part", {"base_docs": "n_docs", "base_ids": "n_ids"}).withColumn("id_bytes", F.lit(kind.itemsize)).coalesce(1).write.parquet(f"{folder}/bases")
    return folder


def open_array(fs, path: str, kind):
    """``read(a, b)`` of values a to b of a flat file: a view of a memory map where the file system is local, else one ranged read."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        values = np.memmap(path, kind, "r")
        return lambda a, b: values[a:b]
    file, size = fs.open_input_file(path), np.dtype(kind).itemsize
    return lambda a, b: np.frombuffer(file.read_at((b - a) * size, a * size), kind)


def read_tokens(spark: SparkSession, folder: str, wide: bool | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document of the files, and ``ids`` if asked for. ``ids_crc32`` is that of the
    ids as little-endian unsigned 32-bit integers. The files know how wide an id is; ``wide``, where it is not None, must agree."""
    bases = spark.read.parquet(f"{folder}/bases")
    width = bases.agg(F.max("id_bytes")).first()[0] or 2
    if wide is not None and width != (4 if wide else 2) and not bases.isEmpty():
        raise ValueError(f"the files hold {8 * width}-bit ids")
    kind = f"<u{width}"

    def read(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for part, n_docs, base in (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("part", "n_docs", "base_ids")])):
            index, ids = (open_array(fs, f"{root}/part-{part:07d}.{x}", k) for x, k in (("idx", "<i8"), ("ids", kind)))
            last = 0
            for a in range(0, n_docs, ROWS):
                rows = index(2 * a, 2 * min(n_docs, a + ROWS)).reshape(-1, 2)
                ends = np.concatenate([[last], rows[:, 1] & ~NO_ID])
                last = int(ends[-1])
                doc = pa.array(rows[:, 0], mask=rows[:, 1] < 0)
                crcs, lists = [], []
                for x, y in zip(ends.tolist(), ends[1:].tolist()):
                    own = ids(x, y).astype("<u4")
                    crcs.append(zlib.crc32(own))
                    if with_ids:
                        lists.append(own.astype(np.int64))
                columns = {"doc_id": doc, "start": pa.array(base + ends[:-1]), "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(crcs, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(lists, pa.list_(pa.int64()))} if with_ids else {}))

    n = max(1, bases.count())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return bases.select("part", "n_docs", "base_ids").repartition(n, F.col("part")).mapInArrow(read, schema)
