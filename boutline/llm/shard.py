"""Sharding by a keyed permutation of global row numbers.

Rows are numbered from 0 in the order of (doc_id, text checksum, size). A balanced Feistel network over the smallest even number
of bits that holds all numbers permutes them; a result outside the table is put through again (cycle walking) until it
falls inside. Row r gets place p = permute(r): shard p mod k, slot p div k. So shard and slot of any row can be
computed from its number, the number of rows, k and the key alone, the order within shards is a reproducible
shuffle, and shards differ by one row at most whatever the sources, copies or sizes are."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import arrow_map, numbered

ROUNDS = 6


def permute(rows: np.ndarray, n: int, key: int) -> np.ndarray:
    """The permutation of 0 .. n-1 that ``key`` names, at the given places."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, h = np.uint64((1 << half) - 1), np.uint64(half)
    at = rows.astype(np.uint64)
    todo = np.arange(len(at))
    while len(todo):
        left, right = at[todo] >> h, at[todo] & low
        for i in range(ROUNDS):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & low)
        at[todo] = (left << h) | right
        todo = todo[at[todo] >= n]
    return at.astype(np.int64)


def unpermute(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse: which row lies at each place."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, h = np.uint64((1 << half) - 1), np.uint64(half)
    at = places.astype(np.uint64)
    todo = np.arange(len(at))
    while len(todo):
        left, right = at[todo] >> h, at[todo] & low
        for i in reversed(range(ROUNDS)):
            f = (left + np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right ^ ((f >> np.uint64(32)) & low), left
        at[todo] = (left << h) | right
        todo = todo[at[todo] >= n]
    return at.astype(np.int64)


def feistel_shards(docs: DataFrame, shards: int = 16, key: int = 1) -> DataFrame:
    """``doc_id, size, text_crc32, row, shard, slot`` for every row of ``docs``.

    size: UTF-8 bytes of the text (null: none) plus 1. Null ids come first in the numbering; rows alike in doc_id, checksum
    and size are interchangeable and get neighbouring numbers; an empty table gives an empty result; other columns of
    ``docs`` are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(narrow, ["doc_id", "text_crc32", "size"], "shard")
    n = rows.count()

    def place(batch):
        p = permute(batch.column("_row").to_numpy(), n, key)
        return {name: batch.column(name) for name in ("doc_id", "size", "text_crc32")} | {"row": batch.column("_row"), "shard": p % shards, "slot": p // shards}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, place, f"doc_id {kind}, size bigint, text_crc32 bigint, row bigint, shard int, slot bigint", text=None)
