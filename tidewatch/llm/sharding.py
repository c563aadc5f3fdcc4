"""Sharding by a Feistel permutation over global row numbers.

Rows get gapless numbers 0..n-1. A Feistel network permutes the smallest even power of two that holds n; results beyond n are
permuted again (cycle walking), which leaves a permutation of 0..n-1. Place p goes to shard p mod shards, slot p div shards: shard
sizes differ by one row at most, slots have no gap, and both follow from the row number alone.

Defined results: rows may repeat (those that agree in all keys are numbered in any order), ids and texts may be null (they are keys like
any other); an empty table gives no rows; texts of any length are hashed by the JVM as they are; columns named row_number, shard or slot give
way to the results, those of documents other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, mapped, mixed
from tidewatch.llm.numbering import numbered

ROUNDS, SEED, SHARDS = 6, 20_240, 8


def permuted(numbers: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each row number under the permutation of 0..n-1 that the seed names."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed % (1 << 40)) * np.uint64(rounds))
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        a, b = out[walk] >> half, out[walk] & low
        for key in keys:
            a, b = b, a ^ (mixed(b + key) & low)
        out[walk] = (a << half) | b
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def sharded(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of the rows, plus row_number, shard and slot. The rows are read once and kept while they are counted."""
    kept = cut(rows.drop("row_number", "shard", "slot"))
    n = kept.count()
    with_numbers = numbered(kept, keys, "row_number")
    schema = with_numbers.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permuted(np.asarray(batch.column("row_number")), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], [*batch.schema.names, "shard", "slot"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "shard int", "slot long"])
    return mapped(with_numbers, run, fields)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (bytes of the text plus 1) and checksum of every document with its shard and slot; counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    return sharded(rows, ["doc_id", "size", "text_crc32", "_hash"], shards, seed)
