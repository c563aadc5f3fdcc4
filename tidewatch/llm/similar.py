"""Groups of texts that share 80 % or more of their five-word shingles.

SimHash alone doesn't reach 0.8: such a pair differs by about ten of 64 bits. Candidates come from SimHash links (4 bits) and from
`BANDS` keys of `ROWS` minima of the shingles each, of which a pair at 0.8 shares none once in 350. Candidates only decide which texts are
compared: the shingle sets of each group of candidates are brought together, once per set, and compared exactly. A group with more than `HELD`
bytes of shingles is dealt into blocks, each pair of blocks is one task, and reports spanning edges only.

Texts with the same shingles are one node, named by a hash of the set, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, mapped, mixed, text_steps
from tidewatch.llm.components import components
from tidewatch.llm.simhash import SEED, links, majorities, shingle_hashes

WORDS, BANDS, ROWS, HELD = 5, 32, 8, 32 << 20
_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of every text of a binary array, in order."""
    return [np.unique(np.array(shingle_hashes(text, WORDS), np.uint64)) for text in col.to_pylist()]


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED) for own in sets], np.uint64).view(np.int64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of keys per set; sets share a key where all minima of a band are the same."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    full = np.nonzero([len(own) for own in sets])[0]
    if len(full):
        flat = np.concatenate([sets[k] for k in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
        for b in range(BANDS):
            key = np.full(len(full), b, np.uint64)
            for r in range(b * ROWS, (b + 1) * ROWS):
                key = mixed(key + mixed(np.minimum.reduceat((flat ^ _SHIFTS[r]) * _FACTORS[r], starts)))
            out[full, b] = key
    return out


def joined(sets: list[np.ndarray]) -> np.ndarray:
    """The first index of each set's group, where sets that share 80 % (of their union) are linked."""
    size = np.array([len(own) for own in sets], np.int64)
    out, left = np.arange(len(sets)), np.nonzero(size)[0]
    if not len(left):
        return out
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [place[e - n : e] for e, n in zip(ends, size)]
    seen = np.zeros(len(words), bool)
    flat, starts = np.concatenate([own[k] for k in left]), np.concatenate([[0], np.cumsum(size[left])[:-1]])
    queue: list[int] = []
    while len(left):
        if not queue:
            first = int(left[0])
            queue, left = [first], left[1:]
            flat, starts = flat[size[first] :], starts[1:] - size[first]
            continue
        x = queue.pop()
        seen[own[x]] = True
        both = np.add.reduceat(seen[flat], starts, dtype=np.int64)
        seen[own[x]] = False
        near = 9 * both >= 4 * (size[x] + size[left])  # both / (all of either) >= 0.8, in integers
        if near.any():
            out[left[near]] = first
            queue.extend(left[near].tolist())
            flat = flat[np.repeat(~near, size[left])]
            left = left[~near]
            starts = np.concatenate([[0], np.cumsum(size[left])[:-1]]).astype(np.int64)
    return out


def similar(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(doc_id, text_hash, node, component) of every row of docs (doc_id, text) that has an id; component: a name of the group."""
    rows = docs.filter("doc_id IS NOT NULL").selectExpr("cast(doc_id AS long) AS doc_id", "xxhash64(text) AS text_hash", "text")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, col in text_steps(batches):
            sets = shingle_sets(col)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sets).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_hash"), pa.array(set_names(sets)), pa.array(majorities(sets).view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), keys], ["doc_id", "text_hash", "node", "fp", "size", "keys"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, col in text_steps(batches):
            sets = shingle_sets(col)
            yield pa.RecordBatch.from_arrays([pa.array(set_names(sets)), pa.array([own.tobytes() for own in sets], pa.binary())], ["node", "shingles"])

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"node": node, "component": node[joined([np.frombuffer(own, np.uint64) for own in pdf["shingles"]])]})

    marked = cut(mapped(rows, marks, "doc_id long, text_hash long, node long, fp long, size long, keys array<long>"))
    nodes = cut(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    keys = nodes.select("node", F.explode("keys").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").select("key", "b")
    edges = keys.join(least, "key").select(F.col("node").alias("a"), "b")
    named = cut(nodes.groupBy("fp").agg(F.min("node").alias("b")))
    edges = edges.unionAll(nodes.join(named, "fp").select(F.col("node").alias("a"), "b"))
    near = links(named.select("fp")).join(named.select(F.col("fp").alias("a"), F.col("b").alias("ra")), "a").join(named.select(F.col("fp").alias("b"), F.col("b").alias("rb")), "b")
    group = cut(components(edges.unionAll(near.select("ra", "rb"))).withColumnRenamed("component", "group_id"))
    asked = nodes.select("node", "doc_id").join(group, "node").select("doc_id").distinct()
    sets = mapped(rows.join(asked, "doc_id", "left_semi").select("text"), contents, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sizes = group.join(nodes.select("node", "size"), "node").groupBy("group_id").agg(F.sum(8 * F.col("size") + 64).alias("size")).withColumn("blocks", F.ceil(F.col("size") / held))
    sets = group.join(sets, "node")
    large = sizes.filter("blocks > 1").select("group_id", "blocks")
    if large.isEmpty():
        found = sets.groupBy("group_id").applyInPandas(exact, "node long, component long")
    else:
        found = sets.join(large, "group_id", "left_anti").groupBy("group_id").applyInPandas(exact, "node long, component long")
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        dealt = sets.join(large, "group_id").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        edges = cut(dealt.groupBy("group_id", "low", "high").applyInPandas(exact, "node long, component long").filter("node <> component").distinct())
        found = found.unionAll(components(edges.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return marked.select("doc_id", "text_hash", "node").join(found, "node", "left").select("doc_id", "text_hash", "node", F.coalesce("component", "node").alias("component"))
