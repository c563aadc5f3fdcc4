"""SimHash near-duplicates: deletion-variant signatures.

Fingerprints link at `LINK_BITS` = 4 or fewer differing bits. 64 bits are cut into three segments: four differences can't put two
into each, so in one segment two linked fingerprints differ by at most one bit. Each segment is indexed once for each of its
bits with that bit as a wildcard; linked fingerprints then share a key, which an equality join finds and the whole fingerprint
verifies. A pair is reported under its first such key only.

Only distinct fingerprints are indexed. A key's fingerprints are read in sorted order as a stream; up to `RUN` of them are linked in
memory by spanning edges (not by all pairs). The fingerprints of a larger key are dealt into blocks of about `RUN`; each pair of blocks is one
task's stream, so none holds more than two blocks.

Defined results: null and empty texts have the fingerprint zero and link like any other; rows without a doc_id get a fingerprint
and the component of that fingerprint, but don't name or join components; repeated rows give repeated results; texts of any length are
hashed whole; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, mapped, mixed, partitions, text_steps
from tidewatch.llm.components import components

LINK_BITS, SHINGLE, SEED, RUN = 4, 4, 42, 1 << 15
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 of each run of k words (of the whole sequence, if shorter; none without words)."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(line, SEED)]
    starts = list(accumulate([len(w) + 1 for w in words], initial=0))
    return [h(line[a : b - 1], SEED) for a, b in zip(starts, starts[k:])]


def fingerprints(col: pa.Array) -> np.ndarray:
    """The fingerprint of every text of a binary array."""
    return majorities([np.array(shingle_hashes(text), np.uint64) for text in col.to_pylist()])


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """The bits that most hashes of each array have."""
    size = np.array([len(own) for own in hashes], np.int64)
    out = np.zeros(len(size), np.uint64)
    full = np.nonzero(size)[0]
    if not len(full):
        return out
    flat, at, lo = np.concatenate(hashes), np.concatenate([[0], np.cumsum(size[full])]), 0
    ones = np.zeros((len(full), 64), np.int64)
    while lo < len(full):  # so many hashes at once that their bits stay small; a longer text is summed in parts
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 200_000, "right")) - 1)
        if hi == lo + 1:
            for s in range(at[lo], at[hi], 200_000):
                ones[lo] += np.unpackbits(flat[s : min(s + 200_000, at[hi])].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            bits = np.unpackbits(flat[at[lo] : at[hi]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[lo:hi] = np.add.reduceat(bits, at[lo:hi] - at[lo], axis=0, dtype=np.int32)
        lo = hi
    bits = 2 * ones > size[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _cut_bits(bits: list[int]) -> list[list[int]]:
    a, b = -(-len(bits) // 3), -(-2 * len(bits) // 3)
    return [bits[:a], bits[a:b], bits[b:]]


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << x for x in bits))


SEGMENTS = _cut_bits(list(range(64)))
_TABLES = [(s, p) for s in range(3) for p in SEGMENTS[s]]


def _variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.empty((len(_TABLES), len(fps)), np.int64)
    for t, (s, p) in enumerate(_TABLES):
        low = np.uint64(SEGMENTS[s][0])
        keys[t] = ((fps & (_mask(SEGMENTS[s]) & ~_mask([p]))) >> low).astype(np.int64) | (t << 32)
    return keys.ravel(), np.tile(fps, len(_TABLES))


def _reported(x: np.ndarray, table: int) -> np.ndarray:
    """Whether differences x link, and whether this table is the first that holds the pair."""
    s, p = _TABLES[table]
    good = np.bitwise_count(x) <= LINK_BITS
    for e in range(s):
        good &= np.bitwise_count(x & _mask(SEGMENTS[e])) > 1
    return good if p == SEGMENTS[s][0] else good & ((x & _mask(SEGMENTS[s])) != 0)


def _spanning(fps: np.ndarray, table: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links of these fingerprints connect, fewer than there are fingerprints."""
    a, b, left = [], [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= LINK_BITS if table is None else _reported(left ^ x, table)
            if near.any():
                new = left[near]
                a.append(np.full(len(new), x, np.uint64))
                b.append(new)
                queue.extend(new)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def _small_runs(keys: np.ndarray, fps: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; length: of the run from each row on."""
    a, b, d = [], [], 1
    at = np.nonzero(length > 1)[0]
    table = (keys >> 32).astype(np.int64)
    seg = np.array([s for s, _ in _TABLES])
    first = np.array([p == SEGMENTS[s][0] for s, p in _TABLES])
    masks = np.array([_mask(x) for x in SEGMENTS])
    while len(at):
        x = fps[at] ^ fps[at + d]
        t = table[at]
        good = np.bitwise_count(x) <= LINK_BITS
        for e in range(2):
            good &= (seg[t] <= e) | (np.bitwise_count(x & masks[e]) > 1)
        good &= first[t] | ((x & masks[seg[t]]) != 0)
        a.append(fps[at[good]])
        b.append(fps[at[good] + d])
        d += 1
        at = at[length[at] > d]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


SMALL = 8
_PAIR = "kind int, key long, a long, b long"


def _rows(kind: int, a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.zeros(len(a), np.int64) if key is None else key), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "key", "a", "b"])


def _link(first: bool, run_length: int = RUN):
    """Turns a stream that is sorted by (key, part) into links (kind 0) and, at first, members of too large keys (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        state = {"large": None}

        def finish(keys, parts, fps):
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])
            at = np.nonzero(new)[0]
            sizes = np.diff(np.append(at, len(keys)))
            if first:
                ends = np.repeat(at + sizes, sizes)
                small = np.repeat(sizes <= SMALL, sizes)
                a, b = _small_runs(keys, fps, np.where(small, ends - np.arange(len(keys)), 0))
                yield _rows(0, a, b)
            for s, n in zip(at[sizes > (SMALL if first else 1)], sizes[sizes > (SMALL if first else 1)]):
                own = slice(s, s + n)
                if first and n > run_length:
                    yield _rows(1, fps[own], fps[own], keys[own])
                else:
                    yield _rows(0, *_spanning(np.sort(fps[own]), int(keys[s]) >> 32 if first else None))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, parts = (np.asarray(batch.column(c)) for c in ("key", "part"))
            fps = np.asarray(batch.column("fp")).view(np.uint64)
            if state["large"] is not None:  # a key that was too large before goes on
                n = len(keys) if (keys == state["large"]).all() else int(np.argmin(keys == state["large"]))
                if n:
                    yield _rows(1, fps[:n], fps[:n], keys[:n])
                keys, parts, fps = keys[n:], parts[n:], fps[n:]
                if not len(keys):
                    continue
                state["large"] = None
            if held:
                keys, parts, fps = (np.concatenate(x) for x in zip(*held, (keys, parts, fps)))
            tail = int(np.argmax((keys == keys[-1]) & (parts == parts[-1])))
            if tail:
                yield from finish(keys[:tail], parts[:tail], fps[:tail])
            held = [(keys[tail:].copy(), parts[tail:].copy(), fps[tail:].copy())]
            if first and len(keys) - tail > run_length:
                yield _rows(1, held[0][2], held[0][2], held[0][0])
                state["large"], held = int(keys[-1]), []
        if held:
            yield from finish(*held[0])

    return run


def links(distinct: DataFrame, run_length: int = RUN) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints `fp` whose graph connects what all links of 4 bits or fewer connect."""
    n = partitions(distinct.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp")).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                keys, own = _variants(fps[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.zeros(len(keys), np.int64)), pa.array(own.view(np.int64))], ["key", "part", "fp"])

    def linked(rows: DataFrame, first: bool) -> DataFrame:
        return cut(mapped(rows.repartition(n, "key", "part").sortWithinPartitions("key", "part"), _link(first, run_length), _PAIR))

    out = linked(mapped(distinct.select("fp"), index, "key long, part long, fp long"), True)
    found, large = out.filter("kind = 0").select("a", "b"), out.filter("kind = 1").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return found
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / run_length).alias("blocks"))
    dealt = large.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.shiftleft(F.least("own", "other"), 31) + F.greatest("own", "other")
    return found.unionAll(linked(dealt.select("key", part.alias("part"), "fp"), False).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints(col).view(np.int64))], ["doc_id", "fp"])

    marked = cut(mapped(docs.selectExpr(f"cast(`{id_col}` AS long) AS doc_id", f"`{text_col}` AS text"), run, "doc_id long, fp long"))
    named = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"))
    pairs = links(named)
    ends = pairs.join(named.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(named.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    found = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    by_fp = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(by_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
