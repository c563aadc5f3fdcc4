"""Exact top-k search by distributed histogram selection.

Candidates are packed into blocks where they lie and stay there. Queries go to them in groups of at most `GROUP` bytes of vectors, whatever
the table's size. For a group, round by round, each task scores its blocks (matrix products of integers), counts the scores per query in `BINS` equal
bins of that query's current interval, and reports its bins from the top until they hold k scores (lower ones can't hold the k-th).
Summed up, the counts tell in which bin the k-th highest score lies, and that bin is the next interval, until it holds a single
integer. Then scores above the k-th value and, among its ties, the smallest ids are taken (k ties of a block at most, so neither copies nor
hot vectors multiply rows), and the group's rows are appended to the result. Vectors are never shuffled but for the dealing of the queries.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; shorter vectors count
as padded with zeros; rows that share the query's id are its own and no candidates; query rows that repeat an id are answered
together (k results in all); candidates that repeat an id count row by row; a query with fewer than k candidates gets them all; only the
two named columns are read. Products are exact whatever the size of finite components; scores beyond 64 bits count as 2^63 - 1 or
-(2^63 - 1), and tie there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, mapped, shared_folder

K, SCALE, EVERY, BINS, ROWS, TILE = 5, 256, 50, 1024, 4096, 128
#: Bytes of query vectors, and queries, that go to all tasks at once.
GROUP, QUERIES = 16 << 20, 8192
TOP = 2**63 - 1
_RESULT = "query_id long, vec_id long, score long"


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter("id IS NOT NULL AND vec IS NOT NULL").filter(~bad)


def _matrix(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """The scaled whole numbers, rows padded with zeros; a product beyond the range of doubles counts as the largest double."""
    size = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(size), int(size.max(initial=0))))
    with np.errstate(over="ignore"):
        out[np.arange(out.shape[1]) < size[:, None]] = np.clip(np.floor(scale * np.asarray(vectors.flatten())), -1.7e308, 1.7e308)
    return out


def _pack(rows: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                whole = _matrix(part.column("vec"), scale)
                ids = np.asarray(part.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([whole.tobytes()], pa.binary()), pa.array([whole.shape[1]], pa.int32()), pa.array([_norm(whole)])], ["ids", "data", "dim", "norm"])

    return run


def _norm(x: np.ndarray) -> float:
    """The largest length of a row, infinite where its square leaves the range."""
    with np.errstate(over="ignore"):
        return float(np.sqrt((x**2).sum(axis=1)).max(initial=0))


_BLOCK = "ids binary, data binary, dim int, norm double"


def scored(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The inner products of rows of whole numbers, exact, those beyond 64 bits as the nearest of TOP and -TOP."""
    high = np.abs(q).max(initial=0), np.abs(c).max(initial=0)
    terms = max(q.shape[1], 1)
    if high[0] * high[1] * terms < 2**53:  # a sum of doubles is exact
        return (q @ c.T).astype(np.int64)
    if high[0] * high[1] * terms < 2**62:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    out = np.empty((len(q), len(c)), np.int64)
    large_q, large_c = (np.abs(x).max(axis=1, initial=0) for x in (q, c))
    with np.errstate(over="ignore"):
        few_q, few_c = large_q * high[1] * terms < 2**62, large_c * high[0] * terms < 2**62
    ok_q, ok_c = np.nonzero(few_q)[0], np.nonzero(few_c)[0]
    if len(ok_q):
        out[ok_q] = _products(q[ok_q], c)
    rest = np.nonzero(~few_q)[0]
    out[np.ix_(rest, ok_c)] = _products(q[rest], c[ok_c])
    big = np.nonzero(~few_c)[0]
    out[np.ix_(rest, big)] = _products(q[rest], c[big])
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By 64-bit integers where no product can leave them, else by integers of any length."""
    if not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**62:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object)
    return np.clip(whole(q) @ whole(c).T, -TOP, TOP).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], group: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block, some queries at a time: which queries, the candidates' ids, which pairs count, and the scores."""
    qid, q = group
    for batch in batches:
        for ids, data, dim in zip(*(batch.column(k).to_pylist() for k in ("ids", "data", "dim"))):
            cid = np.frombuffer(ids, np.int64)
            c = np.frombuffer(data, np.float64).reshape(-1, dim)
            wide = max(q.shape[1], dim)
            own, c = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, c))
            for lo in range(0, len(qid), TILE):
                part = slice(lo, min(lo + TILE, len(qid)))
                yield part, cid, cid[None, :] != qid[part, None], scored(own[part], c)


def _count(k: int, width: int, shared):
    """A task's counts of scores by bin, per query from the top until k scores are reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qid, q), low = shared.value
        every = np.zeros((len(qid), BINS + 1), np.int64)  # the last bin: above the interval
        for part, _, ok, scores in _tiles(batches, (qid, q)):
            # differences of 64-bit integers, as unsigned ones
            bins = np.minimum((scores.view(np.uint64) - low[part, None].view(np.uint64)) // np.uint64(width), np.uint64(BINS)).astype(np.int64)
            bins[~ok | (scores < low[part, None])] = BINS + 1
            n = len(bins)
            every[part] += np.bincount((bins + (BINS + 2) * np.arange(n)[:, None]).ravel(), minlength=n * (BINS + 2)).reshape(n, -1)[:, : BINS + 1]
        down = every[:, ::-1]
        at, b = np.nonzero((down > 0) & (np.cumsum(down, axis=1) - down < k))
        for lo in range(0, len(at), 100_000):
            i, j = at[lo : lo + 100_000], b[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array((BINS - j).astype(np.int32)), pa.array(down[i, j])], ["qi", "bin", "n"])

    return run


def _take(k: int, shared):
    """Scores above each query's k-th value, and the k smallest ids among those that equal it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, low = shared.value
        for part, cid, ok, scores in _tiles(batches, group):
            at = low[part, None]
            q, c = np.nonzero(ok & (scores > at))
            tq, tc = np.nonzero(ok & (scores == at))
            by = np.lexsort((cid[tc], tq))
            tq, tc = tq[by], tc[by]
            few = np.arange(len(tq)) - np.searchsorted(tq, tq, "left") < k
            q, c = np.concatenate([q, tq[few]]), np.concatenate([c, tc[few]])
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(group[0][part][q]), pa.array(cid[c]), pa.array(scores[q, c])], ["query_id", "vec_id", "score"])

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _kth(cands: DataFrame, group: tuple[np.ndarray, np.ndarray], bound: int, k: int) -> np.ndarray:
    """Each query's k-th highest score (the lower bound of scores, if it has fewer candidates)."""
    sc, width = cands.sparkSession.sparkContext, 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    low = np.full(len(group[0]), -bound, np.int64)
    while width:
        shared = sc.broadcast((group, low))  # at most GROUP bytes
        counts = mapped(cands, _count(k, width, shared), "qi int, bin int, n long").groupBy("qi", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("qi").orderBy(F.desc("bin"))
        # the first bin from the top with k scores; an interval that holds fewer keeps its start
        found = counts.withColumn("total", F.sum("n").over(down)).filter(F.col("total") >= k).groupBy("qi").agg(F.max("bin").alias("bin")).toPandas()  # a row a query of the group
        moved = [int(a) + int(b) * width for a, b in zip(low[found["qi"]], found["bin"])]
        low[found["qi"]] = moved
        shared.destroy()
        width //= BINS
    return low


def top_k(vectors: DataFrame, is_query: str, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row that satisfies the SQL condition `is_query` on `id`."""
    spark = vectors.sparkSession
    valid = _valid(vectors, id_col, vec_col)
    cands = cut(mapped(valid, _pack(ROWS, scale), _BLOCK))
    asked = valid.filter(is_query)
    n, dim = asked.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    each = max(1, min(queries, GROUP // (8 * max(dim, 1))))
    groups = -(-n // each)
    # each partition's rows go round the groups, so a group has at most a row a partition more than its share, whatever the ids
    dealt = cut(asked.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))) if groups > 1 else asked.withColumn("group", F.lit(0))
    norm = cands.agg(F.max("norm")).first()[0] or 0.0
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    for g in range(groups):  # a round of jobs over all candidates for each bounded group of queries
        own = dealt.filter(F.col("group") == g).select("id", "vec").toArrow()
        if not own.num_rows:
            continue
        chunk = own.combine_chunks().to_batches()[0]
        group = np.asarray(chunk.column("id")), _matrix(chunk.column("vec"), scale)
        with np.errstate(over="ignore"):
            limit = norm * _norm(group[1])
        bound = int(limit) + 1 if limit < 2.0**62 else TOP  # of any score, by Cauchy and Schwarz
        shared = spark.sparkContext.broadcast((group, _kth(cands, group, bound, k)))
        _best(mapped(cands, _take(k, shared), _RESULT), k).write.mode("append").parquet(folder)
    hits = spark.read.schema(f"{_RESULT}, rank int").parquet(folder)
    if groups > 1:  # rows of one query id may have gone to several groups
        hits = _best(hits.drop("rank"), k)
    return hits.select("query_id", "rank", "vec_id", "score")
