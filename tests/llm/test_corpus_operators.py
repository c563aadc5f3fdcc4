"""Operators over whole tables, against brute force."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT, SF
from pyspark.sql import functions as F

from tidewatch.llm import sharding, simhash, suffix_dedup, topk
from tidewatch.llm.components import components
from tidewatch.llm.queries import QUERIES


def brute_components(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def linked(fps):
    return [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4]


@pytest.mark.parametrize("run", [1 << 15, 40])
def test_links_connect_what_is_within_four_bits(spark, run):
    """Also with keys that are too large to be held, so that they are indexed again."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(40):
            fps.add(int(s) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 7)), replace=False)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    pairs = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), run).collect()]
    got = brute_components([(a % 2**64, b % 2**64) for a, b in pairs])
    expected = brute_components([(fps[i], fps[j]) for i, j in linked(fps)])
    assert got == expected


def test_links_where_every_key_is_large(spark):
    """All fingerprints agree on 50 bits, so every key of the first indexes holds them all."""
    fps = [(0x0123456789ABCDEF & ~0x3FFF) | k * 3 % 0x4000 for k in range(0, 0x4000, 83)]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    pairs = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 64).collect()]
    assert brute_components([(a % 2**64, b % 2**64) for a, b in pairs]) == brute_components([(fps[i], fps[j]) for i, j in linked(fps)])


def test_near_duplicates_whole_table(spark):
    """Every column of the query against brute force."""
    import xxhash

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    docs = {r.doc_id: fingerprint(r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    group = brute_components([(ids[i], ids[j]) for i, j in linked([docs[k] for k in ids])])
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_near_dedup"](spark, SF).collect())
    assert got == [(i, f"{docs[i]:016x}", group.get(i, i)) for i in ids]


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, "A B C D E F G"), (None, "a b c d e f g"), (4, "something quite different is written here now")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component_id int, fp string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    by = {(i, f): c for i, f, c in got}
    assert [c for (i, _), c in by.items() if i in ("1", "2")] == [1, 1]
    assert {c for (i, _), c in by.items() if i in ("3", "9", "None")} == {3}
    assert len(got) == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# ---- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    place = sharding.permuted(np.arange(n), n)
    assert sorted(place.tolist()) == list(range(n))
    assert (sharding.permuted(np.arange(n)[::-1].copy(), n)[::-1] == place).all()
    if n > 100:
        assert (place != sharding.permuted(np.arange(n), n, seed=1)).mean() > 0.9


def test_shards(spark):
    docs = spark.createDataFrame([(i % 90 if i % 10 else None, None if i % 7 == 0 else f"text é {i % 40}", "c") for i in range(200)], "doc_id long, text string, shard string")
    got = sharding.shard_documents(docs).toPandas()
    sizes = got.groupby("shard").size()
    assert sorted(sizes) == [25] * 8
    assert all(sorted(own) == list(range(25)) for _, own in got.groupby("shard")["slot"])
    again = sharding.shard_documents(docs.repartition(7)).toPandas()
    keys = ["doc_id", "size", "text_crc32", "shard", "slot"]
    cols = lambda f: sorted(map(str, f[keys].fillna(-1).itertuples(index=False)))
    assert cols(got) == cols(again)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def brute_permuted(x, n):
    """The network as it is described, one number at a time."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    word = (1 << 64) - 1

    def spread(v):
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & word
        v = (v ^ v >> 27) * 0x94D049BB133111EB & word
        return v ^ v >> 31

    while True:
        a, b = x >> half, x & (1 << half) - 1
        for r in range(sharding.ROUNDS):
            a, b = b, a ^ spread(b + spread(r + 1 + sharding.SEED * sharding.ROUNDS) & word) & (1 << half) - 1
        x = a << half | b
        if x < n:
            return x


def test_sharding_query(spark):
    """Every column of the query over the whole table."""
    import zlib

    got = QUERIES["op7_sharding"](spark, SF).toPandas()
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = len(texts)
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in texts)
    assert sorted(got.slot * 8 + got.shard) == list(range(n))
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
    kept = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert sorted(kept.row_number) == list(range(n))
    assert all(brute_permuted(int(r.row_number), n) == r.slot * 8 + r.shard for r in kept.itertuples())
    keys = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, kept[keys].values.tolist())) == sorted(map(tuple, got[keys].values.tolist()))


def test_numbers_of_hot_buckets(spark):
    """Most rows agree in all keys: their numbers come from counts, and are the same set as those of a sort."""
    from tidewatch.llm.common import cut
    from tidewatch.llm.numbering import numbered

    rows = [(1 if i % 3 else i, None if i % 5 else "x") for i in range(600)]
    kept = cut(spark.createDataFrame(rows, "a long, b string").repartition(5))
    plain = sorted(map(tuple, numbered(kept, ["a", "b"], "n", per_bucket=1000).select("n", "a", "b").toPandas().astype(str).values.tolist()))
    assert sorted(r.n for r in numbered(kept, ["a", "b"], "n", per_bucket=20).collect()) == list(range(600))
    lead = F.when(F.col("b").isNull(), 1).otherwise(0)
    led = numbered(kept, ["a", "b"], "n", lead, 2, per_bucket=20).collect()
    assert sorted(r.n for r in led) == list(range(600))
    assert max(r.n for r in led if r.b) < min(r.n for r in led if r.b is None)
    again = sorted(map(tuple, numbered(cut(kept.repartition(3)), ["a", "b"], "n", per_bucket=1000).select("n", "a", "b").toPandas().astype(str).values.tolist()))
    assert again == plain


# ---- search


def test_top_k_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(120)] + [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan"), 0.0, 0.0, 0.0]), (450, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (500, [1e6, -1e6, 2.0, 0.0]), (501, [3.0]), (101, [9.0, 9.0, 9.0, 9.0])]
    frame = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, score int")
    valid = [(i, np.floor(256 * np.pad(np.array(v, float), (0, 4 - len(v)))).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    expected = []
    for q, (i, v) in enumerate(valid):
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in valid if j != i)[:5]
            expected += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    got = [tuple(r) for r in topk.top_k(frame, "id % 50 = 0").collect()]
    assert sorted(got) == sorted(expected)
    assert topk.top_k(frame.unionByName(frame.filter("vec_id = 100")), "id % 50 = 0").filter("query_id = 100").count() == 5
    assert topk.top_k(frame.limit(0), "id % 50 = 0").count() == 0
    assert topk.top_k(frame.filter("vec_id = 50"), "id % 50 = 0").count() == 0
    assert topk.top_k(frame.filter("vec_id IN (50, 51, 52)"), "id % 50 = 0").count() == 2


def brute_top_k(rows, every=50, k=5):
    whole = [(i, [int(np.floor(256.0 * x)) if abs(x) < 1e300 else int(np.clip(np.floor(256.0 * x), -1.7e308, 1.7e308)) for x in v]) for i, v in rows]
    top = 2**63 - 1
    out = []
    with np.errstate(over="ignore"):
        for i, v in whole:
            if i % every == 0:
                best = sorted((-max(-top, min(top, sum(a * b for a, b in zip(v, w)))), j) for j, w in whole if j != i)[:k]
                out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("large", [1e9, 1e15, 1e300])
def test_top_k_of_large_components(spark, large):
    """Exact beyond what doubles and 64-bit integers hold; scores beyond 64 bits tie at their bound."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(130)]
    rows += [(200, [large, 1.0, 0.0]), (201, [large, 2.0, 0.0]), (202, [-large, 1.0, 0.5]), (250, [large, -large, 1.0]), (203, [large / 3, large / 3 + 1.0, 7.0]), (300, [1.0, 1.0, 1.0]), (301, [1e7, -1e7, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(frame, "id % 50 = 0").collect())
    assert got == brute_top_k(rows)


def test_top_k_in_groups_of_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(400)] + [(400 + i, [0.25] * 5) for i in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(tuple(r) for r in topk.top_k(frame, "id % 10 = 0", queries=7).collect()) == brute_top_k(rows, every=10)
    twice = frame.unionByName(frame.filter("vec_id % 50 = 0")).repartition(4)
    got = topk.top_k(twice, "id % 10 = 0", queries=7).toPandas()
    assert (got.groupby("query_id").size() == 5).all() and (got.groupby("query_id")["rank"].max() == 5).all()
    plain = topk.top_k(twice, "id % 10 = 0").toPandas()
    key = lambda f: sorted(map(tuple, f[["query_id", "rank", "vec_id", "score"]].values.tolist()))
    assert key(got) == key(plain)


# ---- suffix arrays


def brute_dedup(rows):
    seen, out = {}, []
    for i, text in rows:
        for k in range(len(text) - 49):
            w = text[k : k + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 49):
            if seen[text[k : k + 50]] < i:
                gone[k : k + 50] = True
        rest = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((i, len(text), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def dedup(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, spans int, zip string")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(tuple(r) for r in suffix_dedup.deduplicated(frame).select(*cols).collect())


def test_dedup_small_cases(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared, periodic = word(80), "ab" * 200
    texts = [word(300), shared + word(40), word(30) + shared, shared[:60] + "x" + shared[10:], periodic, "q" + periodic[:150], "=" * 500, "=" * 120 + word(20), "=" * 49, "", word(49), word(50), shared, shared[:50], shared[1:50], "é" * 60, "z" + "é" * 60, "x".join([shared] * 3)]
    order = rng.permutation(len(texts))
    rows = [(int(k) * 3, texts[j]) for k, j in enumerate(order)]
    assert dedup(spark, rows) == brute_dedup([(i, t.encode()) for i, t in rows])


def test_dedup_random_alphabet(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("ab"), 400)) for _ in range(4)]
    rows = []
    for i in range(60):
        b = base[int(rng.integers(4))]
        lo, hi = sorted(rng.integers(0, 400, 2))
        rows.append((i, b[lo:hi] + "".join(rng.choice(list("abc"), 30)) + b[: int(rng.integers(0, 120))]))
    assert dedup(spark, rows) == brute_dedup([(i, t.encode()) for i, t in rows])


def test_dedup_defined_results(spark):
    long = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    rows = [(None, long), (5, long), (5, long), (7, long), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, r.kept_text) for r in suffix_dedup.deduplicated(frame).collect()), key=str)
    assert got == sorted([(None, 0, long), (5, 0, long), (5, 0, long), (7, len(long), ""), (8, 0, None)], key=str)
    assert suffix_dedup.deduplicated(frame.limit(0)).count() == 0


def test_dedup_rows_of_one_id(spark):
    """A row loses what is its own, whatever other rows its id has; no row of an id takes from another."""
    rng = np.random.default_rng(11)
    prose = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    shared, more = prose(120), prose(90)
    rows = [(1, shared + prose(70)), (5, prose(400)), (5, prose(60) + shared), (5, more + prose(30)), (5, prose(10) + more), (7, prose(20) + more), (7, more), (7, shared), (3, prose(5) + more[:70])]
    assert dedup(spark, rows) == brute_dedup([(i, t.encode()) for i, t in rows])
    for seed in range(3):  # the rows of an id lie in different batches, in any order
        frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(5 + seed)
        got = suffix_dedup.deduplicated(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == brute_dedup([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("hold", [0, 300])
def test_dedup_where_triggers_are_too_frequent(spark, hold):
    """Phrases that are passed on, by 46 common bytes and string by string, lose the same bytes."""
    rng = np.random.default_rng(12)
    hot = "the same sixteen bytes and more of them in every text"
    rows = [(int(i), "".join(rng.choice(list("abc"), int(rng.integers(0, 60)))) + hot[: int(rng.integers(16, 54))] + "".join(rng.choice(list("ab"), 30)) + "=" * int(rng.integers(0, 90))) for i in rng.permutation(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffix_dedup.deduplicated(frame, hold=hold).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_dedup([(i, t.encode()) for i, t in rows])


def test_dedup_ids_of_other_types_and_clashing_names(spark):
    rng = np.random.default_rng(13)
    shared = "".join(rng.choice(list("abcdef"), 80))
    rows = [("b", shared + "1", 4, 5, 6), ("a", "0" + shared, 4, 5, 6), (None, shared, 4, 5, 6)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, places int, n_removed int, _row int")
    out = suffix_dedup.deduplicated(frame, keep=["places", "n_removed", "_row"])
    assert len(set(out.columns)) == len(out.columns) and {"places", "_row"} <= set(out.columns)
    assert sorted(((r.doc_id, r.n_removed, r.places) for r in out.collect()), key=str) == [("a", 0, 4), ("b", 80, 4), (None, 0, 4)]


def test_dedup_whole_table(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op8_suffix_array_dedup"](spark, SF).collect())
    assert got == brute_dedup(docs)


# ---- pipeline


def survivors(texts):
    """The smallest id of each group of texts that share 80 % of their five-word shingles."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    ids = sorted(sets)
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    group = brute_components([(j, i) for k, i in enumerate(ids) for j in ids[:k] if near(sets[i], sets[j])])
    return [i for i in ids if group.get(i, i) == i]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 34 !!"), (None, "a text without an id that is long enough to be kept by the rules of quality here")], "doc_id long, text string")
    now = docs.unionByName(odd, allowMissingColumns=True).selectExpr("*", "'c' AS lang_pred", "1 AS kept", "2 AS `_id`", "3 AS spans")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect() if r[0] is not None)
    before = ids(now)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == now.columns
        out = out.checkpoint()
        after = ids(out)
        assert set(after) <= set(before)
        if name == "language_id":
            assert set(before) - set(after) == {10**6, 10**6 + 1, 10**6 + 2}
        if name == "simhash_near_dedup":
            assert after == survivors({r.doc_id: r.text for r in now.collect() if r.doc_id is not None})
        if name == "suffix_array_dedup":
            assert after == before
        assert out.filter("doc_id IS NULL").count() == 1
        now, before = out, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {*before, None}
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_rest_works_without_this_subpackage(tmp_path):
    """The entry point still imports when the subpackage and the pipeline are gone."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests"))
    shutil.rmtree(copy / "tidewatch" / "llm")
    (copy / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
