"""Stages of the corpus pipeline against brute force."""

from __future__ import annotations

import numpy as np

from corpus_pipeline import near_duplicate_stage, suffix_stage
from test_corpus_operators import brute_components


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def near_copies(seed=8, bases=40, copies=6):
    """Random texts, and copies of each with some words replaced."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(bases):
        base = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(100, 400)))]
        out.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(1, max(2, len(copy) // 25))), replace=False):
                copy[at] = f"n{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
    return out


def test_near_copies_from_similarity_0_8_go(spark):
    texts = near_copies()
    sets = [shingles(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    assert 60 < sum(similarity(sets[i], sets[j]) < 0.9 for i, j in edges)
    group = brute_components(edges)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = [r.doc_id for r in near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(got) == [k for k in range(len(texts)) if group.get(k, k) == k]


def test_groups_that_no_task_holds(spark):
    """Groups of candidates dealt into blocks are the same groups."""
    from pyspark.sql import functions as F

    from tidewatch.llm.similar import similar

    texts = near_copies(seed=9, bases=6, copies=25)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    named = lambda df: sorted(tuple(sorted(r.ids)) for r in df.groupBy("component").agg(F.collect_set("doc_id").alias("ids")).collect())
    assert named(similar(docs, held=12_000)) == named(similar(docs))


def test_texts_under_one_id(spark):
    """Both stay, join no groups by their id, and each loses its own passages only."""
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"p{k}" for k in rng.integers(0, 10**5, n))
    shared, one, two, three = prose(30), prose(100), prose(120), prose(140)
    rows = [(1, one + " " + shared), (7, two), (7, shared + " " + three), (7, two), (8, two + " end"), (9, "x " + shared + " " + three), (None, two)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    near = near_duplicate_stage(spark, docs, "").cache()
    texts = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    assert texts(near) == sorted([(0, two), rows[0], (7, two), rows[2]])
    assert texts(near_duplicate_stage(spark, docs.repartition(5), "")) == texts(near)
    got = texts(suffix_stage(spark, near, ""))
    assert len(got) == 4 and {(0, two), rows[0], (7, two)} <= set(got)
    left = next(t for i, t in got if i == 7 and t != two)
    assert left.endswith(three) and len(left) < len(three) + 50
