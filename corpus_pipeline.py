"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame with the columns of docs (the last: the pieces).
Documents are named by doc_id and text; rows that repeat both count as one document from the third stage on. Rows without an id have no
group and nothing to lose to others, and go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, table
from tidewatch.llm.language import UNDETERMINED, identify, learned
from tidewatch.llm.packing import packed
from tidewatch.llm.quality import quality
from tidewatch.llm.queries import vocabulary
from tidewatch.llm.similar import similar
from tidewatch.llm.suffix_dedup import deduplicated


def _masked(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id and text with all other columns under names that no operator uses, and those names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = [f"_k{i}" for i in range(len(others))]
    return docs.select("doc_id", "text", *(docs[f"`{c}`"].alias(n) for c, n in zip(others, names))), names


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, in their order."""
    names = iter(range(len(docs.columns)))
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_k{next(names)}").alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language (null, or without a letter) go."""
    rows, names = _masked(docs)
    marked = identify(rows, learned(docs), keep=[*names, "text"])
    return _restored(marked.filter(F.col("lang_pred") != UNDETERMINED), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are too short or repeat themselves go."""
    rows, names = _masked(docs)
    return _restored(quality(rows, keep=[*names, "text"]).filter("kept"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 80 % of their five-word shingles, or are joined by such, the document with the smallest
    id (then text hash) stays. Different texts under one id are documents of their own."""
    rows, _ = _masked(docs)
    stay = similar(rows).groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select(F.col("s.doc_id").alias("_stays"), F.col("s.text_hash").alias("_hash")).distinct()
    hashed = rows.withColumn("_text", F.xxhash64("text"))
    named = hashed.join(stay, (F.col("doc_id") == F.col("_stays")) & (F.col("_text") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "_text"]).drop("_text")
    return _restored(named.unionByName(rows.filter("doc_id IS NULL")), docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the texts (and counted out of n_chars)."""
    rows, names = _masked(docs)
    cuts = deduplicated(rows, keep=names)
    found = _restored(cuts.withColumn("text", F.col("kept_text")), docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    found = packed(docs, vocabulary("word_bpe_49k.json"), with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: Tokens, automata and fingerprints can't be said in SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is kept in the checkpoint folder for the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
