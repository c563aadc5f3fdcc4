"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table
from tidewatch.llm.oracles import ORACLE_SQL  # noqa: F401


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.chat import canonical_turns, formatted, read_back, turn_records

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(formatted(canonical_turns(turn_records(rows.unionByName(more)))))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.topk import EVERY, top_k

    return top_k(table(spark, sf_dir, "embeddings"), f"id % {EVERY} = 0")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.language import held_out, identify, learned

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.sharding import shard_documents

    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.suffix_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.packing import packed

    found = packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.sentencepiece_codec import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_exact_top_k, op3_license_scans, op4_quality_rules, op5_language_id, op6_simhash_near_dedup, op7_sharding, op8_suffix_array_dedup, op9_packing, op10_sentencepiece)}
