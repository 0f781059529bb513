"""The queries op1 to op10 over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.llm import bpe, line_dedup, mixing, ngram_join, pii, quality, sharding, substring_dedup, token_counts, topk
from runeframe.llm.common import n_words, settled, table
from runeframe.llm.oracle import ORACLE
from runeframe.plans.scratch import fresh_folder


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), carry=[])
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law rows: the method cuts one interleaved order, so counts differ by one at most; equal texts lie in any shards."""
    shards = sharding.stratified_shards(table(spark, sf_dir, "documents"), 40, carry=[])
    return shards.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda x: x == name)).cast("long").alias(f"n_{name}") for name in ("email", "ip", "card", "phone")]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.array_max(F.transform("spans", lambda s: s["score"])).cast("long").alias("top_score"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.exact_topk(table(spark, sf_dir, "embeddings"), k=5, is_query=lambda vec_id: vec_id % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host: what is left of each page without its host's boilerplate lines."""
    pages = table(spark, sf_dir, "pages")
    dropped = line_dedup.drop_boilerplate(pages, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")))
    return dropped.select(F.col("row.page_id").alias("page_id"), "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.array_join("kept", " ").cast("binary"), 256).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three commits over all documents, of which the second arrives twice: every document inserted with its byte-level BPE tokens; documents
    under 10 words deleted; the others revised to a second version, which counts runs of letters and digits and single other characters."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    key = F.struct("source", "lang", n_words(text).alias("words"), F.regexp_count(text, F.lit(token_counts.PIECE)).alias("pieces")).alias("key")
    coded = bpe.encode_documents(docs.select(key, "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, id_col="key", decode=False)
    counted = settled(coded.select("id.*", F.size("ids").cast("long").alias("tokens")))  # narrow rows: texts are encoded once for all commits
    first, second, short = F.col("tokens"), F.col("pieces"), F.col("words") < 10
    rollup = token_counts.TokenRollup(spark, fresh_folder(spark, "rollup"))
    rollup.commit("insert", token_counts.inserted(counted, "bpe-1", first))
    rollup.commit("short", token_counts.deleted(counted.where(short), "bpe-1", first))
    rollup.commit("short", token_counts.deleted(counted.where(short), "bpe-1", first))
    rollup.commit("recount", token_counts.revised(counted.where(~short), ("bpe-1", first), ("pieces-2", second)))
    totals = settled(rollup.totals())
    rollup.delete()
    return totals


__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_mix_sources": op2_mix_sources,
    "op3_stratified_shards": op3_stratified_shards,
    "op4_ngram_join": op4_ngram_join,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_counts": op10_token_counts,
}
