"""From raw documents to token ids: five stages, each over all that the one before it kept.

In every stage null and empty texts have no words and fail the quality rules, so they go first; repeated rows are judged alike, and one of them stays behind the join; null ids and sources are values like
others; an empty table gives an empty one; columns beside those of documents stay what they are up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.llm import bpe, line_dedup, mixing, ngram_join, quality
from runeframe.llm.common import table
from runeframe.plans.scratch import fresh_folder, remove

#: Near duplicates: words of a shingle, and per cent of the union that two documents must share.
SHINGLE, SIMILAR = 5, 80
#: Share of a source's texts that makes a line boilerplate. A source isn't a site, whose pages nearly all hold its lines: licence and disclaimer lines
#: stand in a tenth of its texts, lines that meet by chance in less than a twentieth.
LINE_RATIO = 0.06
VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that are boilerplate of its source; n_chars follows the text."""
    return line_dedup.without_boilerplate(docs, ratio=LINE_RATIO)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest doc_id."""
    return ngram_join.one_of_each(docs, n=SHINGLE, percent=SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, the last of each source cut at its budget; n_chars follows the text."""
    return mixing.mixed_rows(docs).withColumn("n_chars", F.length("text").cast("long"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: the tokens of each text. decoded_equal says whether their bytes are the text's, a check that holds for all rows."""
    import public_tokenizers

    coded = bpe.encode_documents(docs.select(F.struct("doc_id", F.md5("text").alias("md5")).alias("key"), "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, id_col="key")
    same = F.md5("decoded") == F.coalesce("id.md5", F.md5(F.lit("")))
    return coded.select("id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decoded_equal"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: No SQL: byte-pair merges are beyond it. The stages are held against plain versions in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder, read again by the next, and deleted when that one has written. The last reads what is left there."""
    place, docs = fresh_folder(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            remove(spark, f"{place}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
