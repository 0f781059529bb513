"""Entropy and repetition statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.functions.text import SENTINEL, kgrams, symbols
from runeframe.operators.suffixes import OF, per_document, suffixes_of_texts
from runeframe.plans.sizing import unsized


def entropy_of(values: DataFrame, value: str) -> DataFrame:
    """h0: bits of a column's values by their frequencies; null for no rows."""
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.log2("m")).alias("s"))
    return counts.select((F.log2("n") - F.col("s") / F.col("n")).alias("h0"))


def context_entropy(texts: DataFrame, k: int) -> DataFrame:
    """k, n, contexts, hk: bits of a symbol given the k before it, the end of each text counted as a symbol.

    n counts all symbols, ends included; contexts counts distinct substrings of k symbols. Counts of (context, symbol) are summed in two steps, so a
    context that is everywhere is partial sums before it is a row.
    """
    whole = texts.where("text is not null").select("doc_id", "text")
    if k == 0:
        pairs = symbols(whole).select(F.lit("").alias("context"), "sym").unionByName(whole.select(F.lit("").alias("context"), F.lit(SENTINEL).alias("sym")))
    else:
        inner = kgrams(whole, k + 1).select(F.substring("gram", 1, k).alias("context"), F.substring("gram", k + 1, 1).alias("sym"))
        pairs = inner.unionByName(whole.where(F.length("text") >= k).select(F.right("text", F.lit(k)).alias("context"), F.lit(SENTINEL).alias("sym")))
    counts = pairs.groupBy("context", "sym").agg(F.count(F.lit(1)).alias("m"))
    by_context = counts.groupBy("context").agg(F.sum("m").alias("occ"), F.sum(F.col("m") * F.log2("m")).alias("s"))
    summed = by_context.agg(F.count(F.lit(1)).alias("contexts"), F.sum(F.col("occ") * F.log2("occ") - F.col("s")).alias("bits"))
    n = whole.agg(F.sum(F.length("text").cast("long") + 1).alias("n"))
    return summed.join(n).select(F.lit(k).cast("long").alias("k"), "n", "contexts", (F.col("bits") / F.col("n")).alias("hk"))


def bwt_repetition(suffixes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n, runs, equal_percent (of neighbours in the BWT), mean_lcp."""
    order = Window.partitionBy(id_col).orderBy("rank")
    same = (F.col("bwt") == F.lag("bwt").over(order)).cast("int")
    return suffixes.select(id_col, "lcp", same.alias("same")).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.coalesce(F.sum("same"), F.lit(0))).alias("runs"), (100 * F.coalesce(F.sum("same"), F.lit(0)) / F.count(F.lit(1))).alias("equal_percent"), F.avg("lcp").alias("mean_lcp")
    )


def lcp_report(suffixes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, max_lcp, sum_lcp, mean_lcp."""
    return suffixes.groupBy(id_col).agg(F.max("lcp").alias("max_lcp"), F.sum("lcp").alias("sum_lcp"), F.avg("lcp").alias("mean_lcp"))


def lcp_report_of_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lcp_report() of suffix_table(), made where the suffix array is: one row of a text moves, not one of each suffix."""

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        lcp = np.maximum(s.lcp, 0)
        return {OF: np.arange(len(texts)), "max_lcp": np.maximum.reduceat(lcp, s.start), "sum_lcp": np.add.reduceat(lcp, s.start), "n": s.size}

    each = per_document(texts, table, {"max_lcp": "long", "sum_lcp": "long", "n": "long"}, id_col, text_col)
    return each.select(id_col, "max_lcp", "sum_lcp", (F.col("sum_lcp") / F.col("n")).alias("mean_lcp"))


def sigma(texts: DataFrame) -> DataFrame:
    """sigma: distinct symbols of all texts, the sentinel included."""
    return symbols(texts).agg((F.countDistinct("sym") + 1).alias("sigma"))


def bit_lcp(lcp: Column, first: Column, second: Column) -> Column:
    """Common bits of two suffixes with lcp common bytes that go on with bytes first and second."""
    return 8 * lcp + 8 - F.length(F.bin(first.bitwiseXOR(second)))


def dump(suffixes: DataFrame, links: DataFrame, texts: DataFrame, width: int = 10, id_col: str = "doc_id") -> DataFrame:
    """id, rank, bwt, psi, lf, pos, head (the first width symbols of the suffix)."""
    each = suffixes.select(id_col, "rank", "pos", "bwt").join(links.select(id_col, "rank", "psi", "lf"), [id_col, "rank"]).join(unsized(texts.select(id_col, "text")), id_col)
    return each.select(id_col, "rank", "bwt", "psi", "lf", "pos", F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.lit(width)).alias("head"))
