"""Columns and tables derived from texts: symbols, k-grams, pieces, checks and rewrites. Positions are code points from 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runeframe.plans.sizing import spread

#: Code points of a piece. Offsets are found by walking from the start of a string, so pieces are cut twice: large, then small.
LARGE, SMALL = 1 << 14, 256
#: What stands for the end of a text where a symbol is asked for.
SENTINEL = ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(texts: DataFrame, width: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, piece: every text in pieces of width code points, each with the overlap that follows it. Null and empty texts have none."""
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(width))
    pieces = texts.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(starts).alias("start"))
    return pieces.select(id_col, "start", F.substring(text_col, F.col("start") + 1, F.lit(width + overlap)).alias("piece"))


def pieces(texts: DataFrame, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start (long), piece: pieces of SMALL code points and overlap."""
    large = cut(spread(texts.select(id_col, text_col)), LARGE, overlap, id_col, text_col)
    own = F.least(F.lit(LARGE), F.length("piece"))
    starts = F.sequence(F.lit(0), own - 1, F.lit(SMALL))
    small = large.select(id_col, "start", "piece", F.explode(starts).alias("inner"))
    return small.select(id_col, (F.col("start") + F.col("inner")).cast("long").alias("start"), F.substring("piece", F.col("inner") + 1, F.least(F.lit(SMALL), F.lit(LARGE) - F.col("inner")) + overlap).alias("piece"))


def kgrams(texts: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos (long), gram: every substring of k code points."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    cut_ = pieces(texts, k - 1, id_col, text_col).where(F.length("piece") >= k)
    grams = F.transform(F.sequence(F.lit(1), F.least(F.length("piece") - k + 1, F.lit(SMALL))), lambda i: F.substring(F.col("piece"), i, F.lit(k)))
    each = cut_.select(id_col, "start", F.posexplode(grams).alias("at", "gram"))
    return each.select(id_col, (F.col("start") + F.col("at")).alias("pos"), "gram")


def rolling_hashes(codes: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """k, low, high for each length: 128 bits for the k symbols from each place on, where there are so many."""
    sums = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        base = np.full(len(codes) + 1, seed | 5, dtype=np.uint64)
        back = np.full(len(codes) + 1, pow(seed | 5, -1, 2**64), dtype=np.uint64)
        base[0] = back[0] = 1
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(seed)) * np.multiply.accumulate(base)[:-1], out=total[1:])
        sums.append((total, np.multiply.accumulate(back)))
    for k in lengths:
        n = max(0, len(codes) - k + 1)
        yield k, *(_mixed((total[k : k + n] - total[:n]) * back[:n]) for total, back in sums)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def symbols(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos (long), sym: every code point."""
    return texts.where(F.length(text_col) > 0).select(id_col, F.posexplode(F.split(text_col, "")).alias("p", "sym")).select(id_col, F.col("p").cast("long").alias("pos"), "sym")


def has_nul(text: Column) -> Column:
    return F.contains(text, F.lit("\x00"))


def without_nul(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """texts; reading a row whose text holds the symbol 0 is an error."""
    checked = F.when(has_nul(F.col(text_col)), F.raise_error(F.lit("a text must not hold the symbol 0"))).otherwise(F.col(text_col))
    return texts.withColumn(text_col, checked)


def nul_replaced(text: Column, by: str = "\xff") -> Column:
    return F.translate(text, "\x00", by)


def extract(text: Column, begin: Column, end: Column) -> Column:
    """Symbols begin to end, both included; null where they don't lie in the text."""
    inside = (begin >= 0) & (begin <= end) & (end < F.length(text))
    return F.when(inside, F.substring(text, begin.cast("int") + 1, (end - begin + 1).cast("int")))


def encoded(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of numbers, for positions by byte."""
    return F.transform(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)(?=.)", "$1,"), ","), lambda b: F.conv(b, 16, 10).cast("int"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def border_table(pattern: pd.Series) -> pd.Series:
    """For every prefix of a pattern, the length of its longest proper border."""

    def borders(p: str | None) -> list[int] | None:
        if p is None:
            return None
        out, k = [0] * len(p), 0
        for i in range(1, len(p)):
            while k and p[i] != p[k]:
                k = out[k - 1]
            k += p[i] == p[k]
            out[i] = k
        return out

    return pattern.map(borders)


def highest_bit(x: Column) -> Column:
    """Position of the highest bit set, from 0; null for 0."""
    return F.when(x > 0, F.length(F.bin(x)) - 1)


def nth_bit(x: Column, i: Column) -> Column:
    """Position of the i-th bit set (from 1, lowest first); null if there are fewer."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", x, b) == 1)
    return F.get(places, i - 1)


def next_bit(x: Column, at: Column) -> Column:
    """The first position after at whose bit is set; null if there is none."""
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: (b > at) & (F.call_function("getbit", x, b) == 1)))


def previous_bit(x: Column, at: Column) -> Column:
    """The last position up to at whose bit is set; null if there is none."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: (b <= at) & (F.call_function("getbit", x, b) == 1)))
