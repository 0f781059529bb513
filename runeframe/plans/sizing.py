"""Which side of a join may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast up to this many rows and characters, both counted first; beyond, Spark joins by shuffle.
MOST_ROWS, MOST_CHARS = 200_000, 16_000_000


def is_small(df: DataFrame, chars: str | None = None) -> bool:
    """Whether df is counted to be small."""
    size = df.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.length(chars)) if chars else F.lit(0)).alias("c")).first()
    return size.n <= MOST_ROWS and (size.c or 0) <= MOST_CHARS


def small_side(df: DataFrame, chars: str | None = None) -> DataFrame:
    """df, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if is_small(df, chars) else df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it comes in fewer pieces than there are cores, as a small file does; a large input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt to three pieces for each core if it comes in fewer: for texts of which a task makes many times as many rows."""
    pieces = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def unsized(df: DataFrame) -> DataFrame:
    """df, not to be broadcast: Spark takes the size of rows that Python or explode() makes for that of the compressed file they come from. It joins them by shuffle, with all that is made of them."""
    return df.hint("merge")
