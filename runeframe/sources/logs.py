"""Benchmark logs of lines '# key = value' as tables, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE = r"^# *(.*?) *= *(.*?) *$"


def key_values(lines: DataFrame) -> DataFrame:
    """file, line_no, key, value of lines (file, line_no, line) that have the form; others are skipped."""
    each = lines.select("file", "line_no", F.regexp_extract("line", LINE, 1).alias("key"), F.regexp_extract("line", LINE, 2).alias("value"))
    return each.where("key <> ''")


def records(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row a record, one string column a key. Within a file the n-th line of each key belongs to its n-th record."""
    nth = F.row_number().over(Window.partitionBy("file", "key").orderBy("line_no"))
    return key_values(lines).withColumn("record", nth.cast("long")).groupBy("file", "record").pivot("key", keys).agg(F.first("value"))


def numeric(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with each of the columns as double if all its values are numbers."""
    bad = df.agg(*[F.count_if(F.col(k).isNotNull() & F.expr(f"try_cast(`{k}` as double)").isNull()).alias(k) for k in keys]).first()
    return df.select(*[F.col(c).cast("double").alias(c) if c in keys and not bad[c] else F.col(c) for c in df.columns])


def phase_costs(df: DataFrame, by: list[str], phase: str, value: str) -> DataFrame:
    """by, phase, mean, cost: means of a cumulative measure by phase and what each phase adds to the one before."""
    means = df.groupBy(*by, phase).agg(F.avg(value).alias("mean"))
    before = F.lag("mean").over(Window.partitionBy(*by).orderBy(phase))
    return means.withColumn("cost", F.col("mean") - F.coalesce(before, F.lit(0.0)))


def mean_table(df: DataFrame, row: str, column: str, values: list, value: str, queries: int) -> DataFrame:
    """Means by row and column as a table, in microseconds a query from milliseconds a batch."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value) * 1000 / queries)
