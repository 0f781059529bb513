"""Where jobs keep state that all machines must see, and rows in a global order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. A session of one machine may do without and gets a local one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "/tmp/checkpoints"


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder and all in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: loops don't grow their lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def in_order(df: DataFrame, *order: str | Column, nth: str = "nth", total: dict[str, Column] | None = None) -> DataFrame:
    """df with nth, each row's number (from 0) in a global order, and for each entry of total a column with the sum of its value over the rows before.

    Rows are dealt by ranges of the order and sorted within them; only the ranges' counts and sums come together. No range is one task's for all rows.
    """
    total = total or {}
    sorted_ = kept(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_row", F.monotonically_increasing_id())
    # The upper bits of that id name the range, the lower 33 count within it
    placed = sorted_.withColumns({"_range": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(value).alias(f"_sum_{name}") for name, value in total.items()])
    starts = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in total])
    inside = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(F.broadcast(starts), "_range")
    sums = [(F.col(f"_start_{name}") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(name) for name, value in total.items()]
    return found.select(*df.columns, (F.col("_start") + F.col("_row")).alias(nth), *sums)
