"""Sharding by proportional stratified interleaving. DataFrame functions only.

Rows get a hash-random order within their source, and from it the fractional rank (rank - 1/2) / rows of the
source. Sorted by that fraction, the sources lie interleaved in the proportions of the corpus all along the order,
so every shard cut from it matches the mixture.

No global sort is needed. Keys are uniform, so KEY_RANGES equal key ranges within each source are even, and
fractions are uniform by construction, so KEY_RANGES equal ranges of them are even too. Each order is a window
within a range plus the range's offset, which comes from counts of ids alone; a hot source is spread over all its ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runeframe.llm.common import KEY_RANGES, key_range, quoted, random_key


def stratified_shards(
    docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, carry: list[str] | None = None
) -> DataFrame:
    """One row for each input row: id, size, text_crc32, shard, slot, and row, a struct of the carried columns (all by default).

    Row counts of shards differ by one at most; slots run from 0 without gaps in each shard. A null source is a
    source of its own; a null id has a key like any id; a null text has 0 bytes. Repeated rows keep their number and
    lie side by side. Rows that agree in source, id, size and checksum may swap places. An empty table gives no rows.
    Column names of the input can't clash: they stay inside row. Rows of equal text, the groups of the law by rows, are dealt like any others: their place
    is their key's, so a group is spread as evenly as its source is, and no shard gets more of it than its share.
    """
    text, carried = quoted(text_col), docs.columns if carry is None else carry
    base = docs.select(
        quoted(id_col).alias("id"),
        quoted(source_col).isNull().alias("no_src"),
        F.coalesce(quoted(source_col).cast("string"), F.lit("")).alias("src"),
        random_key(seed, quoted(id_col)).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        *([F.struct(*[quoted(c) for c in carried]).alias("row")] if carried else []),
    ).withColumn("part", key_range(F.col("key")))
    stratum, place = ["no_src", "src"], ["no_src", "src", "part"]

    # Only ids and sources are read for these counts; texts are not.
    within = Window.partitionBy(*stratum)
    parts = (
        base.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("before", F.sum("rows").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows"))
        .withColumn("in_src", F.sum("rows").over(within))
    )

    def fraction(rank):
        return (rank - F.lit(0.5)) / F.col("in_src")

    def fraction_range(x):
        return F.floor(x * KEY_RANGES).cast("int")

    spans = (
        parts.select("before", "in_src", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("i"))
        .groupBy(fraction_range(fraction(F.col("before") + F.col("i"))).alias("span"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("ahead", F.sum("rows").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows"))
        .withColumn("total", F.sum("rows").over(Window.partitionBy()))
        .drop("rows")
    )

    ranked = (
        base.withColumn("in_part", F.row_number().over(Window.partitionBy(*place).orderBy("key", "id", "size", "crc")))
        .join(parts, place)
        .withColumn("at", fraction(F.col("before") + F.col("in_part")))
        .withColumn("span", fraction_range(F.col("at")))
        .withColumn("in_span", F.row_number().over(Window.partitionBy("span").orderBy("at", "no_src", "src")))
        .join(F.broadcast(spans), "span")  # KEY_RANGES rows at most
        .withColumn("nth", F.col("ahead") + F.col("in_span") - 1)
        .withColumn("shard", F.expr(f"nth * {n_shards} div total"))
        .withColumn("slot", F.expr(f"nth - (shard * total + {n_shards - 1}) div {n_shards}"))
    )
    return ranked.select("id", "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), *(["row"] if carried else []))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, **options) -> None:
    """Writes the rows of docs under path, one folder for each shard, in the order of their slots. Null texts, repeated rows and columns of any name are written as they are; an empty table leaves no folder of a shard."""
    shards = stratified_shards(docs, n_shards, **options)
    shards.repartition("shard").sortWithinPartitions("shard", "slot").select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
