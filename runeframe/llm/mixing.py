"""Mixing sources to target weights. DataFrame functions only.

Rows get hash-random keys. Within each source they lie in the order of the keys: KEY_RANGES equal key ranges are even
because keys are uniform, so the order is a window within a range plus the range's offset, and the offsets are
prefix sums of the sizes of ranges. Each source is cut at its exact budget; where the budget exceeds the source,
whole epochs come first and the cut falls in the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.llm.common import KEY_RANGES, key_range, n_words, quoted, random_key, settled, words

#: Weights of the sources, by code point, repeating; share of all sizes to take; epochs of a source at most.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources (no_src, src, source_size) with a target each: the shares by weight, cut at epochs times the size of the
    source, the excess reshared by weight until none is above.

    In the end every source below its cap has the same target per weight, level. With sources in the order of cap per
    weight, the capped ones come first, so level is what is left after them over the weights left. One row a source.
    """
    everything, ahead = Window.partitionBy(), Window.orderBy("fill", "no_src", "src")
    running = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.row_number().over(Window.orderBy("no_src", "src"))
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth - 1) % len(weights) + 1))
    return (
        weighted.withColumn("cap", F.col("source_size").cast("double") * epochs)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(share) - (F.sum("cap").over(running) - F.col("cap")))
        .withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.sum("weight").over(running) + F.col("weight")))
        .withColumn("free", F.col("level") <= F.col("fill"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct("fill", "no_src", "src", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("no_src", "src", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = 0,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row for each input row: id, source, size, source_size, target, taken, and row, a struct of the carried columns (all by default).

    taken is what the mix takes of the row, repeats counted: whole epochs times its size, and in the last epoch all of
    it before the cut, nothing beyond, and at the cut itself the part that meets the budget. Sizes are words unless
    given. A null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in order. Repeated
    rows count each; rows that agree in id and size may swap places. An empty table gives no rows. The same input gives the same result.
    """
    carried = docs.columns if carry is None else carry
    base = docs.select(
        quoted(id_col).alias("id"),
        quoted(source_col).alias("source"),
        quoted(source_col).isNull().alias("no_src"),
        F.coalesce(quoted(source_col).cast("string"), F.lit("")).alias("src"),
        random_key(seed, quoted(id_col)).alias("key"),
        F.coalesce(n_words(quoted(text_col)) if size is None else size, F.lit(0)).cast("long").alias("size"),
        *([F.struct(*[quoted(c) for c in carried]).alias("row")] if carried else []),
    ).withColumn("part", key_range(F.col("key")))
    if not carried:
        base = settled(base)  # narrow rows: cheaper to keep than to count words twice
    place = ["no_src", "src", "part"]
    parts = base.groupBy(*place).agg(F.sum("size").alias("part_size"))
    sources = source_targets(parts.groupBy("no_src", "src").agg(F.sum("part_size").alias("source_size")), weights, share, epochs)
    budgets = (
        parts.withColumn("before", F.sum("part_size").over(Window.partitionBy("no_src", "src").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("part_size"))
        .join(sources, ["no_src", "src"])
        .withColumn("budget", F.floor("target").cast("long"))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("rounds") * F.col("source_size"))
        .select(*place, "before", "source_size", "target", "rounds", "rest")
    )
    so_far = Window.partitionBy(*place).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        base.withColumn("up_to", F.sum("size").over(so_far) - F.col("size"))
        .join(budgets, place)
        .withColumn("last", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("up_to"))))
        .withColumn("taken", F.col("rounds") * F.col("size") + F.col("last"))
        .select("id", "source", "size", "source_size", "target", "taken", *(["row"] if carried else []))
    )


def mixed_rows(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken whole, and for the rest once more with the first words of its text, joined by blanks.

    Columns are those of docs, whatever their names. Rows of size 0 (null and empty texts) don't appear; repeated rows appear each as often as it is taken; a null source is a source; an empty table gives no rows.
    """
    mixed = mix_sources(docs, text_col=text_col, **options).where("taken > 0")
    whole, rest = F.expr("cast(taken div size as int)"), F.expr("cast(taken % size as int)")
    copies = F.array_repeat(F.lit(None).cast("int"), whole)
    copies = F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)
    each = mixed.select("row", F.explode(copies).alias("cut"))
    first = F.array_join(F.slice(words(F.col("row")[text_col]), 1, F.col("cut")), " ")
    text = F.when(F.col("cut").isNull(), F.col("row")[text_col]).otherwise(first)
    return each.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
