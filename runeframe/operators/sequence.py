"""Rank, select and range queries on sequences given as rows (sequence id, position, symbol). Positions are from 0; rank counts before a position; select's j is from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(by: list[str] | None):
    return Window.partitionBy(*by) if by else Window.partitionBy()


def ranked(seq: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym") -> DataFrame:
    """seq with rank: how often its symbol stands before each place. The window is within a symbol."""
    order = Window.partitionBy(*(by or []), sym).orderBy(pos)
    return seq.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def access(seq: DataFrame, queries: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym") -> DataFrame:
    """queries (by, pos) with the symbol there; null outside."""
    return queries.join(seq.select(*(by or []), pos, sym), [*(by or []), pos], "left")


def rank(seq: DataFrame, queries: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym") -> DataFrame:
    """queries (query, by, i, sym) with rank: occurrences of sym before i, 0 for an absent symbol.

    Queries and places of one symbol are merged in one order, and places are counted as they go by: no pair of them is formed.
    """
    keys = [*(by or []), sym]
    places = seq.select(*keys, F.col(pos).cast("long").alias("at"), F.lit(1).alias("one"), F.lit(None).cast(queries.schema["query"].dataType).alias("query"))
    asked = queries.select(*keys, (F.col("i") - 1).cast("long").alias("at"), F.lit(0).alias("one"), "query")
    so_far = Window.partitionBy(*keys).orderBy("at", F.desc("one")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = places.unionByName(asked).withColumn("rank", F.sum("one").over(so_far)).where("one = 0").select("query", "rank")
    return queries.join(counted, "query")


def select(seq: DataFrame, queries: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym") -> DataFrame:
    """queries (query, by, j, sym) with pos of the j-th occurrence; null if there are fewer."""
    places = ranked(seq, by, pos, sym).select(*(by or []), sym, (F.col("rank") + 1).alias("j"), F.col(pos).alias("pos"))
    return queries.join(places, [*(by or []), sym, "j"], "left")


def inverse_select(seq: DataFrame, queries: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym") -> DataFrame:
    """queries (by, pos) with the symbol there and its rank there."""
    return queries.join(ranked(seq, by, pos, sym).select(*(by or []), pos, sym, "rank"), [*(by or []), pos], "left")


def _in_ranges(seq: DataFrame, ranges: DataFrame, by: list[str] | None, pos: str, sym: str, inclusive: bool, width: int) -> DataFrame:
    """Places with the ranges (query, i, j) that hold them. Places and ranges meet in cells of width positions; a range is dealt to the cells it touches."""
    last = F.col("j") if inclusive else F.col("j") - 1
    cells = ranges.where(F.col("i") <= last).withColumn("cell", F.explode(F.sequence(F.floor(F.col("i") / width), F.floor(last / width))))
    placed = seq.select(*(by or []), F.col(pos).alias("at"), F.col(sym).alias("found"), F.floor(F.col(pos) / width).alias("cell"))
    return cells.join(placed, [*(by or []), "cell"]).where((F.col("at") >= F.col("i")) & ((F.col("at") <= F.col("j")) if inclusive else (F.col("at") < F.col("j"))))


def interval_symbols(seq: DataFrame, ranges: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym", width: int = 4096) -> DataFrame:
    """query, sym, rank_i, rank_j: the distinct symbols in [i, j), a set, and how often each stands before i and before j."""
    held = _in_ranges(ranked(seq, by, pos, sym).withColumn("both", F.struct(F.col(sym), "rank")), ranges, by, pos, "both", False, width)
    return held.groupBy("query", F.col(f"found.{sym}").alias(sym)).agg(F.min("found.rank").alias("rank_i"), (F.max("found.rank") + 1).alias("rank_j"))


def count_lex_smaller(seq: DataFrame, ranges: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym", absent_is_zero: bool = False, width: int = 4096) -> DataFrame:
    """ranges (query, i, j, sym) with smaller: symbols below sym in [i, j). absent_is_zero: 0 where sym stands nowhere in the sequence."""
    held = _in_ranges(seq, ranges, by, pos, sym, False, width).groupBy("query").agg(F.count_if(F.col("found") < F.col(sym)).alias("smaller"))
    out = ranges.join(held, "query", "left").fillna(0, ["smaller"])
    if absent_is_zero:
        known = seq.select(*(by or []), sym).distinct().withColumn("known", F.lit(True))
        out = out.join(known, [*(by or []), sym], "left").withColumn("smaller", F.when(F.col("known"), F.col("smaller")).otherwise(0)).drop("known")
    return out


def range_search_2d(seq: DataFrame, boxes: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym", width: int = 4096) -> DataFrame:
    """query, pos, value: places in [i, j] with values in [low, high], ends included. boxes: query, i, j, low, high."""
    held = _in_ranges(seq, boxes, by, pos, sym, True, width)
    return held.where("found between low and high").select("query", F.col("at").alias("pos"), F.col("found").alias("value"))


def runs(seq: DataFrame, by: list[str] | None = None, pos: str = "pos", sym: str = "sym") -> DataFrame:
    """by, start, sym, length: maximal runs of one symbol."""
    order = _by(by).orderBy(pos)
    new = F.coalesce((F.lag(sym).over(order) != F.col(sym)).cast("int"), F.lit(1))
    marked = seq.withColumn("new", new)
    numbered = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*(by or []), "run").agg(F.min(pos).alias("start"), F.first(sym).alias(sym), F.count(F.lit(1)).alias("length")).drop("run")


# ---- bit vectors: rows (by, pos, bit)


def bit_ranks(bits: DataFrame, by: list[str] | None = None, pos: str = "pos", bit: str = "bit") -> DataFrame:
    """bits with rank1, rank0, rank10, rank01: how many ones, zeros, and pairs 10 and 01 (counted at their second bit) stand before each place."""
    order = _by(by).orderBy(pos)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    b = F.col(bit).cast("int")
    pairs = bits.withColumn("down", ((F.lag(b).over(order) == 1) & (b == 0)).cast("int")).withColumn("up", ((F.lag(b).over(order) == 0) & (b == 1)).cast("int"))
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long")
    return pairs.withColumns({"rank1": total(b), "rank0": total(1 - b), "rank10": total(F.col("down")), "rank01": total(F.col("up"))}).drop("down", "up")


def bit_selects(bits: DataFrame, by: list[str] | None = None, pos: str = "pos", bit: str = "bit") -> DataFrame:
    """by, pattern ('1', '0', '10', '01'), j, pos: the j-th place of each pattern; pairs at their second bit."""
    order = _by(by).orderBy(pos)
    b = F.col(bit).cast("int")
    pair = F.when((F.lag(b).over(order) == 1) & (b == 0), "10").when((F.lag(b).over(order) == 0) & (b == 1), "01")
    both = bits.select(*(by or []), F.col(pos).alias("pos"), F.when(b == 1, "1").otherwise("0").alias("own"), pair.alias("pair"))
    each = both.select(*(by or []), "pos", F.explode(F.array_compact(F.array("own", "pair"))).alias("pattern"))
    return each.withColumn("j", F.row_number().over(Window.partitionBy(*(by or []), "pattern").orderBy("pos")).cast("long"))


def pair_counts(bits: DataFrame, by: list[str] | None = None, pos: str = "pos", bit: str = "bit") -> DataFrame:
    """by, ones, pairs10, pairs01."""
    order = _by(by).orderBy(pos)
    b = F.col(bit).cast("int")
    marked = bits.select(*(by or []), b.alias("b"), F.lag(b).over(order).alias("p"))
    return marked.groupBy(*(by or [])).agg(F.sum("b").cast("long").alias("ones"), F.count_if((F.col("p") == 1) & (F.col("b") == 0)).alias("pairs10"), F.count_if((F.col("p") == 0) & (F.col("b") == 1)).alias("pairs01"))


def nearest_ones(bits: DataFrame, by: list[str] | None = None, pos: str = "pos", bit: str = "bit") -> DataFrame:
    """bits with previous (the last one at or before each place) and following (the first at or after); null if there is none."""
    order, place = _by(by).orderBy(pos), F.when(F.col(bit).cast("boolean"), F.col(pos))
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    return bits.withColumns({"previous": F.last(place, ignorenulls=True).over(back), "following": F.first(place, ignorenulls=True).over(ahead)})


def with_bit(bits: DataFrame, changes: DataFrame, by: list[str] | None = None, pos: str = "pos", bit: str = "bit") -> DataFrame:
    """bits after changes (by, pos, bit) set or clear places."""
    keys = [*(by or []), pos]
    return bits.join(changes.select(*keys, F.col(bit).alias("new")), keys, "left").withColumn(bit, F.coalesce("new", bit)).drop("new")


def random_bits(spark, n: int, seed: int = 0) -> DataFrame:
    """pos, bit: the same for the same seed, however it is partitioned."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2)) == 1).alias("bit"))


def constant(spark, n: int, k: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(k).cast("long").alias("val"))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("val"))


def modulo(values: DataFrame, m: int, val: str = "val") -> DataFrame:
    return values.withColumn(val, F.pmod(val, F.lit(m)))


def width_in_bits(val: Column) -> Column:
    """Bits that the largest value needs, 1 at least; an aggregate."""
    return F.length(F.bin(F.coalesce(F.max(val), F.lit(0)))).cast("long")
