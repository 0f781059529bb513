"""The suffix table: suffix array, LCP and BWT of every document as rows, and what follows from them.

Suffixes are ordered within a document, the virtual sentinel below all symbols. Ranks are doubled in numpy, by whole documents in Arrow
batches; short documents are ranked together. The common prefix of neighbours is read off the levels of the doubling. A text of n symbols has n + 1 rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.functions.text import SENTINEL
from runeframe.plans.sizing import dealt, spread, unsized

#: Rows of a batch of results, and symbols of the texts that are ranked at once.
ROWS = 200_000
#: Which text a row is of.
OF = "_of"


@dataclass
class Suffixes:
    """Suffixes of texts that lie behind each other, each with a sentinel: places and ranks count through all of them, and a text's ranks are where its places are."""

    codes: np.ndarray  # 0 for the sentinel
    start: np.ndarray  # of each text
    size: np.ndarray  # of each text, the sentinel included
    of: np.ndarray  # the text of each place, and of each rank
    order: np.ndarray
    lcp: np.ndarray  # below 0 at the first rank of each text

    @property
    def pos(self) -> np.ndarray:
        """Where the suffix of each rank starts in its text."""
        return self.order - self.start[self.of]


def suffixes_of(codes: list[np.ndarray]) -> Suffixes:
    """The suffixes of sequences of positive numbers, in order within each.

    Suffixes are ranked by as many symbols as a number holds, then ranks are doubled: only groups of suffixes that share their first symbols are sorted again.
    The common prefix of neighbours is read off the levels.
    """
    size = np.array([len(c) + 1 for c in codes], dtype=np.int64)
    n, start = int(size.sum()), np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    end = (start + size)[of]
    symbols = np.zeros(n, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[start + size - 1] = False
    symbols[inside] = np.concatenate(codes) if codes else ()
    known, number = np.unique(symbols, return_inverse=True)
    bits, above = max(1, int(len(known) - 1 + (known[0] > 0)).bit_length()), int(len(size)).bit_length()
    packed, h, levels = number + (known[0] > 0), 1, []
    while 2 * h * bits + above <= 62:
        levels.append(packed)
        packed, h = packed << (h * bits) | _ahead(packed, h, end), 2 * h
    levels.append(packed)
    key = packed if len(size) == 1 else (of << (h * bits)) | packed
    order = np.argsort(key)
    sorted_ = key[order]
    head = np.append(True, sorted_[1:] != sorted_[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.append(head[1:], True)
    open_ = np.flatnonzero(~alone)  # ranks of groups of several
    first = True
    while len(open_):
        if not first:
            levels.append(rank.copy())
            h *= 2
        first = False
        place = order[open_]
        # A suffix that shares h symbols with another has h symbols, so a suffix stands behind them
        key = rank[place] * (n + 1) + rank[place + h]
        by = np.argsort(key)
        key, place = key[by], place[by]
        order[open_] = place
        head = np.append(True, key[1:] != key[:-1])
        rank[place] = open_[np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))]
        open_ = open_[~(head & np.append(head[1:], True))]
    lcp = np.zeros(n, dtype=np.int64)
    later = np.flatnonzero(np.append(False, of[1:] == of[:-1]))
    x, y, at = order[later - 1], order[later], np.zeros(len(later), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[level][x] == levels[level][y])
        for v in (x, y, at):
            v[same] += 1 << level
    lcp[later] = at
    lcp[start] = np.arange(len(start)) - len(start)
    return Suffixes(symbols, start, size, of, order, lcp)


def _ahead(values: np.ndarray, h: int, end: np.ndarray) -> np.ndarray:
    """values h places further in the same text; 0 beyond its end."""
    out = np.zeros(len(values), dtype=np.int64)
    out[: max(0, len(values) - h)] = values[h:]
    out[np.arange(h, len(values) + h) >= end] = 0
    return out


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of a sequence of positive numbers and the sentinel after it."""
    s = suffixes_of([np.asarray(codes, dtype=np.int64)])
    return s.order, np.maximum(s.lcp, 0)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)


def per_document(texts: DataFrame, table: Callable[[list[str]], dict[str, np.ndarray | pa.Array]], schema: dict[str, str], id_col: str = "doc_id", text_col: str = "text", order: Sequence[str] = ()) -> DataFrame:
    """id and the columns that table() gives for texts that aren't null, about ROWS symbols at once; its column OF says which text a row is of. Joins don't broadcast them.

    order: columns of numbers from 0 by which the rows made at once are sorted, then by text: where rows are very many, files of like numbers side by side are smaller.
    """
    kind = texts.schema[id_col].dataType.simpleString()
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def made(ids: pa.Array, rows: list[int], held: list[str]) -> Iterator[pa.RecordBatch]:
        columns = table(held)
        if order and len(columns[OF]):
            key = np.zeros(len(columns[OF]), dtype=np.int64)
            for c in (*order, OF):
                key = key * (int(columns[c].max()) + 1) + columns[c]
            by = np.argsort(key)
            columns = {c: v.take(pa.array(by)) if isinstance(v, pa.Array) else v[by] for c, v in columns.items()}
        which = pa.array(np.array(rows)[columns[OF]])
        for at in range(0, len(which), ROWS):
            some = slice(at, at + ROWS)
            yield pa.RecordBatch.from_arrays([ids.take(which[some]), *(pa.array(columns[c][some], kinds[t]) for c, t in schema.items())], names=[id_col, *schema])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                if (text := text.as_py()) is None:
                    continue
                if held and size + len(text) >= ROWS:
                    yield from made(batch.column(0), rows, held)
                    rows, held, size = [], [], 0
                rows.append(i)
                held.append(text)
                size += len(text) + 1
            if held:
                yield from made(batch.column(0), rows, held)

    return unsized(dealt(texts.select(id_col, text_col)).mapInArrow(run, ", ".join([f"{id_col} {kind}", *(f"{c} {t}" for c, t in schema.items())])))


def suffixes_of_texts(texts: list[str]) -> Suffixes:
    return suffixes_of([code_points(t) + 1 for t in texts])  # the symbol 0 is above the sentinel


def characters(codes: np.ndarray) -> pa.Array:
    """The symbols of suffixes_of_texts() as strings."""
    known, number = np.unique(codes, return_inverse=True)
    return pa.array([chr(c - 1) if c else SENTINEL for c in known.tolist()], pa.string()).take(pa.array(number))


def before_suffixes(s: Suffixes) -> np.ndarray:
    """The code before the suffix of each rank; 0 for a whole text."""
    return np.where(s.pos > 0, s.codes[s.order - 1], 0)


def suffix_table(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rank, pos, lcp (with the suffix of the rank before; 0 at rank 0), bwt (the symbol before the suffix; the sentinel, '', for the whole text)."""

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        return {OF: s.of, "rank": np.arange(len(s.of)) - s.start[s.of], "pos": s.pos, "lcp": np.maximum(s.lcp, 0), "bwt": characters(before_suffixes(s))}

    return per_document(texts, table, {"rank": "long", "pos": "long", "lcp": "long", "bwt": "string"}, id_col, text_col)


def bwt_selected(texts: DataFrame, nth: Sequence[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sym, j, pos: the rank of the j-th place of each symbol of a text's BWT, for each j of nth (from 1); null if there are fewer. Made where the suffix array is: suffixes are no rows."""
    nth = np.array(nth, dtype=np.int64)

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        before = before_suffixes(s)
        known, number = np.unique(before, return_inverse=True)
        group = s.of * len(known) + number
        ranks = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.append(True, group[ranks[1:]] != group[ranks[:-1]]))
        until = np.append(start[1:], len(ranks))
        at = (start[:, None] + nth - 1).ravel()
        first, there = np.repeat(ranks[start], len(nth)), at < np.repeat(until, len(nth))
        of, place = s.of[first], ranks[np.where(there, at, 0)]
        return {OF: of, "sym": characters(before[first]), "j": np.tile(nth, len(start)), "pos": pa.array(place - s.start[of], mask=~there)}

    return per_document(texts, table, {"sym": "string", "j": "long", "pos": "long"}, id_col, text_col)


def sequence_suffix_table(sequences: DataFrame, id_col: str = "seq_id", order_col: str = "pos", sym_col: str = "sym") -> DataFrame:
    """suffix_table() of sequences of numbers, given as rows: id, rank, pos, lcp, previous (null for the sentinel). Sorting is by number."""
    kind = sequences.schema[id_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by(order_col)
        sym = rows.column(sym_col).to_numpy()
        order, lcp = suffix_array(sym)
        before = [int(sym[p - 1]) if p else None for p in order.tolist()]
        key = pa.array([table.column(id_col)[0].as_py()] * len(order), table.column(id_col).type)
        return pa.table({id_col: key, "rank": pa.array(np.arange(len(order))), "pos": pa.array(order), "lcp": pa.array(lcp), "previous": pa.array(before, pa.int64())})

    return sequences.select(id_col, order_col, F.col(sym_col).cast("long").alias(sym_col)).groupBy(id_col).applyInArrow(run, f"{id_col} {kind}, rank long, pos long, lcp long, previous long")


def psi_and_lf(suffixes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, rank, pos, psi (rank of the suffix one symbol shorter) and lf (one symbol longer), both wrapping around."""
    by_place = Window.partitionBy(id_col).orderBy("pos")
    whole = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    psi = F.coalesce(F.lead("rank").over(by_place), F.first("rank").over(whole))
    lf = F.coalesce(F.lag("rank").over(by_place), F.last("rank").over(whole))
    return suffixes.select(id_col, "rank", "pos", psi.alias("psi"), lf.alias("lf"))


def shifted_rank(suffixes: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """id, rank, to: rank of the suffix k symbols further (k-fold psi; for k < 0, k-fold lf), modulo the number of suffixes."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    here = suffixes.select(id_col, "rank", F.pmod(F.col("pos") + k, n).alias("target"))
    there = suffixes.select(id_col, F.col("rank").alias("to"), F.col("pos").alias("target"))
    return here.join(there, [id_col, "target"]).select(id_col, "rank", "to")


def bad_orders(suffixes: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids whose table isn't a permutation in ascending order of suffixes. Empty for a right table.

    Instead of suffixes, symbols and the ranks of what follows them are compared: rank r comes before r + 1 if its symbol is smaller, or is
    the same and the suffix after it comes first.
    """
    at = suffixes.join(texts.select(id_col, text_col), id_col).select(id_col, "rank", "pos", F.length(text_col).alias("n"), F.substring(F.col(text_col), (F.col("pos") + 1).cast("int"), F.lit(1)).alias("sym"))
    follow = at.withColumn("next", F.lead("rank").over(Window.partitionBy(id_col).orderBy("pos")))
    order = Window.partitionBy(id_col).orderBy("rank")
    before = F.lag(F.struct("sym", F.coalesce("next", F.lit(-1)))).over(order)
    wrong = F.coalesce(before >= F.struct("sym", F.coalesce("next", F.lit(-1))), F.lit(False)) | (F.row_number().over(order) - 1 != F.col("rank"))
    tested = follow.select(id_col, "pos", "n", wrong.alias("wrong"))
    return tested.groupBy(id_col).agg(F.max("wrong").alias("wrong"), F.countDistinct("pos").alias("distinct"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).where("wrong or distinct <> rows or rows <> n + 1").select(id_col)


def alphabet(symbols: DataFrame, by: list[str] | None = None, sym_col: str = "sym") -> DataFrame:
    """by, sym, comp (its number), freq, c_before (symbols smaller than it): of all symbols, or for each group."""
    by = by or []
    counts = symbols.groupBy(*by, sym_col).agg(F.count(F.lit(1)).alias("freq"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(sym_col)
    running = F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("freq")
    return counts.select(*by, sym_col, (F.row_number().over(order) - 1).cast("long").alias("comp"), "freq", running.alias("c_before"))


def first_symbol(suffixes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, rank, sym: the first symbol of the suffix at each rank, from the counts of smaller symbols alone."""
    c = alphabet(suffixes.withColumnRenamed("bwt", "sym"), [id_col])
    return c.select(id_col, "sym", F.explode(F.sequence(F.col("c_before"), F.col("c_before") + F.col("freq") - 1)).alias("rank")).select(id_col, "rank", "sym")


def backward_step(suffixes: DataFrame, intervals: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """intervals (id, lb, rb, sym) with new_lb, new_rb: ranks of suffixes that have sym before what those of lb to rb start with. Empty: new_rb = new_lb - 1."""
    c = alphabet(suffixes.withColumnRenamed("bwt", "sym"), [id_col]).select(id_col, "sym", "c_before")
    seen = suffixes.select(id_col, F.col("bwt").alias("sym"), F.col("rank").alias("at"))
    keys = [id_col, "sym", "lb", "rb"]
    counted = intervals.select(*keys).distinct().join(seen, [id_col, "sym"], "left").groupBy(*keys).agg(F.count_if(F.col("at") < F.col("lb")).alias("to_lb"), F.count_if(F.col("at") <= F.col("rb")).alias("to_rb"))
    joined = intervals.join(counted, keys).join(c, [id_col, "sym"], "left")
    base = F.coalesce("c_before", F.lit(0))
    return joined.select(*intervals.columns, (base + F.col("to_lb")).alias("new_lb"), (base + F.col("to_rb") - 1).alias("new_rb"))


def intervals(suffixes: DataFrame, texts: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pattern_id, id, lb, rb: the ranks of suffixes that start with a pattern; documents without it have no row."""
    from runeframe.operators.search import occurrences

    places = occurrences(texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), patterns).withColumnRenamed("doc_id", id_col)
    return places.join(suffixes.select(id_col, "pos", "rank"), [id_col, "pos"]).groupBy("pattern_id", id_col).agg(F.min("rank").alias("lb"), F.max("rank").alias("rb"))


# ---- the index: suffixes of all documents by their first symbols


#: Symbols whose suffixes are sorted together in the index.
RUN = 2_000_000


def index_rows(docs: DataFrame, key: int) -> DataFrame:
    """doc_id, pos, key: every suffix by its first key symbols (fewer at the end of a text). Rows come in runs of about RUN symbols, each in the order of keys, then of its texts: suffixes don't travel."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, starts, size = [], [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                for at in range(0, len(text or ""), RUN):
                    ids.append(batch.column(0)[i : i + 1])
                    parts.append(text[at : at + RUN + key - 1])
                    starts.append(at)
                    size += len(parts[-1])
                    if size >= RUN:
                        yield from _sorted_run(ids, parts, starts, key)
                        ids, parts, starts, size = [], [], [], 0
        if parts:
            yield from _sorted_run(ids, parts, starts, key)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, pos long, key string")


def _sorted_run(ids: list[pa.Array], parts: list[str], starts: list[int], key: int) -> Iterator[pa.RecordBatch]:
    """The rows of parts of texts that start there, RUN suffixes of each at most: what a part holds beyond is for the last keys alone."""
    size = np.array([len(p) for p in parts])
    start, of = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    end = (start + size)[of]
    text = "".join(parts)
    known, number = np.unique(code_points(text), return_inverse=True)
    bits = int(len(known)).bit_length()
    packed, h, words = number + 1, 1, []
    while 2 * h * bits <= 62 and 2 * h <= key:
        packed, h = packed << (h * bits) | _ahead(packed, h, end), 2 * h
    for at in range(0, key, h):  # the last word may reach beyond the key
        word = _ahead(packed, at, end) if at else packed
        words.append(word >> ((at + h - key) * bits) if at + h > key else word)
    order = np.lexsort(words[::-1])
    order = order[order - start[of[order]] < RUN]
    every = pa.concat_arrays(ids)
    first = np.array(starts)[of] - start[of]
    for at in range(0, len(order), ROWS):
        some = order[at : at + ROWS]
        keys = pa.array([text[p : min(p + key, e)] for p, e in zip(some.tolist(), end[some].tolist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([every.take(pa.array(of[some])), pa.array(some + first[some]), keys], names=["doc_id", "pos", "key"])


#: Above every symbol.
LAST = "\U0010ffff"


#: Up to so many patterns a scan is told of the keys of each; more need most pages anyhow.
RANGES = 64


def in_range(index: DataFrame, patterns: list[str], key: int) -> DataFrame:
    """The part of an index whose keys can start with patterns (ascending): a range for each, or one from the first to the last; scans skip the pages of a run that lie outside."""
    if not patterns:
        return index.limit(0)
    groups = [[p] for p in patterns] if len(patterns) <= RANGES else [patterns]
    return index.where(reduce(or_, [F.col("key").between(g[0][:key], max(p[:key] + LAST for p in g)) for g in groups]))


def _bounds(keys: list[str], patterns: list[str], lows: list[str], key: int) -> Iterator[tuple[int, int, int]]:
    """(k, from, to) for patterns (in order) whose first key symbols start keys from to to of an ascending list. Only those that can stand between its ends are looked at, and their prefixes."""
    first = {keys[0][:m] for m in range(1, len(keys[0]) + 1)}
    whole = [k for q in first for k in range(bisect_left(lows, q), bisect_right(lows, q))]
    inside = range(bisect_left(lows, keys[0]), bisect_right(lows, keys[-1]))
    for k in sorted({*whole, *inside}):
        a, b = bisect_left(keys, lows[k]), bisect_right(keys, lows[k] + LAST)
        if b > a:
            yield k, a, b


def count_in_index(index: DataFrame, patterns: list[str], key: int) -> DataFrame:
    """k, n: places of patterns up to key symbols, from ascending keys alone. patterns: ascending."""
    held = index.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, total = held.value, {}
        for batch in batches:
            keys = sorted(batch.column(0).to_pylist())
            for k, a, b in _bounds(keys, lows, lows, key) if keys else ():
                total[k] = total.get(k, 0) + b - a
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["k", "n"])

    return in_range(index.select("key"), patterns, key).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))


def locate_in_index(index: DataFrame, patterns: list[str], key: int) -> DataFrame:
    """k, doc_id, pos: places whose key starts with the first key symbols of pattern k. patterns: ascending."""
    kind, held = index.schema["doc_id"].dataType.simpleString(), index.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = held.value
        lows = [p[:key] for p in patterns]
        for batch in batches:
            order = pc.sort_indices(batch.column(2))
            keys = batch.column(2).take(order).to_pylist()
            for k, a, b in _bounds(keys, patterns, lows, key) if keys else ():
                rows = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, k, "<i4")), batch.column(0).take(rows), batch.column(1).take(rows)], names=["k", "doc_id", "pos"])

    return in_range(index.select("doc_id", "pos", "key"), patterns, key).mapInArrow(run, f"k int, doc_id {kind}, pos long")


def look_up(index: DataFrame, docs: DataFrame, patterns: DataFrame, key: int) -> DataFrame:
    """pattern_id, doc_id, pos through an index of index_rows(). Patterns find
    their places in ascending keys by halving. For patterns longer than key that gives candidates, and the text decides. A batch that is too large for a task is joined on its keys instead."""
    from runeframe.operators.search import keys_at, level_of, numbered

    here: Column = F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.length("pattern")) == F.col("pattern")
    few = numbered(patterns)
    if few:
        known, ids = sorted(few[0]), patterns.where("length(pattern) > 0").select("pattern_id", "pattern")
        places = F.broadcast(patterns.sparkSession.createDataFrame(list(enumerate(known)), "k int, pattern string"))
        hits = locate_in_index(index, known, key).join(places, "k")
        short = hits.where(F.length("pattern") <= key)
        long = hits.where(F.length("pattern") > key).join(docs.select("doc_id", "text"), "doc_id").where(here) if any(len(p) > key for p in known) else hits.limit(0)
        return short.select("pattern", "doc_id", "pos").unionByName(long.select("pattern", "doc_id", "pos")).join(F.broadcast(ids), "pattern").select("pattern_id", "doc_id", "pos")
    wanted = patterns.where("length(pattern) > 0").select("pattern_id", "pattern", F.length("pattern").alias("m"))
    keyed = wanted.withColumn("q", F.substring(F.col("pattern"), F.lit(1), level_of(F.col("m"), key)))
    levels = [r[0] for r in keyed.select(level_of(F.col("m"), key)).distinct().collect()]
    each = index.select("doc_id", "pos", "key", F.explode(keys_at(F.col("key"), F.lit(0), sorted(levels))).alias("q"))
    hits = each.join(keyed, "q").where(F.substring(F.col("key"), F.lit(1), F.col("m")) == F.substring(F.col("pattern"), 1, key))
    short = hits.where(F.col("m") <= key).select("pattern_id", "doc_id", "pos")
    long = hits.where(F.col("m") > key).join(docs.select("doc_id", "text"), "doc_id").where(here).select("pattern_id", "doc_id", "pos")
    return short.unionByName(long)


def count_up(index: DataFrame, docs: DataFrame, patterns: DataFrame, key: int) -> DataFrame:
    """pattern_id, occurrences of patterns with symbols, those that occur, through an index. Patterns up to key symbols are counted on keys alone."""
    from runeframe.operators.search import numbered

    few = numbered(patterns)
    if not few:
        return look_up(index, docs, patterns, key).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("occurrences"))
    short = sorted(p for p in few[0] if len(p) <= key)
    places = F.broadcast(patterns.sparkSession.createDataFrame(list(enumerate(short)), "k int, pattern string"))
    found = count_in_index(index, short, key).join(places, "k").join(F.broadcast(patterns.select("pattern_id", "pattern")), "pattern").select("pattern_id", F.col("n").alias("occurrences"))
    if len(short) == len(few[0]):
        return found
    long = look_up(index, docs, patterns.where(F.length("pattern") > key), key).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("occurrences"))
    return found.unionByName(long)
