"""Pattern search over documents: count, locate, context, earliest places, batches.

Occurrences may overlap and never cross documents. A batch of patterns is one pass over the texts. A batch that is counted to be small makes one automaton in each task, which
walks the texts and gives hits alone, with their context where it is asked for; counts are summed up in the task. A larger batch is joined: a pattern's key is its first q symbols, q the largest
of LEVELS that it reaches; the q-grams at each place of a text, for the levels that the batch has, join the keys; what is left of a pattern is compared
where it would stand. An empty pattern stands at every place from 0 to the length of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.functions.text import SMALL, pieces
from runeframe.operators.suffixes import OF, code_points, per_document
from runeframe.plans.sizing import is_small, small_side, spread

try:
    import ahocorasick
except ImportError:  # then all batches are joined
    ahocorasick = None

#: Lengths of keys.
LEVELS = (1, 2, 3, 4, 6, 8, 12)
#: Hits of a batch of results.
HITS = 100_000


def level_of(m: Column, most: int = LEVELS[-1]) -> Column:
    """The largest level up to a length (1 at least)."""
    return F.greatest(*[F.when(m >= q, q).otherwise(0) for q in LEVELS if q <= most], F.lit(0))


def keys_at(text: Column, at: Column, levels: list[int]) -> Column:
    """The substrings of a text from a place (from 0) on, one for each level that fits in."""
    return F.array_compact(F.array(*[F.when(F.length(text) - at >= q, F.substring(text, at + 1, F.lit(q))) for q in levels]))


def numbered(patterns: DataFrame) -> tuple[list[str], DataFrame] | None:
    """The distinct patterns with symbols, if they are counted to be few, and pattern_id, k: each pattern's place in that list."""
    wanted = patterns.where("length(pattern) > 0").select("pattern_id", "pattern")
    if not is_small(wanted, "pattern"):
        return None
    known = [r[0] for r in wanted.select("pattern").distinct().collect()]
    places = patterns.sparkSession.createDataFrame(list(enumerate(known)), "k int, pattern string")
    return known, wanted.join(F.broadcast(places), "pattern").select("pattern_id", "k")


def automaton_of(patterns: list[str]):
    """Finds (end, (k, length)) of all places of all patterns in a text."""
    out = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        out.add_word(p, (k, len(p)))
    out.make_automaton()
    return out


def scanned(docs: DataFrame, patterns: list[str], before: int = -1, after: int = 0) -> DataFrame:
    """doc_id, k, pos of every hit; with before >= 0 also left and right, the text around it up to a line feed."""
    kind, held, context = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(patterns), before >= 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton_of(held.value)
        for batch in batches:
            row, k, pos, left, right = [], [], [], [], []

            def send(ids: pa.Array = batch.column(0)) -> pa.RecordBatch:
                columns = [ids.take(pa.array(row, pa.int64())), pa.array(k, pa.int32()), pa.array(pos, pa.int64()), *([pa.array(left, pa.string()), pa.array(right, pa.string())] if context else [])]
                out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "pos", *(["left", "right"] if context else [])])
                for column in (row, k, pos, left, right):
                    column.clear()
                return out

            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                for end, (which, m) in find.iter(text):
                    at = end - m + 1
                    row.append(i)
                    k.append(which)
                    pos.append(at)
                    if context:
                        left.append(text[max(0, at - before) : at].rpartition("\n")[2])
                        right.append(text[end + 1 : end + 1 + after].partition("\n")[0])
                    if len(k) >= HITS:
                        yield send()
            if k:
                yield send()

    schema = f"doc_id {kind}, k int, pos long" + (", left string, right string" if context else "")
    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def counted(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """k, occurrences of the patterns that occur."""
    held = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = automaton_of(held.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(x[1][0] for x in find.iter(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["k", "n"])

    return spread(docs.select("text")).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("occurrences"))


def everywhere(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, doc_id, pos of empty patterns: every place of every text."""
    places = docs.where("text is not null").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"))).alias("pos"))
    empty = patterns.where("pattern = ''").select(F.collect_list("pattern_id").alias("ids"))  # each of them is told all places, so there are few
    return places.join(F.broadcast(empty)).select(F.explode("ids").alias("pattern_id"), "doc_id", "pos")


def joined(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, doc_id, pos of patterns with symbols, however many."""
    wanted = patterns.where("length(pattern) > 0").select("pattern_id", "pattern", F.length("pattern").alias("m"))
    lengths = wanted.agg(F.collect_set(level_of(F.col("m"))).alias("levels"), F.max(F.col("m") > level_of(F.col("m"))).alias("longer")).first()
    if not lengths.levels:
        return docs.select(F.lit(None).cast(patterns.schema["pattern_id"].dataType).alias("pattern_id"), "doc_id", F.lit(0).cast("long").alias("pos")).where(F.lit(False))
    keyed = small_side(wanted.withColumn("key", F.substring(F.col("pattern"), F.lit(1), level_of(F.col("m")))), "pattern")
    cut = pieces(docs.select("doc_id", "text"), max(lengths.levels) - 1)
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.length("piece"), F.lit(SMALL)) - 1), lambda at: F.transform(keys_at(F.col("piece"), at, sorted(lengths.levels)), lambda k: F.struct(at.alias("at"), k.alias("key")))))
    each = cut.select("doc_id", "start", F.explode(keys).alias("x")).select("doc_id", (F.col("start") + F.col("x.at")).alias("pos"), F.col("x.key").alias("key"))
    found = each.join(keyed, "key")
    if lengths.longer:  # candidates are few by now; the texts decide
        here = F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.col("m")) == F.col("pattern")
        found = found.join(docs.select("doc_id", "text"), "doc_id").where(here)
    return found.select("pattern_id", "doc_id", "pos")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, doc_id, pos for docs (doc_id, text) and patterns (pattern_id, pattern)."""
    few = numbered(patterns) if ahocorasick else None
    found = scanned(docs, few[0]).join(F.broadcast(few[1]), "k").select("pattern_id", "doc_id", "pos") if few else joined(docs, patterns)
    return found.unionByName(everywhere(docs, patterns)) if patterns.where("pattern = ''").limit(1).count() else found


def count(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, occurrences: for every pattern, 0 included."""
    few = numbered(patterns) if ahocorasick else None
    found = few[1].join(counted(docs, few[0]), "k").select("pattern_id", "occurrences") if few else joined(docs, patterns).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("occurrences"))
    places = docs.where("text is not null").agg(F.coalesce(F.sum(F.length("text").cast("long") + 1), F.lit(0)).alias("places"))  # of an empty pattern
    all_of_them = patterns.select("pattern_id", (F.col("pattern") == "").alias("empty")).join(found, "pattern_id", "left").join(F.broadcast(places))
    return all_of_them.select("pattern_id", F.when(F.col("empty"), F.col("places")).otherwise(F.coalesce("occurrences", F.lit(0))).alias("occurrences"))


def locate(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, doc_id, pos: a set; sort it where order matters."""
    return occurrences(docs, patterns)


def missing(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """The patterns that occur nowhere."""
    return patterns.join(count(docs, patterns).where("occurrences > 0").select("pattern_id"), "pattern_id", "left_anti")


def batch_report(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: patterns, occurrences in all, patterns that occur."""
    return count(docs, patterns).agg(F.count(F.lit(1)).alias("patterns"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.count_if(F.col("occurrences") > 0).alias("found"))


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("pattern_id").orderBy("doc_id", "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_places(docs: DataFrame, patterns: DataFrame, k: int) -> DataFrame:
    """pattern_id, rank, doc_id, pos: the k earliest places of each pattern, by document, then position."""
    return _first(occurrences(docs, patterns), k).select("pattern_id", "rank", "doc_id", "pos")


def in_context(docs: DataFrame, patterns: DataFrame, k: int = 5, before: int = 10, after: int = 10) -> DataFrame:
    """first_places() with left and right, the text around a place, up to a line feed."""
    few = numbered(patterns) if ahocorasick and not patterns.where("pattern = ''").limit(1).count() else None
    if few:  # what stands around a hit comes with it
        return _first(scanned(docs, few[0], before, after).join(F.broadcast(few[1]), "k").drop("k"), k).select("pattern_id", "rank", "doc_id", "pos", "left", "right")
    places = first_places(docs, patterns, k).join(patterns.select("pattern_id", F.length("pattern").alias("m")), "pattern_id").join(docs.select("doc_id", "text"), "doc_id")
    begin = F.greatest(F.col("pos") - before, F.lit(0))
    left, right = F.substring("text", begin.cast("int") + 1, (F.col("pos") - begin).cast("int")), F.substring(F.col("text"), (F.col("pos") + F.col("m") + 1).cast("int"), F.lit(after))
    return places.select("pattern_id", "rank", "doc_id", "pos", F.substring_index(left, "\n", -1).alias("left"), F.substring_index(right, "\n", 1).alias("right"))


def stands_at(text: Column, pattern: Column, pos: Column) -> Column:
    """Whether a non-empty pattern stands at a place; false past the end."""
    return (F.length(pattern) > 0) & (pos >= 0) & (F.substring(text, pos.cast("int") + 1, F.length(pattern)) == pattern)


def automaton(first: str) -> tuple[list[int], list[int], list[dict[str, int]]]:
    """Links, sizes and steps of the automaton of all substrings of a text, read backwards."""
    # Matches that end at each place of reversed texts are matches that start there in the texts.
    link, size, follow, last = [-1], [0], [{}], 0
    for c in reversed(first):
        new = len(size)
        link.append(0)
        size.append(size[last] + 1)
        follow.append({})
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(size)
                link.append(link[q])
                size.append(size[p] + 1)
                follow.append(dict(follow[q]))
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return link, size, follow


def longest_matches(known: tuple[list[int], list[int], list[dict[str, int]]], second: str) -> list[int]:
    """For each place of second, the longest match from there on."""
    link, size, follow = known
    out, state, n = [], 0, 0
    for c in reversed(second):
        while state and c not in follow[state]:
            state = link[state]
            n = size[state]
        if c in follow[state]:
            state, n = follow[state][c], n + 1
        out.append(n)
    return out[::-1]


def matching_statistics(pairs: DataFrame) -> DataFrame:
    """id, pos, length for pairs (id, first, second): the longest match of second from pos on that stands in first.

    The automaton of all substrings of first is walked along second, so a pair costs time in proportion to its texts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, sizes, length = [], [], []

            def send(ids: pa.Array = batch.column(0)) -> pa.RecordBatch:
                of, each = np.repeat(np.array(row), sizes), np.array(sizes)
                pos = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
                out = pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(pos), pa.array(length, pa.int64())], names=["id", "pos", "length"])
                for column in (row, sizes, length):
                    column.clear()
                return out

            for i, (first, second) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if second:
                    row.append(i)
                    sizes.append(len(second))
                    length += longest_matches(automaton(first or ""), second)
                    if len(length) >= HITS:
                        yield send()
            if row:
                yield send()

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", "first", "second").mapInArrow(run, f"id {kind}, pos long, length long")


#: Ends a pattern where several are read as one text; a text never matches it.
APART = "\uffff"


#: Rounds of comparing as many symbols as a number holds, and numbers that all rounds hold together. A text with longer matches is walked.
ROUNDS, HELD = 32, 1 << 24


class Matcher:
    """The longest match in patterns (joined by APART) from each place of texts.

    Substrings of patterns are told apart by as many symbols as a number holds, in rounds: numbers of a round are the substring so far and the symbols that follow. A place finds its neighbours in the
    ascending numbers by halving, and shares the most symbols with one of the two. Places that share all of them go on to the next round.
    """

    def __init__(self, joined: str, rounds: int = ROUNDS):
        codes = code_points(joined)
        self.joined, self.walked = joined, None
        self.known = np.unique(codes[codes != ord(APART)])
        self.bits = (len(self.known) + 1).bit_length()
        self.h = max(1, (62 - len(codes).bit_length()) // self.bits)
        # APART and what lies behind the last pattern is no symbol of a text, and what a text has beside the known ones, 0, is none of the patterns
        end = len(self.known) + 1
        packed = self.packed(np.where(codes == ord(APART), end, np.searchsorted(self.known, codes) + 1), end)
        after = np.flatnonzero(np.append(codes == ord(APART), True))
        left = after[np.searchsorted(after, np.arange(len(codes)))] - np.arange(len(codes))  # symbols up to the pattern's end
        at, group, self.rounds = np.flatnonzero(left > 0), np.zeros(len(codes), dtype=np.int64), []
        while len(at) and len(self.rounds) < min(rounds, max(1, HELD // len(codes))):
            keys, group[at] = np.unique(group[at] << (self.h * self.bits) | packed[at + len(self.rounds) * self.h], return_inverse=True)
            self.rounds.append(keys)
            at = at[left[at] > len(self.rounds) * self.h]
        self.whole = not len(at)

    def packed(self, numbers: np.ndarray, end: int) -> np.ndarray:
        """The h numbers from each place on as one; end behind the last."""
        out, padded = np.zeros(len(numbers), dtype=np.int64), np.concatenate((numbers, np.full(self.h, end)))
        for j in range(self.h):
            out = out << self.bits | padded[j : j + len(numbers)]
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """For the places of all texts, each with one behind its end."""
        codes = code_points(APART.join(texts) + APART)
        place = np.minimum(np.searchsorted(self.known, codes), max(0, len(self.known) - 1))
        packed = self.packed(np.where(self.known[place] == codes, place + 1, 0) if len(self.known) else np.zeros(len(codes), dtype=np.int64), 0)
        length, at, group, all_of = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), self.h * self.bits
        for r, keys in enumerate(self.rounds):
            # A place that shares all symbols so far ends before its text does, so there is a place r * h further
            asked = group << all_of | packed[at + r * self.h]
            near = np.searchsorted(keys, asked)
            differ = np.minimum(asked ^ keys[np.maximum(near - 1, 0)], asked ^ keys[np.minimum(near, len(keys) - 1)])
            for j in range(1, self.h + 1):
                length[at] += differ < (1 << (all_of - j * self.bits))
            some = np.flatnonzero(differ == 0)
            at, group = at[some], near[some]
            if not len(at):
                break
        if len(at) and not self.whole:
            ends = np.cumsum([len(t) + 1 for t in texts])
            self.walked = self.walked or automaton(self.joined)
            for i in np.unique(np.searchsorted(ends, at, side="right")).tolist():
                length[ends[i] - len(texts[i]) - 1 : ends[i] - 1] = longest_matches(self.walked, texts[i].replace(APART, "\ufffe"))
        return length


def matching_statistics_of_batch(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, pos, length for docs (doc_id, text) and patterns (pattern_id, pattern): the longest match of a text from pos on that stands in any pattern.

    Patterns are read to the driver and held by each task, so their total must fit there.
    """
    joined = APART.join(r[0] for r in patterns.where("pattern is not null").select("pattern").distinct().collect())
    held = docs.sparkSession.sparkContext.broadcast(joined)

    def table(texts: list[str]) -> dict:
        sizes = np.array([len(t) for t in texts])
        of = np.repeat(np.arange(len(texts)), sizes + 1)
        pos = np.arange(len(of)) - (np.cumsum(sizes + 1) - sizes - 1)[of]
        some = np.flatnonzero(pos < sizes[of])
        return {OF: of[some], "pos": pos[some], "length": _matcher(held.value).lengths(texts)[some]}

    return per_document(docs.select("doc_id", "text"), table, {"pos": "long", "length": "long"})


@lru_cache(maxsize=1)
def _matcher(joined: str) -> Matcher:
    return Matcher(joined)
