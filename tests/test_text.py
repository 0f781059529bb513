"""Texts, patterns and statistics against goldens and plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runeframe.functions import text as tx
from runeframe.operators import mining, search, stats

# Golden values: texts, entropy of order 0 and 1 (to 4 places), and where patterns stand.
GOLDEN = {
    "mississippi": (2.0850, 1.0000, {"ss": [2, 5], "issi": [1, 4], "i": [1, 4, 7, 10]}),
    "miss_mississippi": (2.2569, 1.0359, {"ss": [2, 7, 10], "issi": [6, 9], "i": [1, 6, 9, 12, 15]}),
    "el_anele_lepanelen_el_aneel_lepanllelen": (2.4880, 1.3707, {"el": [0, 5, 14, 19, 25, 35], "lepanelen": [9]}),
    "barbarabar_barbarbier_rabarbar_barbar_bierbar": (2.3465, 0.9009, {"bar": [0, 3, 7, 11, 14, 24, 27, 31, 34, 42], "i": [18, 39]}),
}


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def patterns(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pattern_id long, pattern string")


def places(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)]


def test_goldens(spark):
    for text, (h0, h1, found) in GOLDEN.items():
        docs = texts(spark, [text])
        got = Counter()
        for r in search.locate(docs, patterns(spark, list(found))).collect():
            got[r.pattern_id, r.pos] += 1
        assert got == Counter((i, p) for i, ps in enumerate(found.values()) for p in ps)
        for k, h in ((0, h0), (1, h1)):
            assert stats.context_entropy(docs, k).first().hk == pytest.approx(h, abs=5e-5)


def random_texts():
    rnd = random.Random(3)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 3, 50, 700]))) for alphabet in ("a", "ab", "abcd", "é\U0001f600a") for _ in range(4)] + [None, "x" * 40_000 + "y"]


def test_search_against_scans(spark):
    values = random_texts()
    rnd = random.Random(4)
    asked = ["", "a", "aa", "ab", "zz", "é\U0001f600", "x" * 39 + "y", "a" * 300] + [t[i : i + rnd.randint(1, 30)] for t in values if t for i in (len(t) // 2,)] + [None]
    docs, wanted = texts(spark, values), patterns(spark, asked)
    expected = Counter((i, d, p) for i, pattern in enumerate(asked) if pattern is not None for d, t in enumerate(values) if t is not None for p in places(t, pattern))
    assert Counter(map(tuple, search.locate(docs, wanted).collect())) == expected
    totals = Counter(k[0] for k in expected.elements())
    assert {r.pattern_id: r.occurrences for r in search.count(docs, wanted).collect()} == {i: totals[i] for i in range(len(asked))}
    assert {r.pattern_id for r in search.missing(docs, wanted).collect()} == {i for i in range(len(asked)) if not totals[i]}
    report = search.batch_report(docs, wanted).first()
    assert (report.patterns, report.occurrences, report.found) == (len(asked), sum(totals.values()), sum(1 for i in totals if totals[i]))
    first = {}
    for r in search.first_places(docs, wanted, 3).collect():
        first.setdefault(r.pattern_id, []).append((r["rank"], r.doc_id, r.pos))
    for i in range(len(asked)):
        best = sorted((d, p) for j, d, p in expected if j == i)[:3]
        assert sorted(first.get(i, [])) == [(n, d, p) for n, (d, p) in enumerate(best, 1)]


def test_search_of_nothing(spark):
    docs = texts(spark, ["abc"])
    assert search.locate(docs, patterns(spark, [])).count() == 0
    assert search.count(texts(spark, []), patterns(spark, ["a", ""])).agg(F.sum("occurrences")).first()[0] == 0


def test_context_stops_at_line_feeds(spark):
    docs = texts(spark, ["one\ntwo needle three\nfour", "needle"])
    got = [(r["rank"], r.left, r.right) for r in search.in_context(docs, patterns(spark, ["needle"]), 5, 6, 8).orderBy("rank").collect()]
    assert got == [(1, "two ", " three"), (2, "", "")]


def test_extract_and_stands_at(spark):
    row = texts(spark, ["abcdef"]).select(
        tx.extract(F.col("text"), F.lit(1), F.lit(3)), tx.extract(F.col("text"), F.lit(4), F.lit(6)), search.stands_at(F.col("text"), F.lit("ef"), F.lit(4)), search.stands_at(F.col("text"), F.lit("ef"), F.lit(5)), search.stands_at(F.col("text"), F.lit(""), F.lit(0))
    ).first()
    assert tuple(row) == ("bcd", None, True, False, False)


def test_matching_statistics(spark):
    rnd = random.Random(8)
    pairs = [(0, "mississippi", "missouri_ippi"), (1, "", "ab"), (2, "abc", ""), (3, None, "a")] + [(i, "".join(rnd.choice("ab") for _ in range(60)), "".join(rnd.choice("abc") for _ in range(40))) for i in range(4, 8)]
    got = {}
    for r in search.matching_statistics(spark.createDataFrame(pairs, "id long, first string, second string")).collect():
        got.setdefault(r.id, {})[r.pos] = r.length
    assert [got[0][p] for p in range(13)] == [4, 3, 2, 1, 0, 0, 0, 1, 0, 4, 3, 2, 1]
    for key, first, second in pairs:
        for p in range(len(second)):
            assert got[key][p] == max(m for m in range(len(second) - p + 1) if second[p : p + m] in (first or ""))


def test_kgrams_and_symbols(spark):
    values = random_texts()
    docs = texts(spark, values)
    for k in (1, 4, 40):
        expected = Counter((d, i, t[i : i + k]) for d, t in enumerate(values) if t for i in range(len(t) - k + 1))
        assert Counter(map(tuple, tx.kgrams(docs, k).collect())) == expected
    assert Counter(map(tuple, tx.symbols(docs).collect())) == Counter((d, i, c) for d, t in enumerate(values) if t for i, c in enumerate(t))
    with pytest.raises(ValueError):
        tx.kgrams(docs, 0)


def test_golden_frequent_kgrams(spark):
    docs = texts(spark, ["el_anele_lepanelen_el_aneel_lepanllelen"])
    assert sorted(map(tuple, mining.frequent_kgrams(docs, 4, 2, 3).collect())) == [(g, 2) for g in sorted("_ane _lep anel el_a elen epan l_an lepa nele".split())]
    assert mining.frequent_kgrams(docs, 4, 1, 1).count() == 18
    grid = {(r.k, r.least): r.candidates for r in mining.kgram_grid(docs, (4,), ((1, 1), (2, 3))).collect()}
    assert grid == {(4, 1): 18, (4, 2): 9}


def test_samples_are_repeatable(spark):
    grams = mining.frequent_kgrams(texts(spark, ["abcabdabeabf"]), 2, 1, 9)
    once = sorted(map(tuple, mining.sampled(grams, 3, 7).collect()))
    assert once == sorted(map(tuple, mining.sampled(grams.repartition(3), 3, 7).collect())) and len({p for _, p in once}) == 3
    many = mining.sampled(grams, 20, 7).collect()
    assert len(many) == 20 and len({r.pattern_id for r in many}) == 20 and {r.pattern for r in many} == {r.gram for r in grams.collect()}
    docs = texts(spark, ["hello world", "tiny", "", None])
    drawn = mining.random_patterns(docs, 30, 6, seed=2).collect()
    assert len(drawn) == 30 and all(len(r.pattern) == 6 and (r.pattern in "hello world" or r.pattern == "tiny\xff\xff") for r in drawn)
    moved = mining.random_patterns(docs, 30, 6, swaps=4, seed=2).collect()
    assert {r.pattern_id: sorted(r.pattern) for r in moved} == {r.pattern_id: sorted(r.pattern) for r in drawn}


def test_entropy_against_counts(spark):
    values = ["abracadabra", "aa", "", "cab"]
    for k in (0, 1, 2, 3):
        contexts = {}
        for t in values:
            for i in range(k, len(t) + 1):
                contexts.setdefault(t[i - k : i], []).append(t[i : i + 1])
        bits = sum(-m * math.log2(m / len(c)) for c in contexts.values() for m in Counter(c).values())
        got = stats.context_entropy(texts(spark, values), k).first()
        assert got.n == sum(len(t) + 1 for t in values) and got.contexts == len(contexts) and got.hk == pytest.approx(bits / got.n)


def test_nul_is_refused_and_replaced(spark):
    docs = texts(spark, ["a\x00b"])
    assert docs.select(tx.nul_replaced(F.col("text"))).first()[0] == "a\xffb"
    with pytest.raises(Exception, match="symbol 0"):
        tx.without_nul(docs).collect()


def test_borders_and_bits(spark):
    assert texts(spark, ["abacabab", "", None]).select(tx.border_table("text")).collect()[0][0] == [0, 0, 1, 0, 1, 2, 3, 2]
    k = F.lit(0b101100).cast("long")
    row = spark.range(1).select(tx.highest_bit(k), tx.nth_bit(k, F.lit(2)), tx.nth_bit(k, F.lit(4)), tx.next_bit(k, F.lit(3)), tx.previous_bit(k, F.lit(4)), tx.highest_bit(F.lit(0)), tx.encoded(F.lit("aé"))).first()
    assert tuple(row) == (5, 3, None, 5, 3, None, [97, 195, 169])
    assert spark.range(1).select(stats.bit_lcp(F.lit(2), F.lit(0b1100), F.lit(0b1001))).first()[0] == 8 * 2 + 7 - 2


def test_matching_statistics_of_batch(spark):
    patterns, texts = ["abcab", "bcd", "", None, "xy"], ["abcabcd", "zabz", "", None, "d\uffffa", "bcdabcab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.pos): r.length for r in search.matching_statistics_of_batch(docs, spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")).collect()}
    expected = {(i, p): max(n for n in range(len(t) - p + 1) if any(t[p : p + n] in x for x in patterns if x is not None)) for i, t in enumerate(texts) if t for p in range(len(t))}
    assert got == expected
