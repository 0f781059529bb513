"""Rank, select, ranges, bits, minima and trees against scans."""

import random

from pyspark.sql import functions as F

from runeframe.operators import arrays, sequence

# A crafted bit vector of length 32, the places of its ones, and some of its ranks.
ONES, LENGTH, RANKS = [1, 4, 7, 18, 24, 26, 30, 31], 32, {0: 0, 5: 2, 18: 3, 19: 4, 31: 7, 32: 8}


def sequences(spark, rnd, by=True):
    values = {s: [rnd.randint(0, 5) for _ in range(n)] for s, n in enumerate((0, 1, 40, 300))}
    return values, spark.createDataFrame([(s, i, v) for s, vs in values.items() for i, v in enumerate(vs)], "seq_id long, pos long, sym long")


def test_rank_select_access(spark):
    values, seq = sequences(spark, random.Random(1))
    by = ["seq_id"]
    asked = [(q, s, i, c) for q, (s, i, c) in enumerate((s, i, c) for s in values for i in (0, 1, 7, 40, 1000) for c in (0, 3, 9))]
    got = {r.query: r["rank"] for r in sequence.rank(seq, spark.createDataFrame(asked, "query long, seq_id long, i long, sym long"), by).collect()}
    assert got == {q: values[s][:i].count(c) for q, s, i, c in asked}
    wanted = [(q, s, j, c) for q, (s, j, c) in enumerate((s, j, c) for s in values for j in (1, 2, 10, 99) for c in (0, 3, 9))]
    for r in sequence.select(seq, spark.createDataFrame(wanted, "query long, seq_id long, j long, sym long"), by).collect():
        at = [i for i, v in enumerate(values[r.seq_id]) if v == r.sym]
        assert r.pos == (at[r.j - 1] if r.j <= len(at) else None)
    places = spark.createDataFrame([(s, i) for s in values for i in (0, 5, 39, 500)], "seq_id long, pos long")
    for r in sequence.inverse_select(seq, places, by).collect():
        inside = r.pos < len(values[r.seq_id])
        assert (r.sym, r["rank"]) == ((values[r.seq_id][r.pos], values[r.seq_id][: r.pos].count(values[r.seq_id][r.pos])) if inside else (None, None))
    assert sequence.access(seq, places, by).where("sym is null").count() == sum(1 for s in values for i in (0, 5, 39, 500) if i >= len(values[s]))


def test_ranges(spark):
    values, seq = sequences(spark, random.Random(2))
    by, rnd = ["seq_id"], random.Random(3)
    asked = [(q, s, *sorted((rnd.randint(0, 310), rnd.randint(0, 310))), rnd.randint(0, 9)) for q, s in enumerate(list(values) * 8)]
    frame = spark.createDataFrame(asked, "query long, seq_id long, i long, j long, sym long")
    symbols = {}
    for r in sequence.interval_symbols(seq, frame.drop("sym"), by, width=16).collect():
        symbols.setdefault(r.query, {})[r.sym] = (r.rank_i, r.rank_j)
    smaller = {r.query: r.smaller for r in sequence.count_lex_smaller(seq, frame, by, width=16).collect()}
    zero = {r.query: r.smaller for r in sequence.count_lex_smaller(seq, frame, by, absent_is_zero=True, width=16).collect()}
    for q, s, i, j, c in asked:
        part = values[s][i:j]
        assert symbols.get(q, {}) == {x: (values[s][:i].count(x), values[s][:j].count(x)) for x in set(part)}
        assert smaller[q] == sum(x < c for x in part) and zero[q] == (smaller[q] if c in values[s] else 0)
    boxes = frame.select("query", "seq_id", "i", "j", F.lit(1).alias("low"), F.lit(3).alias("high"))
    found = sorted((r.query, r.pos, r.value) for r in sequence.range_search_2d(seq, boxes, by, width=16).collect())
    assert found == sorted((q, p, v) for q, s, i, j, _ in asked for p, v in enumerate(values[s]) if i <= p <= j and 1 <= v <= 3)


def test_runs(spark):
    seq = spark.createDataFrame([(i * 3, c) for i, c in enumerate("aabbba")], "pos long, sym string")
    assert sorted(map(tuple, sequence.runs(seq).select("start", "sym", "length").collect())) == [(0, "a", 2), (6, "b", 3), (15, "a", 1)]


def test_golden_bits(spark):
    bits = spark.createDataFrame([(i, i in ONES) for i in range(LENGTH + 1)], "pos long, bit boolean")
    rank = {r.pos: r for r in sequence.bit_ranks(bits).collect()}
    assert {i: rank[i].rank1 for i in RANKS} == RANKS and all(rank[i].rank0 == i - rank[i].rank1 for i in range(LENGTH))
    assert rank[LENGTH].rank10 == 6 - 0 and rank[LENGTH].rank01 == 7
    picks = {(r.pattern, r.j): r.pos for r in sequence.bit_selects(bits.where(F.col("pos") < LENGTH)).collect()}
    assert picks["1", 3] == 7 and [picks["1", j] for j in range(1, 9)] == ONES and ("1", 9) not in picks
    pairs = sequence.pair_counts(bits.where(F.col("pos") < LENGTH)).first()
    assert (pairs.ones, pairs.pairs10, pairs.pairs01) == (8, 6, 7)
    near = {r.pos: (r.previous, r.following) for r in sequence.nearest_ones(bits).collect()}
    assert all(near[i] == (max((o for o in ONES if o <= i), default=None), min((o for o in ONES if o >= i), default=None)) for i in range(LENGTH))
    changed = sequence.with_bit(bits, spark.createDataFrame([(0, True), (31, False)], "pos long, bit boolean"))
    assert sorted(r.pos for r in changed.where("bit").collect()) == [0, *ONES[:-1]]


def test_degenerate_bits(spark):
    for value in (True, False):
        bits = spark.createDataFrame([(i, value) for i in range(7)], "pos long, bit boolean")
        assert {r.pos: r.rank1 for r in sequence.bit_ranks(bits).collect()} == {i: i * value for i in range(7)}
    assert sequence.bit_ranks(spark.createDataFrame([], "pos long, bit boolean")).count() == 0
    once = sequence.random_bits(spark, 100, 3).orderBy("pos").collect()
    assert once == sequence.random_bits(spark, 100, 3).repartition(3).orderBy("pos").collect()
    assert sequence.constant(spark, 5, 9).agg(F.sum("val")).first()[0] == 45 and sequence.modulo(sequence.identity(spark, 10), 3).agg(F.sum("val")).first()[0] == 9
    assert sequence.identity(spark, 10).agg(sequence.width_in_bits(F.col("val"))).first()[0] == 4


def test_range_extremes(spark):
    rnd = random.Random(4)
    for values in ([], [42], list(range(50)), [rnd.randint(0, 9) for _ in range(200)]):
        frame = spark.createDataFrame(list(enumerate(values)), "idx long, val long")
        asked = [(q, *x) for q, x in enumerate([(0, 0), (3, 40), (5, 5), (10, 199), (150, 300), (9, 2)])]
        queries = spark.createDataFrame(asked, "query long, l long, r long")
        for largest in (False, True):
            got = {r.query: r.idx for r in arrays.extreme_in_ranges(frame, queries, largest=largest, width=8).collect()}
            for q, l, r in asked:
                part = values[l : r + 1]
                assert got[q] == (l + part.index((max if largest else min)(part)) if part else None)


def test_smaller_neighbours_and_descent(spark):
    rnd = random.Random(5)
    values = {"a": [rnd.randint(0, 6) for _ in range(60)], "b": [1]}
    frame = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "key string, idx long, val long")
    for r in arrays.smaller_neighbours(frame, ["key"]).collect():
        v = values[r.key]
        assert r.psv == max((i for i in range(r.idx) if v[i] < r.val), default=None) and r.nsv == min((i for i in range(r.idx + 1, len(v)) if v[i] < r.val), default=None)
    steps = sorted((r.step, r.l, r.r, r.idx) for r in arrays.descent(frame, ["key"]).where("key = 'a'").collect())
    low, high = 0, 59
    for _, l, r, idx in steps:
        assert (l, r) == (low, high) and idx == l + values["a"][l : r + 1].index(min(values["a"][l : r + 1]))
        low, high = (l, idx - 1) if idx - l >= r - idx else (idx + 1, r)
    assert low > high and arrays.descent(frame, ["key"], 2).where("key = 'a'").count() == 2


def test_ordinal_trees(spark):
    edges = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 3)], "child long, parent long")
    rows = {r.child: (r.parent, r.child_no, r.degree) for r in arrays.ordinal_tree(edges).collect()}
    assert rows == {0: (None, None, 3), 1: (0, 1, 2), 2: (0, 2, 0), 3: (0, 3, 1), 4: (1, 1, 0), 5: (1, 2, 0), 6: (3, 1, 0)}
    assert "".join(str(r.bit) for r in arrays.louds(edges).orderBy("pos").collect()) == "1110" "110" "0" "10" "0" "0" "0"
