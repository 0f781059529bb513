"""What must not grow with the tables: rows sent to the driver, rows of one task, rows sorted where sums do."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runeframe.operators import arrays, blocks, mining, search, sequence, stats, suffixes, tree

TEXTS = [(i, t) for i, t in enumerate(["", "a", "aa", "mississippi", "a\x00a", "abab" * 30, None, "el_anele"])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_rows_made_of_texts_are_not_broadcast(spark):
    n = texts(spark)
    t = suffixes.suffix_table(n)
    parsed = blocks.block_table(n, 3, parse=True)
    rows = blocks.blocks(parsed, n)
    steps = n.select("doc_id", F.lit("a").alias("sym"), F.lit(0).cast("long").alias("lb"), F.lit(1).cast("long").alias("rb"))
    bwt = t.select("doc_id", F.col("rank").alias("pos"), F.col("bwt").alias("sym"))
    places = n.select("doc_id", F.lit("a").alias("pattern"), F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"))).alias("pos"))
    made = {
        "backward_step": suffixes.backward_step(t, steps),
        "shifted_rank": suffixes.shifted_rank(t, 3),
        "bad_orders": suffixes.bad_orders(t, n),
        "select": sequence.select(bwt, bwt.select("doc_id", "sym").distinct().withColumn("j", F.lit(1).cast("long")), ["doc_id"]),
        "reconstruct": blocks.reconstruct(blocks.factors(parsed), rows),
        "stands_in_factors": blocks.stands_in_factors(blocks.factors(parsed), rows, places),
        "label": tree.nodes(n).join(n, "doc_id"),
        "node_of_id": tree.node_of_id(tree.nodes(n), n.select("doc_id", F.lit(1).alias("query"), F.lit(2).cast("long").alias("node_id"))),
    }
    assert {name: plan(df).count("Broadcast") for name, df in made.items()} == dict.fromkeys(made, 0)


def test_texts_of_one_file_are_dealt_to_all_cores(spark):
    n = texts(spark)
    assert suffixes.suffix_table(n).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_ranked_together_are_ranked_as_alone():
    rnd = random.Random(5)
    some = [t or "" for _, t in TEXTS] + ["".join(rnd.choice("ab\U0001f600") for _ in range(rnd.randrange(40))) for _ in range(60)]
    s = suffixes.suffixes_of_texts(some)
    for i, text in enumerate(some):
        mine = s.of == i
        order = sorted(range(len(text) + 1), key=lambda p: text[p:])
        assert s.pos[mine].tolist() == order
        shared = [0, *(next((m for m in range(len(text) + 1) if text[a : a + m + 1] != text[b : b + m + 1] or max(a, b) + m >= len(text)), 0) for a, b in zip(order, order[1:], strict=False))]
        assert np.maximum(s.lcp[mine], 0).tolist() == shared


def test_parentheses_made_with_the_suffix_array(spark):
    n = texts(spark)
    pick = lambda p: sorted((r.doc_id, r.idx, r.bit) for r in p.select("doc_id", "idx", "bit").collect())
    assert tree.parentheses_of_texts(n).dtypes == tree.parentheses(tree.nodes(n)).select("doc_id", "idx", "bit").dtypes
    found = pick(tree.parentheses_of_texts(n))
    assert found == pick(tree.parentheses(tree.nodes(n))) and found
    assert "Exchange hashpartitioning" not in plan(tree.parentheses_of_texts(n))


def test_kgrams_are_summed_up_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(mining, "PART", 7)
    docs = texts(spark, [(0, "abcabdabeabf\U0001f600\U0001f600"), (1, "ab"), (2, None), (3, ""), (4, "a\x00a\x00a")])
    grams = [t[i : i + 2] for t in ("abcabdabeabf\U0001f600\U0001f600", "ab", "a\x00a\x00a") for i in range(len(t) - 1)]
    found = mining.frequent_kgrams(docs, 2, 1, 9)
    assert dict(map(tuple, found.collect())) == {g: grams.count(g) for g in grams}
    assert "Generate" not in plan(found)


def test_candidates_of_a_sample_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    some = spark.range(100).coalesce(1).selectExpr("cast(id as string) as gram").mapInArrow(run, "gram string")
    assert mining.sampled(some, 5).count() == 5
    assert made.value == 100


def test_bad_neighbours_are_found_without_ranges_of_cells(spark):
    rnd = random.Random(2)
    rows = [(k, 5 * i, float(rnd.randrange(6))) for k in range(3) for i in range(40)]
    values = spark.createDataFrame(rows, "key long, idx long, val double")
    good = arrays.smaller_neighbours(values, ["key"])
    bad = good.withColumn("psv", F.when((F.col("idx") == 50) & (F.col("key") == 1), F.col("idx") + 1).otherwise(F.col("psv"))).withColumn("nsv", F.when((F.col("idx") % 35 == 0) & F.col("nsv").isNotNull(), F.lit(None)).otherwise(F.col("nsv")))
    wrong = {(r.key, r.idx) for r in good.where("idx % 35 = 0 and nsv is not null or idx = 50 and key = 1").collect()}
    assert arrays.bad_neighbours(values, good, ["key"]).count() == 0
    found = arrays.bad_neighbours(values, bad, ["key"])
    assert {(r.query.key, r.query.idx) for r in found.collect()} == wrong and wrong
    assert "Generate" not in plan(found)
    v = np.array([rnd.randrange(9) for _ in range(50)])
    a, b = map(np.array, zip(*[(i, j) for i in range(50) for j in range(i + 1, 51)], strict=True))
    assert arrays.least_between(v, a, b).tolist() == [v[i:j].min() for i, j in zip(a, b, strict=True)]


def test_blocks_made_with_the_suffix_array(spark):
    rnd = random.Random(7)
    n = texts(spark, [*TEXTS, *((20 + i, "".join(rnd.choice("ab\x00") for _ in range(rnd.randrange(60)))) for i in range(20))])
    for b, parse in ((1, True), (3, True), (3, False), (70, False)):
        t = blocks.block_table(n, b, parse=parse).cache()
        rows = blocks.blocks(t, n)
        pairs = {
            "blocks": (blocks.blocks_of_texts(n, b, parse=parse), rows),
            "marked": (blocks.blocks_of_texts(n, b, parse=parse, mark="$"), blocks.blocks(t, n, mark="$")),
            "singletons": (blocks.singletons_of_texts(n, b, parse=parse), blocks.singletons(t)),
            "minimal_depths": (blocks.minimal_depths_of_texts(n, b, parse=parse), blocks.minimal_depths(rows)),
            "reductions": (blocks.reductions_of_texts(n, b, parse=parse), blocks.reductions(t)),
        }
        if parse:
            pairs |= {
                "factor_of_position": (blocks.factor_of_position_of_texts(n, b), blocks.factor_of_position(t)),
                "factor_frequencies": (blocks.factor_frequencies_of_texts(n, b), blocks.factor_frequencies(blocks.factors(t), rows)),
                "parse_report": (blocks.parse_report_of_texts(n, b), blocks.parse_report(blocks.factors(t), rows)),
            }
        for name, (made, joined) in pairs.items():
            assert made.dtypes == joined.dtypes, name
            assert sorted(map(tuple, made.collect())) == sorted(map(tuple, joined.collect())), (name, b, parse)
            assert name == "factor_frequencies" or "Exchange hashpartitioning" not in plan(made), name


def test_block_queries_move_no_rows_of_suffixes(spark, small):
    from runeframe.plans.queries import QUERIES

    for name in ("blocks_heavy_light", "block_reductions", "singleton_pointers", "block_minimal_depths", "factor_positions", "parse_report"):
        assert "Exchange hashpartitioning" not in plan(QUERIES[name](spark, small)), name


def test_patterns_meet_blocks_in_texts(spark, monkeypatch):
    rnd = random.Random(8)
    n = texts(spark, [*TEXTS, *((20 + i, "".join(rnd.choice("ab\x00") for _ in range(rnd.randrange(60)))) for i in range(5))])
    some = {"", "a", "ab", "ba", "issi", "mississippi", "zz", "abab", "a" * 9, "\x00a", *("".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 6))) for _ in range(8))}
    asked = spark.createDataFrame([(i, p) for i, p in enumerate([*sorted(some), "ab", None])], "pattern_id long, pattern string")
    for b, parse in ((3, True), (70, False)):
        rows = blocks.blocks(blocks.block_table(n, b, parse=parse), n).cache()
        for in_texts, joined in ((blocks.narrowed_in_texts, blocks.narrowed), (blocks.under_in_texts, blocks.under), (blocks.chunk_filter_in_texts, blocks.chunk_filter)):
            made, expected = in_texts(n, b, asked, parse=parse), joined(rows, asked)
            assert made.dtypes == expected.dtypes
            assert sorted(map(tuple, made.collect())) == sorted(map(tuple, expected.collect())), (in_texts.__name__, b, parse)
            assert "Exchange hashpartitioning" not in plan(made)
    expected = sorted(map(tuple, blocks.narrowed_in_texts(n, 3, asked).collect()))
    monkeypatch.setattr("runeframe.plans.sizing.MOST_ROWS", 5)
    assert sorted(map(tuple, blocks.narrowed_in_texts(n, 3, asked).collect())) == expected
    assert not blocks.under_in_texts(n, 3, asked.where("pattern = ''")).count()


def test_enclosing_pairs_made_with_the_suffix_array(spark, small):
    from runeframe.plans.queries import QUERIES

    n = texts(spark)
    made, joined = tree.enclosing_pairs_of_texts(n), arrays.enclosing_pairs(tree.parentheses_of_texts(n), ["doc_id"])
    assert made.dtypes == joined.dtypes
    assert set(map(tuple, made.collect())) == set(map(tuple, joined.collect())) and made.count() == joined.count()
    assert "Exchange hashpartitioning" not in plan(QUERIES["tree_parentheses"](spark, small))


def test_matches_by_numbers_are_those_of_the_walk():
    rnd = random.Random(9)
    for known in ("ab", "abcdefgh \U0001f600\x00", "".join(map(chr, range(900, 1500)))):
        patterns = ["".join(rnd.choice(known) for _ in range(rnd.randrange(70))) for _ in range(5)]
        some = ["", "".join(rnd.choice(known + "￿?") for _ in range(50)), *patterns, patterns[0] + patterns[1], "?" + patterns[2] * 2]
        walk = search.automaton(search.APART.join(patterns))
        expected = [x for t in some for x in [*search.longest_matches(walk, t.replace(search.APART, "￾")), 0]]
        for rounds in (1, 2, 99):
            assert search.Matcher(search.APART.join(patterns), rounds).lengths(some).tolist() == expected
    assert search.Matcher("").lengths(["ab", ""]).tolist() == [0, 0, 0, 0]


def test_matches_of_pairs_come_in_batches(spark, small):
    from runeframe.plans.queries import QUERIES

    assert "Broadcast" not in plan(QUERIES["matching_stats_names"](spark, small))
    pairs = spark.createDataFrame([(i, "abcab", "xabca") for i in range(500)] + [(500, None, "a"), (501, "a", None), (502, "a", "")], "id long, first string, second string").coalesce(1)
    found = search.matching_statistics(pairs)
    assert sorted(map(tuple, found.collect())) == sorted([(i, p, n) for i in range(500) for p, n in enumerate((0, 4, 3, 2, 1))] + [(500, 0, 0)])


def test_lcp_report_made_with_the_suffix_array(spark):
    n = texts(spark)
    made, joined = stats.lcp_report_of_texts(n), stats.lcp_report(suffixes.suffix_table(n))
    assert made.dtypes == joined.dtypes and sorted(map(tuple, made.collect())) == sorted(map(tuple, joined.collect()))
    assert "Exchange hashpartitioning" not in plan(made)


def test_bwt_places_made_with_the_suffix_array(spark, small):
    from runeframe.plans.queries import QUERIES

    n = texts(spark)
    bwt = suffixes.suffix_table(n).select("doc_id", F.col("rank").alias("pos"), F.col("bwt").alias("sym"))
    asked = bwt.select("doc_id", "sym").distinct().select("doc_id", "sym", F.explode(F.array(*[F.lit(j).cast("long") for j in (1, 2, 5)])).alias("j"))
    made, joined = suffixes.bwt_selected(n, (1, 2, 5)), sequence.select(bwt, asked, ["doc_id"])
    assert made.dtypes == joined.dtypes
    assert sorted(made.collect(), key=str) == sorted(joined.collect(), key=str) and made.where("pos is null").count()
    assert "Exchange hashpartitioning" not in plan(QUERIES["bwt_select"](spark, small))


def test_double_enclosing_leaves_made_with_the_suffix_array(spark, small):
    from runeframe.plans.queries import QUERIES

    rnd = random.Random(3)
    n = texts(spark, [*TEXTS, *((20 + i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(40)))) for i in range(20))])
    t = tree.nodes(n).cache()
    p = tree.parentheses(t).cache()
    opens = p.where("bit = 1").join(tree.numbered(t).where("lb = rb").select("doc_id", "node_id", F.col("lb").alias("leaf")), ["doc_id", "node_id"])
    for apart in (1, 2, 3):
        pairs = opens.select("doc_id", F.col("leaf").alias("query"), F.col("idx").alias("i")).join(opens.select("doc_id", (F.col("leaf") - apart).alias("query"), F.col("idx").alias("j")), ["doc_id", "query"])
        made, joined = tree.double_enclosing_leaves(n, apart), arrays.double_enclosing(p.select("doc_id", "idx", "bit"), pairs, ["doc_id"])
        assert made.dtypes == joined.dtypes
        assert sorted(made.collect(), key=str) == sorted(joined.collect(), key=str)
    assert "Exchange hashpartitioning" not in plan(QUERIES["double_enclose"](spark, small))


def test_index_rows_are_sorted_where_they_are_made(spark, monkeypatch):
    rows = suffixes.index_rows(texts(spark), 3).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
    assert "rangepartitioning" not in plan(rows)
    found = rows.orderBy("nth").collect()
    assert all(a.key <= b.key for a, b in zip(found, found[1:], strict=False) if a.part == b.part)
    assert sorted((r.doc_id, r.pos, r.key) for r in found) == sorted((i, p, t[p : p + 3]) for i, t in TEXTS if t for p in range(len(t)))
    monkeypatch.setattr(suffixes, "RUN", 5)
    rnd = random.Random(3)
    for key in (1, 3, 12, 40):
        some = ["".join(rnd.choice("ab\x00é\U0001f600") for _ in range(rnd.randrange(1, 60))) for _ in range(20)]
        parts = [(i, at, t[at : at + 5 + key - 1]) for i, t in enumerate(some) for at in range(0, len(t), 5)]
        made = suffixes._sorted_run([pa.array([i]) for i, _, _ in parts], [p for _, _, p in parts], [at for _, at, _ in parts], key)
        got = [tuple(r.values()) for batch in made for r in batch.to_pylist()]
        assert got == sorted(((i, p, t[p : p + key]) for i, t in enumerate(some) for p in range(len(t))), key=lambda r: (r[2], r[0], r[1]))


def test_substrings_of_the_grid_travel_packed(spark):
    docs = texts(spark, [(i, t) for i in range(3) for _, t in TEXTS] + [(9, "".join(chr(97 + (i * i) % 7) for i in range(500)))])
    rows = [t for _ in range(3) for _, t in TEXTS if t] + ["".join(chr(97 + (i * i) % 7) for i in range(500))]
    found = mining.kgram_grid(docs, (2, 5, 40), ((1, 1), (2, 6), (5, 10**6)))
    assert "FlatMapGroupsInArrow" in plan(found) and "low" not in plan(found)
    expected = {}
    for k in (2, 5, 40):
        grams = [t[i : i + k] for t in rows for i in range(len(t) - k + 1)]
        for n in (grams.count(g) for g in set(grams)):
            cell = (k, 1, 1) if n == 1 else (k, 2, 6) if n <= 6 else (k, 5, 10**6)
            expected[cell] = expected.get(cell, 0) + 1
    assert {(r.k, r.least, r.most): r.candidates for r in found.collect()} == expected


def test_packed_substrings_meet_by_all_their_bits():
    low, high, n = np.array([0, 5, 2**64 - 1], np.uint64), np.array([7, 0, 2**32 - 1], np.uint64), np.array([1, 300, 2])
    pack = lambda l, h, c: mining._planes(np.diff(l, prepend=np.uint64(0))) + mining._planes(h) + mining._planes(c)  # noqa: E731,E741
    same, other = pack(low, high, n), pack(low, high + np.array([1, 0, 0], np.uint64), n)
    assert sorted(mining._met([3, 3], [same, same]).tolist()) == [2, 4, 600]
    assert sorted(mining._met([3, 3], [same, other]).tolist()) == [1, 1, 4, 600]


def test_rows_of_trees_lie_by_place(spark):
    made = {"nodes": (tree.nodes, ["lb", "rb"]), "parentheses": (tree.parentheses_of_texts, ["idx"]), "suffix links": (tree.suffix_links, ["link_lb", "link_rb"]), "weiner links": (tree.weiner_links, ["link_lb", "link_rb"])}
    some = spark.createDataFrame([(i, "banana" * (i % 3)) for i in range(400)], "doc_id long, text string")
    for name, (make, order) in made.items():
        found = make(some).select("doc_id", F.struct(*order).alias("at"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")).orderBy("nth").collect()
        assert all(a.at <= b.at for a, b in zip(found, found[1:], strict=False) if a.part == b.part), name
        assert len({r.doc_id for r in found[:3] if r.at == found[0].at}) > 1, name
