"""Suffix tables, blocks and trees against goldens and plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runeframe.functions.text import symbols
from runeframe.operators import arrays, blocks, search, stats, suffixes, tree
from tests.test_text import patterns, random_texts, texts

FIGURES = ["mississippi", "miss_mississippi", "el_anele_lepanelen_el_aneel_lepanllelen", "barbarabar_barbarbier_rabarbar_barbar_bierbar"]
# Golden values for these texts: BWT ($ for the end), runs, mean LCP where known.
BWT = ["ipssm$pissii", "ispsmsm$_pisssiii", "nllnel__ppln_$enlnlllleeeelee__neeaaaaee", "rrrrrrrbbbbbbbbbbrrarra_$_rr_iibbaaaaea_eaaaaa"]
RUNS, MEAN_LCP = [9, 13, 24, 19], [1.083333, None, 2.125, 3.326087]
# Golden values at b = 3: number of blocks, of single ones, reducible ones, irreducible ones, and the parse.
BLOCKS = [
    (8, 4, "si ss", "is p", "m is si ss ip p i$"),
    (10, 5, None, None, "m is s_ m is si ss ip p i$"),
    (23, 11, "_a en ep l_ len lep ne p", "_l ane el_ ele", "el_ ane le_ lep ane len _e l_ ane el_ lep anl lel en $"),
    (30, 18, "_b ab ar_ arbar_ e i r_b rbar_", "bar_ barbar_ bi ra", "barbara bar_ barbarb i e r_r ab arbar_ barbar_ bi e rbar$"),
]


@pytest.fixture(scope="module")
def figures(spark):
    return texts(spark, FIGURES).cache()


@pytest.fixture(scope="module")
def table(figures):
    return blocks.block_table(figures, 3, parse=True).cache()


def by_doc(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_golden_suffix_tables(spark, figures):
    t = suffixes.suffix_table(figures).cache()
    rows = by_doc(t, "rank", "pos", "lcp", "bwt")
    assert [r[1] for r in rows[0]] == [11, 10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2] and [r[2] for r in rows[0]] == [0, 0, 1, 1, 4, 0, 0, 1, 0, 2, 1, 3]
    assert [r[1] for r in rows[1]] == [16, 4, 15, 12, 1, 9, 6, 0, 5, 14, 13, 3, 11, 8, 2, 10, 7] and [r[2] for r in rows[1]] == [0, 0, 0, 1, 1, 3, 4, 0, 4, 0, 1, 0, 1, 2, 1, 2, 3]
    assert ["".join(r[3] or "$" for r in rows[d]) for d in range(4)] == BWT
    links = by_doc(suffixes.psi_and_lf(t), "rank", "pos", "psi", "lf")[0]
    assert [r[2] for r in links] == [5, 0, 7, 10, 11, 4, 1, 6, 2, 3, 8, 9] and [r[3] for r in links] == [1, 6, 8, 9, 5, 0, 7, 2, 10, 11, 3, 4]
    c = {r.sym: r.c_before for r in suffixes.alphabet(t.where("doc_id = 0").withColumnRenamed("bwt", "sym")).collect()}
    assert c == {"": 0, "i": 1, "m": 5, "p": 6, "s": 8}
    report = {r.doc_id: r for r in stats.bwt_repetition(t).collect()}
    assert [report[d].runs for d in range(4)] == RUNS and report[0].equal_percent == 25.0
    assert all(m is None or report[d].mean_lcp == pytest.approx(m, abs=1e-6) for d, m in enumerate(MEAN_LCP))
    info = {r.doc_id: r for r in stats.lcp_report(t).collect()}
    assert (info[0].max_lcp, info[0].sum_lcp, info[3].max_lcp) == (4, 13, 10)
    assert stats.sigma(figures.where("doc_id = 0")).first()[0] == 5


def test_suffix_tables_against_sorting(spark):
    values = [t for t in random_texts() if t is not None and len(t) < 1000] + ["a" * 100, ""]
    docs = texts(spark, [*values, None])
    t = suffixes.suffix_table(docs).cache()
    rows = by_doc(t, "rank", "pos", "lcp")
    assert len(rows) == len(values)
    for d, text in enumerate(values):
        order = sorted(range(len(text) + 1), key=lambda i: text[i:])
        assert [r[1] for r in rows[d]] == order
        for (_, p, _), (_, q, m) in zip(rows[d], rows[d][1:]):
            a, b = text[p:], text[q:]
            assert m == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert suffixes.bad_orders(t, docs).count() == 0
    wrong = t.withColumn("pos", F.when((F.col("doc_id") == 5) & (F.col("rank") < 2), 1 - F.col("pos")).otherwise(F.col("pos")))
    assert suffixes.bad_orders(wrong, docs).where("doc_id <> 5").count() == 0
    firsts = by_doc(suffixes.first_symbol(t), "rank", "sym")
    assert all([s for _, s in firsts[d]] == [text[p : p + 1] for _, p, _ in rows[d]] for d, text in enumerate(values))
    shifted = {k: dict(v) for k, v in by_doc(suffixes.shifted_rank(t, 3), "rank", "to").items()}
    for d, text in enumerate(values):
        rank = {p: r for r, p, _ in rows[d]}
        assert all(shifted[d][rank[p]] == rank[(p + 3) % (len(text) + 1)] for p in rank)


def test_sequences_of_numbers(spark):
    rnd = random.Random(6)
    seqs = {s: [rnd.randint(1, 3) * 10 ** rnd.choice([1, 12]) for _ in range(50)] for s in range(3)}
    rows = spark.createDataFrame([(s, i * 7, v) for s, vs in seqs.items() for i, v in enumerate(vs)], "seq_id long, pos long, sym long")
    got = {}
    for r in suffixes.sequence_suffix_table(rows).collect():
        got.setdefault(r.seq_id, {})[r["rank"]] = r.pos
    assert all([got[s][i] for i in range(51)] == sorted(range(51), key=lambda i, v=v: v[i:]) for s, v in seqs.items())


def test_backward_search_meets_search(spark, figures):
    t = suffixes.suffix_table(figures).cache()
    asked = figures.select("doc_id", F.lit(0).cast("long").alias("lb"), F.length("text").cast("long").alias("rb"))
    for sym in reversed("an"):
        asked = suffixes.backward_step(t, asked.withColumn("sym", F.lit(sym))).select("doc_id", F.col("new_lb").alias("lb"), F.col("new_rb").alias("rb"))
    got = {r.doc_id: (r.lb, r.rb) for r in asked.collect() if r.rb >= r.lb}
    assert got == {r.doc_id: (r.lb, r.rb) for r in suffixes.intervals(t, figures, patterns(spark, ["an"])).collect()}


def test_golden_blocks(spark, figures, table):
    rows = blocks.blocks(table, figures, mark="$")
    found = {d: v for d, v in by_doc(rows, "prefix", "size", "reducible", "block").items()}
    parsed = {}
    named = blocks.factors(table).join(rows.select("doc_id", "block", "prefix"), ["doc_id", "block"])
    for r in named.collect():
        parsed.setdefault(r.doc_id, {})[r.factor_no] = r.prefix
    for d, (k, singles, reducible, irreducible, parse) in enumerate(BLOCKS):
        assert len(found[d]) == k and sum(1 for b in found[d] if b[1] == 1) == singles
        assert " ".join(parsed[d][i] for i in sorted(parsed[d])) == parse
        if reducible:
            assert sorted(b[0] for b in found[d] if b[2]) == reducible.split() and sorted(b[0] for b in found[d] if b[1] > 1 and not b[2]) == irreducible.split()
    assert {b[0]: b[1] for b in found[0]} == {"$": 1, "i$": 1, "ip": 1, "is": 2, "m": 1, "p": 2, "si": 2, "ss": 2}
    statistics = blocks.index_statistics(blocks.blocks(table.where("doc_id = 0"), figures)).first()
    assert (statistics.n, statistics.k, statistics.k_s, statistics.k_re, statistics.k_ir, statistics.n_ir) == (12, 8, 4, 2, 2, 4)
    assert {r.doc_id: r.text for r in blocks.reconstruct(blocks.factors(table), blocks.blocks(table, figures)).collect()} == dict(enumerate(FIGURES))


@pytest.mark.parametrize("b", [1, 2, 7])
def test_blocks_against_counts(spark, b):
    values = [t for t in random_texts() if t and len(t) < 100] + ["a" * 30]
    docs = texts(spark, values)
    got = by_doc(blocks.blocks(blocks.block_table(docs, b), docs, mark="$"), "prefix", "size")
    for d, text in enumerate(values):
        marked, expected = text + "$", Counter()
        counts = Counter(marked[i:j] for i in range(len(marked)) for j in range(i + 1, len(marked) + 1))
        if len(marked) <= b:
            expected[""] = len(marked)
        else:
            for i in range(len(marked)):
                expected[next(marked[i:j] for j in range(i + 1, len(marked) + 1) if counts[marked[i:j]] <= b)] += 1
        assert got[d] == sorted(expected.items())


def test_reductions_follow_lf(spark, figures, table):
    stats_ = {(r.doc_id, r.block): r for r in blocks.blocks(table, figures).collect()}
    rows = table.collect()
    rank = {(r.doc_id, r.pos): r for r in rows}
    first = {(r.doc_id, r["rank"]): r for r in rows}
    for r in blocks.reductions(table).collect():
        at, steps = first[r.doc_id, r.block], 0
        while stats_[r.doc_id, at.block].reducible:
            at, steps = rank[r.doc_id, at.pos - 1], steps + 1
        assert r.dest_block == at.block and r.delta_d == steps and r.delta_x == at["rank"] - at.block
    report = blocks.delta_statistics(blocks.reductions(table)).first()
    assert report.max_d >= 1 and report.avg_x >= 0


def test_narrowing_answers_short_patterns(spark, figures, table):
    rows = blocks.blocks(table, figures)
    asked = ["s", "ss", "issi", "zz", "an", "bar", "barbar", "$", "mississippi"]
    narrowed = blocks.narrowed(rows, patterns(spark, asked)).collect()
    counts = Counter((r.pattern_id, r.doc_id) for r in search.locate(figures, patterns(spark, asked)).collect())
    seen = set()
    for r in narrowed:
        seen.add((r.pattern_id, r.doc_id))
        assert counts[r.pattern_id, r.doc_id] == r.size if r.answered else counts[r.pattern_id, r.doc_id] <= r.size <= 3
    assert set(counts) <= seen
    possible = {(r.pattern_id, r.doc_id) for r in blocks.chunk_filter(rows, patterns(spark, asked)).collect()}
    assert set(counts) <= possible <= seen
    under = Counter()
    for r in blocks.under(rows, patterns(spark, asked)).collect():
        under[r.pattern_id, r.doc_id] += r.size
    assert under == {(r.pattern_id, r.doc_id): r.size for r in narrowed if r.answered}


def test_pointers_and_headers(spark, figures, table):
    rows = {(r.doc_id, r.block): r for r in blocks.blocks(table, figures).collect()}
    alone = {(r.doc_id, r.block) for r in blocks.singletons(table).collect()}
    assert alone == {k for k, r in rows.items() if r.size == 1}
    reduced = blocks.reductions(table)
    for r in blocks.headers(reduced).collect():
        assert not rows[r.doc_id, r.dest_block].reducible and all(rows[r.doc_id, h.block].reducible for h in r.header)
    places = spark.createDataFrame([(0, 2, "ssi"), (0, 2, "sip"), (0, 8, "ppi"), (0, 9, "pip")], "doc_id long, pos long, pattern string")
    got = blocks.stands_in_factors(blocks.factors(table), blocks.blocks(table, figures), places).collect()
    assert sorted((r.pos, r.pattern) for r in got) == [(2, "ssi"), (8, "ppi")]


def test_a_text_that_fits_in_a_block_is_one_factor(spark):
    docs = texts(spark, ["abc", "", "aaaa", "abcd" * 5])
    parsed = blocks.block_table(docs, 8, parse=True)
    assert {r.doc_id: r.text for r in blocks.reconstruct(blocks.factors(parsed), blocks.blocks(parsed, docs)).collect()} == {0: "abc", 1: "", 2: "aaaa", 3: "abcd" * 5}
    assert by_doc(blocks.factors(parsed), "factor_no", "start_pos", "depth")[0] == [(0, 0, 4)]
    with pytest.raises(ValueError):
        blocks.block_table(texts(spark, ["abc"]), 0)


def test_edges_leaves_and_skipped_subtrees(spark):
    words = ["mississippi", "abracadabra", "aaaa", "b"]
    docs = texts(spark, words)
    t = tree.nodes(docs).cache()
    asked = spark.createDataFrame([(p, p) for p in ("ssi", "i", "a", "abra", "issippix", "b", "aaaaa", "mississippi")], "pattern_id string, pattern string")
    expected = set()
    for d, w in enumerate(words):
        order = sorted(range(len(w) + 1), key=lambda i: w[i:])
        for p in ("ssi", "i", "a", "abra", "issippix", "b", "aaaaa", "mississippi"):
            ranks = [r for r, i in enumerate(order) if w[i:].startswith(p)]
            expected |= {(p, d, ranks[0], ranks[-1])} if ranks else set()
    assert set(map(tuple, tree.walk_edges(t, docs, asked).collect())) == expected
    q = spark.createDataFrame([(0, 1, 1), (0, 2, 12), (0, 3, 13), (3, 4, 2)], "doc_id long, query long, i long")
    assert sorted((r.query, r.lb) for r in tree.select_leaf(t, q).collect()) == [(1, 0), (2, 11), (3, None), (4, 1)]
    ids = spark.createDataFrame([(0, 1, 0), (0, 2, 12), (0, 3, 99)], "doc_id long, query long, node_id long")
    assert sorted((r.query, r.lb, r.rb) for r in tree.node_of_id(t, ids).collect()) == [(1, 0, 0), (2, 0, 11), (3, None, None)]
    inner = {(r.doc_id, r.lb, r.rb) for r in t.where("lb < rb and parent_lb is not null").collect()}
    all_nodes = {(r.doc_id, r.lb, r.rb) for r in t.collect()}
    heads = spark.createDataFrame(sorted(inner), "doc_id long, lb long, rb long")
    left = {(r.doc_id, r.lb, r.rb) for r in tree.without_subtrees(t, heads).collect()}
    assert left == {x for x in all_nodes if not any(y != x and y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] for y in inner)}


def test_factors_tile_texts(spark, figures, table):
    placed = by_doc(blocks.factor_of_position(table), "pos", "factor_no")
    f = by_doc(blocks.factors(table, fac_dens=2), "factor_no", "start_pos", "depth", "border")
    for d, text in enumerate(FIGURES):
        assert [x[1] for x in f[d]][1:] == [x[1] + x[2] for x in f[d]][:-1] and f[d][-1][1] + f[d][-1][2] == len(text) + 1
        assert all(no == max(x[0] for x in f[d] if x[1] <= p) for p, no in placed[d]) and all(x[3] == (x[0] % 2 == 0) for x in f[d])
    freq = {r.freq: r.blocks for r in blocks.factor_frequencies(blocks.factors(table), blocks.blocks(table, figures)).collect()}
    assert sum(k * v for k, v in freq.items()) == sum(len(x) for x in f.values())
    report = {r.doc_id: r for r in blocks.parse_report(blocks.factors(table), blocks.blocks(table, figures)).collect()}
    assert report[0].factors == 7 and report[0].mean_length == pytest.approx(12 / 7) and report[0].bits == 3
    assert blocks.condensed_bwt(table).count() == sum(b[0] for b in BLOCKS)
    assert blocks.minimal_depths(blocks.blocks(table, figures)).count() == sum(b[0] for b in BLOCKS)
    nodes = {r.doc_id: (r.nodes, r.blocks) for r in blocks.trie_nodes(table, 3).collect()}
    counts = Counter("mississippi$"[i:j] for i in range(12) for j in range(i + 1, 13))
    assert nodes[0] == (1 + sum(1 for c in counts.values() if c > 3) + 8, 8)


def test_sliding_extremes():
    rnd = np.random.default_rng(1)
    for n, w in ((1, 1), (10, 3), (10, 10), (17, 4), (5, 9)):
        v = rnd.integers(0, 9, n)
        assert blocks.sliding(v, w, np.minimum).tolist() == [v[i : i + w].min() for i in range(n - w + 1)]
        assert blocks.sliding(v, w, np.maximum).tolist() == [v[i : i + w].max() for i in range(n - w + 1)]


def test_golden_tree(spark, figures):
    t = tree.nodes(figures.where("doc_id = 0")).cache()
    inner = sorted((r.depth, r.lb, r.rb) for r in t.where("lb < rb").collect())
    assert inner == [(0, 0, 11), (1, 1, 4), (1, 6, 7), (1, 8, 11), (2, 8, 9), (3, 10, 11), (4, 3, 4)] and t.count() == 19


def test_tree_navigation(spark):
    values = ["mississippi", "aaaa", "abcabcab", "", "z"]
    docs = texts(spark, values)
    t, s = tree.nodes(docs).cache(), suffixes.suffix_table(docs).cache()
    order = {d: sorted(range(len(v) + 1), key=lambda i, v=v: v[i:]) for d, v in enumerate(values)}

    def string(r, d):
        return (values[d] + "$")[order[d][r[0]] :][: r[2]]

    node = {(r.doc_id, r.lb, r.rb): (r.lb, r.rb, r.depth) for r in t.collect()}
    for r in t.collect():
        around = [n for (d, _, _), n in node.items() if d == r.doc_id and n[0] <= r.lb and n[1] >= r.rb and n != (r.lb, r.rb, r.depth)]
        assert r.node_depth == len(around)
        best = min(around, key=lambda n: n[1] - n[0], default=(None, None))
        assert (r.parent_lb, r.parent_rb) == best[:2]
    for r in tree.suffix_links(docs).collect():
        d = r.doc_id
        assert string(node[d, r.link_lb, r.link_rb], d) == string(node[d, r.lb, r.rb], d)[1:]
    for r in tree.weiner_links(docs).collect():
        d = r.doc_id
        longer = r.sym + string(node[d, r.lb, r.rb], d)
        assert [i for i, p in enumerate(order[d]) if (values[d] + "$")[p:].startswith(longer)] == list(range(r.link_lb, r.link_rb + 1))
    degree = {(r.doc_id, r.lb, r.rb): r.degree for r in tree.degrees(t).collect()}
    children = tree.children(t, docs).collect()
    assert Counter((r.doc_id, r.parent_lb, r.parent_rb) for r in children) == Counter(degree)
    assert all(r.sym == string(node[r.doc_id, r.lb, r.rb], r.doc_id)[node[r.doc_id, r.parent_lb, r.parent_rb][2]].replace("$", "") for r in children)
    pairs = t.where("doc_id = 0").alias("a").select("doc_id", "lb", "rb").withColumn("other_lb", F.lit(3).cast("long")).withColumn("other_rb", F.lit(3).cast("long")).withColumn("span", F.col("lb") * 100 + F.col("rb"))
    for r in tree.lca(t, tree.branches(docs), pairs).collect():
        around = [n for (d, _, _), n in node.items() if d == 0 and n[0] <= min(r.lb, 3) and n[1] >= max(r.rb, 3)]
        assert (r.lca_lb, r.lca_rb) == min(around, key=lambda n: n[1] - n[0])[:2]
    numbered = tree.breadth_first(tree.postorder(tree.preorder(tree.numbered(t)))).collect()
    for d in range(len(values)):
        mine = [r for r in numbered if r.doc_id == d]
        for c in ("node_id", "preorder", "postorder", "breadth_first"):
            assert sorted(r[c] for r in mine) == list(range(len(mine)))
        assert all(r.node_id == r.lb for r in mine if r.lb == r.rb)
    h = {(r.doc_id, r.lb, r.rb): r.h0 for r in tree.following_entropy(t).collect()}
    assert h[0, 0, 11] == pytest.approx(2.0850, abs=5e-5)


def test_parentheses_of_trees(spark):
    docs = texts(spark, ["mississippi", "aaaa", ""])
    p = tree.parentheses(tree.nodes(docs))
    for _, rows in by_doc(p, "idx", "bit").items():
        bits = [b for _, b in rows]
        assert [i for i, _ in rows] == list(range(len(bits)))
        stack, pairs = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                pairs[stack.pop()] = i
        assert not stack
    got = arrays.enclosing_pairs(p.select("doc_id", "idx", "bit"), ["doc_id"]).where("doc_id = 0").collect()
    rows = by_doc(p, "idx", "bit")[0]
    stack, expected = [], {}
    for i, b in rows:
        if b:
            expected[i] = [None, stack[-1] if stack else None]
            stack.append(i)
        else:
            expected[stack.pop()][0] = i
    assert {r.open: [r.close, r.enclose] for r in got} == expected
    opens = sorted(expected)
    pairs = [(0, 1000 * i + j, i, j) for i in opens for j in opens if i < j]
    found = arrays.double_enclosing(p.select("doc_id", "idx", "bit"), spark.createDataFrame(pairs, "doc_id long, query long, i long, j long"), ["doc_id"]).collect()
    assert len(found) == len(pairs)
    for r in found:
        end = {o: c for o, (c, _) in expected.items()}
        assert r.double_enclose == max((o for o in opens if o < r.i and end[o] > max(end[r.i], end[r.j])), default=None)
        assert r.rr_enclose == min((o for o in opens if end[r.i] < o < r.j and end[o] > end[r.j]), default=None)



def test_parentheses_join_no_nodes_with_each_other(spark):
    p = tree.parentheses(tree.nodes(texts(spark, ["mississippi"])))
    assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_index_of_symbols(figures):
    rows = {r.sym: (r.comp, r.freq, r.c_before) for r in suffixes.alphabet(symbols(figures)).collect()}
    letters = Counter("".join(FIGURES))
    assert rows == {c: (i, letters[c], sum(letters[x] for x in letters if x < c)) for i, c in enumerate(sorted(letters))}
