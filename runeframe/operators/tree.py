"""The suffix tree of every document as a table of LCP intervals, and navigation as columns, lookups and windows.

A node is an interval of ranks with the depth that its suffixes share. Leaves are single ranks; a leaf's depth is its suffix with the sentinel.
What a node's place among the others decides (parent, level, links) is computed where the suffix array is, in numpy over all nodes of a text, or of many short ones, at once; nodes are never joined with nodes or suffixes of their text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.operators.arrays import extreme_in_ranges
from runeframe.operators.suffixes import OF, Suffixes, before_suffixes, characters, per_document, suffixes_of_texts
from runeframe.plans.sizing import unsized


#: Ranks of a cell where spans of ranks are asked for: most spans are short.
SPAN = 64


def smaller_left(v: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value; -1 if there is none. A place that isn't smaller hands on to where it looks itself."""
    p, going = np.arange(-1, len(v) - 1), np.arange(1, len(v))
    while len(going):
        going = going[p[going] >= 0]
        going = going[v[p[going]] >= v[going]]
        p[going] = p[p[going]]
    return p


def smaller_right(v: np.ndarray) -> np.ndarray:
    """For each place the first one after it with a smaller value; the length if there is none."""
    return len(v) - 1 - smaller_left(v[::-1])[::-1]


@dataclass
class Intervals:
    """All nodes of texts: their leaves by rank, then inner nodes. Ranks count through all texts. parent: -1 at roots. at: for each rank but the first of a text, the node where its suffix parts from the one before."""

    lb: np.ndarray
    rb: np.ndarray
    depth: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    at: np.ndarray
    after: np.ndarray
    of: np.ndarray


def intervals_of(s: Suffixes) -> Intervals:
    n, ranks = len(s.order), np.arange(len(s.order))
    first, after = np.maximum(smaller_left(s.lcp), 0), smaller_right(s.lcp)
    inner = np.flatnonzero(s.lcp >= 0)
    names, place, number = np.unique(first[inner] * (n + 1) + after[inner], return_index=True, return_inverse=True)
    lb, rb, depth = names // (n + 1), names % (n + 1) - 1, s.lcp[inner][place]
    at = np.full(n + 1, -1)
    at[inner] = number + n
    every_lb, every_rb, every_depth = np.concatenate((ranks, lb)), np.concatenate((ranks, rb)), np.concatenate(((s.start + s.size)[s.of] - s.order, depth))
    # The parent parts at one of a node's ends, the deeper of the two
    outer = np.append(np.maximum(s.lcp, -1), -1)
    left, right = outer[every_lb], outer[every_rb + 1]
    parent = at[np.where(left >= right, every_lb, every_rb + 1)]
    level, up = np.zeros(len(parent), dtype=np.int64), parent.copy()
    level[up >= 0] = 1
    some = np.flatnonzero(up >= 0)
    while len(some):
        level[some], up[some] = level[some] + level[up[some]], up[up[some]]
        some = some[up[some] >= 0]
    return Intervals(every_lb, every_rb, every_depth, parent, level, at[:n], after, s.of[every_lb])


def links_of(t: Intervals, s: Suffixes) -> np.ndarray:
    """For each node the node of its string without the first symbol; -1 for the root and the leaf of the sentinel.

    psi takes a node's ends into the linked node, and between them, the first place where suffixes share fewer symbols than the node's depth has just one less.
    """
    n = len(s.order)
    isa = np.empty(n, dtype=np.int64)
    isa[s.order] = np.arange(n)
    psi = isa[np.minimum(s.order + 1, (s.start + s.size)[s.of] - 1)]
    link = np.full(len(t.lb), -1, dtype=np.int64)
    leaves = np.flatnonzero(t.depth[:n] > 1)
    link[leaves] = psi[leaves]
    inner = np.flatnonzero((np.arange(len(t.lb)) >= n) & (t.depth > 0))
    q = psi[t.lb[inner]] + 1
    going = np.arange(len(inner))
    while len(going):
        going = going[s.lcp[q[going]] >= t.depth[inner[going]]]
        q[going] = t.after[q[going]]
    link[inner] = t.at[q]
    return link


def weiner_of(t: Intervals, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, symbol, first and last rank of the string with the symbol in front, for each symbol that stands before suffixes of a node.

    A node has a symbol from the last of its ranks with it: from there a path goes up as long as nodes end before the next rank with that symbol.
    """
    n, before = len(s.order), before_suffixes(s)
    known, number = np.unique(before, return_inverse=True)
    group = s.of * len(known) + number
    ranks = np.flatnonzero(before)
    ranks = ranks[np.argsort(group[ranks], kind="stable")]  # by text, symbol, rank: the rank of the suffix with the symbol in front, less one for the sentinel of each text so far
    kind = group[ranks]
    named, until = kind * n + ranks, np.append(np.where(kind[1:] == kind[:-1], ranks[1:], n), n)[: len(ranks)]
    node, place, out = ranks.copy(), np.arange(len(ranks)), []
    while len(node):
        out.append((node, place))
        node = t.parent[node]
        some = node >= 0
        node, place = node[some], place[some]
        some = t.rb[node] < until[place]
        node, place = node[some], place[some]
    if not out:
        return (np.empty(0, np.int64),) * 4
    node, last = (np.concatenate(x) for x in zip(*out, strict=True))
    first = np.searchsorted(named, kind[last] * n + t.lb[node])
    ahead = s.of[t.lb[node]] + 1
    return node, before[ranks[last]], first + ahead, last + ahead


def parentheses_of(t: Intervals, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idx, bit and node of the trees as balanced parentheses: preorder less node depth nodes are closed when a node opens, and all of its own before it closes."""
    m, nodes_of = len(t.lb), np.bincount(t.of, minlength=len(s.size))
    order = np.lexsort((-t.rb, t.lb))
    own = np.empty(m, dtype=np.int64)
    own[order] = np.arange(m)
    own -= (np.cumsum(nodes_of) - nodes_of)[t.of]  # preorder
    # Inner nodes at or under a node: those that start in it, outer ones at the same start left out
    up_to = np.searchsorted(t.lb[order], t.rb, side="right") - (np.cumsum(nodes_of) - nodes_of)[t.of]
    first = 2 * own - t.level
    return np.concatenate((first, first + 2 * (up_to - own) - 1)), np.repeat((1, 0), m), np.tile(np.arange(m), 2)


def _local(ranks: np.ndarray, s: Suffixes, of: np.ndarray) -> np.ndarray:
    return ranks - s.start[of]


def nodes(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lb, rb, depth, parent_lb, parent_rb, node_depth, pos (of the suffix at lb): one row a node."""

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        t = intervals_of(s)
        up, root = np.maximum(t.parent, 0), t.parent < 0
        return {OF: t.of, "lb": _local(t.lb, s, t.of), "rb": _local(t.rb, s, t.of), "depth": t.depth, "parent_lb": pa.array(_local(t.lb[up], s, t.of), mask=root), "parent_rb": pa.array(_local(t.rb[up], s, t.of), mask=root), "node_depth": t.level, "pos": s.pos[t.lb]}

    return per_document(texts, table, {c: "long" for c in ("lb", "rb", "depth", "parent_lb", "parent_rb", "node_depth", "pos")}, id_col, text_col, ("lb", "rb"))


def branches(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, idx, lb, rb, depth: for each rank but the first, the node where its suffix parts from the one before."""

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        t = intervals_of(s)
        idx = np.flatnonzero(t.at >= 0)
        at, of = t.at[idx], s.of[idx]
        return {OF: of, "idx": _local(idx, s, of), "lb": _local(t.lb[at], s, of), "rb": _local(t.rb[at], s, of), "depth": t.depth[at]}

    return per_document(texts, table, {c: "long" for c in ("idx", "lb", "rb", "depth")}, id_col, text_col)


def parentheses_of_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """parentheses() of nodes() without node_id, made where the suffix array is: no row is sorted or moved."""

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        t = intervals_of(s)
        idx, bit, node = parentheses_of(t, s)
        return {OF: t.of[node], "idx": idx, "bit": bit}

    return per_document(texts, table, {"idx": "long", "bit": "long"}, id_col, text_col, ("idx",)).withColumn("bit", F.col("bit").cast("int"))


def enclosing_pairs_of_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """arrays.enclosing_pairs() of parentheses_of_texts(), made where the suffix array is: a pair is a node, its level is one more than the node's, and its parent's pair encloses it."""

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        t = intervals_of(s)
        idx, _, _ = parentheses_of(t, s)
        opening, closing = idx[: len(t.lb)], idx[len(t.lb) :]
        return {OF: t.of, "open": opening, "close": closing, "level": t.level + 1, "enclose": pa.array(opening[np.maximum(t.parent, 0)], mask=t.parent < 0)}

    return per_document(texts, table, {c: "long" for c in ("open", "close", "level", "enclose")}, id_col, text_col)


def double_enclosing_leaves(texts: DataFrame, apart: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, query, i, j, double_enclose, rr_enclose: arrays.double_enclosing() of each leaf (query, its rank) and the one apart ranks on, made where the suffix array is.

    The narrowest pair around both is their lowest common ancestor's, and the widest that holds the second alone its child's there, if that isn't the leaf.
    """

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        t = intervals_of(s)
        n = len(s.order)
        opening = parentheses_of(t, s)[0][: len(t.lb)]
        rank = np.arange(max(0, n - apart))
        rank = rank[s.of[rank] == s.of[rank + apart]]
        parts = rank + 1  # the last place where suffixes share least between both
        for d in range(2, apart + 1):
            parts = np.where(s.lcp[rank + d] <= s.lcp[parts], rank + d, parts)
        widest = np.arange(n)  # of the nodes that start at a rank; inner ones come by start, then by end
        widest[t.lb[n:]] = np.arange(n, len(t.lb))
        child, of = widest[parts], s.of[rank]
        return {OF: of, "query": _local(rank, s, of), "i": opening[rank], "j": opening[rank + apart], "double_enclose": opening[t.at[parts]], "rr_enclose": pa.array(opening[child], mask=child < n)}

    return per_document(texts, table, {c: "long" for c in ("query", "i", "j", "double_enclose", "rr_enclose")}, id_col, text_col)


def is_leaf() -> Column:
    return F.col("lb") == F.col("rb")


def leaves_below() -> Column:
    return F.col("rb") - F.col("lb") + 1


def numbered(tree: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """tree with node_id: leaves by rank first, then inner nodes by lb, outer before inner."""
    order = Window.partitionBy(id_col).orderBy((~is_leaf()).cast("int"), "lb", F.desc("rb"))
    return tree.withColumn("node_id", (F.row_number().over(order) - 1).cast("long"))


def label(text: Column) -> Column:
    """The string from the root to a node, without the sentinel."""
    return F.substring(text, (F.col("pos") + 1).cast("int"), F.col("depth").cast("int"))


def edge_symbol(text: Column, d: Column | int) -> Column:
    """The d-th symbol (from 1) on the path to a node; null past its depth; '' for the sentinel."""
    d = F.lit(d) if isinstance(d, int) else d
    return F.when((d >= 1) & (d <= F.col("depth")), F.substring(text, (F.col("pos") + d).cast("int"), F.lit(1)))


def children(tree: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, parent_lb, parent_rb, child_no (from 1), sym (first symbol of the edge, '' for the sentinel), lb, rb, depth, sibling_lb, sibling_rb (the next child)."""
    up = tree.select(id_col, F.col("lb").alias("parent_lb"), F.col("rb").alias("parent_rb"), F.col("depth").alias("parent_depth"))
    order = Window.partitionBy(id_col, "parent_lb", "parent_rb").orderBy("lb")
    each = tree.where("parent_lb is not null").join(up, [id_col, "parent_lb", "parent_rb"]).join(unsized(texts.select(id_col, text_col)), id_col)
    return each.select(
        id_col, "parent_lb", "parent_rb", F.row_number().over(order).cast("long").alias("child_no"), edge_symbol(F.col(text_col), F.col("parent_depth") + 1).alias("sym"), "lb", "rb", "depth",
        F.lead("lb").over(order).alias("sibling_lb"), F.lead("rb").over(order).alias("sibling_rb"),
    )


def degrees(tree: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, lb, rb, degree of inner nodes."""
    return tree.where("parent_lb is not null").groupBy(id_col, F.col("parent_lb").alias("lb"), F.col("parent_rb").alias("rb")).agg(F.count(F.lit(1)).alias("degree"))


def enclosing(tree: DataFrame, parted: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """spans (id, span, a, b) with the smallest node that holds ranks a to b: lb, rb, depth. parted: branches() of the texts.

    It is where suffixes part least between a and b: a minimum over a range. One rank is a leaf.
    """
    named = spans.withColumn("query", F.struct(id_col, "span"))
    values = parted.select(id_col, "idx", F.col("depth").alias("val"))
    least = extreme_in_ranges(values, named.where("a < b").select("query", id_col, (F.col("a") + 1).alias("l"), F.col("b").alias("r")), by=[id_col], width=SPAN).select(F.col(f"query.{id_col}").alias(id_col), F.col("query.span").alias("span"), "idx")
    inner = least.join(parted, [id_col, "idx"]).select(id_col, "span", "lb", "rb", "depth")
    leaves = spans.where("a = b").join(tree.where("lb = rb").select(id_col, F.col("lb").alias("a"), "lb", "rb", "depth"), [id_col, "a"]).select(id_col, "span", "lb", "rb", "depth")
    return spans.join(inner.unionByName(leaves), [id_col, "span"]).select(id_col, "span", "a", "b", "lb", "rb", "depth")


def lca(tree: DataFrame, parted: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pairs (id, span, lb, rb, other_lb, other_rb) with lca_lb, lca_rb, lca_depth; span names a pair within its text. parted: branches() of the texts."""
    pairs = unsized(pairs)
    spans = pairs.select(id_col, "span", F.least("lb", "other_lb").alias("a"), F.greatest("rb", "other_rb").alias("b"))
    found = enclosing(tree, parted, spans, id_col).select(id_col, "span", F.col("lb").alias("lca_lb"), F.col("rb").alias("lca_rb"), F.col("depth").alias("lca_depth"))
    return pairs.join(found, [id_col, "span"])


def suffix_links(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lb, rb, link_lb, link_rb: for inner nodes but the root and for leaves, the node of the string less its first symbol. A link of a leaf is a leaf."""

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        t = intervals_of(s)
        link = links_of(t, s)
        some = np.flatnonzero(link >= 0)
        of, link = t.of[some], link[some]
        return {OF: of, "lb": _local(t.lb[some], s, of), "rb": _local(t.rb[some], s, of), "link_lb": _local(t.lb[link], s, of), "link_rb": _local(t.rb[link], s, of)}

    return per_document(texts, table, {c: "long" for c in ("lb", "rb", "link_lb", "link_rb")}, id_col, text_col, ("link_lb", "link_rb"))


def weiner_links(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lb, rb, sym, link_lb, link_rb: for every symbol that stands before suffixes of a node, the ranks of the string with it in front."""

    def table(texts: list[str]) -> dict:
        s = suffixes_of_texts(texts)
        t = intervals_of(s)
        node, sym, a, b = weiner_of(t, s)
        of = t.of[node]
        return {OF: of, "lb": _local(t.lb[node], s, of), "rb": _local(t.rb[node], s, of), "sym": characters(sym), "link_lb": _local(a, s, of), "link_rb": _local(b, s, of)}

    return per_document(texts, table, {"lb": "long", "rb": "long", "sym": "string", "link_lb": "long", "link_rb": "long"}, id_col, text_col, ("link_lb", "link_rb"))


def select_leaf(tree: DataFrame, queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """queries (id, query, i) with lb, rb, depth of the i-th leaf from the left (from 1); null if there are fewer."""
    leaves = tree.where(is_leaf()).select(id_col, (F.col("lb") + 1).alias("i"), "lb", "rb", "depth")
    return queries.join(leaves, [id_col, "i"], "left")


def node_of_id(tree: DataFrame, queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """queries (id, query, node_id) with the node that numbered() gives that number: lb, rb, depth; null if there is none."""
    return queries.join(numbered(tree, id_col).select(id_col, "node_id", "lb", "rb", "depth"), [id_col, "node_id"], "left")


def without_subtrees(tree: DataFrame, heads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """tree in preorder, without what lies below nodes of heads (id, lb, rb), which stay: a traversal that skips their subtrees.

    In preorder a node lies below the last head before it that reaches its end, so one running maximum over heads' ends decides.
    """
    marked = preorder(tree, id_col).join(heads.select(id_col, "lb", "rb", F.lit(True).alias("head")).distinct(), [id_col, "lb", "rb"], "left")
    before = Window.partitionBy(id_col).orderBy("preorder").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(F.col("head"), F.col("rb"))).over(before) >= F.col("rb"), F.lit(False))
    return marked.withColumn("covered", covered).where("not covered").drop("covered", "head")


def walk_edges(tree: DataFrame, texts: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pattern_id, id, lb, rb: the ranks of suffixes that start with a pattern, by forward search from the root: each round follows the edge of the next symbol, and its label is compared.

    Rounds are as many as a pattern passes nodes; patterns at all nodes of all texts advance together.
    """
    from runeframe.plans.scratch import kept

    edges = kept(children(tree, texts, id_col, text_col).join(unsized(texts.select(id_col, text_col)), id_col).join(tree.select(id_col, "lb", "rb", "pos"), [id_col, "lb", "rb"]))
    edges = edges.select(id_col, F.col("parent_lb").alias("at_lb"), F.col("parent_rb").alias("at_rb"), "sym", "lb", "rb", "depth", F.col("pos").alias("_pos"), F.col(text_col).alias("_text"))
    roots = tree.where("parent_lb is null and lb < rb").select(id_col, F.col("lb").alias("at_lb"), F.col("rb").alias("at_rb"), F.lit(0).cast("long").alias("matched"))
    going = roots.join(F.broadcast(patterns.where("length(pattern) > 0").select("pattern_id", "pattern")))  # every pattern starts at every root
    found = None
    while True:
        asked = going.withColumn("sym", F.substring(F.col("pattern"), (F.col("matched") + 1).cast("int"), F.lit(1)))
        met = asked.join(edges, [id_col, "at_lb", "at_rb", "sym"])
        size = F.least(F.col("depth"), F.length("pattern")) - F.col("matched")
        label = F.substring(F.col("_text"), (F.col("_pos") + F.col("matched") + 1).cast("int"), size.cast("int"))
        fits = met.where(label == F.substring(F.col("pattern"), (F.col("matched") + 1).cast("int"), size.cast("int")))
        step = kept(fits.select("pattern_id", "pattern", id_col, "lb", "rb", F.least(F.col("depth"), F.length("pattern")).cast("long").alias("matched")))
        done = step.where(F.col("matched") == F.length("pattern")).select("pattern_id", id_col, "lb", "rb")
        found = done if found is None else found.unionByName(done)
        going = step.where(F.col("matched") < F.length("pattern")).select(id_col, F.col("lb").alias("at_lb"), F.col("rb").alias("at_rb"), "matched", "pattern_id", "pattern")
        if not going.limit(1).count():
            return found


def preorder(tree: DataFrame, id_col: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(id_col).orderBy("lb", F.desc("rb"))
    return tree.withColumn("preorder", (F.row_number().over(order) - 1).cast("long"))


def postorder(tree: DataFrame, id_col: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(id_col).orderBy("rb", F.desc("lb"))
    return tree.withColumn("postorder", (F.row_number().over(order) - 1).cast("long"))


def breadth_first(tree: DataFrame, id_col: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(id_col).orderBy("node_depth", "lb")
    return tree.withColumn("breadth_first", (F.row_number().over(order) - 1).cast("long"))


def following_entropy(tree: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, lb, rb, h0: entropy of the symbol that follows an inner node's string."""
    down = tree.where("parent_lb is not null").select(id_col, F.col("parent_lb").alias("lb"), F.col("parent_rb").alias("rb"), leaves_below().alias("m"))
    p = F.col("m") / (F.col("rb") - F.col("lb") + 1)
    return down.groupBy(id_col, "lb", "rb").agg(F.sum(-p * F.log2(p)).alias("h0"))


def parentheses(tree: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, idx, bit, node_id: the tree as balanced parentheses, an opening (1) and a closing (0) for each node.

    A node opens after the nodes before it in preorder have opened and those that end before it have closed: preorder less its node depth are closed by then.
    """
    named = postorder(preorder(numbered(tree, id_col), id_col), id_col)
    first = 2 * F.col("preorder") - F.col("node_depth")
    # Nodes at or under a node: those that open after its ancestors and close up to it
    inside = F.col("postorder") - F.col("preorder") + F.col("node_depth") + 1
    both = named.select(id_col, "node_id", F.explode(F.array(F.struct(first.alias("idx"), F.lit(1).alias("bit")), F.struct((first + 2 * inside - 1).alias("idx"), F.lit(0).alias("bit")))).alias("x"))
    return both.select(id_col, F.col("x.idx").cast("long").alias("idx"), F.col("x.bit").cast("int").alias("bit"), "node_id")
