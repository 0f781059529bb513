"""Exact top-k search by inner product with cover trees over queries and data.

Pivots, drawn from the rows, split queries and data alike into cells, each covered by a radius around its pivot; they are the upper level of one tree for both sides.
Within a cell, blocks of data and groups of queries of bounded size each get a cover tree, once: centres are rows, every level covers all rows
within a radius half as large as the level above, and centres of a level lie farther apart than that.

Every group of queries first meets one block of its own cell, which gives each query a kth score. From then on a cell is passed over where
its pivot and radius bound every score below the group's worst kth score. Pairs of group and block that are left are searched by dual
traversal of their two trees, node pairs pruned by the same bound. Both sides of a pair are bounded, whatever the cells hold, and results merge by query.

Bound: for a query q within r of p and a vector x within s of c, q.x <= p.c + |p| s + |c| r + r s.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runeframe.llm.common import quoted, settled

#: Rows of a block of data and queries of a group, on average; rows of a leaf, and the fewest rows a centre of a level must stand for on average.
BLOCK, GROUP, LEAF, FEWEST = 4096, 2048, 48, 8
#: Pivots: a block's rows for each, but no more than the root of the rows, nor than this many (with their vectors, what the driver and each task hold).
MOST_PIVOTS = 65_536
#: Scores computed at once.
SCORES = 1 << 20
LOWEST, HIGHEST = -(2**63), 2**63 - 1


# ---- vectors


def quantized(batch: pa.RecordBatch, scale: float) -> tuple[pa.Array, pa.Array]:
    """Ids and floor(scale * x) for each component, as bytes, of the rows that have an id and a vector without null or non-finite components."""
    lists = batch.column(1)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat = pc.list_flatten(lists)
    gaps = np.asarray(pc.is_null(flat))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(np.nan_to_num(np.asarray(pc.fill_null(flat, 0)).astype("<f8"), nan=np.inf) * scale)
    bad = np.concatenate(([0], np.cumsum(gaps | ~np.isfinite(x))))
    ends = np.cumsum(sizes)
    good = (bad[ends] == bad[ends - sizes]) & (sizes > 0) & np.asarray(pc.is_valid(batch.column(0)))
    rows = [x[e - n : e].tobytes() for e, n in zip(ends[good].tolist(), sizes[good].tolist(), strict=True)]
    return batch.column(0).filter(pa.array(good)), pa.array(rows, pa.binary())


def stacked(blobs: Iterable[bytes]) -> np.ndarray:
    """A matrix of the vectors; shorter ones are filled up with zeros, which no inner product sees."""
    rows = [np.frombuffer(b, dtype="<f8") for b in blobs]
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, dtype="<f8").reshape(len(rows), width)
    return np.array([np.pad(r, (0, width - len(r))) for r in rows], dtype="<f8")


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[-1] == width else np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, width - x.shape[-1])])


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row, a pivot near to it: by inner products, so not always the nearest where numbers are large; any pivot is right."""
    with np.errstate(over="ignore", invalid="ignore"):
        return ((pivots**2).sum(axis=1) - 2 * (x @ pivots.T)).argmin(axis=1)


# ---- cover trees


@dataclass
class Tree:
    """Nodes in preorder. A node covers the rows lo to hi, which lie within radius of the row centre; its subtree ends before the node skip. norm: the centre's length."""

    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    skip: np.ndarray
    radius: np.ndarray
    norm: np.ndarray

    def children(self, i: int) -> list[int]:
        out, j = [], i + 1
        while j < self.skip[i]:
            out.append(j)
            j = int(self.skip[j])
        return out

    def pack(self) -> bytes:
        return b"".join(a.astype("<i4").tobytes() for a in (self.lo, self.hi, self.centre, self.skip)) + self.radius.astype("<f8").tobytes() + self.norm.astype("<f8").tobytes()

    @staticmethod
    def unpack(blob: bytes) -> Tree:
        n = len(blob) // 32
        return Tree(*(np.frombuffer(blob, "<i4", n, 4 * n * j) for j in range(4)), *(np.frombuffer(blob, "<f8", n, 16 * n + 8 * n * j) for j in range(2)))


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, Tree]:
    """An order of the rows, and the tree over rows in that order.

    Centres are added farthest first until all rows lie within the level's radius of one, so those of a level are apart by more than that. A centre's parent is the nearest
    one of the level above. Levels end where no centre has over LEAF rows, or where a centre would have under FEWEST rows on average.
    """
    n = len(x)
    square = (x**2).sum(axis=1)
    order, near = [0], np.zeros(n, dtype=np.int64)
    far = distances(x, x[0])
    radius, level, parent, done = float(far.max()), [0], [-1], 1
    final = near.copy()
    while radius > 0 and np.bincount(final).max() > LEAF:
        radius /= 2
        while far.max() > radius and len(order) * FEWEST <= n:
            c = int(far.argmax())
            with np.errstate(invalid="ignore", over="ignore"):
                d = np.sqrt(np.maximum(square + square[c] - 2 * (x @ x[c]), 0))
            d = np.where(np.isfinite(d), d, distances(x, x[c]))
            d[c] = 0
            order.append(c)
            near[d < far] = len(order) - 1
            far = np.minimum(far, d)
        if far.max() > radius:  # the level isn't covered, so it isn't one
            break
        for t in range(done, len(order)):
            level.append(level[done - 1] + 1 if t == done else level[done])
            parent.append(int(final[order[t]]))
        done, final = len(order), near.copy()
    kids: list[list[int]] = [[] for _ in range(done)]
    total = np.bincount(final, minlength=done)
    for t in range(done - 1, 0, -1):
        kids[parent[t]].append(t)
        total[parent[t]] += total[t]
    own = np.split(np.argsort(final, kind="stable"), np.cumsum(np.bincount(final, minlength=done))[:-1])
    rows: list[np.ndarray] = []
    nodes: list[list[int]] = []

    def all_rows(t: int, under: list[int]) -> Iterator[np.ndarray]:
        yield own[t]
        for c in under:
            yield from all_rows(c, kids[c])

    def emit(t: int, under: list[int], at: int) -> int:
        """Adds the node of centre t with those of its children; returns where its rows end."""
        i, size = len(nodes), len(own[t]) + sum(int(total[c]) for c in under)
        nodes.append([at, at + size, order[t], 0])
        if not under or size <= LEAF:
            rows.extend(all_rows(t, under))
        else:
            next_level = min(level[c] for c in under)
            end = emit(t, [c for c in under if level[c] > next_level], at)
            for c in under:
                if level[c] == next_level:
                    end = emit(c, kids[c], end)
        nodes[i][3] = len(nodes)
        return at + size

    emit(0, kids[0], 0)
    perm = np.concatenate(rows)
    place = np.empty(n, dtype=np.int64)
    place[perm] = np.arange(n)
    y = x[perm]
    lo, hi, centre, skip = (np.array(a) for a in zip(*nodes, strict=True))
    centre = place[centre]
    reach = np.array([distances(y[a:b], y[c]).max() for a, b, c in zip(lo, hi, centre, strict=True)]) * (1 + 1e-12)
    return perm, Tree(lo, hi, centre, skip, reach, np.sqrt(square[perm][centre]))


# ---- packed sets of vectors


def pack(keys: list[pa.Array], ids: np.ndarray, x: np.ndarray) -> pa.Table:
    """One row: keys, ids and vectors in the order of their tree, the tree, and its root's centre and radius. Whole numbers of few bits take few bytes."""
    perm, tree = cover_tree(x)
    x = x[perm]
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    values = [ids[perm].astype("<i8").tobytes(), x.astype(kind).tobytes(), tree.pack(), x[tree.centre[0]].tobytes()]
    return pa.table(
        [*keys, *(pa.array([v], pa.binary()) for v in values[:3]), pa.array([kind]), pa.array([x.shape[1]], pa.int32()), pa.array([values[3]], pa.binary()), pa.array([float(tree.radius[0])])],
        names=["cell", "part", "ids", "v", "tree", "kind", "width", "root", "radius"],
    )


PACKED = "cell int, part int, ids binary, v binary, tree binary, kind string, width int, root binary, radius double"


def unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, Tree]:
    x = np.frombuffer(row[prefix + "v"], row[prefix + "kind"]).astype("<f8").reshape(-1, row[prefix + "width"])
    return np.frombuffer(row[prefix + "ids"], "<i8"), x, Tree.unpack(row[prefix + "tree"])


# ---- search


def bound(product: float, norm_a: float, radius_a: float, norm_b: float, radius_b: float) -> float:
    """No inner product of rows within the radii of two centres is above this; a little is added for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        b = product + norm_a * radius_b + norm_b * radius_a + radius_a * radius_b
        b += 1e-9 * (norm_a + radius_a) * (norm_b + radius_b) + 1e-6
    return b if b == b else math.inf


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k = query_ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        self.kth = floor.astype(float)
        self.floor = self.kth.copy()

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        take = (scores >= self.kth[q]) & (ids != self.ids[q])
        if not take.any():
            return
        scores, ids = scores[take], ids[take]
        if len(scores) > 4 * self.k:  # all that tie with the kth of these stay
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[keep], ids[keep]
        first = np.lexsort((ids, -scores))[: self.k]
        new = sorted([*self.found[q], *zip((-scores[first]).tolist(), ids[first].tolist(), strict=True)])[: self.k]
        self.found[q] = new
        if len(new) == self.k:
            kth = float(-new[-1][0])
            self.kth[q] = max(self.floor[q], kth if abs(kth) < 2**53 else np.nextafter(kth, -np.inf))  # never above the score itself


def search(queries: tuple[np.ndarray, np.ndarray, Tree], data: tuple[np.ndarray, np.ndarray, Tree], k: int, floor: np.ndarray) -> Best:
    """Dual traversal of the two trees. floor: a score that each query's kth best is known to reach."""
    (query_ids, x, over), (ids, y, under) = queries, data
    width = max(x.shape[1], y.shape[1])
    x, y = padded(x, width), padded(y, width)
    exact = width * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) < 2**53
    if not exact:  # doubles can't hold the products: integers of any size can
        big_x, big_y = (np.vectorize(int, otypes=[object])(m) for m in (x, y))
    best = Best(query_ids, k, floor)

    def limit(i: int, j: int) -> float:
        with np.errstate(over="ignore", invalid="ignore"):
            product = float(x[over.centre[i]] @ y[under.centre[j]])
        return bound(product, over.norm[i], over.radius[i], under.norm[j], under.radius[j])

    todo = [(limit(0, 0), 0, 0)]
    while todo:
        most, i, j = todo.pop()
        a, b = int(over.lo[i]), int(over.hi[i])
        if most < best.kth[a:b].min():
            continue
        few_queries, few_data = over.skip[i] == i + 1, under.skip[j] == j + 1
        if few_queries and few_data:
            here, there = slice(int(under.lo[j]), int(under.hi[j])), max(1, SCORES // int(under.hi[j] - under.lo[j]))
            for start in range(a, b, there):
                q = slice(start, min(b, start + there))
                scores = x[q] @ y[here].T if exact else big_x[q] @ big_y[here].T
                for r in np.flatnonzero(scores.max(axis=1) >= best.kth[q]):
                    best.add(start + int(r), scores[r], ids[here])
            continue
        pairs = [(i, c) for c in under.children(j)] if few_queries or not few_data and under.radius[j] >= over.radius[i] else [(c, j) for c in over.children(i)]
        todo += sorted((limit(*pair), *pair) for pair in pairs)  # the most promising is taken first
    return best


# ---- the operator


def exact_topk(vectors: DataFrame, *, k: int = 5, is_query, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row where is_query (a condition on the column id) holds, the k rows of another id with the highest
    integer inner products of floor(scale * x), ties to the smaller id; all rows, if fewer than k.

    Ids are integers. Rows whose id or vector is null, or whose vector is empty or holds a null or non-finite component, take no
    part. Vectors of different lengths count as filled up with zeros. Rows of one id are never each other's result; a repeated id can appear repeatedly, as
    data and as a query (its results then merge). A score beyond 64 bits is given as the nearest bound, after ranking within its block. An empty table gives no rows.
    Other columns are not looked at.
    """
    spark = vectors.sparkSession
    source = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("v"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(list(quantized(batch, scale)), names=["id", "v"])

    clean = source.mapInArrow(read, "id long, v binary")
    n = clean.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    n_pivots = max(1, min(n // BLOCK, math.isqrt(n), MOST_PIVOTS))
    pivots = stacked(bytes(r.v) for r in clean.orderBy(F.xxhash64("id", "v"), "id").limit(n_pivots).collect())
    # Two levels: a row's nearest of the tops, then the nearest pivot of those that lie nearest to that top
    tops = pivots[: math.isqrt(len(pivots) - 1) + 1]
    below = nearest(pivots, tops)
    held = spark.sparkContext.broadcast((pivots, tops, [np.flatnonzero(below == t) if (below == t).any() else np.array([t]) for t in range(len(tops))]))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, tops, lists = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = stacked(batch.column(1).to_pylist())
            width = max(x.shape[1], pivots.shape[1])
            x, centres, cell = padded(x, width), padded(pivots, width), np.zeros(len(x), dtype=np.int64)
            top = nearest(x, padded(tops, width))
            for t in np.unique(top):
                cell[top == t] = lists[t][nearest(x[top == t], centres[lists[t]])]
            far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1)) * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

    placed = settled(clean.mapInArrow(assign, "id long, v binary, cell int, far double"))
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("reach"), F.count_if(is_query(F.col("id"))).alias("queries"))
    cells = counted.collect()  # a row for each pivot at most
    sizes = F.broadcast(spark.createDataFrame([(r.cell, max(1, -(-r.n // BLOCK)), max(1, -(-r.queries // GROUP))) for r in cells], "cell int, blocks int, groups int"))

    def packed(table: pa.Table) -> pa.Table:
        keys = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("cell", "part")]
        return pack(keys, table.column("id").to_numpy(), stacked(table.column("v").to_pylist()))

    # placed is settled, so its rows keep their numbers; a repeated row is dealt like others
    dealt = lambda rows, parts: rows.join(sizes, "cell").select("id", "v", "cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(parts)).cast("int").alias("part"))
    blocks = settled(dealt(placed.select("id", "v", "cell"), "blocks").groupBy("cell", "part").applyInArrow(packed, PACKED))
    asked = settled(placed.where(is_query(F.col("id"))).select("id", "v", "cell").distinct())
    groups = settled(dealt(asked, "groups").groupBy("cell", "part").applyInArrow(packed, PACKED))

    found = "cell int, part int, kth binary, worst double, hits array<struct<query_id:long,id:long,score:decimal(38,0)>>"
    hit = pa.list_(pa.struct([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.decimal128(38, 0))]))

    def run(table: pa.Table) -> pa.Table:
        out = []
        for row in table.to_pylist():  # one
            floor = np.frombuffer(row["kth"], "<f8") if row["kth"] else np.full(len(row["ids"]) // 8, -np.inf)
            best = search(unpack(row), unpack(row, "b_"), k, floor)
            hits = [{"query_id": q, "id": key, "score": decimal.Decimal(max(LOWEST, min(HIGHEST, int(-neg))))} for q, some in zip(best.ids.tolist(), best.found, strict=True) for neg, key in some]
            out.append((row["cell"], row["part"], best.kth.tobytes(), float(best.kth.min()), hits))
        return pa.table([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.float64(), hit))], names=["cell", "part", "kth", "worst", "hits"])

    theirs = blocks.select(F.col("cell").alias("target"), F.col("part").alias("block"), *[F.col(c).alias(f"b_{c}") for c in ("ids", "v", "tree", "kind", "width")])
    ours = groups.select("cell", "part", "ids", "v", "tree", "kind", "width")
    near = ours.withColumn("kth", F.lit(None).cast("binary")).join(theirs.where("block = 0"), F.col("cell") == F.col("target"))
    first = settled(near.groupBy("target", "block", "cell", "part").applyInArrow(run, found))

    # Each group's worst kth score and its radius say which cells it must still see.
    reach = {r.cell: (r.reach, max(1, -(-r.n // BLOCK))) for r in cells}
    goals = spark.sparkContext.broadcast((np.array(list(reach)), np.array([r for r, _ in reach.values()]), np.array([b for _, b in reach.values()])))

    def aim(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, radius, n_blocks = goals.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                root = np.frombuffer(row.root, "<f8")
                width = max(len(root), held.value[0].shape[1])
                root, centres = padded(root, width), padded(held.value[0][cell], width)
                with np.errstate(over="ignore", invalid="ignore"):
                    norm, norms = float(np.sqrt((root**2).sum())), np.sqrt((centres**2).sum(axis=1))
                    b = centres @ root + norm * radius + norms * row.radius + radius * row.radius
                    b += 1e-9 * (norm + row.radius) * (norms + radius) + 1e-6
                see = np.flatnonzero(~(b < row.worst))
                target, block = np.repeat(cell[see], n_blocks[see]), np.concatenate([np.arange(m) for m in n_blocks[see]]) if len(see) else see
                rest = (target != row.cell) | (block != 0)
                yield pd.DataFrame({"cell": row.cell, "part": row.part, "target": target[rest], "block": block[rest]})

    known = groups.select("cell", "part", "root", "radius").join(first.select("cell", "part", "worst"), ["cell", "part"], "left").fillna(float("-inf"), ["worst"])
    aimed = known.mapInPandas(aim, "cell int, part int, target int, block int")
    # A pair is two numbers until its group and its block join it: a stated query set against all rows, in blocks.
    pairs = aimed.join(ours.join(first.select("cell", "part", "kth"), ["cell", "part"], "left"), ["cell", "part"]).join(theirs, ["target", "block"])
    rest = pairs.groupBy("target", "block", "cell", "part").applyInArrow(run, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    hits = first.select(F.explode("hits").alias("h")).unionByName(rest.select(F.explode("hits").alias("h"))).select("h.*")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("score").cast("long").alias("score"))
