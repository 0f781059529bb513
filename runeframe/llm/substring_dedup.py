"""Removing repeated passages by fixed-block anchors.

A passage that repeats somewhere else covers, in either place, a whole block of the grid of BLOCK words that starts at each document's
first word, as windows are twice as long as blocks. So
1. the index takes the grid's blocks, and every rolling window of BLOCK words of every document probes it: a block
   is an anchor if its words also stand at another place;
2. around anchors, and nowhere else, each window of full length looks for an earlier twin, and neighbouring windows whose twins are neighbours are one hit,
   so that a hit reaches as far as the repeat does: windows to either side have no twin, or another one;
3. the words of each hit are compared with those of its twin, by a digest of 128 bits over all of them; what agrees is removed.
Nothing is emitted for pairs: a passage in a million places is a million windows that find one earlier place.

Hashes go over the network as sorted, delta-coded blobs, one for each batch of documents and range of hashes. What a batch can tell by itself it settles: a block that stands in it
twice is an anchor, and of windows that agree only the first is sent on, the twin of the others. So a passage of very many places is one entry a batch, in each step.
Probes are compared by 48 bits, which can only add anchors; windows by 64, before their words are compared. Words that stay though they repeat are thus left
where two different windows have one hash of 64 bits, and nowhere else; words that don't repeat are never removed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeframe.llm.common import let, quoted, running, words
from runeframe.llm.hashing import BUCKETS, bucket_cuts, grams, joined, pack, signed, sliced, steps, unpack, unsigned, word_hashes

WINDOW, BLOCK, PROBE_BITS = 20, 10, 48
#: Positions in a batch that is sent at once.
BATCH = 1_000_000
#: Words of an open run: more than a text can have.
REST = 2**30
#: A null id comes after all others.
LAST = 2**63 - 1


def _documents(batches: Iterable[pa.RecordBatch], n: int, more: bool = False) -> Iterator[tuple]:
    """For each part of a batch: n-gram hashes, which row each is of, its position, and which rows there are."""
    for batch in batches:
        for part in sliced(batch, 1):
            hashes, counts = word_hashes([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
            row = np.repeat(np.arange(len(counts)), counts)
            first = np.cumsum(counts) - counts
            at = np.arange(len(hashes)) - first[row]
            whole = at[: max(0, len(hashes) - n + 1)] + n <= counts[row[: max(0, len(hashes) - n + 1)]]
            yield grams(hashes, n)[whole], row[: len(whole)][whole], at[: len(whole)][whole], part


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(pc.fill_null(part.column(0), LAST)).astype(np.int64)


def anchors(source: DataFrame, n_buckets: int) -> DataFrame:
    """id, blocks (array<int>, numbers of the anchors in the document's grid), for documents that have some. source: id long, text string."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            prints, ids, at = (joined(x) for x in zip(*held, strict=True))
            held.clear()
            grid = at % BLOCK == 0
            order = np.argsort(prints[grid], kind="stable")
            index = prints[grid][order], unsigned(ids[grid][order]) ^ np.uint64(2**63), (at[grid][order] // BLOCK).astype(np.uint64)
            prints.sort()
            new = np.append(True, prints[1:] != prints[:-1])
            probes, again = prints[new], np.diff(np.append(np.flatnonzero(new), len(prints))) > 1
            # Blocks that stand in this batch twice are anchors; where they go is even, as it doesn't depend on their words
            here = again[np.searchsorted(probes, index[0])]
            known = (index[1][here] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
            order = np.argsort(known, kind="stable")
            known, known_ids, known_blocks = known[order], index[1][here][order], index[2][here][order]
            index = tuple(column[~here] for column in index)
            cuts = np.searchsorted(known, np.arange(n_buckets + 1, dtype=np.uint64))
            probe_cuts, index_cuts = bucket_cuts(probes, PROBE_BITS, n_buckets), bucket_cuts(index[0], PROBE_BITS, n_buckets)
            rows = []
            for b in range(n_buckets):
                p, i, j = slice(probe_cuts[b], probe_cuts[b + 1]), slice(index_cuts[b], index_cuts[b + 1]), slice(cuts[b], cuts[b + 1])
                if p.stop > p.start or j.stop > j.start:
                    rows.append((b, pack(steps(probes[p]), probes[p][again[p]]), pack(steps(index[0][i]), index[1][i], index[2][i]), pack(known_ids[j], known_blocks[j])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))], names=["bucket", "probes", "grid", "known"])

        size = 0
        for hashes, row, at, part in _documents(batches, BLOCK):
            if len(hashes):
                held.append((hashes >> np.uint64(64 - PROBE_BITS), _ids(part)[row], at))
                size += len(hashes)
            if size >= BATCH:
                yield from send()
                size = 0
        if held:
            yield from send()

    def probe(table: pa.Table) -> pa.Table:
        seen = [unpack(x) for x in table.column("probes").to_pylist()]
        prints = joined(np.cumsum(s, dtype=np.uint64) for s, _ in seen)
        prints.sort()
        hot = np.unique(np.concatenate([prints[1:][prints[1:] == prints[:-1]], *(a for _, a in seen)]))
        ids, blocks = (list(x) for x in zip(*((signed(i ^ np.uint64(2**63)), b.astype(np.int32)) for i, b in map(unpack, table.column("known").to_pylist())), strict=True))
        for blob in table.column("grid").to_pylist():
            s, i, b = unpack(blob)
            p = np.cumsum(s, dtype=np.uint64)
            if len(hot) and len(p):
                hit = hot[np.minimum(np.searchsorted(hot, p), len(hot) - 1)] == p
                ids.append(signed(i[hit] ^ np.uint64(2**63)))
                blocks.append(b[hit].astype(np.int32))
        return pa.table({"id": pa.array(joined(ids).astype(np.int64)), "block": pa.array(joined(blocks).astype(np.int32))})

    found = source.mapInArrow(scan, "bucket int, probes binary, grid binary, known binary").groupBy("bucket").applyInArrow(probe, "id long, block int")
    return found.groupBy("id").agg(F.collect_list("block").alias("blocks"))


def hits(anchored: DataFrame, n_buckets: int, window: int = WINDOW) -> DataFrame:
    """id, start, size, twin_id, twin_start: maximal runs of windows that each have an earlier twin, twins in a row like they are. anchored: id, text, blocks."""
    n_owners = max(1, n_buckets // BUCKETS)

    def by_owner(ids: np.ndarray, at: np.ndarray, twin: np.ndarray, twin_at: np.ndarray) -> list[tuple[int, bytes]]:
        """Windows that have a twin, dealt by document."""
        owner = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        owner = (owner * np.uint64(n_owners)) >> np.uint64(32)
        order = np.lexsort((at, ids, owner))
        owner, ids, at, twin, twin_at = (x[order] for x in (owner, ids, at, twin, twin_at))
        cuts = np.searchsorted(owner, np.arange(n_owners + 1, dtype=np.uint64))
        return [(b, pack(steps(ids[i]), at[i], twin[i], twin_at[i])) for b in range(n_owners) if (i := slice(cuts[b], cuts[b + 1])).stop > i.start]

    def firsts(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Of windows in the order of hash, id, place: which are the first of their hash, and of the others id, place and both of the first."""
        first = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        lead = np.repeat(starts, np.diff(np.append(starts, len(hashes))))
        later = (ids != ids[lead]) | (at != at[lead])
        return first, (ids[later], at[later], ids[lead[later]], at[lead[later]])

    def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            hashes, ids, at = (joined(x) for x in zip(*held, strict=True))
            held.clear()
            ids, at = unsigned(ids) ^ np.uint64(2**63), at.astype(np.uint64)
            order = np.lexsort((at, ids, hashes))
            hashes, ids, at = hashes[order], ids[order], at[order]
            first, later = firsts(hashes, ids, at)
            hashes, ids, at = hashes[first], ids[first], at[first]
            cuts = bucket_cuts(hashes, 64, n_buckets)
            rows = [(b, pack(steps(hashes[i]), ids[i], at[i]), None, None) for b in range(n_buckets) if (i := slice(cuts[b], cuts[b + 1])).stop > i.start]
            rows += [(owner * n_buckets // n_owners, None, owner, blob) for owner, blob in by_owner(*later)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.int32(), pa.binary()))], names=["bucket", "windows", "owner", "found"])

        size = 0
        hot = (b.filter(pc.is_valid(b.column(2))) for b in batches)
        for hashes, row, at, part in _documents(hot, window):
            if not len(hashes):
                continue
            lists = part.column(2)
            owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            # One number for each block of each row, in ascending order
            width = int(at.max()) // BLOCK + 4
            marked = np.unique(owner * width + np.minimum(np.asarray(pc.list_flatten(lists)).astype(np.int64), width - 1))
            key = row * width + -(-at // BLOCK)

            def is_anchor(k: np.ndarray, marked: np.ndarray = marked) -> np.ndarray:
                return marked[np.minimum(np.searchsorted(marked, k), len(marked) - 1)] == k

            take = is_anchor(key) & ((at % BLOCK != 0) | is_anchor(key + 1))
            if take.any():
                held.append((hashes[take], _ids(part)[row[take]], at[take]))
                size += int(take.sum())
            if size >= BATCH:
                yield from send()
                size = 0
        if held:
            yield from send()

    def earliest(table: pa.Table) -> pa.Table:
        sent = [unpack(x) for x in table.column("windows").to_pylist() if x is not None]
        hashes, ids, at = (joined(x) for x in zip(*((np.cumsum(s, dtype=np.uint64), i, a) for s, i, a in sent), strict=True)) if sent else (np.empty(0, np.uint64),) * 3
        order = np.lexsort((at, ids, hashes))
        rows = by_owner(*firsts(hashes[order], ids[order], at[order])[1])
        rows += [(o, x) for o, x in zip(table.column("owner").to_pylist(), table.column("found").to_pylist(), strict=True) if o is not None]
        return pa.table({"owner": pa.array([r[0] for r in rows], pa.int32()), "found": pa.array([r[1] for r in rows], pa.binary())})

    def extend(table: pa.Table) -> pa.Table:
        ids, at, twin, twin_at = (joined(x) for x in zip(*((np.cumsum(s, dtype=np.uint64), *more) for s, *more in map(unpack, table.column("found").to_pylist())), strict=True))
        order = np.lexsort((twin_at, twin, at, ids))
        ids, at, twin, twin_at = (x[order] for x in (ids, at, twin, twin_at))
        once = np.append(True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1]))  # a batch's twin and an earlier one: either shows the repeat, the earlier is taken
        ids, at, twin, twin_at = (x[once] for x in (ids, at, twin, twin_at))
        new = np.append(True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + np.uint64(1)) | (twin[1:] != twin[:-1]) | (twin_at[1:] != twin_at[:-1] + np.uint64(1)))
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(ids))) + window - 1
        name = lambda x: pa.array(signed(x[starts] ^ np.uint64(2**63)))
        return pa.table({"id": name(ids), "start": pa.array(at[starts].astype(np.int32)), "size": pa.array(size.astype(np.int32)), "twin_id": name(twin), "twin_start": pa.array(twin_at[starts].astype(np.int32))})

    windows = anchored.mapInArrow(around, "bucket int, windows binary, owner int, found binary")
    found = windows.groupBy("bucket").applyInArrow(earliest, "owner int, found binary")
    return found.groupBy("owner").applyInArrow(extend, "id long, start int, size int, twin_id long, twin_start int")


def _digest(every: Column, start: Column, size: Column) -> Column:
    """128 bits of so many words from a place on."""
    return F.unhex(F.md5(F.array_join(F.slice(every, start + 1, size), " ").cast("binary")))


def verified(source: DataFrame, found: DataFrame) -> DataFrame:
    """id, hits (array<struct<start, size, digest>>): hits with the digest of their twins' words. Each stretch of a twin is read once, however many hits it has."""
    asked = found.groupBy("twin_id", "twin_start", "size").agg(F.count(F.lit(1)).alias("n"))
    by_twin = asked.groupBy(F.col("twin_id").alias("id")).agg(F.collect_list(F.struct("twin_start", "size")).alias("asked"))
    read = let(words(F.col("text")), lambda every: F.transform("asked", lambda a: F.struct(a["twin_start"].alias("twin_start"), a["size"].alias("size"), _digest(every, a["twin_start"], a["size"]).alias("digest"))))
    # Rows that share an id with other words give a digest each; any of them is a twin
    told = source.join(by_twin, "id").select(F.col("id").alias("twin_id"), F.explode(read).alias("x")).select("twin_id", "x.*").distinct()
    return found.join(told, ["twin_id", "twin_start", "size"]).groupBy("id").agg(F.collect_list(F.struct("start", "size", "digest")).alias("hits"))


def runs_left(every: Column, found: Column) -> Column:
    """array<struct<start, size>>: what stays of the words beside hits whose words agree with their twins'; the last is open. Words between two hits that touch or overlap: none."""
    good = F.array_sort(F.transform(F.filter(found, lambda h: _digest(every, h["start"], h["size"]) == h["digest"]), lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["size"]).alias("end"))))

    def between(spans: Column) -> Column:
        def cut(ends: Column) -> Column:
            gaps = F.transform(spans, lambda s, i: F.struct(F.when(i > 0, F.get(ends, i - 1)).otherwise(0).alias("start"), s["start"].alias("stop")))
            inner = F.transform(F.filter(gaps, lambda g: g["start"] < g["stop"]), lambda g: F.struct(g["start"].alias("start"), (g["stop"] - g["start"]).alias("size")))
            return F.concat(inner, F.array(F.struct(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)).alias("start"), F.lit(REST).alias("size"))))

        return let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), cut)

    return let(good, between)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept (the words that stay, in order), runs (where they stand; null: everywhere).

    Removed is each word covered by a window of WINDOW words whose word sequence also starts earlier: in a document of smaller
    id, or before in the same one. Windows are judged on the input. Ids are integers and name documents: rows that share one are read as that
    document, so repeated rows aren't repeats of each other, and each loses what its own words show to be a repeat; a null id is one that comes last, as does 2**63 - 1, which is read as null. A null or
    empty text has no words; a text under WINDOW words keeps all. An empty table gives no rows. Other columns are not looked at.
    """
    n_buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.coalesce(quoted(id_col).cast("long"), F.lit(LAST)).alias("id"), quoted(text_col).alias("text"))
    # The joins read the same exchange of the texts.
    anchored = source.join(anchors(source, n_buckets), "id", "left").select("id", "text", "blocks")
    found = hits(anchored, n_buckets)
    final = source.join(verified(source, found), "id", "left")

    def left(every: Column) -> Column:
        runs = F.when(F.col("hits").isNotNull(), runs_left(every, F.col("hits")))
        kept = lambda r: F.when(r.isNull(), every).otherwise(F.flatten(F.transform(r, lambda x: F.slice(every, x["start"] + 1, x["size"]))))
        return let(runs, lambda r: F.struct(F.size(every).alias("n"), kept(r).alias("kept"), r.alias("runs")))

    done = final.select("id", let(words(F.col("text")), left).alias("x"))
    return done.select(F.nullif("id", F.lit(LAST)).alias("id"), F.col("x.n").cast("long").alias("n_words"), (F.col("x.n") - F.size("x.kept")).cast("long").alias("n_removed"), F.col("x.kept").alias("kept"), F.col("x.runs").alias("runs"))
