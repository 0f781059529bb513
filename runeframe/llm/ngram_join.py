"""N-gram Jaccard join of documents: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct word n-grams. Grams are ordered rare first; two similar sets share a gram in their
prefixes, so only documents that share a prefix gram are compared, each pair once, on their sets.

1. Frequencies. Every batch of documents sends its grams, as 48-bit prints in sorted, delta-coded blobs, to ranges of prints; a gram that several of its documents hold is
   one entry with their number, and who they are stays with the batch, so a gram of very many documents is an entry a batch. There a
   gram of one document is forgotten: it comes first in the order and links nobody. The others return to their document's text class.
   What a document is compared by later is just this list, and most documents have none.
2. Prefixes. A set of n grams, h of them shared, keeps the first prefix(n) - (n - h) of the list, by frequency; if that
   leaves nothing, no partner is similar enough.
3. Links, in rounds. In each group of documents that share a prefix gram, LEADERS are compared with all others: a group of m costs LEADERS * m
   pairs at most, not m * m. Links merge components; groups that lie in one component are done. The rounds go on with other leaders while
   each leaves far fewer pairs open than the one before; then what is still open is compared, of like lengths only. So no pair that passes the filters is left out, unless
   links join it already. A large group is dealt to as many parts as its rows need, its leaders to each.

Copies of a text are one class throughout, named by a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeframe.llm.common import lean, lean_group, quoted, settled, small_batches
from runeframe.llm.components import components
from runeframe.llm.hashing import BUCKETS, bucket_cuts, grams, joined, mix, pack, signed, sliced, steps, unpack, unsigned, word_hashes

PRINT_BITS = 48
#: Grams in a batch that is sent at once; documents in it, so that 16 bits name one.
BATCH, BATCH_DOCS = 400_000, 60_000
#: Leaders of a group in a round; rounds with leaders, at most, before all open pairs are compared; ranges of prints that the suffix filter counts in.
LEADERS, ROUNDS, RANGES = 8, 6, 32
#: Rows of a group that one part of a join takes; beyond, a group is dealt to several.
GROUP_ROWS = 4096
#: Parts that a join on few keys is dealt to, hot keys among them.
SALTS = 16
#: Says that a gram's documents are in the batch's own list.
SEVERAL = np.uint64(0xFFFF)
#: Pairs whose classes, and rows whose ids and classes, are broadcast (two numbers each); beyond, the join shuffles.
FEW_PAIRS = 100_000


def shared_grams(source: DataFrame, n_buckets: int, n: int, percent: int) -> DataFrame:
    """For each class of texts: class, n (size of its set), prints (its shared grams, ascending, as bytes), prefix (array<struct<gram, at>>).

    prints and prefix are null where no text can be similar enough. A class has a row, the same, for each batch that holds it. source: class long, text string. A batch names its documents by 16 bits, and
    itself by a hash of its classes, so that a task that runs again gives the same names. Copies in other batches count as other documents here:
    that changes frequencies, and with them an order that may be any, and is the same for all.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        known: dict[int, int] = {}

        def send() -> Iterator[pa.RecordBatch]:
            prints, doc = (joined(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.uint64), np.empty(0, np.uint64))
            held.clear()
            keys = (prints << np.uint64(16)) | doc
            keys.sort()
            keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
            prints, doc = keys >> np.uint64(16), keys & np.uint64(0xFFFF)
            starts = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.empty(0, np.int64)
            often = np.diff(np.append(starts, len(prints))).astype(np.uint64)
            several = np.repeat(often, often.astype(np.int64)) > 1
            own = pack(steps(prints[several]), doc[several])
            classes = unsigned(np.fromiter(known, np.int64, len(known)))
            known.clear()
            name = int(mix(classes * (2 * np.arange(len(classes), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64))
            sizes = np.bincount(doc.astype(np.int64), minlength=len(classes)).astype(np.uint64)
            rows = [((name * n_buckets) >> 64, None, pack(classes, sizes), own)]
            prints, doc = prints[starts], np.where(often > 1, SEVERAL, doc[starts])
            cuts = bucket_cuts(prints, PRINT_BITS, n_buckets)
            rows += [(b, pack(steps(prints[i]), doc[i], often[i]), None, None) for b in range(n_buckets) if (i := slice(cuts[b], cuts[b + 1])).stop > i.start]
            signed_name = signed(np.array([name], np.uint64))[0]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([signed_name] * len(rows), pa.int64()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))], names=["bucket", "batch", "grams", "sizes", "own"])

        size = 0
        for batch in batches:
            for part in sliced(batch, 1):
                texts, numbers = [], []
                for c, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if c not in known:
                        numbers.append(len(known))
                        known[c] = len(known)
                        texts.append((t or b"").lower())  # bytes: A-Z alone
                if texts:
                    hashes, counts = word_hashes(texts)
                    row = np.repeat(np.arange(len(counts)), counts)
                    first = np.cumsum(counts) - counts
                    m = max(0, len(hashes) - n + 1)
                    whole = np.arange(m) - first[row[:m]] + n <= counts[row[:m]]
                    held.append((grams(hashes, n)[whole] >> np.uint64(64 - PRINT_BITS), np.asarray(numbers, np.uint64)[row[:m][whole]]))
                    for i in np.flatnonzero((counts > 0) & (counts < n)):  # a short text is one gram
                        held.append((grams(hashes[first[i] : first[i] + counts[i]], int(counts[i])) >> np.uint64(64 - PRINT_BITS), np.array([numbers[i]], np.uint64)))
                    size += len(hashes)
                if size >= BATCH or len(known) >= BATCH_DOCS - 10_000:
                    yield from send()
                    size = 0
        if known:
            yield from send()

    def count(table: pa.Table) -> pa.Table:
        here = table.column("bucket")[0].as_py()
        names, blobs = table.column("batch").to_pylist(), table.column("grams").to_pylist()
        out = [(here, names[i], None, x, y) for i, (x, y) in enumerate(zip(table.column("sizes").to_pylist(), table.column("own").to_pylist(), strict=True)) if x is not None]
        names, blobs = [x for x, b in zip(names, blobs, strict=True) if b is not None], [b for b in blobs if b is not None]
        found = [unpack(b) for b in blobs]
        prints, doc, often = joined(np.cumsum(s, dtype=np.uint64) for s, _, _ in found), joined(d for _, d, _ in found), joined(m for _, _, m in found)
        origin = np.repeat(np.arange(len(found), dtype=np.uint64), [len(s) for s, _, _ in found]) if found else doc
        order = np.argsort(prints, kind="stable")
        prints, doc, often, origin = prints[order], doc[order], often[order], origin[order]
        if len(prints):
            starts = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
            often = np.repeat(np.add.reduceat(often, starts), np.diff(np.append(starts, len(prints))))
            shared = often > 1
            prints, doc, origin, often = prints[shared], doc[shared], origin[shared], often[shared]
            order = np.lexsort((doc, origin))
            prints, doc, origin, often = prints[order], doc[order], origin[order], often[order]
            cuts = np.searchsorted(origin, np.arange(len(found) + 1, dtype=np.uint64))
            for j, name in enumerate(names):
                i = slice(cuts[j], cuts[j + 1])
                if i.stop > i.start:
                    out.append((((name % 2**64) * n_buckets) >> 64, name, pack(doc[i], prints[i], often[i]), None, None))
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int32()), "batch": pa.array([r[1] for r in out], pa.int64()), **{c: pa.array([r[j] for r in out], pa.binary()) for j, c in ((2, "hits"), (3, "sizes"), (4, "own"))}})

    def choose(table: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes | None, list[dict] | None]] = []
        batches: dict[int, tuple[list[bytes], list[tuple[bytes, bytes]]]] = {}
        for name, hit, size, own in zip(*(table.column(c).to_pylist() for c in ("batch", "hits", "sizes", "own")), strict=True):
            batches.setdefault(name, ([], []))[hit is None].append((size, own) if hit is None else hit)
        for hits, sizes in batches.values():
            for (classes, n_), (held_steps, held_doc) in ((unpack(a), unpack(b)) for a, b in sizes[:1]):
                found = [unpack(b) for b in hits]
                doc, prints, often = (joined(f[j] for f in found) for j in range(3))
                held, one = np.cumsum(held_steps, dtype=np.uint64), doc != SEVERAL
                by_print = np.argsort(prints[~one])
                of_held = often[~one][by_print][np.searchsorted(prints[~one][by_print], held)] if len(held) else held
                doc, prints, often = np.concatenate((doc[one], held_doc)), np.concatenate((prints[one], held)), np.concatenate((often[one], of_held))
                order = np.lexsort((prints, often, doc))
                doc, prints, often = doc[order], prints[order], often[order]
                if len(doc):  # batches of the same texts in the same order have one name
                    new = np.append(True, (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1]))
                    doc, prints, often = doc[new], prints[new], often[new]
                cuts = np.searchsorted(doc, np.arange(len(classes) + 1, dtype=np.uint64)).tolist()
                for i, (c, m) in enumerate(zip(signed(classes).tolist(), n_.tolist(), strict=True)):
                    a, b = cuts[i], cuts[i + 1]
                    alone = m - (b - a)
                    keep = m - (percent * m + 99) // 100 + 1 - alone
                    if b == a or keep < 1:
                        rows.append((c, m, None, None))
                        continue
                    mine = prints[a:b]
                    blob = np.sort(mine).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : PRINT_BITS // 8].tobytes()
                    rows.append((c, m, blob, [{"gram": g, "at": alone + j} for j, g in enumerate(mine[:keep].tolist())]))
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64())]))
        return pa.table({"class": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "prints": pa.array([r[2] for r in rows], pa.binary()), "prefix": pa.array([r[3] for r in rows], kind)})

    sent = source.mapInArrow(lean(scan), "bucket int, batch long, grams binary, sizes binary, own binary")
    counted = sent.groupBy("bucket").applyInArrow(lean_group(count), "bucket int, batch long, hits binary, sizes binary, own binary")
    return counted.groupBy("bucket").applyInArrow(lean_group(choose), "class long, n long, prints binary, prefix array<struct<gram:long,at:long>>")


def _prints(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, PRINT_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : PRINT_BITS // 8] = raw
    return out.view("<u8").ravel()


def similar(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    """Whether the sets of sizes n_a and n_b with shared grams a and b are similar. The suffix filter first: prints are even, so in each of
    RANGES ranges no more can be common than the smaller side has there."""
    needed = -(-percent * (n_a + n_b) // (100 + percent))
    if min(len(a), len(b)) < needed:
        return False
    cut = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(PRINT_BITS - RANGES.bit_length() + 1)
    parts = (np.diff(np.concatenate(([0], np.searchsorted(x, cut), [len(x)]))) for x in (a, b))
    if np.minimum(*parts).sum() < needed:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (n_a + n_b - common)


def _passes(percent: int) -> Column:
    """Length and positional filter of a pair (a, n_a, at_a; b, n_b, at_b) at a gram that both hold: the rest of the shorter rest can be common at most."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    length = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    most = F.least(n_a - F.col("at_a"), n_b - F.col("at_b"))
    # At the first gram that two sets share nothing is common before it, so a similar pair passes there, if not at later ones.
    return length & ((100 + percent) * most >= percent * (n_a + n_b))


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    if pairs.count() <= FEW_PAIRS:  # then sets that no pair needs stay where they are
        involved = F.broadcast(involved)
    sets = classes.where("prints is not null").select("class", "n", "prints").join(involved, "class", "left_semi").dropDuplicates(["class"])
    right = pairs.join(sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("prints").alias("prints_b")), "b")
    both = right.join(sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("prints").alias("prints_a")), "a").select("a", "b", "n_a", "n_b", "prints_a", "prints_b")

    def check(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(_prints(x), int(n), _prints(y), int(m), percent) for x, n, y, m in zip(batch.prints_a, batch.n_a, batch.prints_b, batch.n_b, strict=True)]
            yield batch.loc[good, ["a", "b"]]

    return both.mapInPandas(check, "a long, b long")


def salted(rows: DataFrame, few: DataFrame, key: str, spread: Column) -> DataFrame:
    """rows joined with few (one row a key): broadcast where few is counted to be small; otherwise every key is dealt to SALTS parts by the value spread, so that no key is one task's."""
    if few.count() <= FEW_PAIRS:
        return rows.join(F.broadcast(few), key)
    each = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(each, [key, "salt"]).drop("salt")


def linked_classes(classes: DataFrame, percent: int) -> DataFrame | None:
    """class, component, for classes that have links; None if there are no candidates."""
    postings = settled(classes.where("prefix is not null").select("class", "n", F.explode("prefix").alias("p")).select("class", "n", F.col("p.gram").alias("gram"), F.col("p.at").alias("at")).distinct())
    labels, links, tested, last, open_ = None, None, None, None, postings
    for turn in range(ROUNDS + 1):
        here = open_.withColumn("component", F.col("class")) if labels is None else settled(open_.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class")))
        # Groups in several components, and how many of their pairs lie across
        tally = here.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("gram").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("size"), ((F.pow(F.sum("m"), 2) - F.sum(F.pow("m", 2))) / 2).alias("across"))
        tally = settled(tally.where("parts > 1"))
        rest = tally.agg(F.sum("across")).first()[0]
        if not rest:
            break
        now = settled(salted(here.drop("size"), tally.select("gram", "size"), "gram", F.col("class")))
        # Groups of up to LEADERS + 1 have all their pairs compared in this round; a group in one component stays in one
        open_ = now.where(F.col("size") > LEADERS + 1).drop("component")
        everything = turn == ROUNDS or rest <= LEADERS * now.count() or (last is not None and rest > 0.8 * last)
        last = rest
        a = now.select("gram", "size", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("component").alias("of_a"))
        b = now.select("gram", "size", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("component").alias("of_b"))
        # Rows of a large group are dealt to parts, those that they are compared with to each part
        parts = F.ceil(F.col("size") / GROUP_ROWS).cast("int")
        b = b.withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("size")
        if everything:  # sets of lengths that no pair can have don't meet: a step of the scale is as much as similar sets may differ by
            scale = lambda n: F.floor(F.log(n) / F.log(F.lit(100 / percent))).cast("int") if percent < 100 else n.cast("int")
            a, b = a.withColumn("len", scale(F.col("n_a"))), b.withColumn("len", F.explode(F.sequence(scale(F.col("n_b")) - 1, scale(F.col("n_b")) + 1)))
        else:  # first those with the fewest grams of their own, the likely centres; then by a hash that changes with the round
            chosen = ["at_a", "a"] if turn == 0 else [F.xxhash64(F.lit(turn), "a"), "a"]
            # Leaders of each part of a group come first, then those of the group, so that no task reads a large group
            a = a.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
            for group in (["gram", "salt"], ["gram"]):
                a = a.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*chosen))).where(F.col("nth") <= LEADERS).drop("nth")
            a = a.drop("salt")
        a = a.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size")
        pairs = a.join(b, ["gram", "part", "len"] if everything else ["gram", "part"]).where("of_a < of_b" if everything else "of_a <> of_b").where(_passes(percent))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = settled(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        new = settled(verified(pairs, classes, percent))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            labels = components(links).select(F.col("node").alias("class"), "component")
        if everything:
            break
    return labels


def near_duplicates(docs: DataFrame, *, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_shingles (size of its set), component_id (the smallest id that links reach, its own included).

    Texts are compared in lower case (A to Z alone). Two are linked when 100 * intersection >= percent * union. A text under n words has
    one gram, all its words; one without words, or a null one, has none, is linked with nothing, and its component is its own id. Copies and
    repeated rows are linked. Null ids don't count as smallest; a component of null ids has component null. An empty table gives no rows.
    Other columns are not looked at.
    """
    rows, placed = _placed(docs, n, percent, id_col, text_col)
    # A class without links is its own component; the others meet the smallest id of theirs
    alone = placed.where("not linked").select("class", "n", F.col("first").alias("component_id"))
    linked = placed.where("linked")
    smallest = settled(linked.groupBy("component").agg(F.min("first").alias("component_id")))
    by_class = alone.unionByName(salted(linked, smallest, "component", F.col("class")).select("class", "n", "component_id"))
    return rows.join(by_class, "class").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _placed(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, class of every row; and class, first (its smallest id), n, component, linked (whether it has links) of every class."""
    n_buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(_class(text_col).alias("class"), quoted(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        classes = settled(shared_grams(source, n_buckets, n, percent))
    labels = linked_classes(classes, percent)
    sizes = classes.select("class", "n").distinct()
    labels = sizes.select("class", F.col("class").alias("component")).limit(0) if labels is None else labels
    sizes = sizes.join(labels, "class", "left").select("class", "n", F.coalesce("component", "class").alias("component"), F.col("component").isNotNull().alias("linked"))
    rows = docs.select(quoted(id_col).alias("id"), _class(text_col).alias("class"))
    return rows, settled(rows.groupBy("class").agg(F.min("id").alias("first")).join(sizes, "class"))


def _class(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(quoted(text_col), F.lit("")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row of docs, with its columns, for each component: that of the smallest id (null last), of its texts one, of repeated rows one. Rows without words stay."""
    rows, placed = _placed(docs, n, percent, id_col, text_col)
    best = placed.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), F.col("first"), F.col("class"))).alias("best"))
    # Chosen classes are found by their own name, so a large component is no key of a join
    best = best.select(F.col("best.class").alias("class"), F.lit(True).alias("chosen"))
    stays = placed.where("n > 0").join(best, "class", "left").select("class", "first", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    tallied = rows.groupBy("class", "id").agg(F.count(F.lit(1)).alias("m")).join(stays, "class")
    # What doesn't stay as it is: rows that go, and the chosen one where it is repeated
    marked = settled(tallied.withColumn("chosen", F.col("chosen") & F.col("id").eqNullSafe(F.col("first"))).where("not chosen or m > 1").select("class", "id", "chosen"))
    few = marked.count() <= FEW_PAIRS  # then texts stay where they are

    def those(marks: DataFrame, how: str) -> DataFrame:
        marks = marks.select(F.col("class").alias("mark"), F.col("id").alias("mark_id"))
        marks = F.broadcast(marks) if few else marks
        keyed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("id"), _class(text_col).alias("class"))
        return keyed.join(marks, (F.col("class") == F.col("mark")) & F.col("id").eqNullSafe(F.col("mark_id")), how)

    kept, repeated = those(marked, "left_anti").select("row.*"), marked.where("chosen")
    if repeated.limit(1).count():
        kept = kept.unionByName(those(repeated, "left_semi").dropDuplicates(["class", "id"]).select("row.*"))
    return kept
