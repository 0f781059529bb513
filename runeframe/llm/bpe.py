"""Byte-level BPE encoding and decoding by overlapping chunks.

A pre-token depends on what follows its start alone. So where two chunks that overlap both have a pre-token boundary
at the same place, they agree from there on, as far as the earlier one reaches. Texts are cut to chunks that reach OVERLAP beyond either end:
1. chunks are rows, dealt to all tasks whatever text they are of; each is split into pre-tokens by itself;
2. neighbours are stitched at the first boundary that both have where they overlap; only boundaries in overlaps travel for this;
3. the pieces between its two stitches are encoded in each chunk, again as rows;
4. ids are collected by document.
A chunk's last pre-token may be cut by the chunk's end and is not trusted. Should an overlap hold no shared boundary (one run longer than it), the
document's chunks are put together again in step 4 and split as one. A text of one chunk has nothing to stitch and is encoded where it is.

Pieces are encoded once each while they stay in a bounded cache; ids are decoded by joining the raw bytes of tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runeframe.llm.common import lean, quoted

#: Characters of a chunk, and how far it reaches beyond either end of it (less than half a chunk). Texts are cut twice, as offsets are found by walking along: first to so many chunks.
CHUNK, OVERLAP, AT_ONCE = 8192, 256, 8
#: Pieces kept by a worker, and characters of the longest piece kept.
CACHE, CACHED_CHARS = 200_000, 64
#: Characters of text in a batch of results.
BATCH_CHARS = 2_000_000


class Codec:
    """Encodes and decodes by a rank file's bytes and a pattern for pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._find_all = regex.compile(pattern).findall
        self._tokens: list[bytes] = [b""] * (max(table.values()) + 1)
        #: How ids travel.
        self.kind = "<u2" if len(self._tokens) <= 1 << 16 else "<i4"
        for token, rank in table.items():
            self._tokens[rank] = token
        encode_piece = self._encoding._encode_single_piece

        kind = self.kind

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(encode_piece(piece), dtype=kind).tobytes()
                if len(piece) <= CACHED_CHARS:
                    if len(self) >= CACHE:
                        self.clear()
                    self[piece] = ids
                return ids

        self._pieces = Pieces()

    def pretokens(self, text: str) -> list[str]:
        return self._find_all(text)

    def ids(self, pretokens: list[str]) -> bytes:
        """Ids of pre-tokens, as little-endian numbers."""
        return b"".join(map(self._pieces.__getitem__, pretokens))

    def encode(self, text: str) -> np.ndarray:
        return self.numbers(self.ids(self.pretokens(text)))

    def numbers(self, ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, dtype=self.kind).astype("<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self._tokens):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(map(self._tokens.__getitem__, ids.tolist()))


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    key = (hash(ranks), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def cut(texts: DataFrame) -> DataFrame:
    """name, k, chunks (of the text), id, at (where the chunk starts), chunk, copies (rows of that id and text). texts: id, text; dealt to tasks by name and k."""
    n, width = F.length("text"), CHUNK * AT_ONCE
    # Rows of one id and text are one document and get one name
    named = texts.select("id", "text", F.md5(F.concat("text", F.lit("\x00"), F.to_json(F.struct("id")))).alias("name"), n.alias("n"))
    wide = named.select("id", "name", "n", "text", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / width).cast("int"))).alias("b"))
    start = F.greatest(F.col("b") * width - OVERLAP, F.lit(0))
    wide = wide.select("id", "name", "n", "b", start.alias("from"), F.substring("text", start + 1, (F.col("b") + 1) * width + OVERLAP - start).alias("part"))
    last = F.least((F.col("b") + 1) * AT_ONCE, F.ceil(F.col("n") / CHUNK).cast("int")) - 1
    each = wide.select("id", "name", "n", "from", "part", F.explode(F.sequence(F.col("b") * AT_ONCE, last)).alias("k"))
    at = F.greatest(F.col("k") * CHUNK - OVERLAP, F.lit(0))
    rows = each.select("id", "name", "k", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), at.alias("at"), F.substring("part", at - F.col("from") + 1, (F.col("k") + 1) * CHUNK + OVERLAP - at).alias("chunk"))
    # name is never null; said here, so that what joins by it reads the same exchange as what doesn't
    return rows.where("name is not null").groupBy("name", "k").agg(*[F.first(c).alias(c) for c in ("chunks", "id", "at", "chunk")], F.count(F.lit(1)).alias("copies"))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row for each input row: id, ids array<int>, and decoded binary (what the ids decode to; null unless decode).

    vocabulary is the path of a rank file, read here and sent to the executors: its size is fixed. A null text is an empty
    one and has no ids; a null id stays null. Long texts are split in chunks that run in parallel; only their ids come together. Repeated rows are each given; an empty table gives no rows;
    other columns are not looked at.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind, size, overlap = source.schema["id"].dataType.simpleString(), CHUNK, OVERLAP

    def rows(ids: list[np.ndarray], keys: pa.Array, codec: Codec) -> list[pa.Array]:
        ends = np.cumsum([0, *map(len, ids)], dtype="<i4")
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype("<i4") if ids else np.empty(0, "<i4")))
        return [keys, lists, pa.array([codec.decode(x) if decode else None for x in ids], pa.binary())]

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            start, sizes = 0, np.asarray(pc.fill_null(pc.utf8_length(batch.column(1)), 0))
            while start < batch.num_rows:
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), BATCH_CHARS)))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(rows([codec.encode(text or "") for text in part.column(1).to_pylist()], part.column(0), codec), names=["id", "ids", "decoded"])
                start = stop

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundaries where a chunk overlaps those before and after it."""
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            heads, tails = [], []
            for k, chunks, at, text in zip(*(batch.column(c).to_pylist() for c in ("k", "chunks", "at", "chunk")), strict=True):
                tokens = codec.pretokens(text)
                bounds = list(accumulate(map(len, tokens if k == chunks - 1 else tokens[:-1]), initial=at))
                heads.append([b for b in bounds if b <= k * size + overlap] if k else [])
                tails.append([b for b in bounds if b >= (k + 1) * size - overlap] if k < chunks - 1 else [])
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("k"), pa.array(heads, lists), pa.array(tails, lists)], names=["name", "k", "head", "tail"])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of the pre-tokens between two stitches; of a document that couldn't be stitched, the chunk's own text."""
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            out, own = [], []
            for k, at, text, start, stop, apart in zip(*(batch.column(c).to_pylist() for c in ("k", "at", "chunk", "start", "stop", "apart")), strict=True):
                if apart:
                    out.append(None)
                    own.append(text[k * size - at : (k + 1) * size - at])
                    continue
                tokens = codec.pretokens(text[start - at :])
                if stop is not None:
                    tokens = tokens[: list(accumulate(map(len, tokens), initial=start)).index(stop)]
                out.append(codec.ids(tokens))
                own.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "k", "id", "copies")), pa.array(out, pa.binary()), pa.array(own, pa.string())], names=["name", "k", "id", "copies", "part", "own"])

    def collect(table: pa.Table) -> pa.Table:
        codec, table = _codec(ranks.value, pattern), table.sort_by("k")
        parts, own = table.column("part").to_pylist(), table.column("own").to_pylist()
        ids = codec.encode("".join(own)) if None in parts else codec.numbers(b"".join(parts))
        key = table.column("id").slice(0, 1).combine_chunks()
        return pa.table([*rows([ids], key.chunk(0) if isinstance(key, pa.ChunkedArray) else key, codec), table.column("copies").slice(0, 1)], names=["id", "ids", "decoded", "copies"])

    long = F.coalesce(F.length("text") > size + overlap, F.lit(False))
    short = source.where(~long).mapInArrow(lean(whole), f"id {kind}, ids array<int>, decoded binary")
    chunks = cut(source.where(long))
    bounds = chunks.mapInArrow(lean(split), "name string, k int, head array<int>, tail array<int>")
    order = Window.partitionBy("name").orderBy("k")
    met = bounds.select("name", "k", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))).alias("start"))
    stitched = met.select("name", "k", "start", F.lead("start").over(order).alias("stop"), F.max(F.col("start").isNull()).over(Window.partitionBy("name")).alias("apart"))
    coded = chunks.join(stitched, ["name", "k"]).mapInArrow(lean(pieces), f"name string, k int, id {kind}, copies long, part binary, own string")
    gathered = coded.groupBy("name").applyInArrow(collect, f"id {kind}, ids array<int>, decoded binary, copies long")
    again = gathered.select("id", "ids", "decoded", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")
    return short.unionByName(again)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """One row for each input row: id and decoded, the raw bytes of its ids, however many. Null ids decode to no bytes, a null id stays null; an id that the vocabulary
    doesn't hold is an error. Repeated rows are each given; an empty table gives no rows; other columns are not looked at."""
    with open(vocabulary, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())
    source = encoded.select(quoted(id_col).alias("id"), quoted(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            back = [codec.decode(np.array(x or [], dtype="<i4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["id", "decoded"])

    return source.mapInArrow(run, f"id {kind}, decoded binary")
