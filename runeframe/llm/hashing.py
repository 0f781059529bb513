"""Hashes of words and of word n-grams for whole batches of texts, and compact blobs of sorted numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

U = np.uint64
#: Bytes of text hashed at once (a longer text is hashed by itself); words beyond this many bytes are hashed one by one.
SLICE, LONG_WORD = 1_000_000, 48
#: Ranges of hashes for each shuffle partition: a range is what one call of a grouped function holds.
BUCKETS = 4
_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits; one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers modulo 2**64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + (SLICE >> 1))
        factors = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)
        for f in factors:
            f[0] = 1
        _POWERS[:] = [np.multiply.accumulate(f) for f in factors]
    return _POWERS[0][:n], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and how many words each text has. Words are what ASCII white space separates."""
    data = b" ".join(texts) + b" "
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _IS_SPACE[raw]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, offsets))
    powers, inverses = _powers(len(raw))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[raw] * powers, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes, counts


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words, of all texts as one sequence; none if there are fewer."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        out *= U(0xD6E8FEB86659FD93)
        out += hashes[j : j + size]
    return mix(out)


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) + 1
    part = (np.cumsum(sizes) - 1) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


# ---- blobs


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 to 2**64 - 1 as one compressed blob. Bytes of one weight lie together; unneeded ones aren't kept."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c, dtype="<u8")
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        parts.append(len(c).to_bytes(4, "little") + bytes([width]) + c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 4], "little"), data[at + 4]
        c = np.zeros((n, 8), dtype=np.uint8)
        c[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(c.view("<u8").ravel())
        at += 5 + n * width
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first from 0; undone by cumsum."""
    out = ordered.copy()
    out[1:] -= ordered[:-1]
    return out


def joined(arrays: Iterable[np.ndarray]) -> np.ndarray:
    arrays = list(arrays)
    return np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)


def bucket_cuts(ordered: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of n equal ranges of numbers under 2**bits starts in ascending numbers, and where the last ends."""
    lows = np.array([(b * 2**bits + n - 1) // n for b in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(ordered, lows), len(ordered))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)
