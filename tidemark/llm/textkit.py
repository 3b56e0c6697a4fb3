"""NumPy/Arrow helpers that work on a few megabytes of text at a time inside a Spark task.

All operators that tokenise in Python use these: a piece of a record batch becomes one byte buffer
with document offsets, and words are found, compacted and dictionary-encoded without a Python loop
over words. Memory is bounded by the piece size plus the longest single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 20


def _table(spans) -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in spans:
        t[lo : hi + 1] = True
    return t


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` as byte classes; both hold for UTF-8 as
#: every byte of a non-ASCII character is 0x80 or more.
NOT_SPACE = ~_table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = ~_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Piece:
    """Texts of some rows as bytes: `data`, document `offs`, and `rows` (the slice of the batch)."""

    __slots__ = ("data", "offs", "rows")

    def __init__(self, data: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch):
        self.data, self.offs, self.rows = data, offs, rows

    def __len__(self) -> int:
        return len(self.offs) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offs)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int | None = None):
    """Cuts a record batch by rows so that each piece holds about `limit` text bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + (limit or PIECE_BYTES), side="right")) - 1)
        yield Piece(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at], batch.slice(at, to - at))
        at = to


class Words:
    """Words of a piece: byte `start` and `end`, `first[d]:first[d+1]` are document d's words."""

    __slots__ = ("start", "end", "first", "_flat", "_ends", "_enc")

    def __init__(self, p: Piece, is_word: np.ndarray, lower: bool = False):
        data = LOWER[p.data] if lower else p.data
        w = is_word[data]
        edge = np.zeros(len(w) + 1, bool)
        edge[p.offs] = True  # a word never crosses documents
        prev = np.zeros(len(w), bool)
        prev[1:] = w[:-1]
        prev &= ~edge[:-1]
        self.start = np.flatnonzero(w & ~prev)
        nxt = np.zeros(len(w), bool)
        nxt[:-1] = w[1:]
        nxt &= ~edge[1:]
        self.end = np.flatnonzero(w & ~nxt) + 1
        self.first = np.searchsorted(self.start, p.offs)
        self._flat, self._ends, self._enc = data[w], np.cumsum(self.end - self.start), None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """Exact integer codes of the words, and the words in code order."""
        if self._enc is None:
            offs = np.zeros(len(self) + 1, np.int32)
            offs[1:] = self._ends
            flat = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(self._flat))])
            d = flat.dictionary_encode()
            self._enc = (d.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(self) else np.zeros(0, np.int64)), d.dictionary
        return self._enc

    def hashes(self, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """64-bit content hash per word, the codes, and the hash per code."""
        codes, names = self.encode()
        h = xxhash.xxh3_64_intdigest
        by_code = np.fromiter((h(x, seed) for x in names.to_pylist()), np.uint64, len(names))
        return by_code[codes] if len(codes) else np.zeros(0, np.uint64), codes, by_code


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher for 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def per_doc_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of `values` over `offs[d]:offs[d+1]`."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def shingle_hashes(w: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's `size`-word shingles (with fewer words the whole sequence), in text
    order with repeats, and their document offsets."""
    h, _, _ = w.hashes(seed)
    counts = w.counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    out = np.zeros(offs[-1], np.uint64)
    if not len(out):
        return out, offs
    doc = np.repeat(np.arange(len(n)), n)
    at = w.first[doc] + (np.arange(len(out)) - offs[doc])
    odd = np.uint64(0x9E3779B97F4A7C15)
    full = counts[doc] >= size
    acc = np.zeros(len(out), np.uint64)
    for k in range(size):
        have = full | (k < counts[doc])
        acc = np.where(have, acc * odd + h[np.minimum(at + k, len(h) - 1)], acc)
    length = np.where(full, size, counts[doc]).astype(np.uint64)
    out = mix(acc + length * np.uint64(0xC2B2AE3D27D4EB4F))
    return out, offs


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)
