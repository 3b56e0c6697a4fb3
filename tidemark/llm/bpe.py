"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 4).

Two trees, both of halves that are encoded apart and joined by re-encoding a window around the seam:

* A text is halved down to leaves of `leaf_chars` characters. A join's window grows on each side to a safe
  cut: a place where characters of different kinds (letters, numbers, white space, others) meet such that
  the pre-tokenising pattern can neither match across it nor look across it. Matches outside the window,
  and so their tokens, are final.
* A match of the pattern is halved down to leaves of `leaf_bytes` bytes, whose pairs are merged by rank. A
  sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of
  theirs. So a join is done if the two tokens at the seam fit; else the last tokens of the left and the
  first of the right are re-encoded together, by ever more tokens, until what stays outside fits. A window
  of the first tree that lies in one match (a long run without a safe cut) is joined in the same way.

Both joins are associative, so the trees' shapes do not matter. Decoding concatenates up the tree. There
is no size from which on texts are treated in another way.

Defined results: null text is empty and gives no tokens (`ids_sha256` of the empty string). Rows are
independent: ties, repeated rows and extra columns need no rule; a null doc_id is kept. Texts are encoded whole,
whatever their length; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

LEAF_CHARS = 1024
LEAF_BYTES = 48
#: Entries at which a worker's cache of matches or of token pairs starts anew.
CACHE = 1 << 18

#: Safe cuts: before white space; between letters, numbers and other characters, but not after an
#: apostrophe, which may begin a contraction.
_CUT = regex.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, rank_file: bytes, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.matches = regex.compile(pattern).findall
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, k in self.ranks.items():
            self.bytes_of[k] = token
        self.size_of = [len(x) for x in self.bytes_of]
        self.text_of = [str(k) for k in range(len(self.bytes_of))]
        self.byte_id = [self.ranks[bytes([x])] for x in range(256)]
        n = len(self.bytes_of)
        self.union = {self.ranks[t[:c]] * n + self.ranks[t[c:]]: k for t, k in self.ranks.items() for c in range(1, len(t)) if t[:c] in self.ranks and t[c:] in self.ranks}
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, b: bytes) -> list[int]:
        """The tokens of a few bytes: of neighbours whose union has a rank, those of the least are united first."""
        if (whole := self.ranks.get(b)) is not None:
            return [whole]
        union, none = self.union.get, len(self.bytes_of)
        ids = [self.byte_id[x] for x in b]
        made = [union(x * none + y, none) for x, y in zip(ids, ids[1:])]  # what each pair would become
        while made and (least := min(made)) < none:
            k = made.index(least)
            ids[k] = least
            del ids[k + 1], made[k]
            if k < len(made):
                made[k] = union(least * none + ids[k + 1], none)
            if k:
                made[k - 1] = union(ids[k - 1] * none + least, none)
        return ids

    def merged_long(self, b: bytes) -> list[int]:
        """The same for any number of bytes, with a queue of pairs; for seams whose windows grow over all."""
        rank, n = self.ranks.get, len(b)
        part = [b[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k) for k in range(n - 1) if (r := rank(part[k] + part[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, k = heapq.heappop(queue)
            to = after[k]
            if not part[k] or to >= n or rank(part[k] + part[to]) != r:  # one of the two was united meanwhile
                continue
            part[k] += part[to]
            part[to] = b""
            after[k] = after[to]
            if after[k] < n:
                before[after[k]] = k
            for x in (k, before[k]):
                if x >= 0 and after[x] < n and (r := rank(part[x] + part[after[x]])) is not None:
                    heapq.heappush(queue, (r, x))
        return [self.ranks[x] for x in part if x]

    def fit(self, x: int, y: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        ok = self.pairs.get((x, y))
        if ok is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            ok = self.pairs[x, y] = self.merged(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return ok

    def seam(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of one match, given those of its two parts."""
        if not left or not right or self.fit(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            rest = len(left) - i
            b = self.decode(left[rest:] + right[:j])
            window = self.inside(b) if rest or j < len(right) else self.merged_long(b)
            begins = not rest or self.fit(left[rest - 1], window[0])
            ends = j == len(right) or self.fit(window[-1], right[j])
            if begins and ends:
                return left[:rest] + window + right[j:]
            i, j = i if begins else 2 * i, j if ends else 2 * j

    def inside(self, b: bytes) -> list[int]:
        """The tokens of one match's bytes, or of bytes inside one."""
        if len(b) <= self.leaf_bytes:
            return self.merged(b)
        mid = len(b) // 2
        return self.seam(self.inside(b[:mid]), self.inside(b[mid:]))

    def leaf(self, text: str) -> list[int]:
        """The tokens of a text, match by match."""
        ids: list[int] = []
        for m in self.matches(text):
            own = self.known.get(m)
            if own is None:
                own = self.inside(m.encode())
                if len(m) <= self.leaf_bytes:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    self.known[m] = own
            ids += own
        return ids

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        mid = len(text) // 2
        a, b = text[:mid], text[mid:]
        return self.join(a, self.encode(a), b, self.encode(b))

    def join(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        """The tokens of a + b, given those of a and of b."""
        i, j = self._last_cut(a), self._first_cut(b)
        tail, head = a[i:], b[:j]
        keep, drop = self._back(left, len(tail.encode())), self._ahead(right, len(head.encode()))
        if len(tail) + len(head) > self.leaf_bytes and all(len(self.matches(x)) == 1 for x in (tail, head, tail + head)):
            window = self.seam(left[keep:], right[:drop])
        else:
            window = self.leaf(tail + head)
        del left[keep:]
        left += window
        left += right[drop:]
        return left

    def _back(self, ids: list[int], n_bytes: int) -> int:
        """Where the tokens of the last n bytes begin."""
        k = len(ids)
        while n_bytes > 0:
            k -= 1
            n_bytes -= self.size_of[ids[k]]
        assert n_bytes == 0, "a safe cut must be a token boundary"
        return k

    def _ahead(self, ids: list[int], n_bytes: int) -> int:
        """How many tokens make the first n bytes."""
        k = 0
        while n_bytes > 0:
            n_bytes -= self.size_of[ids[k]]
            k += 1
        assert n_bytes == 0, "a safe cut must be a token boundary"
        return k

    @staticmethod
    def _last_cut(a: str) -> int:
        """The last safe cut inside a; 0 if there is none."""
        near = 32
        while True:
            at = max(0, len(a) - near)
            cut = None
            for cut in _CUT.finditer(a, at + (at > 0)):  # a cut looks at the character before it
                pass
            if cut is not None:
                return cut.start()
            if not at:
                return 0
            near *= 4

    @staticmethod
    def _first_cut(b: str) -> int:
        """The first safe cut inside b; its length if there is none."""
        m = _CUT.search(b)
        return m.start() if m else len(b)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            of = self.bytes_of
            return b"".join([of[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _shared(spark: SparkSession, path: str):
    """The rank file (of a fixed size, under 1 MB) as a broadcast; read once, on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_CODECS: dict = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    key = (hash(rank_file), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _over(docs: DataFrame, path: str, pattern: str, schema: str, make) -> DataFrame:
    spark = docs.sparkSession
    ranks = _shared(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [make(codec, x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v) for v in zip(*rows, strict=True))], ["doc_id", *[c.split()[0] for c in schema.split(", ")[1:]]])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids of each whole text."""
    return _over(docs, path, pattern, "doc_id long, ids array<int>", lambda c, x: (np.array(c.encode(x), np.int32),))


def _checked(codec: Codec, text: str) -> tuple:
    ids = codec.encode(text)
    return np.array(ids, np.int32), len(ids), hashlib.sha256(codec.decode(ids)).hexdigest()


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digest of the bytes that the ids decode to."""
    return _over(docs, path, pattern, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string", _checked)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); ids that do not form valid UTF-8 give the replacement character."""
    ranks = _shared(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            texts = [codec.decode(x or []).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digest(codec: Codec, text: str) -> tuple:
    ids = codec.encode(text)
    names = codec.text_of
    return (
        len(ids),
        hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(),
        hashlib.sha256(codec.decode(ids)).hexdigest(),
    )


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded bytes, without keeping the ids."""
    return _over(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def public_ranks() -> tuple[str, str]:
    """Path and pattern of the installed public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_ranks())
