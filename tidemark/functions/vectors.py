"""Tokens, FNV-1a hashes and local hash embeddings.

`embed` stays in the JVM; `embed_fast` does the same in Arrow batches with NumPy integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 64
#: Rows whose tokens are counted at once.
ROWS = 1024
#: A run of letters and digits that are not Han, or a Han character. The run is one class, which Java scans in a loop of
#: its own, and only characters beyond U+2E7F, below which none is Han, are asked for their script.
TOKEN = r"[A-Za-z0-9[\p{L}\p{Nd}&&[\x{80}-\x{2E7F}]][\p{L}\p{Nd}&&[^\x00-\x{2E7F}]&&[^\p{IsHan}]]]+|[\p{IsHan}&&[^\x00-\x{2E7F}]]"
M32 = 0xFFFFFFFF
#: FNV-1a parameters; fixed values.
BASIS32, PRIME32 = 0x811C9DC5, 0x01000193
BASIS64 = 0xCBF29CE484222325


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(x) -> Column:
    """Lower-cased runs of letters and digits; each Han character is a token (T-01)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c(x), F.lit(""))), F.lit(TOKEN), F.lit(0))


def byte_values(x) -> Column:
    h = F.hex(F.encode(c(x), "UTF-8"))
    n = F.length(h) / 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fnv32(x) -> Column:
    """FNV-1a, 32 bits (S-26)."""
    return F.aggregate(byte_values(x), F.lit(BASIS32).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * PRIME32).bitwiseAND(M32))


def fnv64(x) -> Column:
    """FNV-1a, 64 bits, as a struct of the high and low 32 bits, as no product may overflow (S-26)."""

    def step(h, b):
        low = h["lo"].bitwiseXOR(b)
        p = low * 435
        return F.struct((h["hi"] * 435 + F.shiftright(p, 32) + F.shiftleft(low, 8)).bitwiseAND(M32).alias("hi"), p.bitwiseAND(M32).alias("lo"))

    start = F.struct(F.lit(BASIS64 >> 32).cast("bigint").alias("hi"), F.lit(BASIS64 & M32).cast("bigint").alias("lo"))
    return F.aggregate(byte_values(x), start, step)


def features(t) -> Column:
    """Tokens and adjacent pairs, as the embedding hashes them."""
    t = c(t)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.chr(F.lit(0)), b))
    return F.concat(t, F.when(F.size(t) > 1, pairs).otherwise(F.array().cast("array<string>")))


def let(value, use) -> Column:
    """`use(value)` with the value computed once for each row."""
    return F.transform(F.array(c(value)), use)[0]


def l2(v) -> Column:
    """A vector over its norm; a zero vector stays (S-25)."""
    norm = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x))
    over = lambda u, n: F.when(n == 0, u).otherwise(F.transform(u, lambda x: x / n))
    return let(F.struct(c(v).alias("v")), lambda s: let(F.struct(s["v"].alias("v"), norm(s["v"]).alias("n")), lambda p: over(p["v"], p["n"])))


def dot(a, b) -> Column:
    """Dot product (S-24)."""
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embed(text) -> Column:
    """64 signed hash buckets of tokens and pairs, L2-normalised (T-12).

    Each bucket walks all features again: for queries and other single texts. Tables use `embed_fast`."""
    hashed = F.transform(features(tokens(text)), lambda f: _slot(fnv64(f)))
    bucket = lambda hs, k: F.aggregate(hs, F.lit(0.0), lambda s, h: s + F.when(F.abs(h) - 1 == k, F.signum(h)).otherwise(0.0))
    return l2(let(F.struct(hashed.alias("h")), lambda s: F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: bucket(s["h"], k))))


def _slot(h: Column) -> Column:
    """Signed 1-based bucket."""
    return (h["lo"].bitwiseAND(WIDTH - 1) + 1) * F.when(F.shiftright(h["hi"], 31) == 1, -1).otherwise(1)


def _hashed(h: np.ndarray, code: np.ndarray, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """FNV-1a states carried on over the bytes of a word each: one step for each place, for all words at once."""
    h, size = h.copy(), np.diff(offs)
    left, k = np.flatnonzero(size[code] > 0), 0
    while len(left):
        h[left] = (h[left] ^ data[offs[code[left]] + k]) * np.uint64(0x100000001B3)
        k += 1
        left = left[size[code[left]] > k]
    return h


def _embedded(t: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(t), 0).to_numpy()
    words = t.flatten().dictionary_encode()
    code, known = words.indices.to_numpy(), words.dictionary.cast(pa.large_binary())
    _, offs, data = known.buffers()
    offs = np.frombuffer(offs, np.int64)[known.offset : known.offset + len(known) + 1] if len(known) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8).astype(np.uint64) if data else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(t)), size)
    alone = _hashed(np.full(len(known), BASIS64, np.uint64), np.arange(len(known)), offs, data)
    first = np.flatnonzero(row[1:] == row[:-1])
    joint = alone * np.uint64(0x100000001B3)  # the separator is a zero byte
    h = np.r_[alone[code], _hashed(joint[code[first]], code[first + 1], offs, data)]
    slot = np.r_[row, row[first]] * WIDTH + (h % np.uint64(WIDTH)).astype(np.int64)
    v = np.bincount(slot, np.where(h >> np.uint64(63), -1.0, 1.0), len(t) * WIDTH).astype(float).reshape(-1, WIDTH)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    v = np.divide(v, norm, out=v, where=norm > 0)
    ends = np.arange(len(t) + 1, dtype=np.int32) * WIDTH
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()), mask=t.is_null())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def embed_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same vector from tokens; null tokens have none."""
    for t in batches:
        yield _embedded(t)


def _strings(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of strings, as numbers that FNV-1a can go on with."""
    a = a.cast(pa.large_binary())
    _, offs, data = a.buffers()
    offs = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return offs, np.frombuffer(data, np.uint8).astype(np.uint64) if data else np.zeros(0, np.uint64)


def _fnv32(words: pa.Array) -> np.ndarray:
    """FNV-1a, 32 bits, of each string."""
    offs, data = _strings(words)
    h, size = np.full(len(words), BASIS32, np.uint64), np.diff(offs)
    left, k = np.flatnonzero(size > 0), 0
    while len(left):
        h[left] = ((h[left] ^ data[offs[left] + k]) * np.uint64(PRIME32)) & np.uint64(M32)
        k += 1
        left = left[size[left] > k]
    return h.astype(np.int64)


@F.arrow_udf(T.LongType())
def fnv32_fast(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """`fnv32` in Arrow batches; each distinct word of a batch is hashed once."""
    for x in batches:
        words = x.dictionary_encode()
        yield pa.array(_fnv32(words.dictionary)).take(words.indices)


def _counted(rows: int, row: np.ndarray, code: np.ndarray, names: pa.Array, fields: list[str]) -> pa.Array:
    """For each row its distinct codes, as names, with how often they occur."""
    most = max(len(names), 1)
    key, n = np.unique(row * most + code, return_counts=True)
    ends = np.searchsorted(key, np.arange(rows + 1) * most).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([names.take(pa.array(key % most)), pa.array(n.astype(np.int64))], fields))


def _words(t: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of each token, and the tokens by number."""
    return np.repeat(np.arange(len(t)), pc.fill_null(pc.list_value_length(t), 0).to_numpy()), t.flatten().dictionary_encode()


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
def token_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each row's distinct tokens with how often they occur, without a shuffle; `ROWS` rows at a time bound a worker's memory."""
    for batch in batches:
        for t in (batch.slice(a, ROWS) for a in range(0, max(len(batch), 1), ROWS)):
            row, words = _words(t)
            yield _counted(len(t), row, words.indices.to_numpy(), words.dictionary, ["term", "tf"])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("index", T.LongType()), T.StructField("n", T.LongType())])))
def index_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each row's distinct token hashes (`fnv32`) with how often they occur, colliding tokens summed (A-12)."""
    for t in batches:
        row, words = _words(t)
        index, code = np.unique(_fnv32(words.dictionary), return_inverse=True)
        yield _counted(len(t), row, code[words.indices.to_numpy()], pa.array(index), ["index", "n"])


POSTING_LISTS = "index long, term string, chunk_ids array<long>, tfs array<long>"


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (chunk_id, counts), for `mapInArrow`: a row of `POSTING_LISTS` for each distinct term of an Arrow batch, with
    the chunks that hold it and how often; counts as `token_counts` has them. Nothing is shuffled."""
    for t in batches:
        size, flat = pc.list_value_length(t["counts"]).to_numpy(), t["counts"].flatten()
        words = flat.field("term").dictionary_encode()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(code, minlength=len(words.dictionary)))].astype(np.int32))
        row = np.repeat(np.arange(len(t), dtype=np.int32), size)[order]
        chunks, tfs = t["chunk_id"].take(pa.array(row)), flat.field("tf").take(pa.array(order))
        columns = [pa.array(_fnv32(words.dictionary)), words.dictionary, pa.ListArray.from_arrays(ends, chunks), pa.ListArray.from_arrays(ends, tfs)]
        yield pa.RecordBatch.from_arrays(columns, ["index", "term", "chunk_ids", "tfs"])


def embed_fast(text) -> Column:
    """`embed` with the hashing in Arrow batches."""
    return embed_tokens(tokens(text))


def sparse_terms(df, key: str, t: str):
    """(key, index, n): hashed term counts of each row's tokens, colliding terms summed (A-12).

    Terms are counted before they are hashed, so each distinct term of a row is hashed once.
    """
    counts = df.select(key, F.explode(t).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return counts.groupBy(key, fnv32("term").alias("index")).agg(F.sum("n").alias("n"))


#: The closed set of embedding profiles, each a function from a text column to a vector column (X-02).
EMBEDDERS = {"local-hash-v1": embed_fast}


def embed_with(profile: str, text) -> Column:
    """Vectors of a text column by a named profile; an unknown profile is refused."""
    if profile not in EMBEDDERS:
        raise ValueError(f"unknown embedding profile {profile!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[profile](text)
