"""Exact nearest vectors of many queries: blocks of vectors meet blocks of queries as products of matrices.

Vectors and queries are dealt to blocks by a hash of their ids, as many as keep a block bounded, and each pair of blocks
is one group. There the matrix product only tells which pairs can be among a query's k best; their scores are
then summed in order and rounded as `dot` and `round` of columns do it, so results are those of a scan.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of vectors and of queries, at most about; pairs of a product that are held at once; scores summed at once.
VECTORS, QUERIES, PAIRS, SUMS = 65_536, 4_096, 1 << 22, 1 << 16


def _rounded(s: np.ndarray) -> np.ndarray:
    """Six decimals, half up by a number's shortest decimal form, as `round` has it."""
    x = np.abs(s) * 1e6
    with np.errstate(invalid="ignore"):
        out = np.where(x < 2.0**52, np.copysign(np.floor(x + 0.5) / 1e6, s), s) + 0.0
        half = np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-9 + x * 1e-15)
    values, place = np.unique(s[half], return_inverse=True)
    exact = [float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values]
    out[half] = np.array(exact)[place] + 0.0 if len(half) else 0.0
    return out


def _score(c: np.ndarray, q: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Rounded scores of pairs, summed from the first place on."""
    out = np.zeros(len(row))
    for a in range(0, len(row), SUMS):
        x, y = c[row[a : a + SUMS]], q[query[a : a + SUMS]]
        for k in range(c.shape[1]):
            out[a : a + SUMS] += x[:, k] * y[:, k]
    return _rounded(out)


def _best(c: np.ndarray, q: np.ndarray, k: int, positive_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, ties by the row's number; NaN is above all numbers."""
    m, width = len(q), c.shape[1]
    norm = lambda x: np.sqrt((x * x).sum(1))
    with np.errstate(all="ignore"):
        slack = 1e-9 + 4 * (width + 1) * np.finfo(float).eps * np.nan_to_num(norm(q) * (norm(c).max() if len(c) else 0.0), nan=np.inf, posinf=np.inf)
    least = np.where(np.isfinite(slack), 0.5e-6 - slack, -np.inf) if positive_only else np.full(m, -np.inf)
    bar, none = least.copy(), np.zeros(0, np.int64)
    held, new, waiting = (none, none, np.zeros(0)), [], 0

    def prune(held, new):
        g, r, s = (np.concatenate(x) for x in zip(held, *new))
        key = np.where(np.isnan(s), np.inf, s)
        order = np.lexsort((r, -key, g))
        g, r, s, key = g[order], r[order], s[order], key[order]
        first = np.searchsorted(g, np.arange(m))
        place = np.arange(len(g)) - first[g]
        last = place == k - 1
        # rows that follow have larger numbers: they must be above the k-th, by a rounded step
        bar[g[last]] = np.maximum(least[g[last]], np.where(np.isfinite(slack[g[last]]), key[last] + 0.5e-6 - slack[g[last]], -np.inf))
        keep = place < k
        return g[keep], r[keep], s[keep]

    step = max(1, PAIRS // max(m, 1))
    for a in range(0, len(c), step):
        with np.errstate(all="ignore"):
            s = c[a : a + step] @ q.T
        near = ~(s < bar)
        if len(s) > k and np.count_nonzero(near) > 4 * k * m:  # the k best of these rows alone are a bound as well
            kth = np.partition(s, len(s) - k, axis=0)[len(s) - k]
            near &= ~(s < np.where(np.isnan(kth), np.inf, kth) - 1.01e-6 - slack)
        r, g = np.nonzero(near)
        score = _score(c, q, r + a, g)
        if positive_only:
            up = ~(score <= 0)
            r, g, score = r[up], g[up], score[up]
        new.append((g, r + a, score))
        waiting += len(g)
        if a == 0 or waiting > max(m * k // 2, 1 << 16):
            held, new, waiting = prune(held, new), [], 0
    return prune(held, new) if new else held


def _ordered(ids: pa.Array) -> np.ndarray:
    """The places of ids in ascending order; structs go by their fields."""
    t = pa.table({"id": ids})
    while any(pa.types.is_struct(f.type) for f in t.schema):
        t = t.flatten()
    return pc.sort_indices(t, sort_keys=[(n, "ascending") for n in t.column_names], null_placement="at_start").to_numpy()


def _widths(v: pa.Array) -> np.ndarray:
    """Lengths of vectors, -1 for those that are null or hold a null: these have no score."""
    n = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if v.flatten().null_count:
        n[pc.list_parent_indices(v).filter(v.flatten().is_null()).to_numpy()] = -1
    return n


def _matrix(v: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), width)


def _search(k: int, positive_only: bool, schema: pa.Schema):
    def of(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return schema.empty_table()
        one = lambda t, name: pa.concat_arrays(t[name].chunks)
        ids, v, asked, w = one(vectors, "chunk_id"), one(vectors, "vector"), one(queries, "query_id"), one(queries, "vector")
        order = _ordered(ids)
        size, wide, out = _widths(v)[order], _widths(w), []
        for n in np.unique(wide):
            qs, fit = np.flatnonzero(wide == n), np.flatnonzero((size == n) & (n >= 0))
            g, r, s = _best(_matrix(v, order[fit], n), _matrix(w, qs, n), k, positive_only) if len(fit) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            out.append((qs[g], order[fit[r]], s, np.zeros(len(g), bool)))
            if len(fit) < k and not positive_only:  # rows without a score come last
                rest = order[np.flatnonzero((size != n) | (n < 0))[: k - len(fit)]]
                out.append((np.repeat(qs, len(rest)), np.tile(rest, len(qs)), np.zeros(len(qs) * len(rest)), np.ones(len(qs) * len(rest), bool)))
        g, r, s, no = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays([asked.take(pa.array(g)), ids.take(pa.array(r)), pa.array(s, mask=no)], names=schema.names)

    return of


def nearest(chunks: DataFrame, queries: DataFrame, k: int, positive_only: bool = False) -> DataFrame:
    """(query_id, chunk_id, score): rows that hold each query's k best, those of every block, by rounded score then id.

    Rows of a query that has no score come last by id; with `positive_only`, none but positive scores count.
    """
    spark, n, m = chunks.sparkSession, chunks.count(), queries.count()
    groups = max(1, -(-m // QUERIES))
    blocks = max(1, -(-n // VECTORS), min(-(-2 * spark.sparkContext.defaultParallelism // groups), n // 1024))
    block: Column = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks))
    group: Column = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    v = chunks.select("chunk_id", F.col("vector").alias("vector"), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    q = queries.select("query_id", F.col("vector").alias("vector"), group.alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    dealt = lambda df: df.repartition(blocks * groups, "block", "group").groupBy("block", "group")
    schema = T.StructType([queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return dealt(v).cogroup(dealt(q)).applyInArrow(_search(k, positive_only, to_arrow_schema(schema)), schema)
