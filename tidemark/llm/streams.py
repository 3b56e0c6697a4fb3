"""Operators over sorted partitions that hold one row, not one group, at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def shared(rows: DataFrame) -> DataFrame:
    """Of rows sorted by their first two columns, a key and an owner, those whose key has several owners,
    each (key, owner) once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, if its token has one class so far; else that token's flag and class
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.r_[last is None or last != (t[0], c[0]), (t[1:] != t[:-1]) | (c[1:] != c[:-1])]
            idx = np.flatnonzero(new)
            last = (t[-1], c[-1])
            if not len(idx):
                continue
            part = batch.take(pa.array(idx))
            if held is not None:
                part = pa.Table.from_batches([held[0], part]).combine_chunks().to_batches()[0]
            t = part.column(0).to_numpy()
            prev = np.r_[False, t[1:] == t[:-1]]
            nxt = np.r_[t[1:] == t[:-1], False]
            out = prev | nxt
            if held is not None:
                out[0] = (len(t) > 1 and t[1] == t[0]) and not held[1]  # the held row itself, unless it went out before
                known = held[1] & (t == t[0])
                known[0] = False
                out |= known
            done = bool(out[-1]) if len(t) > 1 or held is None else held[1]
            held = (part.slice(len(t) - 1, 1), done)
            if out.any():
                yield part.filter(pa.array(out))

    return rows.mapInArrow(run, rows.schema)
