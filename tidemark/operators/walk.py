"""Sorted walks over command logs: a key's commands pass one task in order, against a small state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def walk(log: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """Rows of a sorted walk over commands: the first of `columns` is the key, the second the order. `make`
    gives a key's empty state, with `apply(command)`, an outcome or a tuple that begins with one, and
    `rows(key)`, the rows of its final state; a command's row has the key, the order, the outcome and nulls.

    Time grows with the commands and memory with the state of one key, never with a key's commands; commands
    without a key are left out, and those of equal order follow the order of their other columns.
    """
    key_of, order = columns[:2]
    fields = [(c.split()[0], KINDS[c.split()[1]]) for c in schema.split(", ")]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])

    def told(key, place, outcome) -> tuple:
        row = (key, place, *((outcome,) if isinstance(outcome, str) else outcome))
        return row + (None,) * (len(fields) - len(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for c in batch.to_pylist():
                if c[key_of] != key:
                    out += state.rows(key) if state else ()
                    key, state = c[key_of], make()
                out.append(told(key, c[order], state.apply(c)))
            yield packed(out)
        if state:
            yield packed(list(state.rows(key)))

    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.where(F.col(key_of).isNotNull()).select(*columns).repartition(n, key_of)
    return rows.sortWithinPartitions(*columns).mapInArrow(run, schema)
