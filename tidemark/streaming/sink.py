"""A sink of two tables: the raw log of applied events and the state they leave (IO-05, IO-12, E-21)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.operators.events import clean_chunks, merge_batch
from tidemark.sources.tables import BatchTable


def log_and_state(log: BatchTable, state: BatchTable, chunks: BatchTable | None = None) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that appends a batch's new events to the log and folds them into the state.

    Both tables keep the numbers of the batches they hold, so a batch that was lost between the two
    writes, or is delivered again, is taken up where it was left: the state is folded from what the log
    holds of the batch, not from the delivery. log: keyed by event_id, each id once at any age; a batch looks
    into the buckets of its ids only. chunks: loses those of dead documents after every batch, with the state's
    number; until then the state hides them.
    """

    def put(events: DataFrame, batch: int) -> None:
        if batch not in log.batches():
            once = events.dropDuplicates(["event_id"])
            known = log.all(batch, log.touched(once)).select("event_id")
            log.write(batch, once.join(known, "event_id", "left_anti"))
        merge_batch(state, batch, log.batch(batch))
        if chunks is not None:
            clean_chunks(chunks, batch, state.current(state.touched(log.batch(batch))))

    return put


def run_to_tables(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream of events to the end of its log; a restart goes on from the checkpoint."""
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
