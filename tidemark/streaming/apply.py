"""Streaming forms: document events folded under fences, deduplication, pending deliveries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.events import Fenced

STATE = "live boolean, agg long, acc long, life long, dead boolean, t_agg long, t_acc long, t_life long, seen long"
OUTCOME = "document_id long, sequence long, outcome string, kind string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One document's new events against its state of nine numbers; sequences seen before are skipped,
    so a redelivered batch changes nothing."""
    *stored, seen = state.get if state.exists else (*Fenced().stored(), 0)
    fenced = Fenced(*stored)
    out = []
    for e in pd.concat(list(batches)).sort_values("sequence").to_dict("records"):
        if e["sequence"] > seen:
            seen = e["sequence"]
            out.append((key[0], seen, fenced.apply(e), e["kind"]))
    state.update((*fenced.stored(), seen))
    yield pd.DataFrame(out, columns=["document_id", "sequence", "outcome", "kind"])


def apply_document_events(stream: DataFrame) -> DataFrame:
    """Outcomes of a stream of document events, keyed by document; the same as the batch fold of the
    same log (E-01). Contents stay out of the state: the sink joins them by sequence."""
    events = stream.select("document_id", "sequence", "kind", "aggregate_revision", "access_revision", "lifecycle_revision")
    return events.groupBy("document_id").applyInPandasWithState(_fold, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def dedupe_events(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """The first of each event id, at any age (E-03)."""
    return stream.dropDuplicates([key])


def dedupe_recent(stream: DataFrame, ts: str, delay: str, key: str = "event_id") -> DataFrame:
    """The same with state bounded by a watermark, for logs whose redelivery is bounded in time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def pending_stream(deliveries: DataFrame, acks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Deliveries not acknowledged within a delay: an outer join of two streams (E-18).

    deliveries: delivery_id, sent_at; acks: delivery_id, acked_at.
    """
    d = deliveries.withWatermark("sent_at", delay).alias("d")
    a = acks.withWatermark("acked_at", delay).alias("a")
    on = (F.col("d.delivery_id") == F.col("a.delivery_id")) & (F.col("a.acked_at") >= F.col("d.sent_at")) & (F.col("a.acked_at") <= F.col("d.sent_at") + F.expr(f"interval {delay}"))
    return d.join(a, on, "left_outer").where("a.delivery_id is null").select("d.*")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream to the end of its log, appending Parquet; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
