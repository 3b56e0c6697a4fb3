"""Folding change-event logs into state under revision fences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.walk import walk
from tidemark.sources.tables import BatchTable

EVENT = ["document_id", "sequence", "kind", "aggregate_revision", "access_revision", "lifecycle_revision"]
FOLDED = "document_id long, sequence long, outcome string, live boolean, agg long, acc long, life long, dead boolean, t_agg long, t_acc long, t_life long, last long"


def dedupe(log: DataFrame, key: str, *arrival) -> DataFrame:
    """The first arrival of each event id (E-03)."""
    w = Window.partitionBy(key).orderBy(*arrival)
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sequence_conflicts(log: DataFrame) -> DataFrame:
    """Sequences that several event ids use (E-04)."""
    return log.groupBy("sequence").agg(F.countDistinct("event_id").alias("ids")).where("ids > 1")


def scan(log: DataFrame, after: int, limit: int = 100) -> DataFrame:
    """The next `limit` events after a cursor (IO-01)."""
    return log.where(F.col("sequence") > after).orderBy("sequence").limit(limit)


def advance_cursors(cursors: DataFrame, applied: DataFrame) -> DataFrame:
    """(consumer, position) after applied sequences (consumer, sequence): a cursor never moves back (E-05)."""
    moved = applied.select("consumer", F.col("sequence").alias("position"))
    return cursors.select("consumer", "position").unionByName(moved).groupBy("consumer").agg(F.max("position").alias("position"))


def append_new(log: DataFrame, new: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """The rows of `new` that the log lacks, each key once (IO-03, IO-05)."""
    return new.dropDuplicates([key]).join(log.select(key), key, "left_anti")


@dataclass
class Fenced:
    """A document's stored row and tombstone: what its events have left so far."""

    live: bool = False
    agg: int = 0
    acc: int = 0
    life: int = 0
    dead: bool = False
    t_agg: int = 0
    t_acc: int = 0
    t_life: int = 0
    last: int = 0

    def outcome(self, delete: bool, agg: int, acc: int, life: int) -> str:
        """Of a document event against the stored row and tombstone (E-01)."""
        if self.dead and self.t_life >= life:
            return "stale_lifecycle"
        if not self.live:
            return "applied"
        if agg < self.agg and (agg > 0 or not delete):
            return "stale_revision"
        if not delete and acc < self.acc:
            return "stale_access"
        return "stale_lifecycle" if life < self.life else "applied"

    def apply(self, e: dict) -> str:
        delete, revisions = e["kind"] == "delete", (e["aggregate_revision"], e["access_revision"], e["lifecycle_revision"])
        outcome = self.outcome(delete, *revisions)
        if outcome == "applied":
            tomb = tuple(map(max, revisions, (self.t_agg, self.t_acc, self.t_life))) if delete else (0, 0, 0)
            self.live, self.dead, self.last = not delete, delete, e["sequence"]
            self.agg, self.acc, self.life = (0, 0, 0) if delete else revisions
            self.t_agg, self.t_acc, self.t_life = tomb
        return outcome

    def stored(self) -> tuple:
        return self.live, self.agg, self.acc, self.life, self.dead, self.t_agg, self.t_acc, self.t_life

    def rows(self, document_id: int) -> Iterator[tuple]:
        yield document_id, None, None, *self.stored(), self.last


def fold_document_events(log: DataFrame) -> DataFrame:
    """Each document's events in sequence order, folded: a row with `sequence` and `outcome` for each event,
    and one without `sequence` for the state of each document.

    Only ids and revisions are walked; contents join later by the winning sequence. log: distinct event ids.
    """
    return walk(log, EVENT, Fenced, FOLDED)


def apply_document_events(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, tombstones, outcomes) of a log of distinct events (E-01, IO-12, IO-13)."""
    f = fold_document_events(log)
    end = f.where("sequence is null")
    state = end.where("live").select("document_id", F.col("last").alias("sequence"), F.col("agg").alias("aggregate_revision"), F.col("acc").alias("access_revision"), F.col("life").alias("lifecycle_revision"))
    tombs = end.where("dead").select("document_id", F.col("t_agg").alias("aggregate_revision"), F.col("t_acc").alias("access_revision"), F.col("t_life").alias("lifecycle_revision"))
    return state, tombs, f.where("sequence is not null").select("document_id", "sequence", "outcome")


STATE = "document_id long, live boolean, agg long, acc long, life long, dead boolean, t_agg long, t_acc long, t_life long, last long, seen long, content string"


@dataclass
class Resumed(Fenced):
    """A document that goes on from its stored row; events up to the last one it saw change nothing."""

    seen: int = 0

    def apply(self, e: dict) -> str:
        if e["kind"] == "stored":
            for name in (c.split()[0] for c in STATE.split(", ")[1:-1]):
                setattr(self, name, e[name])
            return "stored"
        if e["sequence"] <= self.seen:
            return "seen"
        self.seen = e["sequence"]
        return super().apply(e)

    def rows(self, document_id: int) -> Iterator[tuple]:
        yield document_id, None, None, *self.stored(), self.last, self.seen


def resume_document_events(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of `STATE` after events (E-01) on top of stored rows (IO-12, IO-13): the documents of both.

    The content of a live document is that of its winning event, new or stored."""
    numbers = [c.split() for c in STATE.split(", ")[1:-1]]
    before = stored.select("document_id", F.lit(-1).cast("bigint").alias("sequence"), F.lit("stored").alias("kind"), *[F.lit(None).cast("bigint").alias(c) for c in EVENT[3:]], *[n for n, _ in numbers])
    after = events.select(*EVENT, *[F.lit(None).cast(kind).alias(n) for n, kind in numbers])
    f = walk(before.unionByName(after), [*EVENT, *(n for n, _ in numbers)], Resumed, f"{FOLDED}, seen long").where("sequence is null")
    won = events.select("document_id", F.col("sequence").alias("last"), F.col("content").alias("fresh"))
    j = f.drop("sequence", "outcome").join(won, ["document_id", "last"], "left").join(stored.select("document_id", "content"), "document_id", "left")
    return j.withColumn("content", F.when(F.col("live"), F.coalesce("fresh", "content"))).select(*[c.split()[0] for c in STATE.split(", ")])


def merge_batch(table: BatchTable, batch: int, events: DataFrame) -> bool:
    """Folds a batch of distinct events into a stored state table and rewrites the buckets it touches only.

    A batch that is done, and events the documents have seen, change nothing."""
    if batch in table.batches():
        return False
    touched = table.touched(events)
    return table.write(batch, resume_document_events(table.current(touched), events), touched)


def clean_chunks(chunks: BatchTable, batch: int, state: DataFrame) -> bool:
    """Removes the chunks of documents that the state says are dead, some time after their delete (E-21); buckets
    without such chunks stay as they are. Until then readers join the state, which hides them."""
    dead = state.where("dead").select("document_id")
    stale = chunks.current().join(dead, "document_id", "left_semi")
    touched = chunks.touched(stale)
    return bool(touched) and chunks.write(batch, chunks.current(touched).join(dead, "document_id", "left_anti"), touched)


def decide_record_events(log: DataFrame) -> DataFrame:
    """Adds `decision` to record events (E-02): windows only.

    The first event fixes the identity; others never apply. Of matching events a rejected one is not above
    the applied maximum, so the running maximum over matching events is that over applied ones.
    """
    by = Window.partitionBy("record_id").orderBy("arrival")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("conversation_id") == F.first("conversation_id").over(by.rowsBetween(Window.unboundedPreceding, 0))
    r = log.withColumn("same", same).withColumn("prev", F.max(F.when(F.col("same"), F.col("revision"))).over(before))
    r = r.withColumn("applied", F.col("same") & (F.col("prev").isNull() | (F.col("revision") > F.col("prev"))))
    last = lambda x: F.last(F.when(F.col("applied"), x), ignorenulls=True).over(before)
    r = r.withColumn("was_recalled", last(F.col("recall"))).withColumn("was", F.last(F.when(F.col("applied") & ~F.col("recall"), F.col("payload")), ignorenulls=True).over(before))
    equal = (F.col("recall") & F.col("was_recalled")) | (~F.col("recall") & ~F.col("was_recalled") & F.col("payload").eqNullSafe(F.col("was")))
    decision = F.when(~F.col("same"), "conflict").when(F.col("applied"), "apply").when(F.col("revision") < F.col("prev"), "stale_revision").when(equal, "duplicate_revision").otherwise("conflict")
    return r.withColumn("decision", decision).drop("same", "prev", "applied", "was_recalled", "was")


def record_state(decided: DataFrame) -> DataFrame:
    """Current records: the last applied revision and status, the last applied upsert's payload."""
    a = decided.where("decision = 'apply'")
    return a.groupBy("record_id").agg(F.max("revision").alias("revision"), F.max_by("conversation_id", "arrival").alias("conversation_id"), F.max_by("recall", "arrival").alias("recalled"), F.max_by("payload", F.when(~F.col("recall"), F.col("arrival"))).alias("payload"))


def replay(ops: DataFrame) -> DataFrame:
    """Adds `result` of idempotent operations: first, replayed or conflict (E-10)."""
    w = Window.partitionBy("operation_id").orderBy("arrival")
    first = F.first("fingerprint").over(w)
    return ops.withColumn("result", F.when(F.row_number().over(w) == 1, "first").when(F.col("fingerprint") == first, "replayed").otherwise("conflict"))


#: Ranges that a ledger's time is cut into to find where its overflow begins.
RANGES = 1024


def prune_ledger(ops: DataFrame, now: int, ttl: int, cap: int) -> DataFrame:
    """Entries inside the window, of those the `cap` latest; undated ones go first (E-11, W-06, A-16).

    Two levels find where the overflow begins: counts by range of time (some more than `RANGES` rows), then
    counts by time within the one range that is kept in part; only entries of the one time that is kept in part
    are ranked by id. So no task orders the ledger's times.
    """
    kept = ops.where((F.col("recorded_at") == 0) | (F.col("recorded_at") >= now - ttl))
    width = max(1, -(-ttl // RANGES))
    place = F.when(F.col("recorded_at") == 0, -1).otherwise(F.least(F.floor((F.col("recorded_at") - (now - ttl)) / width), F.lit(2 * RANGES)))
    counts = kept.groupBy("recorded_at").agg(F.count("*").alias("_n")).withColumn("_range", place)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("_range").agg(F.sum("_n").alias("_size"))
    sizes = sizes.withColumn("_left", cap - F.coalesce(F.sum("_size").over(before(Window.orderBy(F.desc("_range")))), F.lit(0)))  # a bounded number of rows
    partly = sizes.where("_left > 0 and _left < _size").select("_range", "_left")
    later = F.coalesce(F.sum("_n").over(before(Window.partitionBy("_range").orderBy(F.desc("recorded_at")))), F.lit(0))
    times = counts.join(partly, "_range").withColumn("_room", F.col("_left") - later).where("_room > 0").select("recorded_at", "_room", "_n")
    j = kept.withColumn("_range", place).join(sizes, "_range").join(times, "recorded_at", "left")
    every = (F.col("_left") >= F.col("_size")) | F.coalesce(F.col("_room") >= F.col("_n"), F.lit(False))
    last = j.where(~every & (F.col("_room") > 0)).withColumn("_k", F.row_number().over(Window.partitionBy("recorded_at").orderBy(F.desc("operation_id")))).where("_k <= _room")
    return j.where(every).select(*ops.columns).unionByName(last.select(*ops.columns))


def refresh_records(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows brought to the ledger's latest revision where that is not older (E-07, J-12)."""
    j = rows.join(latest.select("record_id", F.col("revision").alias("to")), "record_id", "left")
    return j.withColumn("revision", F.when(F.col("revision") <= F.col("to"), F.col("to")).otherwise(F.col("revision"))).withColumn("refreshed", F.coalesce(F.col("revision") == F.col("to"), F.lit(False))).drop("to")


def prune_generations(present: DataFrame, referenced: DataFrame) -> DataFrame:
    """Generations that nothing refers to (IO-16)."""
    return present.join(referenced, "generation", "left_anti")


def replace_chunks(store: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """A store with all chunks of the given documents replaced (IO-14)."""
    return store.join(chunks.select(key).distinct(), key, "left_anti").unionByName(chunks)


def sync_controls(chunks: DataFrame, controls: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks with their access columns taken from present controls (IO-15)."""
    return chunks.drop(*[c for c in controls.columns if c != key]).join(controls, key, "left")
