"""The chat corpus fold as a stream with a ledger that forgets (E-09, E-11).

Messages and remembered operations are map state, looked up one by one, so a conversation's state is never
loaded whole; what was recorded when is list state, and a timer for each time takes operations out of the ledger
once they are older than it keeps them. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.corpus import CHAT_COMMANDS, Conversation

HEAD = "owner string, lifecycle long, tombstone long, dead boolean, archived boolean, archive_revision long, access long, scopes array<string>, deletes array<long>"
HEAD_NAMES = [c.split()[0] for c in HEAD.split(", ")]
OUTCOME = "conversation_id long, seq long, outcome string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Held(MutableMapping):
    """Map state as a mapping from one string to a tuple."""

    def __init__(self, state, added=None):
        self.state, self.added = state, added or (lambda key, value: None)

    def __getitem__(self, key):
        value = self.state.getValue((key,))
        if value is None:
            raise KeyError(key)
        return tuple(value)

    def __setitem__(self, key, value):
        self.state.updateValue((key,), tuple(value))
        self.added(key, value)

    def __delitem__(self, key):
        self.state.removeKey((key,))

    def __contains__(self, key):
        return self.state.containsKey((key,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self):
        return sum(1 for _ in self.state.keys())

    def clear(self):
        self.state.clear()


class ChatFold(StatefulProcessor):
    """One conversation's commands; operations are remembered for `keep` milliseconds of event time."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.messages = handle.getMapState("messages", "id string", "digest string, retract long")
        self.done = handle.getMapState("done", "operation_id string", "said string, outcome string, at long")
        self.recorded = handle.getListState("recorded", "operation_id string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        done = Held(self.done, lambda op, value: new.append((op, value[2])))
        c = Conversation(done=done, keep=self.keep, messages=Held(self.messages))
        if self.head.exists():
            for name, value in zip(HEAD_NAMES, self.head.get()):
                setattr(c, name, {"scopes": tuple, "deletes": set}.get(name, lambda x: x)(value))
        plain = lambda v: v if v is None or isinstance(v, (str, int, bool)) else v.tolist() if hasattr(v, "tolist") else v
        commands = pd.concat(list(rows)).sort_values("seq").to_dict("records")
        out = [(key[0], x["seq"], c.apply({k: plain(v) for k, v in x.items()})) for x in commands]
        self.head.update(tuple({"scopes": list, "deletes": sorted}.get(n, lambda x: x)(getattr(c, n)) for n in HEAD_NAMES))
        if new:
            self.recorded.appendList(new)
            for at in {at for _, at in new}:
                self.handle.registerTimer(at + self.keep)
        yield pd.DataFrame(out, columns=["conversation_id", "seq", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Operations recorded up to `keep` before the timer's time leave the ledger."""
        until = expiredTimerInfo.getExpiryTimeInMs() - self.keep
        left = []
        for op, at in self.recorded.get():
            if at > until:
                left.append((op, at))
            elif (held := self.done.getValue((op,))) is not None and held[2] <= until:
                self.done.removeKey((op,))
        self.recorded.clear()
        if left:
            self.recorded.put(left)
        yield pd.DataFrame({"conversation_id": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "outcome": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def apply_chat_commands(stream: DataFrame, keep: int, delay: str = "10 minutes") -> DataFrame:
    """Outcomes of a stream of chat commands (E-09), with operations forgotten after `keep` milliseconds (E-11):
    the same as `corpus.apply_chat_commands` of the whole log with the same `keep`.

    stream: the columns of `CHAT_COMMANDS`, and `time`, a timestamp; commands later than `delay` are left
    out, as their ledger may be gone. Operation ids are a conversation's own, as with `keep` in the batch.
    """
    commands = stream.withWatermark("time", delay).select(*CHAT_COMMANDS, F.unix_millis("time").alias("at"), "time")
    return commands.groupBy("conversation_id").transformWithStateInPandas(ChatFold(keep), OUTCOME, "Append", "EventTime")
