"""The versioned corpus: its command log folded to state, and search over active, authorised versions."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.retrieval import dense_best, top
from tidemark.operators.walk import walk
from tidemark.sources.tables import shared_path

COMMANDS = ["document_id", "seq", "operation_id", "kind", "version_id", "owner_space", "digest", "lifecycle", "revision", "expected_version", "is_public", "spaces"]
FOLDED = "document_id long, seq long, outcome string, version_id string, owner_space string, digest string, is_active boolean, activation long, access long, lifecycle long, tombstone long, dead boolean, is_public boolean, spaces array<string>"


#: How outcomes of refused commands begin; what was refused is not remembered and may come again.
REFUSED = ("stale", "conflict", "not_found", "invalid")


@dataclass
class Commanded:
    """State that commands change, one operation id at a time; a command's kind names the method for it."""

    done: MutableMapping = field(default_factory=dict)  # operation -> its command, outcome and time
    keep: int | None = None  # how long an operation is remembered, in the unit of `at`; None: for ever

    def apply(self, c: dict) -> str:
        """Outcome of a command; a repeated operation repeats its outcome, another one under its id, or one that
        another key's command has `taken`, conflicts."""
        if c.get("taken"):
            return "conflict"
        said = "\x1f".join(str(v) for k, v in c.items() if k not in ("seq", "operation_id", "taken", "at", "time"))
        at = c.get("at") or 0
        if c["operation_id"] in self.done:
            first, outcome, since = self.done[c["operation_id"]]
            if self.keep is None or at - since < self.keep:
                return f"replayed_{outcome}" if first == said else "conflict"
        outcome = getattr(self, c["kind"])(c)
        if not outcome.startswith(REFUSED):
            self.done[c["operation_id"]] = said, outcome, at
        return outcome


def fold_commands(log: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """A walk over each key's commands with one ledger of operation ids for the whole store (E-10): of an id that
    several keys use, the first command that succeeds, by seq and key, takes it, and those of other keys conflict.

    Whether a command succeeds hangs on the commands before it, also by way of ids that other keys took. So
    all keys are walked once as if the first use of each shared id took it. Then only keys with a command that
    the outcomes' takers mark otherwise are walked again, until no mark moves: each round settles the next
    commands in order, and a key whose marks stay keeps its outcomes.
    """
    key, seq = columns[:2]
    log = log.select(*columns).where(F.col(key).isNotNull())
    spark = log.sparkSession
    ids = log.where("operation_id is not null").groupBy("operation_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("operation_id")
    path = shared_path(spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def marked(rows: DataFrame, takers: DataFrame, name: str = "taken") -> DataFrame:
        t = takers.select("operation_id", F.col("first.seq").alias("_seq"), F.col("first.key").alias("_key"))
        other = (F.col(key) != F.col("_key")) & (F.struct(F.col(seq), F.col(key)) > F.struct("_seq", "_key"))
        return rows.join(t, "operation_id", "left").select(*rows.columns, F.coalesce(other, F.lit(False)).alias(name))

    def walked(rows: DataFrame, takers: DataFrame) -> DataFrame:
        return walk(marked(rows, takers), [*columns, "taken"], make, schema)

    def first(uses: DataFrame) -> DataFrame:
        return uses.groupBy("operation_id").agg(F.min(F.struct(F.col(seq).alias("seq"), F.col(key).alias("key"))).alias("first"))

    def won(told: DataFrame) -> DataFrame:
        done = F.col(seq).isNotNull() & ~F.col("outcome").rlike("^(replayed|" + "|".join(REFUSED) + ")")
        return told.where(done).select(key, seq).join(shared, [key, seq]).select(key, seq, "operation_id")

    shared = stored(log.join(ids, "operation_id", "left_semi").select(key, seq, "operation_id"), "shared")
    takers = first(shared)
    if shared.isEmpty():
        return walked(log, takers)
    takers = stored(takers, "takers0")
    once = stored(walked(log, takers), "once")
    winners = stored(won(once), "won0")
    for n in count(1):
        before, takers = takers, stored(first(winners), f"takers{n}")
        both = marked(marked(shared, before, "was"), takers, "now")
        moved = stored(both.where("was <> now").select(key).distinct(), f"moved/{n}")
        if moved.isEmpty():
            break
        told = walked(log.join(moved, key, "left_semi"), takers)
        winners = stored(winners.join(moved, key, "left_anti").unionByName(won(told)), f"won{n}")
    if n == 1:
        return once
    again = spark.read.schema(moved.schema).parquet(*[f"{path}/moved/{k}" for k in range(1, n)]).distinct()
    return once.join(again, key, "left_anti").unionByName(walked(log.join(again, key, "left_semi"), takers))


@dataclass
class Document(Commanded):
    """What the commands of one document have left so far."""

    owner: str | None = None
    lifecycle: int = 0
    tombstone: int = 0
    dead: bool = False
    active: str | None = None
    activation: int = 0
    activated: str | None = None  # the version of the latest activation
    access: int = 0
    public: bool = False
    spaces: tuple = ()
    versions: dict = field(default_factory=dict)  # version -> digest
    contents: dict = field(default_factory=dict)  # digests of all versions ever indexed
    deletes: dict = field(default_factory=dict)  # what was deleted at which lifecycle -> outcome

    def _late(self, life: int) -> bool:
        return life < self.lifecycle or (self.dead and life <= self.tombstone)

    def index(self, c: dict) -> str:
        version, held = c["version_id"], self.contents.get(c["version_id"])
        if self._late(c["lifecycle"]):
            return "stale_lifecycle"
        if self.owner not in (None, c["owner_space"]) or held not in (None, c["digest"]):
            return "conflict"
        self.lifecycle = max(self.lifecycle, c["lifecycle"])
        if version in self.versions:
            return "unchanged"
        self.versions[version] = self.contents[version] = c["digest"]
        self.owner = c["owner_space"]
        return "indexed"

    def activate(self, c: dict) -> str:
        version, revision = c["version_id"], c["revision"]
        if self._late(c["lifecycle"]):
            return "stale_lifecycle"
        if revision < self.activation:
            return "stale_activation"
        again = revision == self.activation and self.activation > 0
        if again and self.activated != version:
            return "conflict"
        if again and not self.dead:
            return "unchanged"
        if version not in self.versions:
            return "not_found"
        if not again and c["expected_version"] and self.active != c["expected_version"]:
            return "conflict"
        self.lifecycle = max(self.lifecycle, c["lifecycle"])
        self.activation, self.activated, self.active, self.dead = revision, version, version, False
        return "activated"

    def share(self, c: dict) -> str:
        policy = bool(c["is_public"]), tuple(sorted({x.strip() for x in c["spaces"] or () if x.strip()}))
        if self._late(c["lifecycle"]):
            return "stale_lifecycle"
        if c["revision"] < self.access:
            return "stale_access"
        same = policy == (self.public, self.spaces)
        if c["revision"] == self.access and not same:
            return "conflict"
        changed = c["revision"] > self.access
        self.access, (self.public, self.spaces) = c["revision"], policy
        self.lifecycle = max(self.lifecycle, c["lifecycle"])
        return "shared" if changed else "unchanged"

    def drop(self, c: dict) -> str:
        key = c["version_id"], c["lifecycle"]
        if key in self.deletes:
            return self.deletes[key]
        if self._late(c["lifecycle"]):
            return "stale_lifecycle"
        self.lifecycle = max(self.lifecycle, c["lifecycle"])
        outcome = "absent" if self.versions.pop(c["version_id"], None) is None else "dropped"
        if outcome == "dropped" and self.active == c["version_id"]:
            self.active, outcome = None, "dropped_active"
        self.deletes[key] = outcome
        return outcome

    def delete(self, c: dict) -> str:
        if (None, c["lifecycle"]) in self.deletes:
            return "deleted"
        if c["lifecycle"] < self.lifecycle:
            return "stale_lifecycle"
        if c["lifecycle"] == self.lifecycle:
            return "conflict"
        self.versions.clear()
        self.active, self.dead = None, True
        self.lifecycle = self.tombstone = c["lifecycle"]
        self.deletes[None, c["lifecycle"]] = "deleted"
        return "deleted"

    def rows(self, document_id: int) -> Iterator[tuple]:
        """The document's row, with a null version, and one for each version."""
        for version in [None, *sorted(self.versions)]:
            yield document_id, None, None, version, self.owner, self.versions.get(version), version is not None and version == self.active, self.activation, self.access, self.lifecycle, self.tombstone, self.dead, self.public, list(self.spaces)


def apply_corpus_commands(log: DataFrame) -> DataFrame:
    """The versioned corpus fold (E-08): a row with `seq` and `outcome` for each command, and rows without
    `seq` for the state of each document (version_id null) and of its versions.

    Each document's commands pass one task in order of `seq`; only the state of the document at hand is held:
    its versions and the operations done, not its commands. Kinds: index, activate, share (a policy snapshot),
    drop (a version), delete (the document). A repeated operation id with the same command repeats its
    outcome, also across the store, see `fold_commands`. Other columns are ignored; commands without a
    document_id are left out.
    """
    return fold_commands(log, COMMANDS, Document, FOLDED)


CHAT_COMMANDS = ["conversation_id", "seq", "operation_id", "kind", "message_ids", "digests", "owner_scope", "lifecycle", "revision", "scopes"]
CHAT_FOLDED = "conversation_id long, seq long, outcome string, message_id string, owner_scope string, digest string, retracted boolean, retract long, archived boolean, archive long, access long, lifecycle long, tombstone long, dead boolean, scopes array<string>"


@dataclass
class Conversation(Commanded):
    """What the commands of one conversation have left so far."""

    owner: str | None = None
    lifecycle: int = 0
    tombstone: int = 0
    dead: bool = False
    archived: bool = False
    archive_revision: int = 0
    access: int = 0
    scopes: tuple = ()
    messages: MutableMapping = field(default_factory=dict)  # id -> digest, retract revision (None if not retracted)
    deletes: set = field(default_factory=set)

    def _late(self, life: int) -> bool:
        """After a delete only what is above it counts, else what is not below the present."""
        return life <= self.tombstone if self.dead else life < self.lifecycle

    def _known(self) -> bool:
        return self.owner is not None

    def index(self, c: dict) -> str:
        """All messages of the command or none; a message's content never changes."""
        ids, digests = c["message_ids"] or [], c["digests"] or []
        if not ids or len(set(ids)) < len(ids):
            return "invalid"
        if self.owner not in (None, c["owner_scope"]):
            return "conflict"
        if self._late(c["lifecycle"]):
            return "stale_lifecycle"
        new = dict(zip(ids, digests, strict=True))
        if any(m in self.messages and self.messages[m][0] != x for m, x in new.items()):
            return "conflict"
        self.owner = c["owner_scope"]
        self.lifecycle = max(self.lifecycle, c["lifecycle"])
        for m, x in new.items():
            if m not in self.messages:
                self.messages[m] = x, None
        return "indexed"

    def archive(self, c: dict) -> str:
        if not self._known():
            return "not_found"
        if c["revision"] < self.archive_revision:
            return "stale_archive"
        if self._late(c["lifecycle"]):
            return "stale_lifecycle"
        self.archived, self.dead, self.archive_revision = True, False, c["revision"]
        self.lifecycle = max(self.lifecycle, c["lifecycle"])
        return "archived"

    def share(self, c: dict) -> str:
        scopes = tuple(sorted({x.strip() for x in c["scopes"] or () if x.strip()}))
        if not self._known():
            return "not_found"
        if c["revision"] < self.access:
            return "stale_access"
        if c["revision"] == self.access and scopes != self.scopes:
            return "conflict"
        if self._late(c["lifecycle"]):
            return "stale_lifecycle"
        self.access, self.scopes = c["revision"], scopes
        self.lifecycle = max(self.lifecycle, c["lifecycle"])
        return "shared"

    def retract(self, c: dict) -> str:
        """Of the command's first message."""
        message = self.messages.get(next(iter(c["message_ids"] or []), None))
        if message is None:
            return "not_found"
        if c["revision"] < (message[1] or 0):
            return "stale_retract"
        if self._late(c["lifecycle"]):
            return "stale_lifecycle"
        self.messages[c["message_ids"][0]] = message[0], c["revision"]
        self.lifecycle = max(self.lifecycle, c["lifecycle"])
        return "retracted"

    def delete(self, c: dict) -> str:
        """A repeated delete is fenced before its old result counts: the conversation may live again since."""
        if c["lifecycle"] < self.lifecycle:
            return "stale_lifecycle"
        if c["lifecycle"] in self.deletes:
            return "deleted"
        if c["lifecycle"] == self.lifecycle and self._known():
            return "conflict"
        self.messages.clear()
        self.archived, self.dead = False, True
        self.lifecycle = self.tombstone = c["lifecycle"]
        self.deletes.add(c["lifecycle"])
        return "deleted"

    def rows(self, conversation_id: int) -> Iterator[tuple]:
        """The conversation's row, with a null message, and one for each message."""
        for m in [None, *sorted(self.messages)]:
            digest, retract = self.messages.get(m, (None, None))
            yield conversation_id, None, None, m, self.owner, digest, retract is not None, retract, self.archived, self.archive_revision, self.access, self.lifecycle, self.tombstone, self.dead, list(self.scopes)


def apply_chat_commands(log: DataFrame, keep: int | None = None) -> DataFrame:
    """The chat corpus fold (E-09), with rows as `apply_corpus_commands` has them: outcomes, then the state of
    each conversation and of its messages. Kinds: index (messages, whose contents never change), archive, share
    (a scope snapshot), retract (a message), delete (the conversation).

    keep: an operation is remembered for so long after its time, the log's further column `at` (E-11); its id is
    then its conversation's own."""
    if keep is None:
        return fold_commands(log, CHAT_COMMANDS, Conversation, CHAT_FOLDED)
    return walk(log, [*CHAT_COMMANDS, "at"], lambda: Conversation(keep=keep), CHAT_FOLDED)


def authorised(spaces: list[str], documents: list[int]) -> Column:
    """Active, not tombstoned, and public, named, or of an allowed owner or granted space (F-09)."""
    allowed = F.array(*[F.lit(x) for x in spaces]).cast("array<string>")
    named = F.array(*[F.lit(x) for x in documents]).cast("array<bigint>")
    return F.col("is_active") & ~F.col("dead") & (F.col("is_public") | F.array_contains(named, F.col("document_id")) | F.array_contains(allowed, F.col("owner_space")) | F.arrays_overlap("spaces", allowed))


def search_versions(chunks: DataFrame, versions: DataFrame, queries: DataFrame, k: int, spaces: list[str], documents: list[int] = ()) -> DataFrame:
    """(query_id, id, document_id, version_id, score, rank): the k best chunks of authorised active versions,
    each displayed chunk once (T-21). The filter comes before the limit, so a page is full whenever enough
    chunks are allowed (K-15).

    chunks: chunk_id, document_id, version_id, position, vector; versions: rows of the fold's versions.
    """
    may = versions.where(authorised(spaces, list(documents))).select("document_id", "version_id").distinct()
    shown = F.format_string("%d@%s#%03d", "document_id", "version_id", "position")
    inside = chunks.join(may, ["document_id", "version_id"], "left_semi").select(F.struct(shown.alias("id"), "document_id", "version_id").alias("chunk_id"), "vector")
    scored = dense_best(inside, queries, k, ["id", "document_id", "version_id"]).groupBy("query_id", "chunk_id.id", "chunk_id.document_id", "chunk_id.version_id").agg(F.max("score").alias("score"))
    return top(scored, k, F.desc("score"), "id")
