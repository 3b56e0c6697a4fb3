"""Reducers of command logs: documents, memberships, group members, reviews."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import payload_fingerprint
from tidemark.operators.walk import walk

COMMAND = ["document_id", "seq", "op", "version", "flag", "expected"]
REDUCED = "document_id long, seq long, result string, status string, active long, agg long, act long, acc long, life long, public boolean"


@dataclass
class Draft:
    """A document's status, active version, four revisions and access, as commands have left them (E-12, E-13)."""

    status: str = "active"
    active: int = 0
    agg: int = 1
    act: int = 0
    acc: int = 1
    life: int = 1
    public: bool = False

    def apply(self, c: dict) -> str:
        """One command: draft, publish, withdraw, access, archive or trash."""
        op, live = c["op"], self.status == "active"
        if c["expected"] not in (0, self.agg):
            return "revision_conflict"
        if not (self.status != "trashed" if op == "trash" else live and (op != "withdraw" or self.active == c["version"])):
            return "precondition"
        if op == "access" and self.public == c["flag"]:
            return "unchanged"
        self.agg += 1
        if op in ("publish", "withdraw"):
            self.act += 1
            self.active = c["version"] if op == "publish" else 0
        elif op == "access":
            self.acc += 1
            self.public = c["flag"]
        elif op in ("archive", "trash"):
            self.life += 1
            self.status = "archived" if op == "archive" else "trashed"
        return "applied"

    def rows(self, document_id: int) -> Iterator[tuple]:
        yield document_id, None, None, self.status, self.active, self.agg, self.act, self.acc, self.life, self.public


def reduce_documents(commands: DataFrame) -> DataFrame:
    """Commands (document_id, seq, op, version, flag, expected) reduced: a row with `seq` and `result` for each,
    rejected ones with their reason, and one without `seq` for the state of each document."""
    return walk(commands, COMMAND, Draft, REDUCED)


SAVE = ["document_id", "seq", "request_id", "subject_key", "fingerprint", "public", "expected", "owner_subject_key", "status", "aggregate", "activation", "access", "latest"]
SAVED = "document_id long, seq long, outcome string, version long, aggregate long, activation long, access long, public boolean"


@dataclass
class Saves:
    """A document under combined saves, with the ledger of the requests that it has committed."""

    known: bool = False
    aggregate: int = 0
    activation: int = 0
    access: int = 0
    latest: int = 0
    public: bool | None = None  # null: no policy yet
    done: dict = field(default_factory=dict)  # request -> its fingerprint and version

    def apply(self, c: dict) -> str | tuple:
        if not self.known:
            self.known = True
            self.aggregate, self.activation, self.access, self.latest = c["aggregate"] or 0, c["activation"] or 0, c["access"] or 0, c["latest"] or 0
        if c["owner_subject_key"] is None:
            return "not_found"
        if c["owner_subject_key"] != c["subject_key"]:
            return "not_owner"
        request, now = c["request_id"], lambda: (self.aggregate, self.activation, self.access, bool(self.public))
        if request and request in self.done:
            fingerprint, version = self.done[request]
            return ("replayed", version, *now()) if fingerprint == c["fingerprint"] else "conflict"
        if c["expected"] not in (0, self.aggregate):
            return "revision_conflict"
        if c["status"] != "active":
            return "precondition"
        self.latest += 1
        self.aggregate += 2  # the version is appended, then activated
        self.activation += 1
        if c["public"] is not None and c["public"] != self.public:
            self.public = c["public"]
            self.access += 1
            self.aggregate += 1
        if request:
            self.done[request] = c["fingerprint"], self.latest
        return ("applied", self.latest, *now())

    def rows(self, document_id: int) -> Iterator[tuple]:
        return iter(())


def save_documents(commands: DataFrame, documents: DataFrame) -> DataFrame:
    """Combined saves (E-14): each appends a version, activates it and changes the access policy if it names
    one, all or nothing; a row for each save, and for an applied one the revisions of its one upsert event.

    A request id that the document has committed repeats its version with the present revisions, or conflicts
    if its payload differs; without an id a save is always new. commands: document_id, seq, request_id,
    subject_key, title, content, format, public (null: keep), expected (0: any); documents: document_id,
    owner_subject_key, status, aggregate, activation, access, latest (version), one row each.
    """
    c = commands.withColumn("fingerprint", payload_fingerprint(F.col("document_id").cast("string"), "title", "content", "format", public="public"))
    return walk(c.join(documents, "document_id", "left"), SAVE, Saves, SAVED)


def effective_intervals(actions: DataFrame, key: list[str]) -> DataFrame:
    """[created_at, revoked_at) of each grant in a log of grant and revoke actions (E-15)."""
    w = Window.partitionBy(*key).orderBy("ts", "seq")
    r = actions.withColumn("before", F.lag("action").over(w)).where("before is null or before <> action")
    r = r.withColumn("revoked_at", F.lead("ts").over(w))
    return r.where("action = 'grant'").select(*key, F.col("ts").alias("created_at"), "revoked_at")


def last_action(actions: DataFrame, key: list[str], *order) -> DataFrame:
    """The last action of each key (E-22, W-10)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return actions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def active_bindings(bindings: DataFrame) -> DataFrame:
    """Bindings of each space in creation order, with their place (K-17); revoked ones are left out before."""
    return bindings.withColumn("place", F.row_number().over(Window.partitionBy("space_id").orderBy("created_at", "binding_id")))


def reduce_reviews(decisions: DataFrame) -> DataFrame:
    """The first decision of each request holds; of approved ones the earliest of a username gets it (E-23)."""
    first = last_action(decisions, ["request_id"], "seq")
    w = Window.partitionBy("username", "decision").orderBy("seq")
    return first.withColumn("status", F.when((F.col("decision") == "approve") & (F.row_number().over(w) > 1), "username_taken").when(F.col("decision") == "approve", "approved").otherwise("rejected"))
