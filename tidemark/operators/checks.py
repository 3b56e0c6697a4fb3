"""Data-quality checks: each returns the rows that break its rule, so an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def missing_parent(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Child rows without a parent (Q-15)."""
    return child.join(parent.select(*key).distinct(), key, "left_anti")


def owner_not_member(spaces: DataFrame, members: DataFrame) -> DataFrame:
    """Spaces whose owner is not an active member (Q-01)."""
    active = members.where("not revoked").select("space_id", F.col("subject_key").alias("owner_subject_key"))
    return spaces.join(active, ["space_id", "owner_subject_key"], "left_anti")


def strangers_in_private(spaces: DataFrame, members: DataFrame) -> DataFrame:
    """Active members of a private space other than its owner (Q-02)."""
    m = members.where("not revoked").join(spaces.where("private").select("space_id", "owner_subject_key"), "space_id")
    return m.where("subject_key <> owner_subject_key").select("space_id", "subject_key")


def active_version_broken(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents whose active version is missing or not published (Q-03)."""
    ok = versions.where("publication = 'published'").select("document_id", F.col("revision").alias("active_version"))
    return docs.where("active_version is not null").join(ok, ["document_id", "active_version"], "left_anti")


def changed_rows(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of an immutable snapshot that changed or vanished (Q-04, Q-09)."""
    digest = lambda df, name: df.select(*key, F.xxhash64(*columns).alias(name))
    return digest(old, "a").join(digest(new, "b"), key, "left").where("b is null or a <> b").select(*key)


def duplicates(df: DataFrame, key: list[str], where: Column | None = None) -> DataFrame:
    """Keys that several rows share, under a condition (Q-06, Q-10)."""
    df = df if where is None else df.where(where)
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def bad_values(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) where a rule does not hold; an unknown outcome passes, as in SQL checks (Q-07, Q-08, Q-12)."""
    broken = F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def scope_inconsistent(scopes: DataFrame) -> DataFrame:
    """Denied scopes with a range, or members that are not the union of the labels (Q-13)."""
    union = F.array_sort(F.array_distinct(F.concat("private_spaces", "other_teams", F.when(F.col("current_team").isNotNull(), F.array("current_team")).otherwise(F.array().cast("array<string>")))))
    denied = F.col("reason").isNotNull() & (F.size(union) > 0)
    return scopes.where(denied | (F.col("reason").isNull() & (F.array_sort("members") != union)))


def revision_jumps(old: DataFrame, new: DataFrame, key: str, revision: str) -> DataFrame:
    """Updated rows whose revision did not rise by one (Q-14)."""
    j = old.select(key, F.col(revision).alias("a"), F.col("content").alias("x")).join(new.select(key, F.col(revision).alias("b"), F.col("content").alias("y")), key)
    return j.where("not (x <=> y) and b <> a + 1").select(key)


def has_parent(child: DataFrame, parent: DataFrame, key: list[str], name: str) -> DataFrame:
    """`child` with a flag column that is true where the parent exists (Q-15, Q-03, Q-05)."""
    p = parent.select(*key).distinct().withColumn(name, F.lit(True))
    return child.join(p, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def is_unique(df: DataFrame, key: list[str], name: str, where: Column | None = None) -> DataFrame:
    """`df` with a flag column that is true where no other row under the condition has the key (Q-06, Q-10).

    Counts come from an aggregate and join back, so that a key of very many rows is no window of one task."""
    counted = df if where is None else df.where(where)
    n = counted.groupBy(*key).agg((F.count("*") == 1).alias(name))
    flag = F.coalesce(name, F.lit(True)) if where is None else F.when(where, F.coalesce(name, F.lit(True))).otherwise(True)
    return df.join(n, key, "left").withColumn(name, flag)


def write_snapshot(df: DataFrame, rules: dict[str, Column], path: str, columns: list[str] | None = None) -> dict[str, int]:
    """Writes a snapshot and returns how many of its rows break each rule, and `rows` (Q-01 to Q-15).

    The counts are metrics of the write itself, so a table is read once for all of its rules; a rule whose outcome
    is unknown passes, as in SQL checks. Rules that ask other rows or tables use flag columns (`has_parent`,
    `is_unique`). columns: what is stored, all by default.
    """
    seen = Observation()
    counts = [F.count("*").alias("rows"), *[F.count(F.when(~rule, 1)).alias(name) for name, rule in rules.items()]]
    df.observe(seen, *counts).select(*(columns or df.columns)).write.mode("overwrite").parquet(path)
    return dict(seen.get)
