"""Access scope: who may read what, as filters over an index and as set algebra over grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import contains_all


def live() -> Column:
    """Active and published (F-01)."""
    return (F.col("lifecycle") == "active") & (F.col("publication") == "published")


def in_scope(spaces, documents=None, public=False) -> Column:
    """Public floor, or a named document, or the owner space, or any allowed space (F-02)."""
    spaces, documents = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.array(*[F.lit(v) for v in (x or [])]).cast("array<string>") for x in (spaces, documents))
    public = F.col(public) if isinstance(public, str) else F.lit(public) if isinstance(public, bool) else public
    return (public & F.col("is_public")) | F.array_contains(documents, F.col("document_id").cast("string")) | F.array_contains(spaces, F.col("owner_space_id")) | F.arrays_overlap("allowed", spaces)


def owned_by(key) -> Column:
    """Owner restriction; a blank key is none (F-03)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.coalesce(F.trim(key), F.lit("")) == "", F.lit(True)).otherwise(F.col("owner_subject_key") == key)


def effective_scope(requested, granted) -> tuple[Column, Column]:
    """(ids, public floor): a named range replaces the grant and drops the floor (F-04)."""
    named = F.size(requested) > 0
    return F.when(named, requested).otherwise(granted), ~named


def granted_spaces(*families) -> Column:
    """The union of a capability's space families (F-06)."""
    return F.array_distinct(F.concat(*families))


def in_channel(columns: dict[str, str]) -> Column:
    """Each non-empty family restricts its column; a scope with no family sees nothing (F-11)."""
    any_family = F.lit(False)
    ok = F.lit(True)
    for column, family in columns.items():
        used = F.size(family) > 0
        any_family = any_family | used
        ok = ok & F.when(used, F.array_contains(family, F.col(column))).otherwise(True)
    return any_family & ok


def narrow(granted: Column, requested: Column) -> Column:
    """The requested family if it lies in the grant, null if it would widen it, else the grant (F-12)."""
    return F.when(F.size(requested) == 0, granted).when((F.size(granted) == 0) | contains_all(granted, requested), requested)


def readable_by(asked: DataFrame, docs: DataFrame, grants: DataFrame, members: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_key, document_id) of what each asked subject may read (F-15): the subjects drive the joins, from
    their spaces to the documents, so that nobody else's pairs are made. asked: subject_key."""
    who = asked.select("subject_key").distinct()
    given = grants.where("not revoked")
    spaces = members.where("not revoked").select("space_id", "subject_key").join(who, "subject_key", "left_semi").distinct()
    seen = who.join(subjects.where("active").select("subject_key"), "subject_key", "left_semi")
    ways = [
        docs.select(F.col("owner_subject_key").alias("subject_key"), "document_id").join(who, "subject_key", "left_semi"),
        given.select(F.col("grantee_subject_key").alias("subject_key"), "document_id").join(who, "subject_key", "left_semi"),
        spaces.join(given.select(F.col("grantee_space_id").alias("space_id"), "document_id"), "space_id").select("subject_key", "document_id"),
        spaces.join(docs.select(F.col("owner_space_id").alias("space_id"), "document_id"), "space_id").select("subject_key", "document_id"),
        seen.crossJoin(docs.where("is_public").select("document_id")),  # the answer itself: all public documents for each asked subject
    ]
    out = ways[0]
    for w in ways[1:]:
        out = out.unionByName(w)
    return out.distinct()


def readable_counts(docs: DataFrame, grants: DataFrame, members: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_key, n, first, last): how many documents each subject may read, and the least and greatest
    (F-14), for all subjects without making their pairs.

    Subjects with the same spaces read the same documents through them, and documents of the same spaces are read
    by the same subjects, so sets of spaces of both sides meet, not subjects and documents; public documents are counted once for all active subjects; only documents that a subject
    owns or was granted in person are pairs, and of those the ones already counted are left out.
    """
    grants = grants.where("not revoked")
    m = members.where("not revoked").select("space_id", "subject_key").distinct()
    flags = docs.select("document_id", "is_public")
    by_space = docs.select("document_id", F.col("owner_space_id").alias("space_id")).unionByName(grants.where("grantee_space_id is not null").select("document_id", F.col("grantee_space_id").alias("space_id"))).distinct()
    by_space = by_space.where("space_id is not null").join(flags, "document_id", "left").withColumn("is_public", F.coalesce("is_public", F.lit(False)))
    own = m.groupBy("subject_key").agg(F.array_sort(F.collect_set("space_id")).alias("spaces"))
    personal = docs.select("document_id", F.col("owner_subject_key").alias("subject_key")).unionByName(grants.where("grantee_subject_key is not null").select("document_id", F.col("grantee_subject_key").alias("subject_key"))).distinct()
    active = subjects.where("active").select("subject_key").distinct().withColumn("active", F.lit(True))
    who = own.select("subject_key").unionByName(personal.select("subject_key")).unionByName(active.select("subject_key")).distinct()
    who = who.join(own, "subject_key", "left").join(active, "subject_key", "left").na.fill(False, ["active"])
    measure = [F.count("*").alias("n"), F.min("document_id").alias("first"), F.max("document_id").alias("last")]
    left = ~(F.col("active") & F.col("is_public"))
    kinds = who.where("spaces is not null").select("spaces", "active").distinct()
    held = by_space.groupBy("document_id", "is_public").agg(F.array_sort(F.collect_set("space_id")).alias("held")).groupBy("held", "is_public").agg(*measure)
    met = kinds.withColumn("space_id", F.explode("spaces")).join(held.withColumn("space_id", F.explode("held")), "space_id").where(left).drop("space_id").distinct()
    in_sets = met.groupBy("spaces", "active").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    counted = personal.join(m, "subject_key").join(by_space.select("document_id", "space_id"), ["document_id", "space_id"], "left_semi").select("document_id", "subject_key")
    alone = personal.join(counted, ["document_id", "subject_key"], "left_anti").join(who.select("subject_key", "active"), "subject_key").join(flags, "document_id", "left").withColumn("is_public", F.coalesce("is_public", F.lit(False)))
    alone = alone.where(left).groupBy("subject_key").agg(*measure)
    public = docs.where("is_public").agg(*measure).where("n > 0")
    rows = who.where("spaces is not null").join(in_sets, ["spaces", "active"]).select("subject_key", "n", "first", "last")
    rows = rows.unionByName(alone).unionByName(active.select("subject_key").crossJoin(public))  # public is one row
    return rows.groupBy("subject_key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def access_facts(pairs: DataFrame, docs: DataFrame, grants: DataFrame, members: DataFrame, subjects: DataFrame) -> DataFrame:
    """The facts of the read decision as columns for given (document_id, subject_key) pairs, and
    `may_read` (F-16); one row a pair of an existing document.

    The asked pairs drive both hops (J-03): a pair meets its own document's grants only, and the spaces that
    come of them, with the owner's, are looked up as (space, subject), which no space of many members skews.
    """
    asked = pairs.select("document_id", "subject_key").distinct()
    p = asked.join(docs.select("document_id", "owner_subject_key", "owner_space_id", "is_public"), "document_id")
    given = grants.where("not revoked").select("document_id", "grantee_subject_key", "grantee_space_id")
    by_grant = asked.join(given, "document_id")
    direct = by_grant.where(F.col("grantee_subject_key") == F.col("subject_key")).select("document_id", "subject_key").distinct().withColumn("has_grant", F.lit(True))
    ways = by_grant.where("grantee_space_id is not null").select("document_id", "subject_key", F.col("grantee_space_id").alias("space_id"), F.lit(False).alias("own"))
    ways = ways.unionByName(p.where("owner_space_id is not null").select("document_id", "subject_key", F.col("owner_space_id").alias("space_id"), F.lit(True).alias("own")))
    met = ways.join(members.where("not revoked").select("space_id", "subject_key"), ["space_id", "subject_key"], "left_semi")
    inside = met.groupBy("document_id", "subject_key").agg(F.max(~F.col("own")).alias("in_granted_space"), F.max("own").alias("in_owner_space"))
    f = p.join(direct, ["document_id", "subject_key"], "left").join(inside, ["document_id", "subject_key"], "left")
    f = f.join(subjects.select("subject_key", F.col("active").alias("is_active")), "subject_key", "left")
    no = F.lit(False)
    f = f.select("document_id", "subject_key", F.coalesce(F.col("owner_subject_key") == F.col("subject_key"), no).alias("is_owner"), *[F.coalesce(x, no).alias(x) for x in ("has_grant", "in_granted_space", "in_owner_space", "is_public", "is_active")])
    return f.withColumn("may_read", F.col("is_owner") | F.col("has_grant") | F.col("in_granted_space") | F.col("in_owner_space") | (F.col("is_public") & F.col("is_active")))


def resolve_scopes(requests: DataFrame) -> DataFrame:
    """Adds reason (null: granted), current_team, other_teams, private_spaces, documents (E-16).

    requests: subject_seen, subject_active, is_group, bot_id, group_seen, group_revoked,
    active_group_space, is_active_member, private_space_ids, team_space_ids, document_ids.
    """
    unbound = (F.coalesce(F.trim("bot_id"), F.lit("")) == "") | F.col("active_group_space").isNull()
    reason = (
        F.when(~F.col("subject_seen"), "subject_unknown")
        .when(~F.col("subject_active"), "subject_inactive")
        .when(F.col("is_group") & unbound & F.col("group_seen") & F.col("group_revoked"), "group_binding_revoked")
        .when(F.col("is_group") & unbound, "group_unbound")
        .when(F.col("is_group") & ~F.col("is_active_member"), "not_space_member")
    )
    r = requests.withColumn("reason", reason)
    ok, group = F.col("reason").isNull(), F.col("is_group")
    none = F.array().cast("array<string>")
    return (
        r.withColumn("current_team", F.when(ok & group, F.col("active_group_space")))
        .withColumn("other_teams", F.when(ok & group, F.array_sort(F.array_remove("team_space_ids", F.col("active_group_space")))).when(ok, F.array_sort("team_space_ids")).otherwise(none))
        .withColumn("private_spaces", F.when(ok, F.array_sort("private_space_ids")).otherwise(none))
        .withColumn("documents", F.when(ok, F.array_sort("document_ids")).otherwise(none))
    )


def narrow_capabilities(scopes: DataFrame, labels: tuple[str, ...], requested: str) -> DataFrame:
    """Keeps each label's ids that are requested (all if none are); `refused` if any is not granted (E-17)."""
    every = F.array_distinct(F.concat(*labels))
    named = F.size(requested) > 0
    out = scopes.withColumn("refused", named & ~contains_all(every, requested))
    for label in labels:
        out = out.withColumn(label, F.when(F.col("refused"), F.array().cast("array<string>")).when(named, F.array_intersect(label, requested)).otherwise(F.col(label)))
    return out
