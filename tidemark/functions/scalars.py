"""Scalar column functions: identifiers, instants, digests, snippets, conversation ids and validators.

Every function takes column names or columns and returns a column; all stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.vectors import let

#: Prefixes that a status value may carry; fixed values.
STATUS_PREFIXES = ("content_format_", "lifecycle_status_", "publication_status_")
#: The name space of derived ledger ids, as hex; a fixed value.
LEDGER_NAMESPACE = "71712d7365617263682d6c6564676572"
SNIPPET = 240
#: White space, as `\\s` has it.
SPACES = " \t\n\x0b\f\r"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_uuid(x) -> Column:
    """Lower-case dashed form of 36 dashed or 32 bare hex digits; null if neither (S-01)."""
    v = F.lower(F.trim(c(x)))
    bare = F.regexp_replace(v, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), bare)


def truncate(x, n: int) -> Column:
    """The first n characters (S-02)."""
    return F.substring(c(x), 1, n)


def status(x, fallback: str, prefix: str | None = None) -> Column:
    """Lower-cased status without its enum prefix and any `_status`; blank or unspecified falls back (S-03)."""
    v = F.lower(F.trim(c(x)))
    for p in [f"{prefix}_"] if prefix else STATUS_PREFIXES:
        v = F.regexp_replace(v, f"^{p}", "")
    v = F.replace(v, F.lit("_status"), F.lit(""))
    return F.when(v.isNull() | v.isin("", "unspecified"), F.lit(fallback)).otherwise(v)


def instant(x) -> Column:
    """An RFC 3339 or `yyyy-MM-dd HH:mm:ss[.f]+hh` instant; null if blank or unreadable (S-04)."""
    v = F.trim(c(x))
    shaped = F.when(v.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), v).when(v.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,6})?[+-]\d\d$"), F.concat(v, F.lit(":00")))
    return F.try_to_timestamp(shaped)


def instant_problem(x) -> Column:
    """`bad_instant` where a value is given but unreadable, else null (S-05)."""
    return F.when((F.trim(c(x)) != "") & instant(x).isNull(), F.lit("bad_instant"))


def content_digest(given, content) -> Column:
    """A well-formed given SHA-256, else that of the content (S-06)."""
    v = F.lower(F.trim(c(given)))
    return F.when(v.rlike("^[0-9a-f]{64}$"), v).otherwise(F.sha2(F.coalesce(c(content), F.lit("")), 256))


def digest_agrees(given, content) -> Column:
    """Whether a supplied digest is that of the content (S-07)."""
    return F.sha2(c(content), 256) == F.lower(F.trim(c(given)))


def one_line(x) -> Column:
    """White space folded to single spaces (S-08)."""
    return F.trim(F.regexp_replace(c(x), r"\s+", " "))


def summary(x, n: int = 100) -> Column:
    """The first n characters of the trimmed content (S-09)."""
    return F.substring(F.regexp_replace(c(x), r"^\s+|\s+$", ""), 1, n)


def snippet(summary_, content, query, n: int = SNIPPET) -> Column:
    """n characters around the first match of the query, else of its first word of two characters or
    more that occurs, else the head; content falls back to summary (S-10).

    The stripped text, its lower case and the place of the match are each computed once for a row."""
    strip = lambda x: F.btrim(F.coalesce(c(x), F.lit("")), F.lit(SPACES))
    body = let(strip(content), lambda s: F.when(s != "", s).otherwise(strip(summary_)))
    texts = let(F.struct(body.alias("body"), F.lower(strip(query)).alias("need")), lambda t: F.struct(t["body"], F.lower(t["body"]).alias("low"), t["need"]))
    return let(texts, lambda t: _around(t["body"], t["low"], t["need"], n))


def _around(body: Column, low: Column, need: Column, n: int) -> Column:
    find = lambda x: F.when(x != "", F.position(x, low)).otherwise(0)
    words = lambda: F.filter(F.transform(F.split(need, r"\s+"), lambda w: F.when(F.char_length(w) >= 2, find(w)).otherwise(0)), lambda k: k > 0)
    at = let(find(need), lambda k: F.when(k > 0, k).otherwise(F.coalesce(F.get(words(), F.lit(0)), F.lit(0))))

    def cut(p):
        start = F.greatest(p["at"] - 1 - n // 3, F.lit(0))
        around = F.concat(F.when(start > 0, "…").otherwise(""), one_line(F.substring(body, start + 1, F.lit(n))), F.when(start + n < p["size"], "…").otherwise(""))
        head = F.concat(one_line(F.substring(body, 1, n)), F.when(p["size"] > n, "…").otherwise(""))
        return F.when((p["at"] > 0) & (F.char_length(low) == p["size"]), around).otherwise(head)

    return F.when(body == "", F.lit("")).otherwise(let(F.struct(at.alias("at"), F.char_length(body).alias("size")), cut))


def trigrams(x) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(c(x)), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a, b) -> Column:
    """Shared share of trigrams, 0 if there are none (S-11)."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def conversation_kind(group) -> Column:
    return F.when(F.coalesce(c(group), F.lit("")) != "", "group").otherwise("private")


def conversation_id(bot, user, group) -> Column:
    """`qq:<bot>:group:<group>` or `qq:<bot>:private:<user>` (S-12)."""
    return F.concat_ws(":", F.lit("qq"), c(bot), conversation_kind(group), F.when(conversation_kind(group) == "group", c(group)).otherwise(c(user)))


def conversation_problem(conversation, kind, bot, user, group) -> Column:
    """Why a conversation id disagrees with its redundant fields; null if it agrees (S-13)."""
    p = F.split(c(conversation), ":")
    g, u = F.coalesce(c(group), F.lit("")), F.coalesce(c(user), F.lit(""))
    part = lambda k: F.get(p, F.lit(k))
    return (
        F.when(F.coalesce((F.size(p) != 4) | (part(0) != "qq") | (part(2) != c(kind)) | (F.trim(part(3)) == ""), F.lit(True)), "shape")
        .when(part(1) != c(bot), "bot_mismatch")
        .when((c(kind) == "group") & (g == ""), "group_missing")
        .when((c(kind) == "group") & (g != part(3)), "group_mismatch")
        .when((c(kind) == "private") & (g != ""), "group_unexpected")
        .when((c(kind) == "private") & (u != "") & (u != part(3)), "user_mismatch")
    )


def _uuid_layout(hex64: Column) -> Column:
    """The first 16 bytes of a digest in name-based (version 5) UUID layout."""
    ninth = F.lower(F.conv(F.conv(F.substring(hex64, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat(F.substring(hex64, 1, 8), F.lit("-"), F.substring(hex64, 9, 4), F.lit("-5"), F.substring(hex64, 14, 3), F.lit("-"), ninth, F.substring(hex64, 18, 3), F.lit("-"), F.substring(hex64, 21, 12))


def ledger_event_id(x) -> Column:
    """UUID-shaped key of a producer's opaque event id (S-14)."""
    return _uuid_layout(F.sha2(F.concat(F.unhex(F.lit(LEDGER_NAMESPACE)), F.encode(c(x), "UTF-8")), 256))


def derived_event_id(conversation, what: str, record) -> Column:
    """SHA-256 of `conversation:what:record` (S-15)."""
    return F.sha2(F.concat_ws(":", c(conversation), F.lit(what), c(record)), 256)


def chunk_point_id(document, index) -> Column:
    """UUID-shaped id of a document's chunk (S-16)."""
    return _uuid_layout(F.sha2(F.concat(c(document), F.lit("#"), c(index).cast("string")), 256))


def _sized(x) -> Column:
    v = F.coalesce(c(x).cast("string"), F.lit(""))
    return F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)


def storage_key(*parts) -> Column:
    """Parts with their byte lengths, so that no two different tuples share a key (S-17)."""
    return F.concat(*[_sized(p) for p in parts])


def payload_fingerprint(*fields, public) -> Column:
    """SHA-256 over length-prefixed fields, the last of which says whether the nullable flag `public` is absent,
    true or false (S-18); a null field counts as empty."""
    flag = F.concat(F.lit("authenticated_public:"), F.coalesce(c(public).cast("string"), F.lit("absent")))
    return F.sha2(F.concat(*[_sized(F.coalesce(c(f), F.lit(""))) for f in fields], _sized(flag)), 256)


def operation_fingerprint(*fields: str) -> Column:
    """SHA-256 of the operation's JSON (S-19)."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def subject_problem(x) -> Column:
    """Why a subject key is malformed; null if it is fine (S-20)."""
    key = F.trim(c(x))
    p = F.split(key, ":", 3)
    part = lambda k: F.get(p, F.lit(k))
    local = F.trim(part(2))
    bot, user = F.trim(F.regexp_extract(local, "^([^/]*)/", 1)), F.trim(F.regexp_extract(local, "^[^/]*/(.*)$", 1))
    return (
        F.when(key.isNull() | (key == ""), "blank")
        .when(F.octet_length(key) > 192, "too_long")
        .when(F.size(p) != 3, "shape")
        .when(~part(0).isin("web", "qq"), "origin")
        .when(~part(1).isin("user", "group"), "type")
        .when(local == "", "local_id")
        .when((part(0) == "qq") & (part(1) == "user") & ((bot == "") | (user == "")), "bot")
    )


def chunk_label(document, version, number) -> Column:
    """`document@version#NNN` (S-21)."""
    return F.format_string("%s@%s#%03d", c(document), c(version), c(number).cast("int"))


def metadata_problem(m, entries: int = 8, key_bytes: int = 32, value_bytes: int = 64, total: int = 64) -> Column:
    """Which bound a metadata map breaks; null if none (S-23)."""
    keys, values = F.map_keys(c(m)), F.map_values(c(m))
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.octet_length(x))
    return (
        F.when(F.size(keys) > entries, "entries")
        .when(F.exists(keys, lambda k: F.octet_length(k) > key_bytes), "key_bytes")
        .when(F.exists(values, lambda v: F.octet_length(v) > value_bytes), "value_bytes")
        .when(size(keys) + size(values) > total, "total_bytes")
    )


def identifier_problem(x, most: int = 64) -> Column:
    """Shape of an external id: not blank, bounded, without white space or control characters (S-27)."""
    v = F.trim(c(x))
    return F.when(v.isNull() | (v == ""), "blank").when(F.octet_length(v) > most, "too_long").when(v.rlike(r"[\s\p{Cntrl}]"), "character")


def title_problem(x, most: int = 255) -> Column:
    v = F.trim(c(x))
    return F.when(v.isNull() | (v == ""), "blank").when(F.char_length(v) > most, "too_long")


def role(x) -> Column:
    """Blank is member; null for an unknown role (S-27)."""
    v = F.lower(F.trim(c(x)))
    return F.when(v == "", "member").when(v.isin("owner", "admin", "member"), v)


def content_format(x) -> Column:
    """Blank is markdown; null for an unknown format (S-27)."""
    v = F.lower(F.trim(c(x)))
    return F.when(v == "", "markdown").when(v.isin("markdown", "doc", "docx"), v)


def event_problem(kind, document, event, sequence, version, owner_space) -> Column:
    """Why a change event is rejected, in order of the checks; null if it is accepted (S-28)."""
    k = F.lower(F.trim(c(kind)))
    blank = lambda x: F.coalesce(F.trim(c(x)) == "", F.lit(True))
    needs = k == "upsert"
    return (
        F.when(~F.coalesce(k, F.lit("")).isin("upsert", "delete"), "kind")
        .when(blank(document), "document_id")
        .when(blank(event), "event_id")
        .when(F.coalesce(c(sequence) <= 0, F.lit(True)), "sequence")
        .when(needs & blank(version), "version_id")
        .when(needs & blank(owner_space), "owner_space_id")
    )


def index_profile(request, configured) -> Column:
    """The requested profile, else the configured, else `markdown-v1` (S-29)."""
    return F.coalesce(F.nullif(F.trim(c(request)), F.lit("")), F.nullif(F.trim(c(configured)), F.lit("")), F.lit("markdown-v1"))


def user_number(x) -> Column:
    """The number in a `web:user:<n>` key; null for others (S-30)."""
    return F.nullif(F.regexp_extract(c(x), r"^web:user:(\d{1,18})$", 1), F.lit("")).cast("bigint")


def escape_like(x) -> Column:
    r"""`\`, `%` and `_` escaped for a LIKE pattern (F-17)."""
    v = c(x)
    for ch in ("\\", "%", "_"):
        v = F.replace(v, F.lit(ch), F.lit("\\" + ch))
    return v


def canonical_ids(x, lower: bool = True) -> Column:
    """Trimmed, lower-cased, without blanks, distinct and sorted (U-01)."""
    ids = F.transform(F.coalesce(c(x), F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)) if lower else F.trim(v))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda v: v != "")))


def contains_all(granted, requested) -> Column:
    """Whether every requested id is granted (F-05, U-02)."""
    return F.size(F.array_except(c(requested), c(granted))) == 0
