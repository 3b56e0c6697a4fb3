"""Chat history and reliable delivery: fan-out, pending, history, backlog, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import trigram_similarity
from tidemark.functions.vectors import tokens
from tidemark.operators.retrieval import bm25_scores, cover_rank, dense_best, fuse_by, parse_query, text_match, top


def fan_out(messages: DataFrame, members: DataFrame) -> DataFrame:
    """One delivery for each message and member of its group, if the sender is a member (J-16).

    messages: message_id, to_id, from_id, created_at; members: group_id, member_id.
    """
    sender = members.select(F.col("group_id").alias("to_id"), F.col("member_id").alias("from_id"))
    sent = messages.join(sender, ["to_id", "from_id"], "left_semi")
    return sent.join(members.withColumnRenamed("group_id", "to_id"), "to_id").select("to_id", "message_id", "created_at", F.col("member_id").alias("recipient_id"))


def pending(deliveries: DataFrame, acks: DataFrame, key: list[str]) -> DataFrame:
    """Deliveries without an acknowledgement (E-18)."""
    return deliveries.join(acks, key, "left_anti")


def _cursor(columns, values) -> Column:
    """A keyset cursor; whole numbers are 64 bits wide, as keys are."""
    return F.struct(*[(F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v)).alias(c) for c, v in zip(columns, values, strict=True)])


def after(*columns: str, cursor: tuple) -> Column:
    """Rows behind a keyset cursor in ascending order (K-12)."""
    return F.struct(*columns) > _cursor(columns, cursor)


def before(*columns: str, cursor: tuple) -> Column:
    """Rows behind a keyset cursor in descending order (K-11)."""
    return F.struct(*columns) < _cursor(columns, cursor)


def history(messages: DataFrame, newest: int, by: str = "to_id") -> DataFrame:
    """The newest n of each group, with their place oldest first (K-09)."""
    w = Window.partitionBy(by)
    kept = messages.withColumn("_n", F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("message_id")))).where(F.col("_n") <= newest).drop("_n")
    return kept.withColumn("place", F.row_number().over(w.orderBy("created_at", "message_id")))


def backlog(messages: DataFrame, since: int, oldest: int, by: str = "to_id") -> DataFrame:
    """The oldest n of each group since a time (K-10)."""
    w = Window.partitionBy(by).orderBy("created_at", "message_id")
    return messages.where(F.col("created_at") >= since).withColumn("place", F.row_number().over(w)).where(F.col("place") <= oldest)


def bucket_counts(messages: DataFrame, seconds: int) -> DataFrame:
    """Messages for each group, type and tumbling bucket of time (A-14)."""
    b = (F.floor(F.col("created_at") / seconds) * seconds).alias("bucket")
    return messages.groupBy(b, "to_id", "group_type").agg(F.count("*").alias("n"))


def controls(messages: DataFrame, conversations: DataFrame, pending_deletes: DataFrame) -> DataFrame:
    """Access controls of messages, and dead ones for pending deletes that are not live any more (F-21)."""
    live = messages.join(conversations, "to_id").select("storage_id", "archived", "retracted", F.lit(False).alias("dead"))
    gone = pending_deletes.join(live, "storage_id", "left_anti").select("storage_id", F.lit(False).alias("archived"), F.lit(False).alias("retracted"), F.lit(True).alias("dead"))
    return live.unionByName(gone)


def visible(control: DataFrame) -> DataFrame:
    """(storage_id) of messages that may be found: archived, neither retracted nor dead (F-20)."""
    return control.where("archived and not retracted and not dead").select("storage_id").distinct()


#: Candidates of a search of k hits: at first, and at most by k and in all (K-15).
FIRST, MOST, RECALL = (2, 16), (16, 128), 800


def candidate_limits(k) -> Column:
    """The candidate limits that a search of k hits goes through: twice k, 16 at least, doubled up to 16 times k,
    128 at least and 800 at most."""
    k = F.col(k) if isinstance(k, str) else k
    first, most = F.greatest(k * FIRST[0], F.lit(FIRST[1])), F.least(F.greatest(k * MOST[0], F.lit(MOST[1])), F.lit(RECALL))
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(most / first)).cast("int"))
    return F.array_distinct(F.transform(doublings, lambda i: F.least(first * F.pow(F.lit(2), i), most).cast("int")))


def widened(ranked: DataFrame, queries: DataFrame, key: str = "storage_id") -> DataFrame:
    """Pages of fused searches whose candidates are allowed or not, each query by its own candidate limit (K-15).

    With a limit, each arm gives as many of its best, they are fused, and as many of the fused are
    candidates; of the allowed ones the first k are the page. A query takes the least of its
    `candidate_limits` that fills its page or exhausts the candidates, else the last. All limits of a query
    are tried together over its ranked rows (800 an arm at most), so no search is run twice.

    ranked: query_id, k, arm, key, rank, score, may (whether it is allowed); queries: query_id, k. Gives for each
    hit query_id, key, rank, fused, each arm's rank and score, `candidates` (the limit) and `truncated`: the
    page is not full although candidates were left. A query without hits has one row with null key and rank.
    """
    tried = F.explode(F.filter(candidate_limits("k"), lambda x: x >= F.col("rank"))).alias("candidates")
    rows = ranked.select("query_id", "k", "arm", key, "rank", "score", "may", tried)
    arms = ("sparse", "dense")
    one = Window.partitionBy("query_id", "candidates")
    fused = fuse_by(rows, ["query_id", "candidates", "k", key, "may"], arms)
    c = fused.withColumn("place", F.row_number().over(one.orderBy(F.desc("fused"), key))).where(F.col("place") <= F.col("candidates"))
    c = c.select("*", F.count("*").over(one).alias("n"), F.count(F.when(F.col("may"), 1)).over(one).alias("n_may"), F.element_at(candidate_limits("k"), -1).alias("most"))
    full, exhausted = F.col("n_may") >= F.col("k"), F.col("n") < F.col("candidates")
    done = F.when(full | exhausted | (F.col("candidates") == F.col("most")), F.col("candidates"))
    c = c.withColumn("chosen", F.min(done).over(Window.partitionBy("query_id"))).where(F.col("candidates") == F.col("chosen"))
    c = c.withColumn("rank", F.row_number().over(one.orderBy(F.desc("may"), "place")))
    told = [key, "rank", "fused", *[f"{a}_{x}" for a in arms for x in ("rank", "score")]]
    hits = c.where((F.col("may") & (F.col("rank") <= F.col("k"))) | ((F.col("n_may") == 0) & (F.col("rank") == 1)))
    hits = hits.select("query_id", "candidates", (~full & ~exhausted).alias("truncated"), *[F.when(F.col("may"), F.col(x)).alias(x) for x in told])
    asked = queries.select("query_id", F.get(candidate_limits("k"), F.lit(0)).alias("_first"))
    out = asked.join(hits, "query_id", "left")
    return out.withColumn("candidates", F.coalesce("candidates", "_first")).withColumn("truncated", F.coalesce("truncated", F.lit(False))).drop("_first")


def search_chat(chunks: DataFrame, control: DataFrame, queries: DataFrame, allowed: Column) -> DataFrame:
    """The k best messages of each query by keyword and vector ranks fused (T-22, T-19), as `widened` gives them.

    Both arms recall visible chunks only (F-20), and the best of each message counts (one hit a message). The
    rule of time and scope (F-10), which may use columns of queries and messages, comes after the
    fusion; a query whose page it leaves open takes more candidates (K-15, see `widened`).
    chunks: chunk_id, storage_id, text, vector (null: in no vector arm) and the messages' columns of `allowed`;
    queries: query_id, text, vector, k (1 to 100) and columns of `allowed`.
    """
    may = chunks.join(visible(control), "storage_id", "left_semi")
    owner = may.select("chunk_id", "storage_id")
    def arm(name: str, rows: DataFrame) -> DataFrame:
        best = rows.groupBy("query_id", "storage_id").agg(F.max("score").alias("score"))
        return top(best, RECALL, F.desc("score"), "storage_id").withColumn("arm", F.lit(name))

    # queries of one text share its keyword arm, which is computed once
    texts = queries.groupBy("text").agg(F.min("query_id").alias("first"))
    sparse = arm("sparse", bm25_scores(chunks.select("chunk_id", "text"), texts.select(F.col("first").alias("query_id"), "text")).join(owner, "chunk_id"))
    shared = queries.select("query_id", "text").join(texts, "text").select("query_id", "first")
    sparse = sparse.withColumnRenamed("query_id", "first").join(shared, "first").drop("first")
    points = may.where("vector is not null").select(F.struct("chunk_id", "storage_id").alias("chunk_id"), "vector")
    near = dense_best(points, queries.select("query_id", "vector"), RECALL, ["storage_id"])
    dense = arm("dense", near.select("query_id", "chunk_id.storage_id", "score"))
    ranked = sparse.unionByName(dense)
    messages = chunks.drop("chunk_id", "text", "vector").distinct()
    ruled = ranked.join(queries.drop("text", "vector"), "query_id").join(messages, "storage_id").withColumn("may", F.coalesce(allowed, F.lit(False)))
    return widened(ruled, queries.select("query_id", "k"))


def _ranked(rows: DataFrame, score: Column, at: str, ident: str, limit: int) -> DataFrame:
    """The first rows by score, then `at` with nulls last, then `ident`, and whether one more follows
    (K-07, K-08, W-09)."""
    order = [F.desc("score"), F.desc_nulls_last(at), ident]
    probe = rows.withColumn("score", score).orderBy(*order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # limit + 1 rows
    return probe.withColumn("rank", place).withColumn("more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("rank") <= limit)


#: Weight of a word in a text without fields.
PLAIN = 0.1


def _plain(text: str) -> Column:
    return F.transform(tokens(text), lambda x, i: F.struct(x.alias("term"), (i + 1).alias("pos"), F.lit(PLAIN).alias("weight")))


def _words(query: str) -> list[str]:
    return sorted({t for g in parse_query(query) for t in [*g["terms"], *(x for p in g["phrases"] for x in p)]})


def search_channel_messages(messages: DataFrame, query: str, scope: Column, limit: int) -> DataFrame:
    """Messages of a channel scope that match, by cover rank, newest first among equals (T-23).

    messages: record_id, text, sent_at and the columns of the scope; adds score, rank and more."""
    found = messages.where(scope).where(text_match(tokens("text"), query))
    return _ranked(found, F.round(cover_rank(_plain("text"), _words(query) or [""]), 6), "sent_at", "record_id", limit)


def search_channel_files(files: DataFrame, query: str, scope: Column, limit: int) -> DataFrame:
    """Files of a channel scope whose name and type match, or whose name holds the query (F-18); the score is
    the greater of the cover rank of name and type and the name's trigram similarity (T-05), the latest upload
    first among equals (K-08, T-24). files: record_id, file_name, mime, uploaded_at and scope columns."""
    rows = files.where(scope).withColumn("_both", F.concat_ws(" ", F.coalesce("file_name", F.lit("")), F.coalesce("mime", F.lit(""))))
    name = F.coalesce("file_name", F.lit(""))
    found = rows.where(text_match(tokens("_both"), query) | F.contains(F.lower(name), F.lit(query.lower())))
    score = F.greatest(cover_rank(_plain("_both"), _words(query) or [""]), trigram_similarity(name, F.lit(query)))
    return _ranked(found, F.round(score, 6), "uploaded_at", "record_id", limit).drop("_both")


def authorised(start, end, scopes) -> Column:
    """Messages inside inclusive time bounds (0: open) and a conversation scope (F-10); bounds and scopes are
    columns, or numbers."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return ((start == 0) | (F.col("created_at") >= start)) & ((end == 0) | (F.col("created_at") <= end)) & F.array_contains(scopes, F.col("to_id"))
