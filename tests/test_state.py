"""Stored state: merged batches, the two-table sink, store-wide operation ids, the chat stream, term statistics."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus as C
from tidemark.operators import events as EV
from tidemark.sources.tables import BatchTable

EVENTS = "event_id string, sequence long, kind string, document_id long, aggregate_revision long, access_revision long, lifecycle_revision long, content string"


def event_rows(n=400, documents=25, seed=1):
    r = random.Random(seed)
    return [(f"e{i}", i + 1, r.choice(["upsert", "upsert", "upsert", "delete"]), r.randrange(documents), i // 20 + r.randrange(5), i // 40 + r.randrange(3), i // 80 + r.randrange(2), f"c{i}") for i in range(n)]


def folded(spark, rows):
    empty = spark.createDataFrame([], EV.STATE)
    return {tuple(r) for r in EV.resume_document_events(empty, spark.createDataFrame(rows, EVENTS)).collect()}


def files_of(table, parts):
    return {(v, b): sorted(os.listdir(table._folder(v, b))) for v, b in parts}


def test_merged_batches_equal_one_fold(spark, tmp_path):
    rows = event_rows()
    table = BatchTable(spark, str(tmp_path / "s"), EV.STATE, "document_id", buckets=7)
    assert table.current().count() == 0
    for k in range(5):
        part = spark.createDataFrame(rows[80 * k : 80 * k + 80], EVENTS)
        assert EV.merge_batch(table, k, part)
        assert not EV.merge_batch(table, k, part)  # the same batch again
    want = folded(spark, rows)
    assert {tuple(r) for r in table.current().collect()} == want
    assert {(r[0], r[1], r[5]) for r in want} == {(s, x, y) for s, x, y in ((r.document_id, r.live, r.dead) for r in table.current().collect())}
    state, tombs, _ = EV.apply_document_events(spark.createDataFrame(rows, EVENTS))
    assert {tuple(r) for r in state.collect()} == {(r[0], r[9], r[2], r[3], r[4]) for r in want if r[1]}
    assert {tuple(r) for r in tombs.collect()} == {(r[0], r[6], r[7], r[8]) for r in want if r[5]}
    assert EV.merge_batch(table, 9, spark.createDataFrame(rows[100:200], EVENTS))  # redelivered under another number
    assert {tuple(r) for r in table.current().collect()} == want
    assert table.sweep() > 0 and {tuple(r) for r in table.current().collect()} == want


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "s"), EV.STATE, "document_id", buckets=16)
    rows = event_rows()
    EV.merge_batch(table, 0, spark.createDataFrame(rows, EVENTS))
    before = files_of(table, table.parts())
    one = [r for r in rows if r[3] == 3][:1]
    touched = table.touched(spark.createDataFrame(one, EVENTS))
    EV.merge_batch(table, 1, spark.createDataFrame([("new", 9999, "upsert", 3, 99, 99, 99, "last")], EVENTS))
    after = files_of(table, table.parts())
    assert len(touched) == 1
    assert {p: f for p, f in after.items() if p[1] not in touched} == {p: f for p, f in before.items() if p[1] not in touched}
    assert [p[0] for p in after if p[1] in touched] == [1]
    assert table.current(touched).where("document_id = 3").first().content == "last"


def test_half_written_batch_does_not_count(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "s"), "k long, x string", "k", buckets=3)
    table.write(1, spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"))
    spark.createDataFrame([(1, "lost", 0)], "k long, x string, b int").write.partitionBy("b").parquet(table._folder(2))
    assert sorted(map(tuple, table.current().collect())) == sorted(map(tuple, table.all().collect())) == [(1, "a"), (2, "b")]
    rows = spark.createDataFrame([(1, "c")], "k long, x string")
    touched = table.touched(rows)
    assert table.write(2, rows, touched) and table.batches() == [1, 2]
    assert (1, "c") in set(map(tuple, table.current().collect())) and "lost" not in {r.x for r in table.all().collect()}
    every = list(range(3))
    table.write(3, rows.limit(0), every)  # all buckets become empty
    assert table.current().count() == 0 and table.all().count() == 3


def test_two_table_sink_survives_a_loss_between_its_writes(spark, tmp_path, monkeypatch):
    from tidemark.streaming import sink

    rows = event_rows(300)
    source = tmp_path / "in"
    for k in range(3):  # each file repeats some events of the one before
        spark.createDataFrame(rows[max(0, 100 * k - 10) : 100 * k + 100], EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    log = BatchTable(spark, str(tmp_path / "log"), EVENTS, "event_id", 5)
    state = BatchTable(spark, str(tmp_path / "state"), EV.STATE, "document_id", 5)
    chunks = BatchTable(spark, str(tmp_path / "chunks"), "document_id long, chunk long", "document_id", 5)
    chunks.write(0, spark.range(25).select(F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("chunk")))
    put, lost, real = sink.log_and_state(log, state, chunks), [], sink.merge_batch

    def fails_once(table, batch, events):
        if batch == 2 and not lost:
            lost.append(batch)
            raise RuntimeError("lost between the two writes")
        return real(table, batch, events)

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
        sink.run_to_tables(stream, lambda events, n: put(events, n + 1), str(tmp_path / "cp"))  # batch 0 of the chunks was written above

    monkeypatch.setattr(sink, "merge_batch", fails_once)
    with pytest.raises(Exception, match="lost between"):
        run()
    assert log.batches() == [1, 2] and state.batches() == [1]
    run()
    assert lost == [2] and log.batches() == state.batches() == [1, 2, 3]
    assert sorted(r.event_id for r in log.all().collect()) == sorted(r[0] for r in rows)
    last = {r[0]: r for r in map(tuple, state.current().collect())}
    held = [log.all(v + 1).select("event_id").collect() for v in (1, 2, 3)]
    by_id = {r[0]: r for r in rows}
    steps = [{r[0]: r for r in folded(spark, [by_id[x.event_id] for x in ids])} for ids in held]
    assert last == steps[-1]
    dead = {d for step in steps for d, r in step.items() if r[5]}
    assert dead and {r.document_id for r in chunks.current().collect()} == set(range(25)) - dead


# ---- operation ids of the whole store


def by_one_ledger(rows, make, columns):
    """Outcomes of commands, one after the other over all keys, with one ledger."""
    ledger, keyed, out = {}, {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        c = dict(zip(columns, row))
        key, op = c[columns[0]], c["operation_id"]
        said = tuple(str(v) for k, v in c.items() if k not in ("seq", "operation_id"))
        if op in ledger:
            first, outcome = ledger[op]
            out[key, c["seq"]] = f"replayed_{outcome}" if first == said else "conflict"
            continue
        outcome = getattr(keyed.setdefault(key, make()), c["kind"])(c)
        if not outcome.startswith(("stale", "conflict", "not_found", "invalid")):
            ledger[op] = said, outcome
        out[key, c["seq"]] = outcome
    return out


COMMANDS = "document_id long, seq long, operation_id string, kind string, version_id string, owner_space string, digest string, lifecycle long, revision long, expected_version string, is_public boolean, spaces array<string>"


@pytest.mark.parametrize("seed", [1, 2])
def test_operation_ids_count_for_the_whole_store(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(600):
        version = f"v{r.randrange(3)}"
        row = (r.randrange(12), i, f"op{r.randrange(250)}", r.choice(["index", "index", "activate", "activate", "share", "drop", "delete"]), version, "s1", version, i // 60, 1 + i // 30, None, r.random() < 0.5, ["s"])
        rows.append(row)
        if r.random() < 0.1:  # the same command again, much later
            rows.append((row[0], 1000 + i, *row[2:]))
    got = C.apply_corpus_commands(spark.createDataFrame(rows, COMMANDS).repartition(3)).where("seq is not null")
    got = {(x.document_id, x.seq): x.outcome for x in got.collect()}
    want = by_one_ledger(rows, C.Document, C.COMMANDS)
    assert got == want
    assert sum(w == "conflict" for w in want.values()) > 30 and sum(w.startswith("replayed") for w in want.values()) > 3


def test_only_keys_whose_marks_move_are_walked_again(spark, monkeypatch):
    """The first use of a shared id fails for two documents of forty: the others are walked once."""
    put = lambda d, seq, op, kind="index", v="v1", rev=1: (d, seq, op, kind, v, "s", v, 1, rev, None, False, [])
    rows = [put(d, 100 * k + d, f"{d}-{k}", v=f"v{k}") for d in range(40) for k in range(5)]
    rows += [put(d, 600 + d, f"shared{d // 2}", "activate", "none" if d == 4 else "v1") for d in range(40)]  # 5 takes what 4 could not
    walk, passed = C.walk, []
    monkeypatch.setattr(C, "walk", lambda log, *x: passed.append(log.count()) or walk(log, *x))
    got = C.apply_corpus_commands(spark.createDataFrame(rows, COMMANDS)).where("seq is not null").collect()
    assert {(x.document_id, x.seq): x.outcome for x in got} == by_one_ledger(rows, C.Document, C.COMMANDS)
    assert len(got) == len(rows) == passed[0] and sum(passed[1:]) <= 4 * 6


def test_an_id_used_for_two_documents_conflicts(spark):
    put = lambda d, seq, op, kind="index", v="v1", rev=1: (d, seq, op, kind, v, "s", v, 1, rev, None, False, [])
    rows = [put(1, 1, "a"), put(2, 2, "a"), put(2, 3, "b"), put(2, 4, "c", "activate"), put(3, 5, "c", "activate"), put(3, 6, "d", "activate"), put(4, 7, "d")]
    got = C.apply_corpus_commands(spark.createDataFrame(rows, COMMANDS)).where("seq is not null").orderBy("seq").collect()
    # document 3 has no version: its "d" fails and takes nothing, so document 4 may use it
    assert [x.outcome for x in got] == ["indexed", "conflict", "indexed", "activated", "conflict", "not_found", "indexed"]


def test_chat_operation_ids_count_for_the_whole_store(spark):
    r = random.Random(5)
    schema = "conversation_id long, seq long, operation_id string, kind string, message_ids array<string>, digests array<string>, owner_scope string, lifecycle long, revision long, scopes array<string>"
    rows = [(r.randrange(8), i, f"op{r.randrange(180)}", r.choice(["index", "index", "archive", "share", "retract", "delete"]), [f"m{r.randrange(5)}"], ["x"], "s", i // 80, 1 + i // 40, ["s1"]) for i in range(400)]
    got = C.apply_chat_commands(spark.createDataFrame(rows, schema)).where("seq is not null").collect()
    assert {(x.conversation_id, x.seq): x.outcome for x in got} == by_one_ledger(rows, C.Conversation, C.CHAT_COMMANDS)


CHAT = "conversation_id long, seq long, operation_id string, kind string, message_ids array<string>, digests array<string>, owner_scope string, lifecycle long, revision long, scopes array<string>"


def chat_commands(n=360, seed=3):
    """Commands a minute apart; ids come again in a conversation, some within the ledger's hour and some after."""
    r, rows = random.Random(seed), []
    for i in range(n):
        again = rows and r.random() < 0.3
        row = r.choice(rows[-250:])[:1] + (i,) + r.choice(rows[-250:])[2:10] if again and r.random() < 0.3 else None
        if again and row is None:
            old = r.choice(rows[-250:])
            row = (old[0], i, *old[2:10])
        row = row or (r.randrange(6), i, f"op{i}", r.choice(["index", "index", "index", "archive", "share", "retract", "delete"]), [f"m{r.randrange(6)}"], [f"x{r.randrange(3) // 2}"], "s", i // 60, 1 + i // 30, [f"s{r.randrange(2)}"])
        rows.append((*row, 60_000 * (i + 1)))
    return rows


def test_chat_stream_forgets_as_the_batch_does(spark, tmp_path):
    """Over a restart, and with operations that come again after the ledger's hour has passed."""
    from tidemark.streaming import chat
    from tidemark.streaming.apply import run_available

    rows, keep = chat_commands(), 3_600_000
    log = spark.createDataFrame(rows, CHAT + ", at long")
    want = {(x.conversation_id, x.seq): x.outcome for x in C.apply_chat_commands(log, keep).where("seq is not null").collect()}
    for_ever = {(x.conversation_id, x.seq): x.outcome for x in C.apply_chat_commands(log, 10**15).where("seq is not null").collect()}
    assert want != for_ever and sum(o.startswith("replayed") for o in want.values()) > 3
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", chat.ROCKS)
    source, timed = tmp_path / "in", log.withColumn("time", F.timestamp_millis("at"))
    try:
        for k in range(4):
            timed.where(F.floor(F.col("seq") / 90) == k).coalesce(1).write.mode("append").parquet(str(source))
            if k in (1, 3):  # a stop between the second file and the third
                stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
                run_available(chat.apply_chat_commands(stream, keep), str(tmp_path / "out"), str(tmp_path / "cp"))
        out = spark.read.parquet(str(tmp_path / "out"))
        assert {(x.conversation_id, x.seq): x.outcome for x in out.collect()} == want
        assert out.count() == len(rows)
        ledger = spark.read.format("statestore").option("stateVarName", "done").load(str(tmp_path / "cp"))
        held = {x.operation_id for x in ledger.select("user_map_key.operation_id").distinct().collect()}
        assert 0 < len(held) < 110  # an hour's operations, and those behind the watermark's delay
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# ---- term statistics


def test_term_store_equals_a_fresh_count(spark, tmp_path):
    """After replacements, removals and a lost batch, searches equal those over the chunks' texts."""
    from tidemark.operators import retrieval as R
    from tidemark.operators.terms import TermStore

    r = random.Random(4)
    text = lambda: " ".join(r.choice("alpha beta gamma delta eps zeta eta Ünïcode 中文".split()) for _ in range(r.randrange(30)))
    held = {(d, 10 * d + k): text() for d in range(40) for k in range(3)}
    held[0, 0] = ""
    frame = lambda rows: spark.createDataFrame([(*k, t) for k, t in rows.items()], "document_id long, chunk_id long, text string")
    store = TermStore(spark, str(tmp_path / "t"), buckets=5)
    store.replace(0, frame(held))
    for batch in (1, 2, 3):
        chosen = r.sample(range(45), 12)  # some are new
        new = {(d, 10 * d + k): text() for d in chosen if r.random() < 0.8 for k in range(r.randrange(1, 4))}
        named = spark.createDataFrame([(d,) for d in chosen], "document_id long")
        if batch == 2:  # lost after the postings were written: they count for the batch when it goes on
            write, store.owners.write = store.owners.write, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
            with pytest.raises(RuntimeError, match="lost"):
                store.replace(batch, frame(new), named)
            store.owners.write = write
        assert store.replace(batch, frame(new), named)
        assert not store.replace(batch, frame(new), named)
        held = {k: t for k, t in held.items() if k[0] not in chosen} | new
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "中 eta eta"), (3, "absent"), (4, "Ünïcode zeta gamma")], "query_id int, text string")
    chunks = frame(held).select("chunk_id", "text")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.statistics()) == rows(R.corpus_statistics(chunks))
    assert rows(store.bm25_search(queries, 7)) == rows(R.bm25_search(chunks, queries, 7).select("query_id", "chunk_id", "score", "rank"))
    assert rows(store.sparse_search(queries, 7)) == rows(R.sparse_search(chunks, queries, 7).select("query_id", "chunk_id", "score", "rank"))
    plan = store.bm25_search(queries, 7)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in "".join(x for x in plan.split("\n") if "ReadSchema" in x or "Scan parquet" in x)
    empty = TermStore(spark, str(tmp_path / "e"))
    assert empty.bm25_search(queries, 3).count() == 0 and empty.statistics().first().n == 0


def test_sparse_search_without_few_terms(spark, monkeypatch):
    from tidemark.operators import retrieval as R

    chunks = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17}" for j in range(20))) for k in range(30)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "w3 w4 w4"), (2, "w16")], "query_id int, text string")
    few = sorted(map(tuple, R.sparse_search(chunks, queries, 50).collect()))
    monkeypatch.setattr(R, "FEW_TERMS", 1)
    assert sorted(map(tuple, R.sparse_search(chunks, queries, 50).collect())) == few and few


def test_sparse_search_passes_texts_once(spark):
    """One scan of the texts, no shuffle of their tokens, and terms whose hashes collide count together."""
    from tidemark.functions import vectors as V
    from tidemark.operators import retrieval as R

    assert spark.range(1).select(V.fnv32(F.lit("costarring")) == V.fnv32(F.lit("liquid"))).first()[0]
    chunks = spark.createDataFrame([(1, "liquid costarring x"), (2, "x é"), (3, "costarring é é"), (4, None)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "liquid"), (2, "É é x")], "query_id int, text string")
    found = R.sparse_search(chunks, queries, 5)
    assert sorted(tuple(x) for x in found.select("query_id", "rank", "chunk_id", "score").collect()) == [(1, 1, 1, 2.0), (1, 2, 3, 1.0), (2, 1, 3, 4.0), (2, 2, 2, 3.0), (2, 3, 1, 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2  # scores, then each query's best


def test_passages_are_found_as_contains_finds_them(spark):
    from tidemark.operators.evaluate import holding

    r = random.Random(6)
    words = ["uno", "dos", "tres", "Años", "x1", "中文", "a-b", "it's"]
    bodies = [" ".join(r.choice(words) + r.choice(["", ",", ".", "\n"]) for _ in range(60)) for _ in range(40)] + [None, "", "uno"]
    asks = [b[k : k + n] for b in bodies[:20] for k, n in ((3, 40), (11, 25), (0, 9))] + ["not here at all, ever", "unknownword between uno dos", "uno", "", None, "-------------", "no"]
    docs, passages = spark.createDataFrame(list(enumerate(bodies)), "document_id long, body string"), spark.createDataFrame(list(enumerate(asks)), "query_id long, passage string")
    want = {(q, d) for q, a in enumerate(asks) if a is not None for d, b in enumerate(bodies) if b is not None and a in b}
    assert {tuple(x) for x in holding(docs, passages).collect()} == want
    long = passages.where("length(passage) >= 25 and passage not like '----%'")
    found = holding(docs, long)
    assert {tuple(x) for x in found.collect()} <= want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quality_of_searches_leaves_texts_and_scores_in_place(spark, monkeypatch):
    """Scores are added where a chunk's counts lie, texts meet their passages unshuffled, and both forms agree."""
    from tidemark.operators import evaluate as E
    from tidemark.operators import retrieval as R

    r = random.Random(9)
    text = lambda n: " ".join(r.choice("uno dos tres cuatro cinco Seis siete 中文 x".split()) for _ in range(n))
    rows = [(k, text(r.randrange(40))) for k in range(60)] + [(60, None), (61, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "uno dos"), (2, "seis 文"), (3, "none"), (4, "")], "query_id int, text string")
    found = R.bm25_search(chunks, queries, 9)
    scored = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan and not [x for x in plan.split("\n") if "hashpartitioning(query_id#" in x and "chunk_id" in x]
    docs = spark.createDataFrame(rows, "document_id long, body string")
    passages = spark.createDataFrame([(k, rows[k][1][4:60]) for k in range(20) if len(rows[k][1]) > 80], "query_id long, passage string")
    held = E.holding(docs, passages)
    assert "hashpartitioning(document_id#" not in held._jdf.queryExecution().executedPlan().toString()
    once, pairs = scored(found), sorted(map(tuple, held.collect()))
    assert len(once) == 18 and len(pairs) >= passages.count() > 3
    monkeypatch.setattr(R, "FEW_TERMS", 1)
    monkeypatch.setattr(E, "FEW_PAIRS", 1)
    assert scored(R.bm25_search(chunks, queries, 9)) == once and sorted(map(tuple, E.holding(docs, passages).collect())) == pairs


# ---- history and snapshots


def test_history_is_compacted_and_skips(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from tidemark.sources.history import DAY, History

    schema = "to_id long, group_type string, message_id long, created_at long, payload string"
    r = random.Random(2)
    rows = [(k % 40, "group", k, r.randrange(4 * DAY), "p" * r.randrange(50)) for k in range(6000)] + [(1, "group", 9000, -5, "before")]
    table = History(spark, str(tmp_path / "h"), schema, tasks=2, row_group_bytes=4096)
    table.options["parquet.page.size"] = "1024"
    for n in range(5):
        table.write(n, spark.createDataFrame([x for x in rows if x[2] % 5 == n], schema))
    every = sorted(rows)
    assert sorted(map(tuple, table.current().collect())) == every and table.days() == [-1, 0, 1, 2, 3]

    def groups(to_id, day):
        """Row groups of a day that the statistics of to_id do not rule out, and all."""
        files = [f for v, b in table.parts([day]) for f in glob.glob(f"{table._folder(v, b)}/*.parquet")]
        meta = [pq.ParquetFile(f).metadata for f in files]
        stats = [m.row_group(k).column(0).statistics for m in meta for k in range(m.num_row_groups)]
        return sum(s.min <= to_id <= s.max for s in stats), len(stats)

    before = groups(7, 1)
    hot = {f for v, b in table.parts([3]) for f in glob.glob(f"{table._folder(v, b)}/*.parquet")}
    assert table.compact(5, before_day=3) and not table.compact(6, before_day=3)
    after = groups(7, 1)
    assert after[0] < before[0] and after[0] < after[1] and after[0] <= 2
    assert {f for v, b in table.parts([3]) for f in glob.glob(f"{table._folder(v, b)}/*.parquet")} == hot
    assert sorted(map(tuple, table.current().collect())) == every
    table.write(7, spark.createDataFrame([(7, "group", 7777, DAY + 5, "late")], schema))  # a late message of a compacted day
    assert sorted(map(tuple, table.between(DAY, 2 * DAY - 1).where("to_id = 7").collect())) == sorted([x for x in rows if x[0] == 7 and DAY <= x[3] < 2 * DAY] + [(7, "group", 7777, DAY + 5, "late")])
    assert table.compact(8, before_day=3) and len(table.parts([1])) == 1
    assert table.sweep() > 0 and table.current().count() == len(rows) + 1


def test_snapshot_counts_are_those_of_the_checks(spark, tmp_path):
    from tidemark.operators import checks as Q

    r = random.Random(3)
    child = spark.createDataFrame([(k, r.randrange(9), r.choice([None, -1, 1, 2]), r.randrange(60)) for k in range(200)], "id long, parent long, value long, k long")
    parent = spark.createDataFrame([(p,) for p in (0, 1, 2, 3, 3)], "parent long")
    rules = {"non_negative": F.col("value") >= 0}
    flagged = Q.is_unique(Q.has_parent(child, parent, ["parent"], "known"), ["k"], "once", F.col("value") != 2)
    got = Q.write_snapshot(flagged, {**rules, "known": F.col("known"), "once": F.col("once")}, str(tmp_path / "s"), ["id", "parent", "value", "k"])
    pairs = Q.duplicates(child, ["k"], F.col("value") != 2).agg(F.sum("n")).first()[0]
    assert got == {"rows": 200, "non_negative": Q.bad_values(child, "id", rules).count(), "known": Q.missing_parent(child, parent, ["parent"]).count(), "once": pairs}
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.columns == ["id", "parent", "value", "k"] and stored.count() == 200


@pytest.mark.parametrize(("ttl", "cap"), [(900, 50), (900, 10_000), (5000, 200), (10, 3), (100_000, 321), (900, 0)])
def test_ledger_retention_equals_one_order(spark, ttl, cap):
    r = random.Random(ttl + cap)
    rows = [(f"op{k:04d}", r.choice([0, r.randrange(8000, 10_000), 9_900, 20_000])) for k in range(600)]
    inside = [x for x in rows if x[1] == 0 or x[1] >= 10_000 - ttl]
    want = sorted(sorted(inside, key=lambda x: (x[1], x[0]), reverse=True)[:cap])
    got = EV.prune_ledger(spark.createDataFrame(rows, "operation_id string, recorded_at long").repartition(3), 10_000, ttl, cap)
    assert sorted(map(tuple, got.collect())) == want


# ---- keyword search of many queries


def test_many_queries_equal_one_by_one(spark):
    from tidemark.operators import keyword as K
    from tidemark.operators import retrieval as R

    r = random.Random(9)
    words = "alpha beta gamma delta x1 Ünïcode 中文 re".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(n)))
    rows = [(k, text(5), text(9), text(60)) for k in range(80)] + [(90, None, None, "alpha beta"), (91, "alpha beta", None, None), (92, None, None, None), (93, "", "", "")]
    index = spark.createDataFrame(rows, "document_id long, title string, summary string, content string").repartition(3)
    asked = ["alpha", "alpha beta", '"alpha beta"', "alpha OR gamma -beta", '"beta gamma" delta -x1 OR "re re"', "absent", "", "-alpha", "文", "ünïcode Alpha", '"alpha beta" OR beta', "ALPHA BETA"]
    got = sorted(map(tuple, K.matches_of(index, list(enumerate(asked))).collect()))
    want = sorted((q, x.document_id, x.score) for q, t in enumerate(asked) if t for x in R.keyword_matches(index, t).collect())
    assert [g for g in got if asked[g[0]]] == want and len(want) > 200
    vectors = spark.createDataFrame([(k, 0, [1.0, float(k % 5)]) for k in range(80)], "document_id long, position int, vector array<double>")
    texts = [(0, "alpha beta"), (1, '"beta gamma"'), (2, "absent")]
    asks = spark.createDataFrame([(k, [1.0, float(k)]) for k, _ in texts], "query_id long, vector array<double>")
    many = sorted(map(tuple, K.search_documents(index, vectors, texts, asks, F.lit(True), 3, 12, 8, 9).select("query_id", "document_id", "hit_score", "position", "total", "truncated").collect()))
    one = []
    for k, t in texts:
        page = R.search_documents(index, vectors, t, [1.0, float(k)], F.lit(True), 3, 12, 8, 9)
        one += [(k, *x) for x in page.select("document_id", "hit_score", "position", "total", "truncated").collect()]
    assert many == sorted(map(tuple, one))


def test_readable_counts_of_people_in_many_spaces(spark):
    """All ways in, against pairs by hand: subjects in several spaces, documents granted to several."""
    from tidemark.operators import scope

    r = random.Random(11)
    docs = [(d, f"u{r.randrange(12)}", f"s{r.randrange(6)}" if r.random() < 0.9 else None, r.random() < 0.2) for d in range(60)]
    grants = [(r.randrange(64), f"u{r.randrange(14)}" if u else None, None if u else f"s{r.randrange(7)}", r.random() < 0.2) for u in (r.random() < 0.4 for _ in range(150))]
    members = [(f"s{r.randrange(7)}", f"u{r.randrange(14)}", r.random() < 0.2) for _ in range(45)]
    subjects = [(f"u{k}", r.random() < 0.7) for k in range(13)]
    frames = (
        spark.createDataFrame(docs, "document_id long, owner_subject_key string, owner_space_id string, is_public boolean"),
        spark.createDataFrame(grants, "document_id long, grantee_subject_key string, grantee_space_id string, revoked boolean"),
        spark.createDataFrame(members, "space_id string, subject_key string, revoked boolean"),
        spark.createDataFrame(subjects, "subject_key string, active boolean"),
    )
    spaces = {u: {s for s, x, gone in members if x == u and not gone} for u in {f"u{k}" for k in range(14)}}
    active = {u for u, a in subjects if a}
    known = {d for d, *_ in docs}
    reads = {}
    for u in spaces:
        own = {d for d, owner, s, public in docs if owner == u or s in spaces[u] or (public and u in active)}
        reads[u] = own | {d for d, to, s, gone in grants if not gone and (to == u or s in spaces[u])}
    got = {x.subject_key: (x.n, x.first, x.last) for x in scope.readable_counts(*frames).collect()}
    assert got == {u: (len(d), min(d), max(d)) for u, d in reads.items() if d}
    asked = spark.createDataFrame([("u1",), ("u5",), ("u13",), ("nobody",), ("u1",)], "subject_key string")
    by = sorted(map(tuple, scope.readable_by(asked, *frames).collect()))
    assert by == sorted((u, d) for u in ("u1", "u5", "u13") for d in reads[u])
    pairs = [(d, u) for d in range(64) for u in ("u0", "u1", "u2", "u12", "nobody")]
    facts = scope.access_facts(spark.createDataFrame(pairs * 2, "document_id long, subject_key string"), *frames).collect()
    assert len(facts) == len({(d, u) for d, u in pairs if d in known})
    assert {(x.document_id, x.subject_key) for x in facts if x.may_read} == {(d, u) for d, u in pairs if d in reads.get(u, ()) and d in known}


# ---- work that grows with the input


def test_tokens_are_the_runs_of_their_definition(spark):
    from tidemark.functions import vectors as V

    r = random.Random(12)
    texts = ["".join(r.choice("ab9 Zé中文ЖßİΣ٣-_,.\n'\U0001f600\U00020000x") for _ in range(r.randrange(60))) for _ in range(400)] + [None, "", "é" * 50_000 + "a" * 50_000]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(r"\p{IsHan}|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"), F.lit(0))
    assert d.where(V.tokens("t") != plain).count() == 0


def test_embedding_query_does_not_walk_a_text_for_each_bucket(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(0, "ab cd ab"), (1, None), (2, "中 x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = entry.queries()["t12_hash_embedding"](spark, str(tmp_path))
    assert "conv(" not in df._jdf.queryExecution().optimizedPlan().toString()  # bytes of words in lambda functions
    assert {x.doc_id: x.same for x in df.collect()} == {0: 1.0, 1: 0.0, 2: 1.0}


def test_dense_search_in_blocks_equals_a_scan(spark, monkeypatch):
    """Ties of copies, negative and equal scores, halves of a rounded step, vectors without a score."""
    from tidemark.operators import dense
    from tidemark.operators import retrieval as R

    r = random.Random(13)
    some = [[r.choice([-1.0, -0.5, 0.0, 0.5, 1.0, 1 / 128]) for _ in range(6)] for _ in range(40)] + [[0.0] * 6, [0.0078125] + [0.0] * 5, [r.random() for _ in range(6)]]
    rows = [(k, r.choice(some)) for k in range(900)] + [(900 + k, some[-1]) for k in range(300)] + [(1200, None), (1201, [1.0]), (1202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1203, [float("nan")] * 6)]
    asks = [(k, v) for k, v in enumerate([*some[:9], *some[-3:], [1.0] + [0.0] * 5, None, [2.0], [1e-3, 0.0, 0.0, 0.0, 0.0, 0.1]])]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    queries = spark.createDataFrame(asks, "query_id long, vector array<double>")
    read = lambda df: sorted(repr(tuple(x)) for x in df.select("query_id", "chunk_id", "score", "rank").collect())
    shapes = [(65_536, 4_096, 1 << 22), (100, 5, 64), (300, 100, 4096)]
    scan = R.dense_scores(chunks, queries).cache()
    for (v, q, p), k in zip(shapes, (7, 40, 1300)):
        for name, x in (("VECTORS", v), ("QUERIES", q), ("PAIRS", p)):
            monkeypatch.setattr(dense, name, x)
        assert read(R.dense_search(chunks, queries, k)) == read(R.top(scan, k, F.desc("score"), "chunk_id"))
        assert read(R.dense_search(chunks, queries, k, True)) == read(R.top(scan.where("score > 0"), k, F.desc("score"), "chunk_id"))
    plan = R.dense_search(chunks, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    named = chunks.select(F.struct(F.concat(F.lit("é"), F.col("chunk_id").cast("string")).alias("id"), F.col("chunk_id").alias("n")).alias("chunk_id"), "vector")
    assert read(R.dense_search(named, queries, 9)) == read(R.top(R.dense_scores(named, queries), 9, F.desc("score"), "chunk_id"))


def test_fused_arms_meet_no_product_of_queries_and_rows(spark, tmp_path):
    import __spark_entry__ as entry

    r = random.Random(14)
    rows = [(k, [r.random() - 0.5 for _ in range(4)], r.randrange(3)) for k in range(701)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("t18_t19_rank_fusion", "k04_j11_fused_page", "u06_u07_compare_engines", "t27_stability"):
        df = entry.queries()[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    page = entry.queries()["k04_j11_fused_page"](spark, str(tmp_path)).collect()
    for q in range(0, 701, 100):
        kw = [k for _, k in sorted((lab, k) for k, _, lab in rows if (k + q) % 3 == 0)]
        tail = [x.document_id for x in sorted(page, key=lambda x: x.position) if x.query_id == q and x.hit_score == 0]
        assert tail == [k for k in kw if k in set(tail)] and len([x for x in page if x.query_id == q]) == 40


def test_queries_of_one_text_share_its_matches(spark, monkeypatch):
    """Many queries of two texts: the pages are those of each alone, and a text's matches are found once."""
    from tidemark.operators import keyword as K
    from tidemark.operators import retrieval as R

    index = spark.createDataFrame([(k, "t", "s", "alpha " * (k % 4) + "beta " * (k % 3)) for k in range(60)], "document_id long, title string, summary string, content string")
    vectors = spark.createDataFrame([(k, 0, [1.0, float(k % 5)]) for k in range(60)], "document_id long, position int, vector array<double>")
    texts = [(k, ("alpha beta", "ALPHA beta", "absent")[k % 3]) for k in range(7)]
    asks = spark.createDataFrame([(k, [1.0, float(k)]) for k, _ in texts], "query_id long, vector array<double>")
    asked, found = [], K.matches_of
    monkeypatch.setattr(K, "matches_of", lambda index, queries: asked.append(sorted(t for _, t in queries)) or found(index, queries))
    many = sorted(map(tuple, K.search_documents(index, vectors, texts, asks, F.lit(True), 3, 12, 8, 9).select("query_id", "document_id", "hit_score", "position", "total", "truncated").collect()))
    assert asked == [["absent", "alpha beta"]]
    one = []
    for k, t in texts:
        page = R.search_documents(index, vectors, t, [1.0, float(k)], F.lit(True), 3, 12, 8, 9)
        one += [(k, *x) for x in page.select("document_id", "hit_score", "position", "total", "truncated").collect()]
    assert many == sorted(map(tuple, one))


def test_positions_tokenise_each_field_once(spark):
    from tidemark.operators import retrieval as R

    d = spark.createDataFrame([("a b", "c", "d e"), (None, "x", None), ("", "", "")], "t string, s string, c string")
    rows = [[tuple(e) for e in x[0]] for x in d.select(R.positions("t", "s", "c")).collect()]
    assert rows == [[("a", 1, 1.0), ("b", 2, 1.0), ("c", 3, 0.4), ("d", 4, 0.2), ("e", 5, 0.2)], [("x", 1, 0.4)], []]
    plan = d.select(R.positions("t", "s", "c").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3


def test_term_counts_of_a_store_need_no_shuffle_by_term(spark, tmp_path, monkeypatch):
    from tidemark.functions import vectors as V
    from tidemark.operators import terms as TS

    d = spark.createDataFrame([(1, "a b a é"), (2, ""), (3, None), (4, "中中 b")], "document_id long, text string")
    got = {x[0]: sorted(map(tuple, x[1])) for x in d.select("document_id", V.token_counts(V.tokens("text"))).collect()}
    assert got == {1: [("a", 2), ("b", 1), ("é", 1)], 2: [], 3: [], 4: [("b", 1), ("中", 2)]}
    words = spark.createDataFrame([(w,) for w in ["a", "", "é", "foobar", None, "a"]], "w string")
    assert words.where(~V.fnv32_fast("w").eqNullSafe(F.when(F.col("w").isNotNull(), V.fnv32("w")))).count() == 0
    plans, write = [], TS.BatchTable.write
    monkeypatch.setattr(TS.BatchTable, "write", lambda self, n, rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, n, rows, *a))
    TS.TermStore(spark, str(tmp_path / "s"), 4).replace(0, d.withColumn("chunk_id", F.col("document_id")))
    assert "Join [term" not in plans[0] and not any("regexp" in p for p in plans)  # what is written comes from counted rows


def test_a_batch_writes_what_it_changes_only(spark, tmp_path):
    """One document of a bucket is replaced: the batch holds its rows alone, no posting is shuffled, counted texts are gone."""
    from tidemark.operators import terms as TS

    rows = [(k, 10 * k + j, f"alpha w{k} w{k} beta") for k in range(40) for j in range(2)]
    frame = lambda rows: spark.createDataFrame(rows, "document_id long, chunk_id long, text string")
    store, plans, write = TS.TermStore(spark, str(tmp_path / "s"), buckets=3), [], BatchTable.write
    with pytest.MonkeyPatch.context() as m:
        m.setattr(BatchTable, "write", lambda self, n, rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, n, rows, *a))
        paths, fresh = [], TS.shared_path
        m.setattr(TS, "shared_path", lambda s: paths.append(fresh(s)) or paths[-1])
        store.replace(0, frame(rows))
        store.replace(1, frame([(7, 70, "alpha alpha new")]))
        store.replace(2, frame([]), spark.createDataFrame([(8,)], "document_id long"))
    assert [store.owners.batch(k).count() for k in range(3)] == [80, 1, 1]
    assert sorted(x.term for x in store.postings.batch(1).collect()) == ["alpha", "new"] and store.postings.batch(2).count() == 0
    assert not any("Exchange" in p for p in plans if "posting_lists" in p) and sum("posting_lists" in p for p in plans) == 3
    assert len(paths) == 3 and not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    got = store.term_counts(spark.createDataFrame([("alpha",), ("w7",), ("w8",), ("w9",)], "term string"))
    want = [(k, 4, "alpha", 1) for d, k, _ in rows if d not in (7, 8)] + [(70, 3, "alpha", 2), (90, 4, "w9", 2), (91, 4, "w9", 2)]
    assert sorted(map(tuple, got.select("chunk_id", "length", "term", "tf").collect())) == sorted(want)


def test_a_lost_batch_counts_for_nothing(spark, tmp_path):
    """Statistics and counts stay as they were until the batch comes again."""
    from tidemark.operators.terms import TermStore

    frame = lambda *rows: spark.createDataFrame(list(rows), "document_id long, chunk_id long, text string")
    asked = spark.createDataFrame([("a",), ("b",)], "term string")
    store = TermStore(spark, str(tmp_path / "s"), buckets=3)
    store.replace(0, frame((1, 10, "a b b"), (2, 20, "a")))
    now = lambda: (tuple(store.statistics().first()), sorted(map(tuple, store.term_counts(asked).select("chunk_id", "length", "term", "tf").collect())))
    before = now()
    assert before == ((2, 2.0), [(10, 3, "a", 1), (10, 3, "b", 2), (20, 1, "a", 1)])
    write, store.owners.write = store.owners.write, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        store.replace(1, frame((1, 10, "b a a a a")))
    store.owners.write = write
    assert now() == before
    assert store.replace(1, frame((1, 10, "b a a a a")))
    assert now() == ((2, 3.0), [(10, 5, "a", 4), (10, 5, "b", 1), (20, 1, "a", 1)])
