"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns; and the pipeline against its stages' brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, language_id, license_scan, lm_score, pipeline, quality_model, quality_rules, streams, suffix_dedup, warc

WORD, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, g long, key string, late int"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def corpus():
    """Texts with copies, near copies, shared passages, odd and empty ones; extra columns clash in name."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgéñ") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(r.randrange(1, 150)) for _ in range(30)]
    texts += [f"{prose(30)}\n{passage}. {prose(20)}" for _ in range(6)]
    long = texts[0] + " " + prose(3000)
    texts += [texts[1], texts[1], long, long.replace(vocabulary[0], "zz"), long[40:]]
    for k in (2, 35):
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "   \n\t", "one", "ONE", "a b c d", "\x1c'll  it's x  y", "É" * 120, "x" * 49, "x" * 50, "y" * 200, "Licensed under CC BY-NC 4.0. all rights reserved cc by cc by"]
    return [(k, t, ["en", "de", None][k % 3], "s", 0, k, "key", 1) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def library():
    import base64

    import tiktoken

    path, pattern = bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb").read().splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_equals_library_and_round_trips(docs, none):
    want = library()
    got = by_id(bpe.digests(docs, *bpe.public_ranks()))
    for k, t, *_ in corpus():
        ids = want(t or "")
        assert tuple(got[k][1:]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert by_id(bpe.decode(bpe.encode(docs, *bpe.public_ranks()), *bpe.public_ranks()))[3]["text"] == corpus()[3][1]
    assert bpe.digests(none, *bpe.public_ranks()).count() == 0


@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(1, 1), (3, 4), (40, 16), (bpe.LEAF_CHARS, bpe.LEAF_BYTES)])
def test_bpe_joins_any_text(leaf_chars, leaf_bytes):
    codec, want = bpe.Codec(open(bpe.public_ranks()[0], "rb").read(), bpe.public_ranks()[1], leaf_chars, leaf_bytes), library()
    r = random.Random(leaf_chars)
    for n in [60] * 60 + [900] * 6:
        t = "".join(r.choice(" \n\t'slltre12.é漢\x1c\x85\u3000-- aB") for _ in range(r.randrange(n)))
        assert codec.encode(t) == want(t) and codec.decode(want(t)) == t.encode(), t
    han = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(2000))
    mixed = "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(3000))
    word = "".join(r.choice("etaoinshrdlu") for _ in range(3000))
    for t in (han, mixed, word, "a" * 1000, "=" * 777 + "x", " " * 500 + "x" + " " * 300, "\n" * 100, "ab" * 700, " " + word, "'s" * 300, "don't'll've" * 60, "1" * 400):
        assert codec.encode(t) == want(t) and codec.decode(want(t)) == t.encode(), t[:20]


def test_bpe_long_texts_take_time_in_proportion():
    """A text without any safe cut costs about as much for each character, however long."""
    import time

    codec = bpe.Codec(open(bpe.public_ranks()[0], "rb").read(), bpe.public_ranks()[1])
    r = random.Random(1)
    took = []
    for n in (20_000, 160_000):
        t = "".join(r.choice("etaoinshrdlu") for _ in range(n))
        began = time.process_time()
        codec.encode(t)
        took.append(time.process_time() - began)
    assert took[1] < 20 * max(took[0], 0.05)


def test_quality_rules_counts(docs, none):
    got = by_id(quality_rules.quality_rules(docs))
    for k, t, *_ in corpus():
        w = WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        longest = max([0, *(n for a in range(len(w)) for n in [next(n for n in range(len(w) + 1) if a + n >= len(w) or not any(w[b : b + n + 1] == w[a : a + n + 1] for b in range(len(w) - n) if b != a))])]) if len(w) < 200 else None
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert longest is None or r["longest_repeat"] == longest
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_rules.kept(docs).columns == docs.columns
    assert quality_rules.quality_rules(docs).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    twice = docs.unionByName(docs)
    assert sorted(map(str, quality_rules.quality_rules(twice).collect())) == sorted(2 * [str(r) for r in got.values()])


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(rows):
    s = {k: shingles(t) for k, t in rows}
    label = {k: k for k in s}
    changed = True
    pairs = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return s, label


@pytest.mark.parametrize("spread", [5, 20, 1000])
def test_jaccard_components(docs, spread):
    got = by_id(jaccard_join.jaccard_components(docs, jaccard_join.Rule(spread=spread, block=2)))
    s, label = components_of([(k, t) for k, t, *_ in corpus()])
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == {k: (len(s[k]), label[k]) for k in s}


def test_jaccard_odd_rows(spark, none):
    assert jaccard_join.jaccard_components(none).count() == 0 and jaccard_join.one_of_each(none).columns == none.columns
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A B C D E F")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard_join.jaccard_components(rows).collect()) == [(0, 7), (7, 7), (7, 7), (9, 7)]
    w = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = spark.createDataFrame([(None, " ".join(w)), (3, " ".join([*w[:-1], "Ä"])), (4, " ".join(["Ä", *w[1:-1], "Ö"])), (None, "1 2 3"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.jaccard_components(rows).collect()) == [(0, 0, 0), (0, 1, 0), (0, 22, 3), (3, 22, 3), (4, 22, 3)]


def family(n, changes):
    """Near copies of one text of 80 words, each with some words changed, with similarities around the threshold."""
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(changes + 1)):
            w[r.randrange(80)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    return rows


def test_jaccard_large_family(spark):
    rows = family(160, 5)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s, label = components_of(rows)
    assert len(set(label.values())) > 5
    assert {k: r["component_id"] for k, r in by_id(jaccard_join.jaccard_components(d, jaccard_join.Rule(block=16))).items()} == label
    got, pairs = jaccard_join.jaccard_links(d, jaccard_join.Rule(block=16))
    want = {a: sum(100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) for b in s) - 1 for a in s}
    assert {k: r["n_links"] for k, r in by_id(got).items()} == want and pairs.count() <= sum(want.values()) // 2


@pytest.mark.parametrize("seed", range(4))
def test_shared_rows_in_any_batches(seed):
    """The streamed operator against grouping, over random cuts into batches."""
    r = np.random.default_rng(seed)
    rows = sorted((int(a), int(b)) for a, b in zip(r.integers(0, 12, 80), r.integers(0, 3, 80), strict=True))
    owners = {a: {y for x, y in rows if x == a} for a, _ in rows}
    captured = {}

    class Frame:
        schema = None

        def mapInArrow(self, f, schema):  # noqa: N802
            captured["f"] = f

    streams.shared(Frame())
    cuts = sorted({0, len(rows), *r.integers(0, len(rows), 15).tolist()})
    batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[a:b]], pa.int64()) for k in (0, 1)], ["t", "c"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = [x for b in captured["f"](iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert got == sorted({x for x in rows if len(owners[x[0]]) > 1})


def cut_bytes(rows):
    starts = {}
    for k, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            starts.setdefault(b[p : p + 50], set()).add(k)
    out = {}
    for k, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if min(starts[b[p : p + 50]]) < k:
                gone[p : p + 50] = [True] * 50
        out[k] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def test_suffix_dedup(docs, none):
    got = by_id(suffix_dedup.suffix_dedup(docs))
    want = cut_bytes([(k, t) for k, t, *_ in corpus()])
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for k, r in got.items()} == want
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_odd_rows(spark):
    t = "abcdefghij" * 6
    rows = spark.createDataFrame([(None, t), (5, t + "!"), (5, t), (6, "é" * 20 + t[:51] + "é")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.suffix_dedup(rows).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (6, 51)]
    assert all(r["text"] is None or r["text"].encode() for r in suffix_dedup.shortened(rows).collect())


def test_suffix_dedup_rows_of_one_id_and_clashing_columns(spark):
    """Of many rows of one doc_id, each loses what itself shares with an earlier document, and no other."""
    r = random.Random(9)
    first = "".join(r.choice("abcdefghij") for _ in range(200))
    texts = [first[20:80]] + ["".join(r.choice("klmnopq") for _ in range(60)) + (first[k : k + 52] if k % 3 == 0 else "") for k in range(60)]
    names = ["copy", "spans", "same", "n_bytes", "kept", "n_removed", "tag", "rest", "found", "g"]
    rows = [(1, first)] + [(2, t) for t in texts + texts[:2]]
    d = spark.createDataFrame([(*x, *range(len(names))) for x in rows], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names)).repartition(3)
    held = lambda t: [any(t[q : q + 50] in first for q in range(max(0, p - 49), min(p, len(t) - 50) + 1)) for p in range(len(t))]
    want = sorted((k, t, "".join(c for c, g in zip(t, held(t), strict=True) if not g) if k == 2 else t) for k, t in rows)
    got = suffix_dedup.suffix_dedup(d)
    assert sorted((x["doc_id"], x["text"], bytes(x["kept"]).decode()) for x in got.collect()) == want
    assert got.columns == ["doc_id", "text", "copy", "spans", "same", "tag", "rest", "found", "g", "n_bytes", "n_removed", "n_spans", "kept"]
    left = suffix_dedup.shortened(d)
    assert left.schema == d.schema and sorted((x["doc_id"], x["text"]) for x in left.collect()) == sorted((k, x) for k, _, x in want if x)
    assert all([x[n] for n in names] == list(range(len(names))) for x in left.collect())


def test_decontamination(spark, docs, none):
    items = [("b", " ".join(corpus()[31][1].split()[32:50])), ("a", "one"), ("c", None), ("d", "nothing of this stands anywhere at all in these texts"), ("b", "a b c d")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = by_id(decontaminate.contamination(docs, bench))
    for k, t, *_ in corpus():
        w, hit, ids = ALNUM.findall(lower(t)), set(), set()
        for i, x in items:
            v = ALNUM.findall(lower(x))
            n = min(10, len(v))
            for win in {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if v else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == win:
                        hit |= set(range(p, p + n))
                        ids.add(i)
        want = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
        assert tuple(got[k][1:]) == want, (k, t)
    assert decontaminate.contamination(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_decontamination_proximity(spark):
    """The two rarest terms of a window at most `slop` words apart, but not as in the window."""
    r = random.Random(8)
    w = [f"w{k}" for k in range(40)]
    texts = [[r.choice(w) for _ in range(r.randrange(1, 60))] for _ in range(40)] + [w[:14], w[5:3:-1]]
    items = [w[:12], w[4:6], w[3:30:3], ["w9"]]
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(str(k), " ".join(t)) for k, t in enumerate(items)], "item_id string, text string")
    index = decontaminate.Index(d, b)
    names = {x["uid"]: x["item_id"] for x in index.items.select("uid", "item_id").distinct().collect()}
    f = Counter(x for t in texts for x in t)
    for slop in (1, 4, 30):
        want = set()
        for i, t in enumerate(items):
            size = min(10, len(t))
            for s in range(len(t) - size + 1):
                places = sorted(range(s, s + size), key=lambda j: (f[t[j]], j))[:2]
                if len(places) < 2 or not f[t[places[0]]]:
                    continue
                j, k = places
                want |= {(str(i), n) for n, x in enumerate(texts) for p in range(len(x)) for q in range(len(x)) if x[p] == t[j] and x[q] == t[k] and 0 < abs(q - p) <= slop and q - p != k - j}
        assert {(names[x["uid"]], x["d"]) for x in index.proximity(slop).collect()} == want


def test_decontamination_plan_is_native(spark, docs):
    plan = decontaminate.contamination(docs, spark.createDataFrame([("a", "x y z")], "item_id string, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_lm_scores(docs, none):
    got = by_id(lm_score.lm_score(docs, max_common=20))
    count = Counter()
    for k, t, *_ in corpus():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            count.update([*WORD.findall(lower(t)), None])
    n, v = sum(count.values()), len(count)
    for k, t, *_ in corpus():
        w = [*WORD.findall(lower(t)), None]
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(k).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r["score"] < 0
    assert lm_score.lm_score(none).count() == 0


def tree_score(rows):
    """The model by hand: contexts as tuples of symbols, word starts as bytes, all counts in dictionaries."""
    learned = [(lower(t).encode() if t else b"") for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 7 != 2]
    split = lambda b: [x for x in re.split(rb"[\x20\x09-\x0d]+", b) if x]
    line = lambda b: b" ".join(split(b)) + b"\n"
    cls = lambda b: tuple(lm_score.CLASS_OF[list(b)].tolist())
    depth, end, space = lm_score.DEPTH, lm_score.END, lm_score.SPACE
    grams, n_byte = Counter(), Counter()
    for b in map(line, learned):
        n_byte.update(b)
        x = (end,) * depth + cls(b)
        grams.update((x[p - d : p], x[p]) for p in range(depth, len(x)) for d in range(depth + 1))
    nxt = {}
    for (c, x), n in grams.items():
        nxt.setdefault(c, {})[x] = n
    total = {c: sum(v.values()) for c, v in nxt.items()}
    passes = lambda c: total[c] >= lm_score.MIN_COUNT and sum(n * math.log2(n / total[c] / (nxt[c[1:]][x] / total[c[1:]])) for x, n in nxt[c].items()) > len(nxt[c]) * math.log2(total[c]) / 2
    states = {c for c in nxt if c and passes(c)}

    def share(c, x):
        if not c:
            return (nxt.get(c, {}).get(x, 0) + 0.5) / (total.get(c, 0) + 0.5 * lm_score.CLASSES)
        if c not in states:
            return share(c[1:], x)
        m = len(nxt[c])
        return (nxt[c].get(x, 0) + m * share(c[1:], x)) / (total[c] + m)

    after = lambda w, p, last: lm_score.CLASS_OF[w[p]] if p < len(w) else end if last else space
    begun = {}
    for b in learned:
        w = split(b)
        for i, y in enumerate(w):
            for p in range(depth, len(y) + 1):
                begun.setdefault(y[:p], Counter())[int(after(y, p, i == len(w) - 1))] += 1
    starts = {}
    for y, n in begun.items():
        t, m = sum(n.values()), len(n)
        if t >= lm_score.START_COUNT and sum(c * math.log2(c / share(cls(y[-depth:]), x)) for x, c in n.items()) - t * math.log2(t) > m * math.log2(t) / 2:
            starts[y] = n
    in_class = Counter()
    for b in range(256):
        in_class[int(lm_score.CLASS_OF[b])] += n_byte[b] + 0.5

    def score(text):
        b = lower(text).encode() if text else b""
        w, x = split(b), line(b)
        s = (end,) * depth + cls(x)
        out = sum(math.log10(share(s[p : p + depth], s[p + depth])) + math.log10((n_byte[x[p]] + 0.5) / in_class[s[p + depth]]) for p in range(len(x)))
        for i, y in enumerate(w):
            for p in range(depth, len(y) + 1):
                if y[:p] in starts:
                    n, z = starts[y[:p]], int(after(y, p, i == len(w) - 1))
                    own = share(cls(y[p - depth : p]), z)
                    out += math.log10((n[z] + len(n) * own) / (sum(n.values()) + len(n)) / own)
        return out

    return score, len(states), len(starts)


def test_lm_score_equals_the_tree_by_hand(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice(["ta", "ri", "no", "sel", "ém", "x", "4"]) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    rows = [(k, " ".join(r.choice(vocabulary[: 20 + k % 40]) for _ in range(r.randrange(40)))) for k in range(120)]
    rows += [(200, None), (201, ""), (None, "tari nosel"), (5, rows[5][1]), (202, "\n Unknown  WORDS\t" + vocabulary[0]), (203, " ".join(vocabulary) * 30)]
    d = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n long, h long").repartition(3)
    score, n_states, n_starts = tree_score(rows)
    assert n_states > 50 and n_starts > 50
    got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_tokens"], round(x["score"], 2)) for x in lm_score.lm_score(d, max_common=30).collect())
    want = sorted((-1 if k is None else k, len(WORD.findall(lower(t))) + 1, round(score(t), 2)) for k, t in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) <= 0.02 + 1e-5 * abs(b[2]) for a, b in zip(got, want, strict=True))


def test_lm_word_starts_of_any_length(spark):
    """A symbol that only bytes further back than DEPTH tell is scored by them; every state counts, by both ways."""
    r = random.Random(4)
    learned = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 7 != 2]
    rows = [(k, " ".join(r.choice(["qabcdefgh1x", "wabcdefgh2y"]) for _ in range(8))) for k in learned]
    rows += [(k, t) for k, t in zip((k for k in range(3000) if zlib.crc32(str(k).encode()) % 7 == 2), ["qabcdefghx", "qabcdefghy", "qabcdefgh1x", "qabcdefgh1y", "wabcdefgh2x", "wabcdefgh2y", "wabcdefgh2y qabcdefgh1x", ""], strict=False)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got, rare = by_id(lm_score.lm_score(d)), by_id(lm_score.lm_score(d, max_common=0))
    assert all(got[k]["score"] == pytest.approx(rare[k]["score"]) for k, _ in rows)
    score = {t: got[k]["score"] for k, t in rows if got[k]["held_out"]}
    assert score["qabcdefgh1x"] > score["qabcdefgh1y"] + 2 and score["wabcdefgh2y"] > score["wabcdefgh2x"] + 2

    count = Counter((w[:i], (w + " ")[i]) for _, t in rows[: len(learned)] for w in t.split() for i in range(4, len(w)))
    tree = lm_score.grow(stats := lm_score.statistics(d))
    kept = lm_score.starts(lm_score.scratch.stored(lm_score.reaching(stats.where("kind = 0")).mapInArrow(lambda bs: (lm_score.places(b, tree, tree.table()) for b in bs if len(b)), "h long, p long, x int, last int, n long, s double"))).collect()
    assert sorted(x["t"] for x in kept)[-2:] == sorted([count["qabcdefgh", "1"], count["wabcdefgh", "2"]])


def test_language_id(spark, none):
    r = random.Random(1)
    words = {"en": "the of and to in is that for with".split(), "de": "der die und von mit ist das ein nicht".split()}
    rows = [(k, " ".join(r.choice(words[x]) for _ in range(40)), x) for k in range(120) for x in [["en", "de"][k % 2]]] + [(500, None, "en"), (501, "123 ...", "de"), (502, "und der mit", None)]
    got = by_id(language_id.predict(d := spark.createDataFrame(rows, "doc_id long, text string, lang string"), language_id.fit(d)))
    assert all(got[k]["lang_pred"] == x and 0 <= got[k]["score"] <= 1 for k, _, x in rows[:120])
    assert [got[k]["lang_pred"] for k in (500, 501, 502)] == ["und", "und", "de"] and got[500]["score"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.values())
    x, y, z = [k for k in range(20) if zlib.crc32(str(k).encode()) % 3 != 1][:3]
    many = spark.createDataFrame([(x, "der die und", "de", 0)] * 3000 + [(y, "the of and", "en", 0), (z, None, "en", 0), (None, "le la", "fr", 0), (98, "und die der " * 9000, None, 0)], "doc_id long, text string, lang string, score long")
    taken = language_id.sample(many, 400, 1000)
    assert taken.count() == 401 and {r["lang"]: r["n"] for r in taken.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {"de": 400, "en": 1}
    assert {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(many, language_id.fit(many)).collect() if r["doc_id"] in (x, z, 98)} == {(x, "de"), (z, "und"), (98, "de")}
    p = language_id.tk.Piece(np.frombuffer(b"abcabx", np.uint8), np.array([0, 6]), None)
    model = language_id.Model((), np.array([], np.int64), np.zeros((0, 1), np.float32), np.zeros((1, 0), np.float32))
    grams = {b"abcabx"[k : k + n] for n, _ in language_id.SPECTRUM for k in range(7 - n)}
    assert language_id.presence(p).sum() == len(grams) and language_id.kernel(p, model).shape == (1, 1)
    empty = none.select("doc_id", "text", "lang")
    assert language_id.fit(empty) is None and language_id.predict(d, None).where("lang_pred <> 'und'").count() == 0


def test_license_scan(spark, docs, none):
    got = by_id(license_scan.license_scan(docs))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for k, t, *_ in corpus():
        w = ALNUM.findall(lower(t))
        at = sorted((p, label) for x, label in phrases.items() for p in range(len(w)) if w[p : p + len(x.split())] == x.split())
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(","))
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "Licensed under CC BY-NC 4.0."), (3, "Released under the MIT License."), (4, "mit dem alles"), (5, "license identifier Apache License 2.0, or the Mozilla Public License 2.0")]
    labels = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert labels == {1: "gpl,gpl-3.0", 2: "cc-by,cc-by-nc", 3: "mit", 4: "", 5: "apache-2.0,mpl-2.0"}
    assert license_scan.license_scan(none).count() == 0 and len(license_scan.rules()) > 300


def spelled(node):
    """Texts of a regex: every alternative and letter of a set, repetitions at their least and one more (at most)."""
    out = [""]
    for op, av in node:
        kind = str(op)
        if kind == "LITERAL":
            part = [chr(av)]
        elif kind == "IN":
            part = [x for o, v in av for x in ([chr(v)] if str(o) == "LITERAL" else [chr(c) for c in range(v[0], v[1] + 1)] if str(o) == "RANGE" else ["7"])]
        elif kind == "ANY":
            part = ["x"]
        elif kind == "BRANCH":
            part = [x for b in av[1] for x in spelled(b)]
        elif kind == "SUBPATTERN":
            part = spelled(av[3])
        elif kind == "MAX_REPEAT":
            part = [x * n for n in range(av[0], min(av[0] + 1, av[1]) + 1) for x in (spelled(av[2]) if n else [""])]
        else:
            assert kind == "ASSERT_NOT", kind
            part = [""]
        out = [a + b for a in out for b in part]
    return out


def test_license_keywords_lose_nothing():
    """Scans with and without the keywords agree on a text of every alternative of every name, way and other rule."""
    parse = lambda x: spelled(re._parser.parse(x))
    texts = [t for _, _, name in license_scan.NAMES for t in parse(name)]
    texts += [a + "mit license" + b for pre, post, *_ in license_scan.WAYS for a in parse(pre) for b in parse(post)]
    texts += ["spdx license identifier " + " ".join(re.findall("[a-z0-9]+", x.lower())) for _, xs in license_scan.SPDX for x in xs.split()]
    texts += [t + end for r in license_scan.rules()[-2:] for t in parse(r.regex.pattern) for end in ("", "s")]
    texts += [t for r in license_scan.sentences() for t in parse(r.regex.pattern)]
    made = license_scan.rules()
    by_key = license_scan.keyed(made)
    for t in texts:
        every = [(a, a + m.group().count(" ") + 1, r) for r in made for m in r.regex.finditer(t) for a in [t.count(" ", 0, m.start())]]
        assert every and license_scan.scan_words(t.split(" "), by_key) == license_scan.resolve(every), t
    assert len(texts) > 1000
    for r in license_scan.sentences():
        assert any(x in t.split(" ") for t in parse(r.regex.pattern) for x in r.need)


def test_license_names_without_their_short_form(spark):
    rows = ["GNU General Public License v3", "GNU General Public Licence v2", "AGPL v3", "GPLv3", "Library General Public License", "Common Development and Distribution License", "European Union Public Licence", "Creative Commons Attribution ShareAlike", "Alle Rechte vorbehalten"]
    got = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert [got[k]["labels"] for k in range(len(rows))] == ["gpl,gpl-3.0", "gpl-2.0", "agpl", "gpl", "gpl,lgpl", "cddl", "eupl", "cc-by-sa", "reserved"]


def test_license_sentences_each_have_an_example(spark):
    """Of every written signature rule, a text that it matches gets its label; long texts take time in proportion."""
    import time

    parse = lambda x: spelled(re._parser.parse(x))
    made = license_scan.sentences()
    assert len(made) >= 80
    rows = [(k, "word " + parse(r.regex.pattern)[0] + " word") for k, r in enumerate(made)]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(made[k].label in got[k]["labels"].split(",") for k, _ in rows)
    by_key, took = license_scan.keyed(license_scan.rules()), []
    for n in (3_000, 24_000):
        words = ("licensed under the mit license and gpl v3 " * n).split()
        began = time.process_time()
        license_scan.scan_words(words, by_key)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_license_suppression_equals_all_comparisons():
    r = random.Random(6)
    for n in range(60):
        made = [license_scan.Rule(f"r{k}", ("k",), (), r.randrange(3), 0.5, re.compile("x")) for k in range(6)]
        found = [(a, a + r.randrange(1, 7), r.choice(made)) for a in (r.randrange(20) for _ in range(n))]
        order = lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)
        ranked = sorted(set(found), key=order)
        want = [x for k, x in enumerate(ranked) if not any(y[0] <= x[0] and x[1] <= y[1] for y in ranked[:k])]
        assert license_scan.resolve(found) == sorted(want, key=lambda x: (x[0], x[1]))


def test_license_suppression():
    rule = lambda name, p: license_scan.Rule(name, "k", (), p, 0.5, re.compile("x"))
    a, b, c = rule("a", 2), rule("b", 1), rule("c", 1)
    assert [r.label for _, _, r in license_scan.resolve([(0, 5, a), (1, 3, b), (4, 8, c), (5, 7, b)])] == ["a", "c"]


def test_quality_model(spark, none):
    r = random.Random(2)
    prose = lambda: ". ".join("The " + " ".join("".join(r.choice("abcdeo") for _ in range(5)) for _ in range(9)) for _ in range(8)) + "."
    bad = [lambda: prose().upper() + "!!", lambda: " ".join(["spam"] * 60), lambda: prose().replace(" ", "*** ### "), lambda: prose().replace(" ", " | ")]
    rows = [(k, bad[k // 10 % 4]() if k % 10 == 0 else prose()) for k in range(400)] + [(900, None), (901, "")]
    got = by_id(quality_model.quality_scores(spark.createDataFrame(rows, "doc_id long, text string")))
    right = sum(got[k]["kept"] == (k % 10 != 0) for k in range(400))
    assert right >= 390 and not got[900]["kept"] and got[901]["score"] == 0 and all(0 <= x["score"] <= 1 for x in got.values())
    assert quality_model.quality_scores(none).count() == 0
    odd = spark.createDataFrame([(7, "x " * 9, 1, 2)] * 3000 + [(None, "the end. " * 9000, 1, 2)], "doc_id long, text string, score long, kept long")
    assert quality_model.quality_scores(odd, fit_rows=50).groupBy("doc_id", "score", "kept").count().count() == 2


def test_quality_model_finds_each_labellers_rates():
    """Votes drawn from known rates: posteriors and rates against those, and one round against sums by hand."""
    r = np.random.default_rng(4)
    n, k = 40_000, len(quality_model.LABELLERS)
    kind = np.where(r.random(n) < 0.1, r.integers(0, k, n), -1)
    u = r.random((n, k))
    bad_rate = np.where(kind[:, None] == np.arange(k), 0.9, np.where(kind[:, None] >= 0, 0.05, 0.002))
    v = np.where(u < bad_rate, -1, np.where(u < bad_rate + 0.05, 0, 1))
    patterns, back, counts = np.unique(quality_model.pattern(v), return_inverse=True, return_counts=True)
    rates, good = quality_model.expectation_maximisation(patterns, counts.astype(float))
    assert ((good[back] > 0.5) == (kind < 0)).mean() > 0.97  # 2.1 % of these votes mislead any rule
    for c, own in ((0, kind >= 0), (1, kind < 0)):
        true = np.stack([(v[own] == x).mean(0) for x in (-1, 0, 1)], 1)
        assert np.abs(rates[c] - true).max() < 0.06
    rates, good = quality_model.expectation_maximisation(patterns, counts.astype(float), rounds=1)
    weight = quality_model.PRIOR_SHARE * n
    share = np.zeros((k + 1, n))
    for i in range(n):
        objects = np.flatnonzero(v[i] == -1)
        share[0, i] = 0.05 if len(objects) else 1.0
        share[1 + objects, i] = 0.95 / max(1, len(objects))
    own = lambda c, j, x: share[c][v[:, j] == x].sum() + weight * (quality_model.ON_OWN if c == j + 1 else quality_model.ON_OTHER)[x + 1]
    want = [[sum((share[c].sum() + weight) * own(c, j, x) / sum(own(c, j, y) for y in (-1, 0, 1)) for c in range(1, k + 1)) for x in (-1, 0, 1)] for j in range(k)]
    assert np.allclose(rates[0], np.array(want) / (share[1:].sum() + weight * k))


def test_warc_revisits(spark):
    h = {"content-type": "text/html", "cache-control": "a", "server": "s"}
    rows = [
        (1, "http://www.X.com/p/?b=2&utm_source=q&a=1#f", 10, "response", '"e1"', None, h, "d1"),
        (2, "https://x.com/p?a=1&b=2", 20, "revisit", 'W/"e1"', None, {"cache-control": "b", "content-type": "no"}, None),
        (3, "https://x.com/p?a=1&b=2", 30, "revisit", '"e2"', None, None, None),
        (4, "https://x.com/p?a=1&b=2", 10_000_000, "revisit", None, None, {}, None),
        (5, "https://x.com/p?a=1&b=2", 5, "revisit", None, None, {}, None),
        (6, None, 40, "revisit", None, None, {}, None),
        (7, "http://x.com/p/?a=1&b=2", None, "revisit", None, None, {}, None),
        (0, "http://x.com/p?a=1&b=2", 20, "response", '"e0"', None, h, "d0"),
    ]
    d = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified long, headers map<string,string>, digest string")
    got = {r["record_id"]: r for r in warc.resolve_revisits(d.withColumn("near0", F.lit(1))).collect()}
    assert {k: (r["outcome"], r["source_id"]) for k, r in got.items()} == {0: ("full", 0), 1: ("full", 1), 2: ("validator_mismatch", None), 3: ("validator_mismatch", None), 4: ("unvalidated", 0), 5: ("no_earlier", None), 6: ("no_earlier", None), 7: ("no_earlier", None)}
    r = {x["record_id"]: x for x in warc.resolve_revisits(d.where("record_id <> 0")).collect()}
    assert r[2]["outcome"] == "resolved" and r[2]["headers"] == {"content-type": "text/html", "server": "s", "cache-control": "b"} and r[4]["source_digest"] == "d1"
    assert warc.resolve_revisits(d.limit(0)).count() == 0
    odd = [(1, "example.com/a", 10, "response", None, None, h, "d1"), (2, "other.org/zzz", 20, "revisit", None, None, {}, None), (3, "", 30, "revisit", None, None, {}, None), (4, "http://", 40, "revisit", None, None, {}, None), (5, "http://a.b/", 5, "response", None, None, h, "d5"), (6, "http://a.b", 50, "revisit", None, None, {}, None), (6, "http://a.b", 50, "revisit", None, None, {}, None)]
    names = ["block", "near", "far", "o", "rest", "Outcome"]
    d = spark.createDataFrame([(*x, *range(len(names))) for x in odd], "record_id long, url string, ts long, kind string, etag string, last_modified long, headers map<string,string>, digest string, " + ", ".join(f"{n} long" for n in names))
    got = warc.resolve_revisits(d)
    assert got.columns == [*d.columns[:-1], "canonical_url", "outcome", "source_id", "source_digest"]
    assert sorted((r["record_id"], r["canonical_url"], r["outcome"], r["source_id"]) for r in got.collect()) == [(1, None, "full", 1), (2, None, "no_earlier", None), (3, None, "no_earlier", None), (4, None, "no_earlier", None), (5, "a.b", "full", 5), (6, "a.b", "unvalidated", 5), (6, "a.b", "unvalidated", 5)]
    assert all([r[n] for n in names[:-1]] == [0, 1, 2, 3, 4] for r in got.collect())


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [x[:5] for x in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(corpus()[30][1].split()[:14])
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    verdict = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    left = [(k, t) for k, t, *_ in rows if verdict[k]["kept"]]
    _, label = components_of(left)
    left = [(k, t) for k, t in left if label[k] == k]
    cut = cut_bytes(left)
    whole = lambda k, t: t if not cut[k][1] else cut[k][3].decode()  # noqa: E731  the cuts of this corpus fall between characters
    left = [(k, whole(k, t)) for k, t in left if not cut[k][1] or cut[k][1] < cut[k][0]]
    v = ALNUM.findall(lower(item))
    windows = {tuple(v[p : p + 10]) for p in range(len(v) - 9)}
    held = lambda w: any(tuple(w[p : p + 10]) in windows for p in range(len(w) - 9))
    left = [(k, t) for k, t in left if not held(ALNUM.findall(lower(t)))]
    want = library()
    assert {k: (list(r["ids"]), r["decoded_sha256"]) for k, r in got.items()} == {k: (want(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in left}


def test_pipeline_odd_tables(spark, tmp_path):
    """No rows; rows without or with repeated doc_id, and columns named like the stages' own."""
    names = ["kept", "spans", "tag", "cls", "node", "_gone", "ids", "rest"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names)
    prose = [t for _, t, *_ in corpus()[:30] if len((t or "").split()) > 60]
    rows = [(k, t, "en", "s", 0) for k, t in [(None, prose[0]), (1, prose[1]), (1, prose[2]), (2, prose[3]), (3, prose[3]), (3, prose[3]), (4, None), (None, None), (None, prose[0])]]
    for name, data in (("none", []), ("odd", rows)):
        spark.createDataFrame([(*x, *range(len(names))) for x in data], schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "odd"))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    want = library()
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in pipeline.run(spark, str(tmp_path / "odd")).collect()) == sorted((k, want(t)) for k, t in [(0, prose[0]), (0, prose[0]), (1, prose[1]), (1, prose[2]), (2, prose[3])])
