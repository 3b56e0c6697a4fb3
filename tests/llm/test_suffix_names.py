"""Suffix dedup on texts made to confuse its identifiers: near-equal strings, exchanged bytes, common buckets."""

import random

import numpy as np
import pytest

from tests.llm.test_llm import by_id, cut_bytes
from tidemark.llm import suffix_dedup


def exchanged(r):
    """Two texts that differ by bytes exchanged between offsets that are powers of two."""
    n = r.randrange(50, 70)
    t = [r.choice("abcdefgh") for _ in range(n)]
    u = t[:]
    at = r.randrange(max(n - 20, 1))
    a, b = r.sample("abcdefgh", 2)
    for k in (1, 2, 4):
        t[at + k], u[at + k] = a, b
    t[at + 8], u[at + 8] = b, a
    return "".join(t), "".join(u)


def measured(spark, rows, n=4):
    got = by_id(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)))
    return {k: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for k, r in got.items()}


def test_exchanged_bytes_are_no_repeat(spark):
    r = random.Random(0)
    rows = [x for k in range(200) for x in zip((2 * k, 2 * k + 1), exchanged(r))]
    assert measured(spark, rows) == cut_bytes(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_equal_strings_over_two_letters(spark, seed):
    """5,000 texts over two letters, many of them one change, exchange or shift away from another."""
    r = random.Random(seed)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(50, 90))) for _ in range(40)]
    while len(texts) < 5000:
        t = list(r.choice(texts))
        for _ in range(r.randrange(3)):
            i, j = r.randrange(len(t)), r.randrange(len(t))
            t[i], t[j] = t[j], t[i]
        if r.random() < 0.3:
            t[r.randrange(len(t))] = r.choice("ab")
        texts.append("".join(t[r.randrange(3) :]) if len(t) > 55 else "".join(t) + r.choice("ab"))
    rows = list(enumerate(texts))
    assert measured(spark, rows) == cut_bytes(rows)


def test_names_of_exchanged_bytes_differ():
    r = random.Random(4)
    for first in (suffix_dedup._FIRST, suffix_dedup._OTHER):
        for _ in range(2000):
            t, u = exchanged(r)
            a, b = (suffix_dedup.identifiers(np.frombuffer(x.encode(), np.uint8), first) for x in (t, u))
            same = np.array([t[k : k + 16] == u[k : k + 16] for k in range(len(t) - 15)])
            assert ((a[0] == b[0]) == same).all()
            assert not (a[1] == b[1])[: 1].any() or t[:50] == u[:50]


def test_one_bucket_over_many_batches(spark):
    """A 16-byte string that all texts hold, with different surroundings, some of them shared."""
    r = random.Random(8)
    core = "=-=-=common=-=-="
    side = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(40))
    shared = [side() for _ in range(30)]
    rows = [(k, (r.choice(shared) if r.random() < 0.3 else side()) + core + (r.choice(shared) if r.random() < 0.3 else side())) for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert measured(spark, rows) == cut_bytes(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
