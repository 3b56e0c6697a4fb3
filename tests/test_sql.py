"""Registered queries against their SQL, over small tables with odd rows."""

import random

import pytest


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents whose titles hold a query inside other words, alone or beside its words, in other cases, cut or null."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(5)
    words = "is ering der und the of this eringan wieder undine theof IS Ering".split() + ["x"] * 60
    texts = ["x " * 50 + " ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(150)]
    texts += ["this eringan x", "in this eringst of", "wieder undine", "bathe offer", "THIS ERINGAN, is", "x this eringle ering", "a" * 31 + " this ering" + "er", "this\neringan"]
    texts += [None, "", " ", "is " + "x " * 255 + "ering", "is-ering is_ering", "is ering " * 3, "中文 is ering 中", "this eringan " * 40]
    langs = ["en", "de", "zh", None]
    path, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(k + 1, t, langs[k % 4] if k % 17 == 0 else "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)])
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(k, [r.random() - 0.3 for _ in range(8)], k % 7) for k in range(301)])
    for name in ("documents", "embeddings"):
        con.execute(f"COPY {name} TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path), con


@pytest.mark.parametrize("name", ["t04_k01_keyword_window", "t20_hybrid_search", "t20_search_page", "t20_j01_many_searches"])
def test_titles_without_a_word_of_the_query(spark, odd, name):
    import __spark_entry__ as entry

    path, con = odd
    got = entry.queries()[name](spark, path)
    asked = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, asked.fetchall()))
