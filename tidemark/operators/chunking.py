"""Texts to chunks: packed paragraphs, overlapping windows, sections, and chunk vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import embed_tokens, let, tokens

LIMIT, MOST, WINDOW, OVERLAP = 800, 200, 180, 20


def paragraphs(x) -> Column:
    """Trimmed, non-empty, blank-line separated."""
    x = F.col(x) if isinstance(x, str) else x
    lines = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(F.transform(F.split(lines, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def packed(x, limit: int = LIMIT, most: int = MOST) -> Column:
    """Paragraphs packed in order up to `limit` characters; longer ones are cut; `most` chunks at most (T-06).

    As in the service it follows, the separator is still counted for a piece that opens a chunk because
    it did not fit into the one before.
    """
    cut = F.transform(paragraphs(x), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / limit).cast("int")), lambda k: F.substring(p, k * limit + 1, F.lit(limit))))
    pieces = F.flatten(cut)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("len"))

    def step(s, p):
        gap = F.when(s["cur"] == "", 0).otherwise(2)
        n = F.char_length(p)
        full = s["len"] + gap + n > limit
        out = full & (s["cur"] != "")
        return F.struct(
            F.when(out, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["cur"] == ""), p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p)).alias("cur"),
            F.when(full, gap + n).otherwise(s["len"] + gap + n).cast("int").alias("len"),
        )

    end = F.aggregate(pieces, start, step)
    chunks = F.concat(end["done"], F.when(end["cur"] != "", F.array(end["cur"])).otherwise(F.array().cast("array<string>")))
    return F.slice(chunks, 1, most)


def chunk_paragraphs(docs: DataFrame, limit: int = LIMIT, most: int = MOST) -> DataFrame:
    """(document_id, position, chunk)."""
    return docs.select("document_id", F.posexplode(packed("content", limit, most)).alias("position", "chunk"))


def message_blocks(messages: DataFrame) -> DataFrame:
    """A chat message as a document of one paragraph block (X-04). messages: document_id, text."""
    return messages.select("document_id", F.lit(0).alias("position"), F.lit("paragraph").alias("kind"), F.lit("").alias("section"), F.trim("text").alias("text")).where("text <> ''")


def windows(x, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters, each `overlap` into the last (T-07)."""
    step = size - overlap
    assert 0 <= overlap <= step, "a window may reach into the next one only"
    x = F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"^\s+|\s+$", "")

    def cut(s: Column) -> Column:
        """From pieces of `step` characters, found in one pass: each with the beginning of the next."""
        p, n = s["p"], (F.size(s["p"]) - 1) * step + F.char_length(F.element_at(s["p"], -1))
        last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.concat(F.get(p, k), F.coalesce(F.substring(F.get(p, k + 1), 1, overlap), F.lit(""))))

    pieces = F.regexp_extract_all(x, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return let(F.struct(pieces.alias("p")), lambda s: F.when(F.size(s["p"]) > 0, cut(s)).otherwise(F.array().cast("array<string>")))


def chunk_windows(docs: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, position, chunk): trimmed windows; a blank one is left out but keeps its position."""
    w = docs.select("document_id", F.posexplode(windows("content", size, overlap)).alias("position", "piece"))
    return w.select("document_id", "position", F.regexp_replace("piece", r"^\s+|\s+$", "").alias("chunk")).where("chunk <> ''")


def section_runs(blocks: DataFrame) -> DataFrame:
    """Adds `run`: the number of a document's stretch of consecutive blocks with one section (W-07).

    blocks: document_id, position, section, text.
    """
    w = Window.partitionBy("document_id").orderBy("position")
    return blocks.withColumn("new", (~F.col("section").eqNullSafe(F.lag("section").over(w))).cast("int")).withColumn("run", F.sum("new").over(w)).drop("new")


def chunk_sections(blocks: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Consecutive blocks of a section joined, cut into windows, prefixed by the section and numbered
    through the document (T-08)."""
    joined = section_runs(blocks).groupBy("document_id", "run", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda b: b["text"]), "\n").alias("content"))
    w = joined.select("document_id", "run", "section", F.posexplode(windows("content", size, overlap)).alias("k", "piece"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("run", "k")) - 1
    label = F.when(F.coalesce("section", F.lit("")) != "", F.concat("section", F.lit("\n"), F.trim("piece"))).otherwise(F.trim("piece"))
    return w.select("document_id", number.alias("position"), "section", label.alias("chunk"))


def plain_blocks(x) -> Column:
    """Paragraphs without control characters, white space joined (T-11)."""
    x = F.col(x) if isinstance(x, str) else x
    clean = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.filter(F.transform(paragraphs(clean), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def document_vectors(docs: DataFrame) -> DataFrame:
    """(document_id, position, vector): the first chunk is embedded with title and summary; a chunk
    without tokens takes the whole text; a document without any has no vector (T-13)."""
    head, none = F.concat_ws("\n", "title", "summary"), F.array().cast("array<string>")
    first = tokens(head)

    def of(chunk: Column, i: Column) -> Column:
        """A chunk's tokens, those of title and summary before the first one's."""
        return let(F.when(i == 0, F.concat(first, tokens(chunk))).otherwise(tokens(chunk)), lambda t: F.when(F.size(t) > 0, t).otherwise(F.concat(first, tokens("content"))))

    chunks = let(packed("content"), lambda p: F.when(F.size(p) > 0, F.transform(p, of)).otherwise(F.array(F.concat(first, tokens("content")))))
    t = docs.select("document_id", F.posexplode(F.coalesce(chunks, F.array(first), F.array(none))).alias("position", "t"))
    return t.select("document_id", "position", embed_tokens(F.when(F.size("t") > 0, F.col("t"))).alias("vector")).where("vector is not null")
