"""Corpora of files: Markdown and DOCX to blocks, assembled documents, a registry by extension."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "document_id string, position int, kind string, section string, text string"


def stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of .md and .markdown files (IO-08)."""
    t = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{md,markdown}", recursiveFileLookup=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _inline(text: str) -> str:
    """Without emphasis, code ticks and link targets."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"(\*\*|__|`|\*|(?<!\w)_|_(?!\w))", "", text).strip()


def markdown_lines(content: str) -> list[tuple[str, str, str]]:
    """(kind, section, text) of one document: front matter skipped, fenced code kept together, headings
    up to six levels as the section path, list and quote marks removed, lines of a paragraph joined."""
    lines = content.replace("\r\n", "\n").split("\n")
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        lines = lines[2 + [x.strip() for x in lines[1:]].index("---") :]
    path: list[str] = []
    out: list[tuple[str, str, str]] = []
    para: list[str] = []
    code: list[str] | None = None

    def close():
        if para:
            out.append(("paragraph", " / ".join(filter(None, path)), _inline(" ".join(para))))
            para.clear()

    for line in lines:
        if re.match(r"\s*(```|~~~)", line):
            if code is None:
                close()
                code = []
            else:
                out.append(("code", " / ".join(filter(None, path)), "\n".join(code)))
                code = None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            level = len(m[1])
            path[level - 1 :] = [""] * max(0, level - 1 - len(path)) + [_inline(m[2])]
            out.append(("heading", " / ".join(filter(None, path)), _inline(m[2])))
        elif not line.strip():
            close()
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            close()
            out.append(("list", " / ".join(filter(None, path)), _inline(m[1])))
        else:
            para.append(re.sub(r"^\s*>\s?", "", line).strip())
    if code is not None:
        out.append(("code", " / ".join(filter(None, path)), "\n".join(code)))
    close()
    return [x for x in out if x[2]]


def _blocks(rows: Iterator[pd.DataFrame], parse: Callable) -> Iterator[pd.DataFrame]:
    for batch in rows:
        found = [(d, k, *b) for d, c in zip(batch["document_id"], batch["content"], strict=True) for k, b in enumerate(parse(c))]
        yield pd.DataFrame(found, columns=["document_id", "position", "kind", "section", "text"])


def markdown_blocks(files: DataFrame) -> DataFrame:
    """Blocks of Markdown documents (T-10). files: path, content."""
    return files.select(stem().alias("document_id"), "content").mapInPandas(lambda it: _blocks(it, markdown_lines), BLOCKS)


#: The word-processing name space; a fixed value of the file format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks_of(data: bytes) -> list[tuple[str, str, str]]:
    """(kind, section, text) of a DOCX file: headings as sections, paragraphs, table rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    path: list[str] = []
    out = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t")).strip()
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            if (m := re.fullmatch(r"[Hh]eading([1-6])", name)) and text(e):
                path[int(m[1]) - 1 :] = [""] * max(0, int(m[1]) - 1 - len(path)) + [text(e)]
                out.append(("heading", " / ".join(filter(None, path)), text(e)))
            else:
                out.append(("paragraph", " / ".join(filter(None, path)), text(e)))
        elif e.tag == f"{W}tbl":
            out += [("table", " / ".join(filter(None, path)), " | ".join(text(c) for c in r.iter(f"{W}tc"))) for r in e.iter(f"{W}tr")]
    return [x for x in out if x[2]]


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the .docx files of a folder, parsed where they are read (IO-09)."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(folder)
    return f.select(stem().alias("document_id"), "content").mapInPandas(lambda it: _blocks(it, docx_blocks_of), BLOCKS)


def assemble_documents(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(document_id, title, content): title as given, else the first heading, else the id (IO-10)."""
    d = blocks.groupBy("document_id").agg(
        F.min_by("text", F.when(F.col("kind") == "heading", F.col("position"))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda b: b["text"]), "\n\n").alias("content"),
    )
    d = d.join(titles, "document_id", "left") if titles is not None else d.withColumn("given", F.lit(None).cast("string"))
    return d.select("document_id", F.coalesce(F.nullif("given", F.lit("")), "heading", "document_id").alias("title"), "content")


#: Readers by extension (X-01): (spark, folder) -> blocks; `register` adds to them.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "md": lambda spark, folder: markdown_blocks(read_markdown(spark, folder)),
    "docx": read_docx,
}


def register(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[extension.lstrip(".").lower()] = reader


def read_blocks(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "docx")) -> DataFrame:
    """Blocks of all registered kinds of files in a folder."""
    out = None
    for x in extensions:
        b = READERS[x](spark, folder)
        out = b if out is None else out.unionByName(b)
    return out
