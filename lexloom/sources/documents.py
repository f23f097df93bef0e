"""Documents of any kind to clauses: rendering, reading by kind, and import against what is stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.plans import segment
from lexloom.plans.portable import Suite, relation
from lexloom.sources import readers

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles

CONTROL = frozenset(range(32)) - {9, 10, 12, 13}


def render(content: bytes | None, name: str = "") -> tuple[str, str | None, str | None]:
    """``kind, text, error`` of a file's bytes: text is UTF-8 (with or without a mark), else Windows-1252; control characters are refused."""
    body = bytes(content or b"")
    head = body.lstrip()[:200].lower()
    if body.startswith(b"%PDF-"):
        return "pdf", None, "no reader for PDF is installed"
    kind = "html" if name.lower().endswith((".html", ".htm")) or head.startswith((b"<!doctype html", b"<html")) else "text"
    try:
        text = body.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = body.decode("cp1252", "replace")
    if any(ord(c) in CONTROL for c in text):
        return kind, None, "binary, not text"
    return (kind, text, None) if text.strip() else (kind, None, "no text")


def rendered(files: DataFrame, key: str, content: str, name: str) -> DataFrame:
    """``key, kind, text, error`` of each file; a null content is empty."""
    type_ = files.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, *render(c, n or "")) for k, c, n in zip(f["_key"], f["_content"], f["_name"], strict=True)]
            yield pd.DataFrame(out, columns=[key, "kind", "text", "error"])

    chosen = files.select(F.col(key).alias("_key"), F.col(content).cast("binary").alias("_content"), F.col(name).alias("_name"))
    return chosen.mapInPandas(run, f"{key} {type_}, kind string, text string, error string")


def _plain(texts: DataFrame, key: str) -> DataFrame:
    blocks = segment.blocks(segment.lines(texts, key, F.col("text")), key)
    return segment.tree(blocks, key).join(blocks, [key, "seq"]).select(key, "seq", "parent", F.when(F.col("kind") == "paragraph", "clause").otherwise("heading").alias("kind"), "ref", "text")


def _page(texts: DataFrame, key: str) -> DataFrame:
    nodes = readers.html_tree(texts, key, "text")
    return nodes.select(key, F.col("pos").alias("seq"), "parent", F.when(F.col("kind").isin("paragraph", "provision"), "clause").otherwise("heading").alias("kind"), F.coalesce("ref", F.concat(F.lit("html/"), F.col("pos").cast("string"))).alias("ref"), "text")


#: Readers by kind: ``(texts, key) -> key, seq, parent, kind, ref, text``.
READERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"text": _plain, "html": _page}


def reader(kind: str) -> Callable[[DataFrame, str], DataFrame]:
    if kind not in READERS:
        raise KeyError(f"no reader for {kind!r}; known are {', '.join(sorted(READERS))}")
    return READERS[kind]


def clauses(texts: DataFrame, key: str) -> DataFrame:
    """Nodes of all rendered documents, each by its kind's reader; those that failed have none."""
    good = texts.where("error is null")
    out = None
    for kind in sorted(READERS):
        part = reader(kind)(good.where(F.col("kind") == kind), key)
        out = part if out is None else out.unionByName(part)
    return out


def imported(texts: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``key, state, reason``: added, unchanged, amended or failed, against ``stored(key, text_hash)``.

    What is stored and not imported again is not mentioned.
    """
    now = texts.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("_hash"), "error")
    both = now.join(stored.select(key, F.col("text_hash").alias("_old")), key, "left")
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("_hash"), "unchanged").otherwise("amended")
    return both.select(key, state.alias("state"), F.col("error").alias("reason"))


def _files(spark, sf_dir):
    """A regulation or a page for each customer; some files are empty, binary or PDF."""
    text = relation(spark, sf_dir, "regulation").where("doc % 2 = 0").select("doc", F.col("text").alias("body"))
    page = relation(spark, sf_dir, "web_page").where("doc % 2 = 1").select("doc", F.col("html").alias("body"))
    broken = F.when(F.col("doc") % 50 == 8, F.lit(" \n")).when(F.col("doc") % 50 == 9, F.concat(F.lit("\0"), F.col("body"))).when(F.col("doc") % 50 == 11, F.concat(F.lit("%PDF-1.7 "), F.col("body"))).otherwise(F.col("body"))
    return text.union(page).select("doc", broken.cast("binary").alias("content"), F.concat(F.lit("file-"), F.col("doc").cast("string")).alias("name"))


@S.checked("a08_document_import", """
    SELECT doc, CASE WHEN doc % 50 IN (8, 9, 11) THEN 'failed' WHEN doc % 5 = 0 THEN 'added' WHEN doc % 7 = 1 THEN 'amended' ELSE 'unchanged' END AS state,
        CASE doc % 50 WHEN 8 THEN 'no text' WHEN 9 THEN 'binary, not text' WHEN 11 THEN 'no reader for PDF is installed' END AS reason FROM {regulation}""")
def _a08(spark, sf_dir):
    """Imported again after one in five was forgotten and one in seven had another text."""
    texts = rendered(_files(spark, sf_dir), "doc", "content", "name")
    stored = texts.where("doc % 5 <> 0").select("doc", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc") % 7 == 1, "x").otherwise("")), 256).alias("text_hash"))
    return imported(texts, stored, "doc")


@S.checked("a33_reader_by_kind", """
    SELECT doc, count(*) FILTER (WHERE shape < 3) + 0 * count(*) AS articles, sum(CASE WHEN doc % 2 = 0 THEN CASE shape WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 2 END ELSE CASE shape WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END END)::BIGINT AS clauses
    FROM {article} WHERE doc % 50 NOT IN (8, 9, 11) GROUP BY doc""")
def _a33(spark, sf_dir):
    """Clauses of each document by its kind's reader, and its articles."""
    nodes = clauses(rendered(_files(spark, sf_dir), "doc", "content", "name"), "doc").where("kind = 'clause'").groupBy("doc").agg(F.count("*").alias("clauses"))
    return nodes.join(relation(spark, sf_dir, "article").groupBy("doc").agg(F.count("*").alias("articles")), "doc")
