"""Sources and sinks: files, HTML, XML, JSON, CSV, listings, releases (A)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans.portable import Suite, joined, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles

# What HTML reading skips and what opens a block.
SKIPPED = frozenset({"nav", "header", "footer", "script", "style", "aside", "noscript", "form", "template", "title"})
BLOCKS = frozenset({"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd", "blockquote", "pre", "caption"})
MAX_BYTES = 25 * 1024 * 1024


class _Blocks(HTMLParser):
    """Text blocks in order, with the tag that holds them; lenient with unclosed tags.

    With ``inside``, only the first element of that name counts.
    """

    def __init__(self, inside: str | None = None):
        super().__init__(convert_charrefs=True)
        self.skip, self.tag, self.words, self.found = 0, "", [], []
        self.inside, self.depth, self.over = inside, 0, False

    @property
    def off(self) -> bool:
        return bool(self.skip) or (self.inside is not None and (self.over or not self.depth))

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.found.append((self.tag or "text", text))
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag == self.inside and not self.over:
            self.words = self.words if self.depth else []
            self.depth += 1
        if tag in SKIPPED:
            self.flush()
            self.skip += 1
        elif tag in BLOCKS or tag in ("div", "section", "main", "article", "br", "tr", "ul", "ol", "table", "body"):
            self.flush()
            self.tag = tag if tag in BLOCKS else ""

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.flush()
            self.skip -= 1
        elif tag in BLOCKS or tag in ("div", "section", "main", "article"):
            self.flush()
            self.tag = ""
        if tag == self.inside and self.depth and not self.over:
            self.depth -= 1
            self.over = not self.depth

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """Tag and text of each block: of the first ``main``, else of the first ``article``, else of the page."""
    low = (html or "").lower()
    p = _Blocks(next((tag for tag in ("main", "article") if f"<{tag}" in low), None))
    p.feed(html or "")
    p.close()
    p.flush()
    return p.found


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, pos, tag, text``: blocks of each page; parsing has no built-in, so it runs on Arrow batches."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, t, x) for k, h in zip(f[key], f[html], strict=True) for i, (t, x) in enumerate(blocks_of(h))]
            yield pd.DataFrame(rows, columns=[key, "pos", "tag", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, tag string, text string")


def heading_tree(blocks: DataFrame, key: str) -> DataFrame:
    """Each block with the last heading before it: a running window within the page."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("heading", F.last(F.when(F.col("tag").rlike("^h[1-6]$"), F.col("text")), ignorenulls=True).over(w))


def outline(blocks: list[tuple[str, str]], provision: re.Pattern | None = None) -> list[tuple]:
    """``pos, parent, kind, ref, label, text`` of a page's nodes, in order.

    Headings nest by their level and are groups of provisions, or sections
    where nothing is numbered.  A block that ``provision`` (with a group
    ``ref``) matches opens a provision; if its ref is taken it stays a
    paragraph.  Other blocks belong to the open provision, else to the last
    heading.  A page with neither is one section, at position -1.
    """
    numbered = [provision.match(text) if provision else None for _, text in blocks]
    heads: list[tuple[int, int]] = []
    taken, out, opened = set(), [], None
    for pos, ((tag, text), match) in enumerate(zip(blocks, numbered, strict=True)):
        level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0
        if level and not match:
            heads = [h for h in heads if h[0] < level]
            out.append((pos, heads[-1][1] if heads else None, "group" if any(numbered) else "section", f"html/{pos}", None, text))
            heads.append((level, pos))
            opened = None
        elif match and (ref := " ".join(match["ref"].split())) not in taken:
            taken.add(ref)
            out.append((pos, heads[-1][1] if heads else None, "provision", ref, text[: match.end()].strip(), text[match.end():].strip()))
            opened = pos
        else:
            above = opened if opened is not None else heads[-1][1] if heads else None
            out.append((pos, above, "paragraph", None, None, text))
    if out and not any(numbered) and not any(n[2] == "section" for n in out):
        out = [(-1, None, "section", "document", None, ""), *((pos, -1, *rest) for pos, _, *rest in out)]
    return out


def html_tree(pages: DataFrame, key: str, html: str, provision: str | None = None) -> DataFrame:
    """``key, pos, parent, kind, ref, label, text``: see :func:`outline`; a page without text has no node."""
    kind, pattern = pages.schema[key].dataType.simpleString(), re.compile(provision) if provision else None
    names = [key, "pos", "parent", "kind", "ref", "label", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *node) for k, h in zip(f[key], f[html], strict=True) for node in outline(blocks_of(h), pattern)]
            yield pd.DataFrame(rows, columns=names).astype({"parent": "Int64"})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos long, parent long, kind string, ref string, label string, text string")


def kind_of(content: Column, name: Column) -> Column:
    """pdf by its magic, html by name or doctype, else text."""
    head = F.lower(F.substring(F.ltrim(content), 1, 200))
    return F.when(F.substring(content, 1, 5) == "%PDF-", "pdf").when(F.lower(name).rlike(r"\.html?$") | head.startswith("<!doctype html") | head.startswith("<html"), "html").otherwise("text")


def local_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Files below ``root`` only; one of more than 25 MB fails the job that reads it."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    if real != base and not real.startswith(base + os.sep):
        raise ValueError(f"{path} is outside {root}")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(real).where(
        F.when(F.col("length") > MAX_BYTES, F.raise_error(F.concat(F.col("path"), F.lit(f" has more than {MAX_BYTES} bytes")))).otherwise(True))


def store_artifacts(df: DataFrame, body: str, path: str) -> None:
    """Content-addressed: a file for each first byte of the hash; equal contents once."""
    hashed = df.withColumn("content_hash", F.sha2(F.col(body), 256)).dropDuplicates(["content_hash"])
    hashed.withColumn("shard", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def publish(df: DataFrame, path: str, release: str) -> None:
    """A release: rows as Parquet and JSON, and a manifest row."""
    df.write.mode("overwrite").parquet(f"{path}/{release}/parquet")
    df.write.mode("overwrite").json(f"{path}/{release}/json")
    df.agg(F.count("*").alias("rows")).withColumn("release", F.lit(release)).coalesce(1).write.mode("overwrite").json(f"{path}/{release}/manifest")


@S.checked("a03_html_blocks")
def _a03(spark, sf_dir):
    return html_blocks(relation(spark, sf_dir, "pages"), "page_id", "html")


@S.checked("a04_html_heading_tree", """
    WITH a AS (SELECT *, 1 + coalesce(sum(CASE shape WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 3 END) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM {article}),
    h AS (SELECT *, coalesce(max(CASE WHEN shape = 0 THEN base END) OVER w, 0) AS h2, coalesce(max(CASE WHEN shape <> 1 THEN base END) OVER w, 0) AS head FROM a WINDOW w AS (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT DISTINCT doc, 0::BIGINT AS pos, NULL::BIGINT AS parent, 'group' AS kind, 'html/0' AS ref, NULL AS label, concat('Orders of customer ', doc) AS text FROM a
    UNION ALL SELECT doc, base, CASE shape WHEN 0 THEN 0 ELSE h2 END, 'group', concat('html/', base), NULL, concat('Order ', k) FROM h WHERE shape <> 1
    UNION ALL SELECT doc, base + CASE shape WHEN 1 THEN 0 ELSE 1 END, head, 'provision', i::VARCHAR, concat('Article ', i, '.'), CASE shape WHEN 0 THEN concat('The depot shall keep & file order ', k, '.') WHEN 1 THEN concat('The carrier must not open order ', k, '.') ELSE 'Weigh it.' END FROM h
    UNION ALL SELECT doc, base + 2, base + 1, 'paragraph', NULL, NULL, CASE shape WHEN 0 THEN 'name the carrier' ELSE concat('Article ', i, '. Cited again.') END FROM h WHERE shape <> 1
    UNION ALL SELECT doc, base + 3, base + 1, 'paragraph', NULL, NULL, concat('state the priority ', priority) FROM h WHERE shape = 0""")
def _a04(spark, sf_dir):
    return html_tree(relation(spark, sf_dir, "web_page"), "doc", "html", r"Article (?P<ref>[0-9]+)\.\s")


@S.checked("a02_sniff_kind", "SELECT page_id, CASE WHEN lower(html) LIKE '<!doctype html%' OR lower(html) LIKE '<html%' THEN 'html' ELSE 'text' END AS kind FROM {pages}")
def _a02(spark, sf_dir):
    return relation(spark, sf_dir, "pages").select("page_id", kind_of(F.col("html"), F.lit("page")).alias("kind"))


@S.checked("a09_xml_records", "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM {nation}")
def _a09(spark, sf_dir):
    xml = F.concat(F.lit("<act id='"), F.col("n_nationkey").cast("string"), F.lit("'><name>"), F.col("n_name"), F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></act>"))
    parsed = relation(spark, sf_dir, "nation").select(F.from_xml(xml, "_id long, name string, region long").alias("x"))
    return parsed.select(F.col("x._id").alias("id"), "x.name", "x.region")


@S.checked("a13_json_controls", "SELECT p_brand AS family, p_partkey AS control, p_name AS title FROM {part}")
def _a13(spark, sf_dir):
    docs = relation(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.col("p_brand").alias("family"), F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))).alias("controls"))).alias("doc"))
    parsed = docs.select(F.from_json("doc", "family string, controls array<struct<id: long, title: string>>").alias("d"))
    return parsed.select("d.family", F.explode("d.controls").alias("c")).select("family", F.col("c.id").alias("control"), F.col("c.title").alias("title"))


@S.checked("a15_json_pointers", "SELECT event_id, '/k' AS pointer, json_extract_string(props, '$.k') AS value FROM {events}")
def _a15(spark, sf_dir):
    """Nodes of a JSON document by pointer; the document stays a VARIANT until it is asked."""
    v = relation(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"))
    return spark.sql("SELECT event_id, concat('/', key) AS pointer, cast(value AS STRING) AS value FROM {nodes}, LATERAL variant_explode(v)", nodes=v)


@S.checked("a16_xml_nodes", "SELECT r_regionkey::BIGINT AS id, r_name AS name, '2' AS items FROM {region}")
def _a16(spark, sf_dir):
    xml = F.concat(F.lit("<doc><title>"), F.col("r_name"), F.lit("</title><p>one</p><p>two</p></doc>"))
    return relation(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.xpath_string(xml, F.lit("doc/title")).alias("name"), F.size(F.xpath(xml, F.lit("doc/p/text()"))).cast("string").alias("items"))


@S.checked("a17_csv_lists", "SELECT s_suppkey AS id, f AS field_, v AS value FROM (SELECT s_suppkey, 'name' AS f, s_name AS v FROM {supplier} UNION ALL SELECT s_suppkey, 'nation', s_nationkey::VARCHAR FROM {supplier}) x")
def _a17(spark, sf_dir):
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))
    rows = relation(spark, sf_dir, "supplier").select(F.from_csv(line, "id long, name string, nation string").alias("r")).select("r.*")
    return rows.unpivot("id", ["name", "nation"], "field_", "value")


S.portable("a18_record_fields", "SELECT c_custkey AS id, 'segment' AS field_, c_mktsegment AS value FROM {customer} UNION ALL SELECT c_custkey, 'name', c_name FROM {customer}")


@S.checked("a19_listing_items", "SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)) AS href FROM {pages}")
def _a19(spark, sf_dir):
    return relation(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1))).alias("href"))


@S.checked("a27_page_regions", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM {pages}")
def _a27(spark, sf_dir):
    return relation(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


S.portable("a21_numbered_provisions", "SELECT clause_id, regexp_extract(heading, 'Section ([0-9]+)', 1) AS number FROM {clause} WHERE heading LIKE 'Section %'")
S.portable("a24_rule_status", "SELECT status, count(*) AS rules, status IN ('R', 'D') AS binding FROM (SELECT CASE clause_id % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'G' WHEN 2 THEN 'E' ELSE 'D' END AS status FROM {clause}) x GROUP BY status")
S.portable("a31_numbering_schemes", "SELECT c.clause_id, s.scheme FROM {clause} c JOIN (SELECT 'Section %' AS shape, 'section' AS scheme UNION ALL SELECT 'Scope%', 'untitled') s ON c.heading LIKE s.shape")
S.portable("a32_restricted_sources", "SELECT clause_id, source_key, CASE WHEN source_key IN ('SRC-03', 'SRC-07') THEN NULL ELSE text END AS text, [[sha2(text, 256)||sha256(text)]] AS text_hash FROM {clause}")
S.portable("a36_source_upsert", "SELECT key, id, body FROM (SELECT concat('src/', cast(record_id AS VARCHAR(19))) AS key, id, state AS body, row_number() OVER (PARTITION BY record_id ORDER BY valid_from DESC, id DESC) AS n FROM {history}) x WHERE n = 1")
S.portable("a37_scope_registry", "SELECT DISTINCT c.source_key FROM {clause} c WHERE c.source_key IN (SELECT concat('SRC-', lpad(cast(n_nationkey AS VARCHAR(9)), 2, '0')) FROM {nation} WHERE n_regionkey = 1)")
S.portable("a38_artifact_store", "SELECT [[sha2(text, 256)||sha256(text)]] AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM {documents} GROUP BY text")
S.portable("a40_release_manifest", f"SELECT source_key, count(*) AS rows_, [[sha2(||sha256(]]{joined('stable_id')}[[, 256)||)]] AS digest FROM {{obligation}} GROUP BY source_key")
S.portable("a41_scope_release", "SELECT o.obligation_id, o.stable_id FROM {obligation} o WHERE o.source_key IN ('Brand#1', 'Brand#5') AND NOT EXISTS (SELECT 1 FROM {requires} r JOIN {block} b ON b.block_id = r.block_id WHERE r.obligation_id = o.obligation_id AND b.block_id = 3)")
S.portable("a42_viewer_snapshot", "SELECT clause_id, ref, CASE WHEN clause_id % 10 <> 0 THEN text END AS text, CASE WHEN clause_id % 10 <> 0 THEN heading END AS heading FROM {clause}")


@S.checked("a43_json_export", "SELECT s_suppkey, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}' AS doc FROM {supplier}")
def _a43(spark, sf_dir):
    return relation(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("doc"))


S.portable("a44_atom_entries", "SELECT event_id, concat('<entry><id>urn:event:', cast(event_id AS VARCHAR(19)), '</id><title>', event_type, '</title></entry>') AS entry FROM {events}")
