"""Text to a tree of nodes: paragraphs, headings, ranks, ancestry and spans."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.functions import text as tx
from lexloom.functions.grammar import staged
from lexloom.plans.fixpoint import settled
from lexloom.plans.portable import Suite, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles

# Words that open divisions and units, the shapes of numbers, and the words of refs.
DIVISION = r"(?i)^(part|title|chapter|book|annex|schedule|appendix|subpart|division)\s+([0-9]+[a-z]?|[ivxlcdm]+|[a-z])\b[.:]?(?:\s|$)"
UNIT = r"(?i)^(article|art\.|section|sec\.|§+|rule|clause|regulation|standard|requirement|control|principle)\s*([0-9]+(?:\.[0-9]+)*[a-z]?(?:-[0-9]+)?|[ivxlcdm]+)\b[.:]?"
NUMBERED_HEADING = r"^(\d{1,3}(?:\.\d{1,3}){0,5})\.?\s+([A-Z][^.;:!?]{1,118})$"
ENUMERATOR = r"(?i)^(?:\(([0-9]{1,3}[a-z]?|[a-z]{1,2}|[ivxlc]{1,6})\)|([0-9]{1,3}(?:\.[0-9]{1,3}){0,4})[.)]\s|([a-z])\)\s|§\s*([0-9]+[a-z]?))"
BULLET = r"^[-•*–]\s"
SENTENCE_END = r"[.;:!?][\"'’”)\]]*$"
MODAL = r"(?i)\b(?:shall|must|may|should|will|is required|are required)\b"
REF_WORDS = {
    "article": "art", "art.": "art", "section": "sec", "sec.": "sec", "§": "sec", "rule": "rule", "clause": "cl", "regulation": "reg", "standard": "std",
    "requirement": "req", "control": "ctl", "principle": "prin", "part": "part", "title": "title", "chapter": "ch", "book": "book", "annex": "annex",
    "schedule": "sch", "appendix": "app", "subpart": "subpart", "division": "div",
}
LONG, LINE, TITLE, REST, WORDS = 1200, 160, 120, 90, 12


def lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, pos, line``: all lines, blank ones too, without white space at their ends."""
    parts = F.split(F.regexp_replace(text, r"\r\n?|\f", "\n"), "\n")
    return docs.select(key, F.posexplode(parts).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def _after(line: Column, pattern: str) -> Column:
    """What follows a marker, without separators."""
    return F.regexp_replace(F.regexp_replace(line, pattern, ""), r"^[ .:–—-]+|[ .:–—-]+$", "")


def marked_heading(line: Column) -> Column:
    """A division, or a unit with nothing but a title after it."""
    rest = _after(line, UNIT)
    unit = line.rlike(UNIT) & ((rest == "") | (~rest.rlike(MODAL) & (~line.rlike(SENTENCE_END) | (F.length(rest) < REST))))
    return (F.length(line) <= LINE) & (line.rlike(DIVISION) | unit)


def numbered_heading(line: Column) -> Column:
    """A number and a short title, where no unit is named."""
    title = F.regexp_extract(line, NUMBERED_HEADING, 2)
    return (F.length(line) <= LINE) & ~line.rlike(DIVISION) & ~line.rlike(UNIT) & (title != "") & (F.size(F.split(F.trim(title), r"\s+")) <= WORDS) & ~line.rlike(MODAL)


def is_heading(line: Column) -> Column:
    return marked_heading(line) | numbered_heading(line)


def paragraphs(df: DataFrame, key: str) -> DataFrame:
    """``key, seq, lines, head`` from :func:`lines`: gaps and islands.

    A line opens a block after a blank line, if it carries a marker, or if the
    block before was closed by being a heading.  Whether a numbered line closes
    its block depends on whether it opened it, which runs of such lines hand
    on: the first line of a run decides for all.  Blocks of more than 1,200
    characters end at sentence ends after 600.
    """
    w = Window.partitionBy(key).orderBy("pos")
    line = F.col("line")
    marked = line.rlike(ENUMERATOR) | line.rlike(BULLET) | line.rlike(DIVISION) | (line.rlike(UNIT) & (F.length(line) <= LINE))
    flagged = staged(df, {"marked": marked, "heads": marked_heading(line), "numbers": numbered_heading(line)})
    before = lambda c, default: F.lag(c, 1, default).over(w)
    flagged = flagged.withColumns({"opens": F.col("marked") | (before("line", "") == "") | before("heads", False), "handed": before("numbers", False)})
    decides = F.when(~F.col("handed") | F.col("opens"), F.col("opens"))
    flagged = flagged.withColumn("first", F.last(decides, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbered = flagged.where("line <> ''").withColumn("block", F.sum(F.col("first").cast("int")).over(w))
    whole = numbered.groupBy(key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"), F.bool_or((F.col("heads") | F.col("numbers")) & F.col("first")).alias("head"))
    cut = whole.select(key, "block", "head", F.posexplode(_split_long(F.col("lines"))).alias("i", "lines"))
    return cut.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("block", "i")).cast("long")).select(key, "seq", "lines", "head")


def _split_long(lines_: Column) -> Column:
    size = F.aggregate(lines_, F.lit(0), lambda n, x: n + F.length(x))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("now"), F.lit(0).alias("n"))

    def step(state, x):
        now, n = F.concat(state["now"], F.array(x)), state["n"] + F.length(x)
        ends = (n >= LONG // 2) & x.rlike(SENTENCE_END)
        return F.struct(F.when(ends, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"), F.when(ends, none).otherwise(now).alias("now"), F.when(ends, 0).otherwise(n).alias("n"))

    split = F.aggregate(lines_, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
    return F.when(size <= LONG, F.array(lines_)).otherwise(split)


def _marker(first: Column, pattern: str) -> Column:
    """A ref's own words: ``art-5`` of "Article 5"."""
    word = F.regexp_replace(F.lower(F.regexp_extract(first, pattern, 1)), "^§+$", "§")
    short = F.create_map(*[F.lit(x) for pair in REF_WORDS.items() for x in pair])
    return F.concat_ws("-", F.try_element_at(short, word), tx.slug(F.regexp_extract(first, pattern, 2)))


def blocks(df: DataFrame, key: str) -> DataFrame:
    """Classified blocks ``key, seq, kind, rank, hint, heading, text``, numbered from 1.

    A division has rank 0, a unit 1 and one more for each dot of its number, a
    paragraph that names a unit 1, an item -1, others 2.  A bare marker takes a
    plain, short line after it as its title.  Null and empty documents have no
    block.
    """
    p = paragraphs(df, key).withColumn("first", F.col("lines")[0])
    first = F.col("first")
    w = Window.partitionBy(key).orderBy("seq")
    division, unit, listed = first.rlike(DIVISION), first.rlike(UNIT), first.rlike(ENUMERATOR)
    number = F.coalesce(*[F.nullif(F.regexp_extract(first, ENUMERATOR, i), F.lit("")) for i in (1, 2, 3, 4)], F.lit(""))
    dots = lambda x: F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))
    own = F.regexp_extract(first, NUMBERED_HEADING, 1)
    hint = (
        F.when(F.col("head") & division, _marker(first, DIVISION)).when(F.col("head") & unit, _marker(first, UNIT)).when(F.col("head"), tx.slug(own))
        .when(listed, tx.slug(number)).when(unit, _marker(first, UNIT))
    )
    rank = (
        F.when(F.col("head") & division, 0).when(F.col("head") & unit, 1 + dots(F.regexp_extract(first, UNIT, 2))).when(F.col("head"), 1 + dots(own))
        .when(listed & F.regexp_extract(first, ENUMERATOR, 1).rlike("^[a-zA-Z]"), -1).when(~listed & unit, 1).otherwise(2)
    )
    kind = F.when(F.col("head") & division, "division").when(F.col("head"), "unit").otherwise("paragraph")
    bare = F.col("head") & F.when(division, _after(first, DIVISION) == "").otherwise(unit & (_after(first, UNIT) == ""))
    plain = ~F.col("head") & (F.size("lines") == 1) & (F.length(first) <= TITLE) & ~listed & ~unit & ~first.rlike(SENTENCE_END) & ~first.rlike(MODAL)
    read = staged(p, {"kind": kind, "rank": rank, "hint": hint, "bare": bare, "plain": plain})
    read = read.withColumns({"title": F.col("plain") & F.lag("bare", 1, False).over(w), "next": F.when(F.lead("plain", 1, False).over(w) & F.col("bare"), F.lead("first").over(w))})
    kept = read.where("not title").withColumn("seq", F.row_number().over(w).cast("long"))
    text = F.concat_ws("\n", F.array_join("lines", "\n"), F.col("next"))
    return kept.select(key, "seq", "kind", "rank", "hint", F.coalesce("next", F.lit("")).alias("heading"), text.alias("text"))


def _placed(rows):
    """``seq, parent, ref, depth`` of one document's blocks ``seq, kind, rank, hint, text``, which are in order: a stack of ranks."""
    above: list[tuple[int, int]] = []  # rank and seq of the open headings
    names: dict[int | None, str] = {None: ""}
    depth: dict[int | None, int] = {None: -1}
    places: dict[int | None, int] = {}
    taken: dict[str, int] = {}
    lead = None
    for seq, kind, rank, hint, text in rows:
        head = kind != "paragraph"
        if head or rank == 1:
            above = [h for h in above if h[0] < rank]
        parent = above[-1][1] if above else None
        local = hint or ""
        if head:
            ref = local
        else:
            if rank == -1 and lead is not None and lead[0] == parent:
                parent = lead[1]
            places[parent] = places.get(parent, 0) + 1
            local = local or f"p{places[parent]}"
            ref = local if parent is None or rank == 1 else f"{names[parent]}/{local}"
        free = ref
        if ref in taken:  # numbers only grow, so the search goes on where it ended
            n = next(n for n in count(taken[ref] + 1) if f"{ref}-{n}" not in taken)
            taken[ref], free = n, f"{ref}-{n}"
        taken[free] = 1
        names[seq], depth[seq] = free, depth[parent] + 1
        yield seq, parent, free, depth[seq]
        if head:
            above.append((rank, seq))
        elif rank != -1:
            lead = (parent, seq) if text.rstrip().endswith((":", "—", "-")) else None


def _documents(batches):
    """Key and rows of each document from batches in the order of key and seq; a document may go over several."""
    now, held, started = None, [], False
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if started and k != now:
                yield now, held
                held = []
            now, started = k, True
            held.append(row)
    if started:
        yield now, held


def _batched(rows, schema: pa.Schema, most: int = 20_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _whole(blocks_: DataFrame, key: str, *more: Column) -> DataFrame:
    return blocks_.select(key, "seq", "kind", "rank", "hint", "text", *more).repartition(key).sortWithinPartitions(key, "seq")


def tree(blocks_: DataFrame, key: str) -> DataFrame:
    """``key, seq, parent, ref, depth``: a stack of ranks for each document.

    The stack is sequential within a document and independent between them; a
    task goes through the documents it holds.  Headings are named by
    themselves.  A paragraph is ``parent/local``, where local is its number or
    its place among the parent's paragraphs; an item belongs to the paragraph
    before it that ends with a colon or dash.  A repeated ref gets the next
    free number.
    """
    kind = blocks_.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("seq", pa.int64()), ("parent", pa.int64()), ("ref", pa.string()), ("depth", pa.int32())])

    def build(batches):
        yield from _batched(((k, *node) for k, rows in _documents(batches) for node in _placed(rows)), schema)

    return _whole(blocks_, key).mapInArrow(build, f"{key} {kind.simpleString()}, seq long, parent long, ref string, depth int")


def clause_context(blocks_: DataFrame, key: str) -> DataFrame:
    """``key, seq, heading, lead`` of each paragraph under a heading that has words: the nearest one, and the text of the paragraph that it is an item of.

    Both are known when a paragraph is reached, so documents are gone through
    once and no ancestor is joined.
    """
    kind = blocks_.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("seq", pa.int64()), ("heading", pa.string()), ("lead", pa.string())])

    def read(rows):
        over: dict[int | None, str] = {None: ""}
        leads: dict[int | None, str | None] = {None: None}
        for (seq, parent, _, _), (_, kind_, _, _, _, heading, lead) in zip(_placed(r[:5] for r in rows), rows):
            over[seq], leads[seq] = heading or over[parent], lead
            if kind_ == "paragraph" and over[parent]:
                yield seq, over[parent], leads[parent]

    def build(batches):
        yield from _batched(((k, *row) for k, rows in _documents(batches) for row in read(rows)), schema)

    lead = F.when(F.col("text").rlike("[:—-]$"), F.col("text")).alias("lead")
    return _whole(blocks_.where(F.col(key).isNotNull()), key, F.col("heading"), lead).mapInArrow(build, f"{key} {kind.simpleString()}, seq long, heading string, lead string")


def span_layout(nodes: DataFrame, key: str) -> DataFrame:
    """``start_, end_`` of each block in the text joined by line breaks: a running sum of lengths."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select(key, "seq", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("start_"), F.length("text").alias("n")).select(key, "seq", "start_", (F.col("start_") + F.col("n")).alias("end_"))


def verify(blocks_: DataFrame, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, chars, exact``: whether the blocks, in order, are the lines of the document, all of them and nothing else.

    A document without blocks is exact only if it has no line.
    """
    back = blocks_.groupBy(key).agg(_in_order("text").alias("_back"))
    own = F.array_join(F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?|\f", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    joined = docs.join(back, key, "left").withColumn("_back", F.coalesce("_back", F.lit("")))
    return joined.select(key, F.length("_back").alias("chars"), (F.col("_back") == own).alias("exact"))


def _in_order(column: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", column))), lambda x: x[column]), "\n")


def descendants(t: DataFrame, key: str) -> DataFrame:
    """``key, seq, below``: each node with itself and all nodes under it; a join for each level, until none is left."""
    t = settled(t)
    edge = t.select(key, F.col("seq").alias("next"), F.col("parent").alias("below"))
    out = level = t.select(key, "seq", F.col("seq").alias("below"))
    while True:
        level = settled(level.join(edge, [key, "below"]).select(key, "seq", F.col("next").alias("below")))
        if level.isEmpty():
            return out
        out = out.union(level)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "regulation")


def _blocks(spark, sf_dir):
    return blocks(lines(_docs(spark, sf_dir), "doc", F.col("text")), "doc")


def _settled_blocks(spark, sf_dir):
    """For queries that read the blocks more than once."""
    return settled(_blocks(spark, sf_dir))


def _tree(spark, sf_dir):
    return tree(_blocks(spark, sf_dir), "doc")


# What the articles' shapes must come to: offsets of an article's blocks, and of their parents (0 is the chapter).
_SHAPES = """
    shape(shape, d, kind, rank, hint, up) AS (VALUES (0, 1, 'unit', 1, NULL, 0), (0, 2, 'paragraph', 2, '1', 1), (0, 3, 'paragraph', 2, '2', 1), (0, 4, 'paragraph', -1, 'a', 3), (0, 5, 'paragraph', -1, 'b', 3),
        (1, 1, 'unit', 1, NULL, 0), (1, 2, 'paragraph', 2, NULL, 1), (2, 1, 'unit', 1, NULL, 0), (2, 2, 'paragraph', 2, '1', 1), (2, 3, 'paragraph', 2, '1', 1)),
    a AS (SELECT *, 1 + coalesce(sum(CASE shape WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 3 END) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM {article}),
    e AS (SELECT DISTINCT doc, 1::BIGINT AS seq, 'division' AS kind, 0 AS rank, 'ch-i' AS hint, NULL::BIGINT AS parent, 'ch-i' AS ref, concat('Orders of customer ', doc) AS heading, concat('CHAPTER I', chr(10), 'Orders of customer ', doc) AS text, 0 AS d, 9 AS shape, 0::BIGINT AS k FROM a
        UNION ALL SELECT doc, base + d, kind, rank, CASE WHEN d = 1 THEN concat('art-', i) ELSE hint END, CASE WHEN up = 0 THEN 1 ELSE base + up END,
            concat('art-', i, CASE WHEN d = 1 THEN '' WHEN a.shape = 0 AND d > 3 THEN concat('/2/', hint) WHEN a.shape = 1 THEN '/p1' WHEN a.shape = 2 AND d = 3 THEN '/1-2' ELSE concat('/', hint) END),
            CASE WHEN d = 1 AND a.shape <> 1 THEN concat('Order ', k) ELSE '' END,
            CASE WHEN d = 1 THEN concat('Article ', i, CASE WHEN a.shape = 1 THEN '' ELSE concat(chr(10), 'Order ', k) END) WHEN a.shape = 1 THEN concat('The carrier must not open order ', k, ' without consent.')
                WHEN a.shape = 2 THEN CASE d WHEN 2 THEN concat('1. Order ', k, ' must be weighed.') ELSE '1. It must be sealed.' END
                ELSE CASE d WHEN 2 THEN concat('1. The depot shall keep a register of order ', k, '.') WHEN 3 THEN '2. The register shall:' WHEN 4 THEN concat('(a) name the carrier of order ', k, ';') ELSE concat('(b) state the priority ', priority, '.') END END, d, a.shape, k
        FROM a JOIN shape ON shape.shape = a.shape)"""


@S.checked("b01_paragraphs", f"WITH {_SHAPES} SELECT doc, count(*) AS blocks FROM e GROUP BY doc")
def _b01(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("blocks"))


@S.checked("b02_headings", "SELECT DISTINCT doc, 'CHAPTER I' AS line FROM {article} UNION ALL SELECT doc, concat('Article ', i) FROM {article}")
def _b02(spark, sf_dir):
    return lines(_docs(spark, sf_dir), "doc", F.col("text")).where(is_heading(F.col("line"))).select("doc", "line")


@S.checked("b03_classify", f"WITH {_SHAPES} SELECT doc, seq, kind, rank, hint FROM e")
def _b03(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc", "seq", "kind", "rank", "hint")


@S.checked("b04_segment_titles", f"WITH {_SHAPES} SELECT doc, seq, heading FROM e WHERE heading <> ''")
def _b04(spark, sf_dir):
    return _blocks(spark, sf_dir).where("heading <> ''").select("doc", "seq", "heading")


@S.checked("b05_build_tree", f"WITH {_SHAPES} SELECT doc, seq, parent, ref FROM e")
def _b05(spark, sf_dir):
    return _tree(spark, sf_dir).select("doc", "seq", "parent", "ref")


@S.checked("b06_verify_cover", "SELECT doc, length(text) AS chars, true AS exact FROM {regulation}")
def _b06(spark, sf_dir):
    return verify(_blocks(spark, sf_dir), _docs(spark, sf_dir), "doc")


@S.checked("b07_walk", f"WITH {_SHAPES} SELECT doc, string_agg(ref, ' ' ORDER BY seq) AS walk FROM e GROUP BY doc")
def _b07(spark, sf_dir):
    """Refs in pre-order, which is the order of ``seq``."""
    return _tree(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ref"))), lambda x: x["ref"]), " ").alias("walk"))


@S.checked("b08_subtree_text", f"""WITH {_SHAPES}, u AS (SELECT doc, seq AS top, seq, text FROM e UNION ALL SELECT doc, parent, seq, text FROM e WHERE parent IS NOT NULL
    UNION ALL SELECT c.doc, p.parent, c.seq, c.text FROM e c JOIN e p ON p.doc = c.doc AND p.seq = c.parent WHERE p.parent IS NOT NULL
    UNION ALL SELECT c.doc, q.parent, c.seq, c.text FROM e c JOIN e p ON p.doc = c.doc AND p.seq = c.parent JOIN e q ON q.doc = p.doc AND q.seq = p.parent WHERE q.parent IS NOT NULL)
    SELECT doc, top AS seq, count(*) AS nodes, sha256(string_agg(text, chr(10) ORDER BY seq)) AS text_hash FROM u GROUP BY doc, top""")
def _b08(spark, sf_dir):
    b = _settled_blocks(spark, sf_dir)
    under = descendants(tree(b, "doc"), "doc").join(b.select("doc", F.col("seq").alias("below"), "text"), ["doc", "below"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("below", "text"))), lambda x: x["text"]), "\n")
    return under.groupBy("doc", "seq").agg(F.count("*").alias("nodes"), F.sha2(text, 256).alias("text_hash"))


@S.checked("b09_canonical_text", "SELECT doc, text FROM {regulation}")
def _b09(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc").agg(_in_order("text").alias("text"))


@S.checked("b10_span_layout", "WITH " + _SHAPES + """, r AS (SELECT e.doc, e.seq, strpos(r.text, concat(chr(10), CASE WHEN e.d > 1 THEN NULL ELSE concat('Article ', substr(e.ref, 5), chr(10)) END)) AS start_, length(e.text) AS n FROM e JOIN {regulation} r ON r.doc = e.doc WHERE e.d = 1)
    SELECT doc, seq, start_::BIGINT AS start_, (start_ + n)::BIGINT AS end_ FROM r""")
def _b10(spark, sf_dir):
    """Where each article's heading stands in the whole text."""
    b = _settled_blocks(spark, sf_dir)
    return span_layout(b, "doc").join(b.where("kind = 'unit'").select("doc", "seq"), ["doc", "seq"])


@S.checked("b12_clause_rows", f"WITH {_SHAPES} SELECT doc, ref, sha256(text) AS text_hash FROM e WHERE kind = 'paragraph'")
def _b12(spark, sf_dir):
    b = _settled_blocks(spark, sf_dir)
    return tree(b, "doc").join(b, ["doc", "seq"]).where("kind = 'paragraph'").select("doc", "ref", F.sha2("text", 256).alias("text_hash"))


def apply_hints(blocks_: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """``key, span, seq``: the first block that holds each missing span; spans that none holds are left out."""
    hits = blocks_.join(hints, key).where(F.contains(F.lower("text"), F.lower("span")))
    return hits.groupBy(key, "span").agg(F.min("seq").alias("seq"))


@S.checked("b15_parse_hints", f"WITH {_SHAPES} SELECT doc, concat('OPEN ORDER ', k, ' ') AS span, seq FROM e WHERE shape = 1 AND d = 2")
def _b15(spark, sf_dir):
    hints = relation(spark, sf_dir, "article").select("doc", F.concat(F.lit("OPEN ORDER "), F.col("k").cast("string"), F.lit(" ")).alias("span"))
    return apply_hints(_blocks(spark, sf_dir), hints, "doc")


@S.checked("b23_containers", f"WITH {_SHAPES} SELECT doc, seq FROM e WHERE d <= 1 OR (shape = 0 AND d = 3)")
def _b23(spark, sf_dir):
    return _tree(spark, sf_dir).select("doc", F.col("parent").alias("seq")).where("seq is not null").distinct()


@S.checked("b24_clause_context", f"WITH {_SHAPES} SELECT doc, seq, CASE WHEN shape = 1 THEN concat('Orders of customer ', doc) ELSE concat('Order ', k) END AS heading, CASE WHEN shape = 0 AND d > 3 THEN '2. The register shall:' END AS lead FROM e WHERE kind = 'paragraph'")
def _b24(spark, sf_dir):
    """The nearest heading above each paragraph, and the lead-in of items."""
    return clause_context(_blocks(spark, sf_dir), "doc")
