"""Trees of documents: segmentation of text and outlines of pages."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexloom.plans import segment
from lexloom.sources import documents, readers

ACT = """The following rules hold for depots.
CHAPTER I
General rules
Article 1
Registers
1. Every depot shall keep a register.
2. The register shall:
(a) name the carrier;
(b) state the day.
Article 2
A carrier must not open sealed cargo.
1. Seals are numbered.
1. Seals are grey."""
REFS = ["p1", "ch-i", "art-1", "art-1/1", "art-1/2", "art-1/2/a", "art-1/2/b", "art-2", "art-2/p1", "art-2/1", "art-2/1-2"]


def parsed(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    return docs, segment.blocks(segment.lines(docs, "doc", F.col("text")), "doc")


def test_refs_follow_the_documents_own_units(spark):
    docs, blocks = parsed(spark, ACT, "", None, "One line only", ACT.replace("\n", "\r\n"))
    refs: dict = {}
    for r in segment.tree(blocks, "doc").orderBy("doc", "seq").collect():
        refs.setdefault(r.doc, []).append(r.ref)
    assert refs == {0: REFS, 3: ["p1"], 4: REFS}
    heads = {r.seq: r.heading for r in blocks.where("doc = 0 and heading <> ''").collect()}
    assert heads == {2: "General rules", 3: "Registers"}


def test_shapes_of_headings_and_blocks(spark):
    long = "\n".join(f"Sentence {i} of a long block that goes on and on for quite a while." for i in range(30))
    text = "\n".join([
        "3.2 Records of processing", "3.3 Their loss", "plain text goes on", "and on", "", "4.1 Numbered but must not head", "Section 5.1. The depot shall weigh.", "§ 7 Scales", "- a bullet", "PART A",
        "Goods", "", "Schedule", "", "Rule 8 - Weights", "Not a title: it ends so.", "(iv) item without a lead", "b) another", "12) more", "Article 9 Each carrier must report its own weight to the office.", "", long,
    ])
    docs, blocks = parsed(spark, text)
    got = [(r.kind, r["rank"], r.hint, r.text.split("\n")[0][:24]) for r in blocks.orderBy("seq").collect()]
    assert got == [
        ("unit", 2, "3.2", "3.2 Records of processin"), ("unit", 2, "3.3", "3.3 Their loss"), ("paragraph", 2, None, "plain text goes on"), ("paragraph", 2, None, "4.1 Numbered but must no"),
        ("paragraph", 1, "sec-5.1", "Section 5.1. The depot s"), ("unit", 1, "sec-7", "§ 7 Scales"), ("paragraph", 2, None, "- a bullet"), ("division", 0, "part-a", "PART A"),
        ("paragraph", 2, None, "Schedule"), ("unit", 1, "rule-8", "Rule 8 - Weights"), ("paragraph", 2, None, "Not a title: it ends so."), ("paragraph", -1, "iv", "(iv) item without a lead"),
        ("paragraph", 2, "b", "b) another"), ("paragraph", 2, "12", "12) more"), ("paragraph", 1, "art-9", "Article 9 Each carrier m"),
        ("paragraph", 2, None, "Sentence 0 of a long blo"), ("paragraph", 2, None, "Sentence 10 of a long bl"), ("paragraph", 2, None, "Sentence 20 of a long bl"),
    ]
    assert [r.exact for r in segment.verify(blocks, docs, "doc").collect()] == [True]


def test_a_changed_node_is_rejected(spark):
    docs, blocks = parsed(spark, ACT, "", ACT.replace("\n", "\n\n  "))
    assert {r.doc: r.exact for r in segment.verify(blocks, docs, "doc").collect()} == {0: True, 1: True, 2: True}
    other = blocks.withColumn("text", F.regexp_replace("text", "sealed", "open"))
    assert not any(r.exact for r in segment.verify(other.where("doc <> 1"), docs.where("doc <> 1"), "doc").collect())
    assert [r.exact for r in segment.verify(blocks.where("seq <> 4"), docs.where("doc = 0"), "doc").collect()] == [False]


def test_hints_and_descendants(spark):
    _, blocks = parsed(spark, ACT)
    hints = spark.createDataFrame([(0, "SEALS are"), (0, "nowhere"), (1, "Seals")], "doc long, span string")
    assert [tuple(r) for r in segment.apply_hints(blocks, hints, "doc").collect()] == [(0, "SEALS are", 10)]
    t = segment.tree(blocks, "doc")
    under: dict = {}
    for r in segment.descendants(t, "doc").collect():
        under.setdefault(r.seq, set()).add(r.below)
    assert under[2] == set(range(2, 12)) and under[5] == {5, 6, 7} and under[11] == {11} and under[1] == {1}


PAGE = """<!DOCTYPE html><html><head><title>t</title></head><body><nav>Menu</nav><article>Advert</article><main><h1>Rules</h1>
<h2>First &amp; last</h2><p>Section 1. Each depot  shall <b>keep</b> a register.<li>an item<p>Section 1. Again.</p>
<h2>Second</h2><p>loose</p><footer>inside</footer></main><p>after</p><footer>Contact</footer></body></html>"""


def test_outline_of_a_page():
    found = readers.blocks_of(PAGE)
    assert found == [("h1", "Rules"), ("h2", "First & last"), ("p", "Section 1. Each depot shall keep a register."), ("li", "an item"), ("p", "Section 1. Again."), ("h2", "Second"), ("p", "loose")]
    section = re.compile(r"Section (?P<ref>[0-9]+)\.\s")
    assert readers.outline(found, section) == [
        (0, None, "group", "html/0", None, "Rules"), (1, 0, "group", "html/1", None, "First & last"),
        (2, 1, "provision", "1", "Section 1.", "Each depot shall keep a register."), (3, 2, "paragraph", None, None, "an item"),
        (4, 2, "paragraph", None, None, "Section 1. Again."), (5, 0, "group", "html/5", None, "Second"), (6, 5, "paragraph", None, None, "loose")]
    assert [n[2] for n in readers.outline(found)] == ["section", "section", "paragraph", "paragraph", "paragraph", "section", "paragraph"]


@pytest.mark.parametrize(("html", "want"), [
    (None, []), ("", []), ("just text", [("text", "just text")]), ("<p>a<p>b", [("p", "a"), ("p", "b")]), ("<article><p>x</p></article><p>y</p>", [("p", "x")]),
    ("<p>&lt;main&gt; &eacute;</p>", [("p", "<main> é")]), ("<nav>a<p>b</p></nav>c", [("text", "c")]),
])
def test_lenient_blocks(html, want):
    assert readers.blocks_of(html) == want


def test_a_page_without_structure_is_one_section(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><p>b</p>"), (2, ""), (3, None)], "page_id int, html string")
    got = [tuple(r) for r in readers.html_tree(pages, "page_id", "html").orderBy("page_id", "pos").collect()]
    assert got == [(1, -1, None, "section", "document", None, ""), (1, 0, -1, "paragraph", None, None, "a"), (1, 1, -1, "paragraph", None, None, "b")]


def test_pages_have_the_text_that_a_plain_reading_finds(spark):
    """On the table's pages: tags of invisible elements out, blocks in order."""
    from lexloom.registry import queries

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found: dict = {}
    for r in queries()["a03_html_blocks"](spark, sf).orderBy("page_id", "pos").collect():
        found.setdefault(r.page_id, []).append(r.text)
    import html as entities

    for i, h in pages.items():
        body = re.search(r"<article>(.*?)</article>", h, re.S)
        plain = re.sub(r"<(script|style|nav|aside|footer|header|form)\b.*?</\1>|<!--.*?-->", " ", body[1] if body else h, flags=re.S)
        words = entities.unescape(re.sub(r"<[^>]*>", " ", plain)).split()
        assert "".join(found.get(i, [])).replace(" ", "") == "".join(words)


def test_large_files_fail(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("small")
    assert readers.local_files(spark, str(tmp_path), str(tmp_path)).count() == 1
    monkeypatch.setattr(readers, "MAX_BYTES", 3)
    with pytest.raises(Exception, match="has more than 3 bytes"):
        readers.local_files(spark, str(tmp_path), str(tmp_path)).collect()
    with pytest.raises(ValueError, match="outside"):
        readers.local_files(spark, str(tmp_path), str(tmp_path / "below"))


@pytest.mark.parametrize(("content", "name", "want"), [
    (b"plain", "", ("text", "plain", None)), (b"\xef\xbb\xbfmarked", "", ("text", "marked", None)), ("caf\xe9".encode("cp1252"), "", ("text", "café", None)),
    (b" <!DOCTYPE html><p>x", "", ("html", " <!DOCTYPE html><p>x", None)), (b"<p>x", "A.HTML", ("html", "<p>x", None)), (b"%PDF-1.4", "x.txt", ("pdf", None, "no reader for PDF is installed")),
    (b"a\x00b", "", ("text", None, "binary, not text")), (None, "", ("text", None, "no text")), (b" \n", "", ("text", None, "no text")),
])
def test_rendering(content, name, want):
    assert documents.render(content, name) == want


def test_import_and_import_again(spark):
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content binary, name string")
    first = documents.rendered(files(("a", ACT.encode(), "a"), ("b", PAGE.encode(), "b.html"), ("c", b"\x00", "c")), "path", "content", "name")
    none = spark.createDataFrame([], "path string, text_hash string")
    assert {r.path: r.state for r in documents.imported(first, none, "path").collect()} == {"a": "added", "b": "added", "c": "failed"}
    stored = first.where("error is null").select("path", F.sha2("text", 256).alias("text_hash"))
    again = documents.rendered(files(("a", ACT.encode(), "a"), ("b", PAGE.replace("loose", "other").encode(), "b.html")), "path", "content", "name")
    assert {r.path: r.state for r in documents.imported(again, stored, "path").collect()} == {"a": "unchanged", "b": "amended"}
    nodes: dict = {}
    for r in documents.clauses(first, "path").orderBy("path", "seq").collect():
        nodes.setdefault(r.path, []).append((r.kind, r.ref))
    assert [ref for _, ref in nodes["a"]] == REFS and len(nodes["b"]) == 7 and set(nodes) == {"a", "b"}
    assert documents.clauses(first.limit(0), "path").count() == 0
    with pytest.raises(KeyError, match="no reader for 'pdf'"):
        documents.reader("pdf")


def test_clause_context_is_that_of_ancestors(spark):
    """One pass over the documents: no group of its own for each, no join of ancestors; refs that repeat by the thousand are numbered."""
    text = "CHAPTER I\n\nGeneral\nArticle 1\nScope\n1. It applies to:\n(a) carriers;\n(b) depots.\n2. It ends.\nArticle 2\nThe carrier shall not open it.\n" + "1. Again.\n" * 2000
    docs = spark.createDataFrame([("x", text), ("y", "Nothing above."), (None, text), ("z", None)], "doc string, text string")
    b = segment.blocks(segment.lines(docs, "doc", F.col("text")), "doc")
    df = segment.clause_context(b, "doc")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan
    found = {(r.doc, r.seq): (r.heading, r.lead) for r in df.collect()}
    nodes = {(r.doc, r.seq): r for r in segment.tree(b, "doc").where("doc is not null").collect()}
    held = {(r.doc, r.seq): r for r in b.where("doc is not null").collect()}
    want = {}
    for (doc, seq), node in nodes.items():
        up, at = [], node.parent
        while at is not None:
            up.append(at)
            at = nodes[doc, at].parent
        over = [held[doc, u].heading for u in up if held[doc, u].heading]
        lead = held[doc, node.parent].text if node.parent is not None else ""
        if held[doc, seq].kind == "paragraph" and over:
            want[doc, seq] = (over[0], lead if lead.endswith((":", "—", "-")) else None)
    assert found == want and len(want) > 2000
    assert sorted(lead for _, lead in found.values() if lead) == ["1. It applies to:"] * 2
    assert len({r.ref for k, r in nodes.items() if k[0] == "x"}) == sum(k[0] == "x" for k in nodes)
