"""The ten operators over whole tables, with production parameters.

Each query is thin: it calls its operator and derives the digest columns.
``ORACLE`` has DuckDB SQL where SQL can express the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe_words, decontaminate, exact_dedup, line_dedup, ngram_join, sstable, substring_dedup, token_counts
from lexloom.llm import quality as quality_
from lexloom.llm import toxicity as toxicity_


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of five-word shingles, containment 0.8 or more."""
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    found = quality_.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "quality_expected", "quality_tail", "selected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, tail probability and rejection of every document."""
    found = toxicity_.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "toxicity_expected", "toxicity_tail", "rejected")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the sorted-string-table shards."""
    return sstable.token_table(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(spark, table(spark, sf_dir, "documents"), min_docs=5, min_points=40)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(spark, table(spark, sf_dir, "documents"), words=3, threshold=0.9)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(spark, table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_words.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_quality_classifier, op3_toxicity, op4_token_shards, op5_token_counts,
        op6_line_dedup, op7_ngram_jaccard_join, op8_substring_dedup, op9_bpe_round_trip, op10_exact_dedup, pipeline,
    )
}

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]"

ORACLE = {
    "op1_benchmark_decontamination": rf"""
        WITH w AS (
            SELECT 'd' AS side, doc_id AS id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
            UNION ALL
            SELECT 'i', item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') FROM benchmark),
        p AS (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS i FROM w),
        s AS (SELECT DISTINCT side, id, array_to_string(w[i : i + 4], ' ') AS g FROM p),
        n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id),
        hit AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM s d JOIN s i ON d.g = i.g WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL)
        SELECT doc_id, item_id, n::INTEGER AS item_shingles, shared::INTEGER AS shared, shared / n AS containment
        FROM hit JOIN n ON n.id = hit.item_id WHERE 10 * shared >= 8 * n""",
    "op6_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, {_FOLD.format(f"regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', '')")} AS key FROM l),
        c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c ON c.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op7_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) m USING (doc_id)""",
    "op8_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS i FROM w),
        s AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS g FROM p),
        t AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM s) WHERE m < doc_id),
        x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
        q AS (SELECT x.doc_id, x.i, x.word, max(t.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
            FROM x LEFT JOIN t ON t.doc_id = x.doc_id AND t.i = x.i)
        SELECT d.doc_id, count(q.i) AS n_words, count(q.i) FILTER (WHERE gone) AS n_removed,
            sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id""",
    "op10_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t""",
}
