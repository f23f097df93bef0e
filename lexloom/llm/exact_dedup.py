"""Exact deduplication as a stateful stream, DataFrame functions only.

Each call writes its documents' normalised texts to a content store in the
shared folder, one folder a call, with SHA-256 digest, stable identifier and
locator (the call, and the row's number in it, which grows from file to file).
The store is also the stream's source, read without the texts: a streaming
aggregate without watermark keeps, in RocksDB and for ever, the least
identifier, its locator and the number of rows for each digest.  A later call
with the same ``state`` folder adds new documents to what is known.  Whatever
the state calls equal is compared in full bytes with the row that stays, whose
content is opened through the locator if it came in an earlier call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.store import discard, fits, settings, sized_join, work_dir, written

SPACES = r"[\x20\x09-\x0D]+"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a broadcast of ids may have (each under 100 bytes).
SMALL = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: What the state keeps of the row that stays.
FIRST = ("doc_id", "call", "locator")
STORED = "doc_id long, digest string, mark long, locator long, content string, call long"


def _drain(spark: SparkSession, source: str, state: str, updates: str) -> None:
    """Runs the stream over what has come to ``source``; state stays in ``state``."""
    values = {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # many small stores: no space is set aside for their logs
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    with settings(spark, values):
        known = (
            spark.readStream.schema(STORED).parquet(source)
            .groupBy("digest")
            .agg(F.min(F.struct(*FIRST)).alias("first"), F.count("*").alias("group_size"))
        )

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        query = (
            known.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def keyed(docs: DataFrame, digest=sha256) -> DataFrame:
    """Rows of the content store."""
    text = normalised(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), F.xxhash64(text).alias("mark"),
        F.monotonically_increasing_id().alias("locator"), text.alias("content"),
    )


def groups(spark: SparkSession, docs: DataFrame, *, digest=sha256, state: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest, mark``.

    Texts are equal when they are identical after replacing each run of
    ASCII white space by one space; null counts as empty.  The row with the
    smallest doc_id stays; among rows that repeat that doc_id with an equal
    text exactly one is ``kept``.  A null doc_id is smaller than none: such a
    row stays only if it is its group's first in Spark's order (nulls first).
    An empty table gives no rows.  ``digest`` may be any function of a column
    that gives a string; texts that share a digest without being equal are
    told apart by their bytes, those of earlier calls too.  ``mark`` is a
    64-bit hash of the normalised text.  A call that fails must be repeated
    with another state folder: what it had stored counts.
    """
    folder, call = state or work_dir(spark, "exact-dedup"), uuid.uuid4().int >> 65
    keyed(docs, digest).write.parquet(f"{folder}/content/call={call}")
    content = spark.read.schema(STORED).parquet(f"{folder}/content")
    mine = content.where(F.col("call") == call)
    _drain(spark, f"{folder}/content", f"{folder}/state", f"{folder}/updates")
    known = _latest(spark, f"{folder}/updates")
    if known is None:
        return mine.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(False).alias("kept"), "digest", "mark")
    here = f"{folder}/call-{call}"
    several = written(known.where("group_size > 1"), f"{here}/several")
    alone = F.struct(*FIRST)
    done = written(sized_join(mine.drop("content"), several, "digest", "left", SMALL // 4).select(
        "doc_id", F.coalesce("first.doc_id", F.when(F.col("first").isNull(), F.col("doc_id"))).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone == F.coalesce("first", alone)).alias("kept"), "digest", "mark",
    ), f"{here}/rows")
    unequal = written(_unequal(content, mine, several, call), f"{here}/unequal")
    if not unequal.isEmpty():
        done = written(_apart(content, call, done, unequal, here), f"{here}/told-apart")
    if not state:  # nobody will ask again
        discard(spark, f"{folder}/content", f"{folder}/state", f"{folder}/updates", f"{here}/apart")
    return done


def _latest(spark: SparkSession, updates: str) -> DataFrame | None:
    """State after the last batch: ids only fall and counts only rise."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(updates)
    except AnalysisException:  # no batch ran
        return None
    return rows.groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def _near(docs: DataFrame, ids: DataFrame, name: str, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (not) among ``ids``, null-safely."""
    right = ids.select(F.col(name).alias("__lexloom_hit")).distinct()
    right = F.broadcast(right) if fits(ids, SMALL * 2) else right
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("__lexloom_hit")), how)


def _unequal(content: DataFrame, mine: DataFrame, several: DataFrame, call: int) -> DataFrame:
    """Digests whose rows don't all have the bytes of the row that stays.

    All are equal when the least and the greatest are: an aggregate that is
    combined before the shuffle, so that a digest which a third of all rows
    share costs one text for each task.
    """
    hits = sized_join(mine, several.select("digest"), "digest", "left_semi", SMALL).select("digest", "content")
    earlier = several.select(F.col("first.call").alias("call"), F.col("first.locator").alias("locator")).where(F.col("call") != call)
    stays = sized_join(content.where(F.col("call") != call), earlier, ["call", "locator"], "left_semi", SMALL).select("digest", "content")
    ends = hits.union(stays).groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    return ends.where("low <> high").select("digest")


def _apart(content: DataFrame, call: int, done: DataFrame, unequal: DataFrame, here: str) -> DataFrame:
    """Groups the rows of unequal digests, of all calls, by their bytes."""
    rows = written(sized_join(content, unequal, "digest", "left_semi", SMALL), f"{here}/apart")
    by_text = rows.groupBy("digest", "content").agg(F.min(F.struct(*FIRST)).alias("first"), F.count("*").alias("group_size"))
    again = rows.where(F.col("call") == call).join(by_text, ["digest", "content"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.struct(*FIRST) == F.col("first")).alias("kept"), "digest", "mark",
    )
    return sized_join(done, unequal, "digest", "left_anti", SMALL).unionByName(again)


def without_copies(spark: SparkSession, docs: DataFrame, *, digest=sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    folder = work_dir(spark, "kept")
    rows = written(groups(spark, docs, digest=digest), f"{folder}/rows")
    dropped = written(rows.where("not kept").select("doc_id"), f"{folder}/dropped")
    clear = _near(docs, dropped, "doc_id", "left_anti")
    # ids that stay in one row and go in another: told apart by their texts
    both = written(_near(rows.where("kept").select("doc_id", "mark"), dropped, "doc_id", "left_semi"), f"{folder}/both")
    if both.isEmpty():
        return clear
    text = normalised(F.col("text"))
    mixed = _near(docs, both, "doc_id", "left_semi").withColumns({"__lexloom_mark": F.xxhash64(text), "__lexloom_text": text})
    kept = both.select(F.col("doc_id").alias("__lexloom_hit"), F.col("mark").alias("__lexloom_kept")).distinct()
    stay = mixed.join(kept, F.col("doc_id").eqNullSafe(F.col("__lexloom_hit")) & (F.col("__lexloom_mark") == F.col("__lexloom_kept")), "left_semi")
    return clear.union(stay.dropDuplicates(["doc_id", "__lexloom_text"]).select(docs.columns))
