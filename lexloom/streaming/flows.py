"""Event flows as Structured Streaming: relay, idempotent consumers, rollups, claims (U, N24, N29, N31)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexloom.plans.fixpoint import ensure_folder
from lexloom.plans.portable import Suite, joined, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles

# Relay batch, lease and backoff, largest payload kept in line.
RELAY_FILES, LEASE_S, BACKOFF_S, BACKOFF_CAP_S, INLINE_BYTES = 100, 300, 30, 900, 240 * 1024


def stream(spark: SparkSession, sf_dir: str, name: str, files: int = RELAY_FILES) -> DataFrame:
    """A table's files as a stream; event time is a timestamp with zone, as watermarks need."""
    schema: StructType = relation(spark, sf_dir, name).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}*.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def drained(query: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that has come and reads its sink; state and sink lie in the shared folder."""
    spark = query.sparkSession
    ensure_folder(spark)
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")).rstrip("/") + f"/flow-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/sink/part={number}")

    run = query.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(StructType([*query.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{root}/sink/*")


def last_updates(df: DataFrame, *keys: str) -> DataFrame:
    """What an update-mode sink holds after the last batch."""
    rest = [c for c in df.columns if c not in (*keys, "_batch", "part")]
    return df.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def disposition(kind: Column, ref: Column) -> Column:
    return F.when(kind.isin("signup", "purchase", "error"), "sent").when(kind.isin("view", "click"), "audit_only").otherwise("quarantined")


@S.checked("u02_relay", "SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'sent' WHEN event_type IN ('view', 'click') THEN 'audit_only' ELSE 'quarantined' END AS disposition FROM {events}")
def _u02(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").select("event_id", disposition(F.col("event_type"), F.col("user_id")).alias("disposition"))
    return drained(rows, "append").select("event_id", "disposition")


@S.checked("u03_relay_totals", "SELECT event_type AS kind, count(*) AS n FROM {events} GROUP BY event_type")
def _u03(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return last_updates(drained(rows, "update"), "kind")


@S.checked("u05_idempotent_consumer", "SELECT event_id FROM {events}")
def _u05(spark, sf_dir):
    """Every event comes twice; each is handled once, however far apart the two are: the state doesn't expire."""
    once = stream(spark, sf_dir, "events").select("event_id", "ts")
    twice = once.select("ts", F.explode(F.array("event_id", "event_id")).alias("event_id"))
    handled = twice.dropDuplicates(["event_id"]).select("event_id")
    return drained(handled, "append").select("event_id")


@S.checked("n24_stream_spend", "SELECT cast(ts AS DATE) AS day, event_type AS fleet, round(sum(value), 4) AS spent FROM {events} GROUP BY 1, 2")
def _n24(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.sum("value").alias("s"))
    flat = rows.select(F.col("window.start").cast("date").alias("day"), F.col("event_type").alias("fleet"), "s")
    return last_updates(drained(flat, "update"), "day", "fleet").select("day", "fleet", F.round("s", 4).alias("spent"))


@S.checked("n29_stream_usage", "SELECT cast(ts AS DATE) AS day, user_id % 10 AS app, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors FROM {events} GROUP BY 1, 2")
def _n29(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), (F.col("user_id") % 10).alias("app")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return last_updates(drained(rows.select(F.col("window.start").cast("date").alias("day"), "app", "requests", "errors"), "update"), "day", "app")


@S.checked("n31_stream_rate_limit", "SELECT user_id AS bucket, floor(epoch(ts) / 21600)::BIGINT AS window_no, count(*) AS hits FROM {events} GROUP BY 1, 2")
def _n31(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours"), F.col("user_id").alias("bucket")).agg(F.count("*").alias("hits"))
    return last_updates(drained(rows.select("bucket", (F.unix_seconds("window.start") / 21600).cast("bigint").alias("window_no"), "hits"), "update"), "bucket", "window_no")


@S.checked("u12_dead_letters", "SELECT user_id, event_type FROM {events} WHERE event_type = 'error' GROUP BY 1, 2")
def _u12(spark, sf_dir):
    """One letter for each (user, type), however often it fails; state is kept, as letters may come again at any time."""
    rows = stream(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return drained(rows, "append").select("user_id", "event_type")


S.portable("u01_outbox_emit", "SELECT concat('EVT-', lpad(cast(event_id AS VARCHAR(19)), 8, '0')) AS event_key, 'L1' AS layer, event_type AS kind, concat('user/', cast(user_id AS VARCHAR(19))) AS subject_ref, props AS payload FROM {events}")
S.portable("u04_route_table", "SELECT e.event_id, coalesce(r.consumer, 'unknown') AS consumer FROM {events} e LEFT JOIN (SELECT 'signup' AS kind, 'L2' AS consumer UNION ALL SELECT 'purchase', 'L3' UNION ALL SELECT 'purchase', 'L4' UNION ALL SELECT 'view', 'audit') r ON r.kind = e.event_type")
S.portable("u06_delivery_key", "SELECT event_id, [[sha2(||sha256(]]concat(event_type, '/', cast(event_id AS VARCHAR(19)))[[, 256)||)]] AS delivery_key FROM {events}")
S.portable("u07_claim_task", "SELECT user_id AS task, count(CASE WHEN event_type = 'error' THEN 1 END) AS attempts, cast(least(30 * power(2, greatest(count(CASE WHEN event_type = 'error' THEN 1 END) - 1, 0)), 900) AS BIGINT) AS backoff_s, max(event_id) AS last_claim FROM {events} GROUP BY user_id")
S.portable("u08_finish_task", "SELECT record_id AS task, state, id AS finished_by FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY valid_from DESC, id DESC) AS n FROM {history}) x WHERE n = 1 AND state IN ('purchase', 'signup')")
S.portable("u09_claim_run", "SELECT o_orderpriority AS queue, min_by(o_orderkey, struct_key) AS run FROM (SELECT o_orderpriority, o_orderkey, concat(cast(cast(o_orderdate AS DATE) AS VARCHAR(19)), lpad(cast(o_orderkey AS VARCHAR(19)), 12, '0')) AS struct_key FROM {orders} WHERE o_orderstatus = 'O') x GROUP BY o_orderpriority")
S.portable("u10_fan_out", "SELECT e.event_id, t.layer FROM {events} e JOIN (SELECT 'signup' AS kind, 'L2' AS layer UNION ALL SELECT 'purchase', 'L3' UNION ALL SELECT 'purchase', 'L4' UNION ALL SELECT 'purchase', 'L5' UNION ALL SELECT 'error', 'L6') t ON t.kind = e.event_type")
S.portable("u11_payload_indirection", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN [[sha2(text, 256)||sha256(text)]] END AS by_hash, length(text) <= 4000 AS inline_ FROM {documents}")
S.portable("u13_missed_sources", "SELECT d.day, count(*) AS missed FROM (SELECT DISTINCT cast(ts AS DATE) AS day FROM {events}) d CROSS JOIN (SELECT DISTINCT user_id FROM {events}) u LEFT JOIN (SELECT DISTINCT cast(ts AS DATE) AS day, user_id FROM {events}) e ON e.day = d.day AND e.user_id = u.user_id WHERE e.user_id IS NULL GROUP BY d.day")
