"""What goes through shared folders: rows and log lines that are written and read back, stored objects, landed pages."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.plans import events
from docketry.runtime import checkpoint, ensure_checkpoint_dir, table
from docketry.sources import documents, store
from docketry.streaming import incremental


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which whoever owns those clears."""
    return f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"


def written_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in two writes, the ids that the writes gave, and the rows read back by them."""
    path = _folder(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))
    first, second = (store.insert_returning(orders.where(F.col("o_orderkey") % 2 == n), path, "o_orderkey", id_col="order_id") for n in (0, 1))
    return first.union(second).join(store.read_rows(spark, path, "order_id string, status string"), "order_id")


def log_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a log from a level on, read back."""
    path, k = _folder(spark), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.element_at(F.array(*map(F.lit, store.LEVELS)), (k % 4 + 1).cast("int")).alias("level"), F.timestamp_seconds(k).alias("at"),
        F.concat(F.lit("mail a"), k.cast("string"), F.lit("@b.org")).alias("msg"), k.alias("event_id"), F.when(k % 3 == 0, "x").alias("state"), F.lit("123").alias("ssn"),
    )
    store.append_lines(store.log_lines(rows, "warn"), path)
    return store.read_lines(spark, path).select("value")


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are left in a store after one organization is erased, found by listing it."""
    path, k = _folder(spark), F.col("s_suppkey")
    key = F.format_string("org/%d/supplier/%d/%s", F.col("s_nationkey"), k, F.concat(F.replace("s_name", F.lit("#"), F.lit("_")), F.lit(".txt")))
    store.put_objects(table(spark, sf_dir, "supplier").select(key.alias("key"), F.col("s_name").alias("content")), path)
    store.delete_prefix(path, "org/7")
    return store.read_objects(spark, path, "*.txt").select("key", "length", F.sha2("content", 256).alias("content_hash"))


def open_data_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of an open-data export that is landed in pages by date and read up to its last page; a page of an older landing lies behind a gap."""
    path, k = _folder(spark), F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (k % 997).cast("int")), "yyyy-MM-dd")
    rows = table(spark, sf_dir, "pages").select(k.cast("string").alias("decision_number"), F.col("url").alias("link"), day.alias("decision_date"))
    store.land_pages(rows, path, "decision_date", "decision_number")
    old = spark.range(1).select(F.lit("9999999800-1.json").alias("key"), F.lit('[{"decision_number":"old","link":"x"}]').alias("content"))
    store.put_objects(old, path)
    names = ", ".join(f"`{c}` string" for c in rows.columns)
    read = store.read_pages(spark, path).select("place", F.from_json("row", names).alias("r")).select("place", "r.*")
    found = documents.open_data_rows(read).select("citation", "url", F.date_format("decided_at", "yyyy-MM-dd").alias("decided_at"))
    return found.join(read.select(F.concat(F.lit("DAB No. "), F.col("decision_number")).alias("citation"), "place"), "citation")


def _sentences(text: str) -> list[dict]:
    return [{"ordinal": n, "chars": len(s)} for n, s in enumerate(text.split(". ")) if s]


def staged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by document, version and run of a resumable stage that is run three times.

    Between the first two runs nothing lands, so the second makes nothing. Before the third
    every other document lands again and every sixth of all has changed.
    """
    path, k = _folder(spark), F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(k, "text", F.lit(1).alias("at"))
    again = docs.where(k % 2 == 0).withColumns({"text": F.when(k % 6 == 0, F.concat("text", F.lit(". Amended"))).otherwise(F.col("text")), "at": F.lit(2)})
    for run, landed in enumerate((docs, None, again), 1):
        if landed is not None:
            landed.withColumn("at", F.timestamp_seconds("at")).write.mode("append").parquet(f"{path}/landed")
        incremental.run_versions(
            spark, f"{path}/landed", "doc_id long, text string, at timestamp", f"{path}/parts", f"{path}/state", _sentences, "ordinal int, chars int", run=F.lit(run)
        ).awaitTermination()
    made = spark.read.parquet(f"{path}/parts")
    now = incremental.current(made).select("doc_id", "version").distinct().withColumn("current", F.lit(True))
    counts = made.groupBy("doc_id", "version", "run").agg(F.count("*").alias("sentences"), F.sum("chars").alias("chars"))
    return counts.join(now, ["doc_id", "version"], "left").withColumn("current", F.coalesce("current", F.lit(False)))


def limited_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event of a stream that arrives in two halves is within its user's limit, decided with the state of open windows."""
    path = _folder(spark)
    hits = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("hit_id"))
    half = checkpoint(hits.agg(F.percentile_approx(F.unix_micros("at"), 0.5).alias("half")))  # asked again, it may be another
    cut = hits.join(F.broadcast(half)).withColumn("late", F.unix_micros("at") > F.col("half")).drop("half")
    for late in (False, True):
        cut.where(F.col("late") == late).drop("late").write.mode("append").parquet(f"{path}/landed")
        found = incremental.rate_limit_stream(spark.readStream.schema("key string, at timestamp, hit_id long").parquet(f"{path}/landed"), 3, 6 * 3600)
        found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/decided").awaitTermination()
    return spark.read.parquet(f"{path}/decided")


def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by the run that claimed them: half land, are claimed, are offered again with nothing new, then the others land.

    A run takes what no run of the same checkpoint took, so each job is claimed once.
    """
    path, k = _folder(spark), F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(k.alias("job_id"), F.col("event_type").alias("kind"), (k % 2).alias("half"))
    for run, half in enumerate((0, None, 1), 1):
        if half is not None:
            jobs.where(F.col("half") == half).drop("half").write.mode("append").parquet(f"{path}/landed")
        incremental.drain_jobs_stream(
            spark, f"{path}/landed", "job_id long, kind string", f"{path}/claimed/run={run}", f"{path}/state", lambda batch: batch.withColumn("claim", F.concat("kind", F.lit(" claimed")))
        ).awaitTermination()
    return spark.read.option("basePath", f"{path}/claimed").parquet(f"{path}/claimed").select("job_id", "claim", F.col("run").cast("int").alias("run"))


_LIMITED = re.sub(r"user_id as key", "user_id::varchar as key", events.ORACLE["rate_limits"])
QUERIES = {"staged_documents": staged_documents, "limited_stream": limited_stream, "claimed_jobs": claimed_jobs, "written_orders": written_orders, "log_written": log_written, "stored_objects": stored_objects, "open_data_pages": open_data_pages}
ORACLE = {
    "staged_documents": """with t as (select doc_id, coalesce(text, '') as text from documents), a as (select doc_id, list_filter(string_split(text, '. '), lambda s: s <> '') as s from t),
b as (select doc_id, list_filter(string_split(case when doc_id % 6 = 0 then text || '. Amended' else text end, '. '), lambda s: s <> '') as s from documents where doc_id % 6 = 0 and text is not null),
v as (select doc_id, 1 as version, 1 as run, s from a union all select doc_id, case when len(a.s) > 0 then 2 else 1 end, 3, b.s from b join a using (doc_id)),
c as (select doc_id, version, run, len(s) as sentences, list_sum(list_transform(s, lambda x: length(x)))::bigint as chars from v where len(s) > 0)
select *, run = max(run) over (partition by doc_id) as current from c""",
    "limited_stream": _LIMITED,
    "claimed_jobs": "select event_id as job_id, event_type || ' claimed' as claim, case event_id % 2 when 0 then 1 else 3 end::integer as run from events",
    "written_orders": """select left(sha256('["' || o_orderkey || '"]'), 32) as order_id, o_orderkey, case when o_orderkey % 5 <> 0 then o_orderstatus end as status from orders""",
    "log_written": """select '{"level":"' || ['debug', 'info', 'warn', 'error'][event_id % 4 + 1] || '","at":"' || strftime(to_timestamp(event_id) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') || '","msg":"mail [redacted:email]","event_id":' || event_id
  || ',"state":' || case when event_id % 3 = 0 then '"x"' else 'null' end || ',"ssn":"[redacted]"}' as value from events where event_id % 4 >= 2""",
    "stored_objects": """select 'org/' || s_nationkey || '/supplier/' || s_suppkey || '/' || replace(s_name, '#', '_') || '.txt' as key, strlen(s_name) as length, sha256(s_name) as content_hash from supplier where s_nationkey <> 7""",
    "open_data_pages": """with p as (select page_id::varchar as n, url, strftime(date '2000-01-01' + (page_id % 997)::integer, '%Y-%m-%d') as d from pages), q as (select *, row_number() over (order by d, n) - 1 as place from p)
select 'DAB No. ' || n as citation, trim(url) as url, d as decided_at, place from q where trim(url) <> ''""",
}
