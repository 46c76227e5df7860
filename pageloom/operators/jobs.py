"""The life of a job: latest states, expiry, cancelling, queue depth and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators import base as B
from pageloom.session import table

#: The moment from which ages are counted in the example queries.
NOW = "2024-03-01 06:00:00"
TTL_MIN, MAX_AGE_MIN = 30, 240


def closed_states(states: DataFrame) -> DataFrame:
    """``job_id, status``: the last state of each job; one that was finished but never closed becomes an error."""
    last = B.latest_jobs(states)
    return last.select("job_id", F.when(F.col("finished_at").isNotNull() & ~F.col("status").isin("done", "error"), "error").otherwise(F.col("status")).alias("status"))


def expired(jobs: DataFrame, now: Column, ttl_min: int = TTL_MIN, max_age_min: int = MAX_AGE_MIN) -> DataFrame:
    """Jobs to remove: finished longer ago than one limit, or created longer ago than the other, running ones too (both strictly)."""
    done = F.unix_micros(now) - F.unix_micros("finished_at") > ttl_min * 60_000_000
    old = F.unix_micros(now) - F.unix_micros("created_at") > max_age_min * 60_000_000
    return jobs.where(F.coalesce(done, F.lit(False)) | F.coalesce(old, F.lit(False))).select("job_id")


def cancelled(jobs: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Jobs that stay when some are cancelled."""
    return jobs.join(cancellations.select("job_id").distinct(), "job_id", "left_anti")


def queue_depth(jobs: DataFrame, capacity: int = 4, slots: str = "1 hour") -> DataFrame:
    """``at, depth, would_queue``: jobs under way after each start or end.

    The running sum goes over time in two steps, so that no task holds all
    events: within an hour, and over the hours' totals.
    """
    starts = jobs.where("created_at is not null").select(F.col("created_at").alias("at"), F.lit(1).alias("step"))
    ends = jobs.where("created_at is not null and finished_at is not null").select(F.col("finished_at").alias("at"), F.lit(-1).alias("step"))
    events = starts.unionByName(ends).groupBy("at").agg(F.sum("step").alias("step")).withColumn("slot", F.window("at", slots)["start"])
    totals = events.groupBy("slot").agg(F.sum("step").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row an hour
    inside = F.sum("step").over(Window.partitionBy("slot").orderBy("at"))
    depth = F.col("inside") + F.col("before")
    return (
        events.withColumn("inside", inside).join(totals.select("slot", before.alias("before")), "slot")
        .select("at", depth.cast("long").alias("depth"), (depth >= capacity).alias("would_queue"))
    )


def progress(documents: DataFrame) -> DataFrame:
    """``job_id, docs_done, pages_done, pages_total``: how far each job is."""
    return documents.groupBy("job_id").agg(
        F.count_if(F.col("status").isin("done", "error")).alias("docs_done"), F.coalesce(F.sum("pages_done"), F.lit(0)).cast("long").alias("pages_done"),
        F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("pages_total"),
    )


def public_view(jobs: DataFrame) -> DataFrame:
    """The fields of a job that are shown, with defaults for what isn't known yet."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return jobs.select(
        "job_id", "status", "filename", F.when(F.col("is_archive"), "zip").otherwise("pdf").alias("kind"), zero("document_count").alias("document_count"), zero("documents_done").alias("documents_done"),
        zero("current_document").alias("current_document"), F.coalesce("elapsed_seconds", F.lit(0.0)).alias("elapsed_seconds"), F.coalesce("stage", F.lit("ocr")).alias("stage"), F.coalesce("clean", F.lit(False)).alias("clean"),
        F.coalesce("clean_mode", F.lit("auto")).alias("clean_mode"), F.when((F.col("status") == "error"), F.coalesce("error.code", F.lit("processing_failed"))).alias("error_code"),
    )


def guard(jobs: DataFrame, documents: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, code, http``: the first reason to refuse a request ``request_id, job_id, doc_index, side``; null if none."""
    j = jobs.select("job_id", F.col("status").alias("job_status"), F.coalesce("clean", F.lit(False)).alias("clean"))
    d = documents.select("job_id", "doc_index", F.col("status").alias("doc_status"))
    r = requests.join(j, "job_id", "left").join(d, ["job_id", "doc_index"], "left")
    code = (
        F.when(F.col("job_status").isNull(), "job_not_found").when(F.col("doc_status").isNull(), "document_not_found").when(~F.col("clean"), "preview_unavailable")
        .when(F.col("doc_status") != "done", "preview_unavailable").when(~F.col("side").isin("original", "cleaned"), "invalid_side")
    )
    http = F.when(code.isin("job_not_found", "document_not_found"), 404).when(code == "preview_unavailable", 409).when(code == "invalid_side", 400)
    return r.select("request_id", code.alias("code"), http.alias("http"))


def _requests(s, d):
    return B.uploads(s, d).select(F.concat("batch_id", F.lit("/"), F.col("ord").cast("string")).alias("request_id"), F.col("batch_id").alias("job_id"), (F.col("ord") + F.when(F.col("ord") % 7 == 6, 1000).otherwise(0)).cast("int").alias("doc_index"), F.when(F.col("ord") % 3 == 2, "both").otherwise("cleaned").alias("side"))


_NOW = f"TIMESTAMPTZ '{NOW}+00'"

_VIEW = f"""WITH {B.JOBS} SELECT job_id, status, filename, CASE WHEN is_archive THEN 'zip' ELSE 'pdf' END AS kind, coalesce(document_count, 0) AS document_count, coalesce(documents_done, 0) AS documents_done,
        coalesce(current_document, 0) AS current_document, coalesce(elapsed_seconds, 0.0) AS elapsed_seconds, coalesce(stage, 'ocr') AS stage, coalesce(clean, false) AS clean, coalesce(clean_mode, 'auto') AS clean_mode,
        CASE WHEN status = 'error' THEN coalesce(error.code, 'processing_failed') END AS error_code FROM jobs"""

QUERIES = {
    "T1_job_states": (
        lambda s, d: closed_states(table(s, d, "ocr_job")),
        f"WITH {B.JOBS} SELECT job_id, CASE WHEN finished_at IS NOT NULL AND status NOT IN ('done', 'error') THEN 'error' ELSE status END AS status FROM jobs",
    ),
    "T2_reap": (
        lambda s, d: expired(B.jobs(s, d), F.lit(NOW).cast("timestamp")),
        f"WITH {B.JOBS} SELECT job_id FROM jobs WHERE coalesce({_NOW} - finished_at > INTERVAL 30 MINUTE, false) OR coalesce({_NOW} - created_at > INTERVAL 240 MINUTE, false)",
    ),
    "T3_cancel": (
        lambda s, d: cancelled(B.jobs(s, d), B.jobs(s, d).where("document_count is null or document_count = 1")).select("job_id", "status"),
        f"WITH {B.JOBS} SELECT job_id, status FROM jobs WHERE NOT (document_count IS NULL OR document_count = 1)",
    ),
    "T4_queue_depth": (
        lambda s, d: queue_depth(B.jobs(s, d)).select(F.unix_micros("at").alias("at"), "depth", "would_queue"),
        f"""WITH {B.JOBS}, e AS (SELECT created_at AS moment, 1 AS step FROM jobs WHERE created_at IS NOT NULL UNION ALL SELECT finished_at, -1 FROM jobs WHERE created_at IS NOT NULL AND finished_at IS NOT NULL),
        g AS (SELECT moment, sum(step) AS step FROM e GROUP BY moment) SELECT epoch_us(moment) AS "at", (sum(step) OVER (ORDER BY moment))::BIGINT AS depth, sum(step) OVER (ORDER BY moment) >= 4 AS would_queue FROM g""",
    ),
    "T5_latest_progress": (
        lambda s, d: table(s, d, "ocr_document").groupBy("doc_id").agg(F.max_by(F.struct("status", "pages_done"), F.struct("seen_at", "pages_done")).alias("x")).select("doc_id", "x.status", "x.pages_done"),
        f"WITH {B.DOCS} SELECT doc_id, status, pages_done FROM docs",
    ),
    "T6_partial_failure": (
        lambda s, d: B.documents(s, d).groupBy("job_id").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("documents")),
        f"WITH {B.DOCS} SELECT job_id, count(*) FILTER (error IS NOT NULL) AS failed, count(*) AS documents FROM docs GROUP BY job_id",
    ),
    "W8_progress": (
        lambda s, d: progress(B.documents(s, d)),
        f"WITH {B.DOCS} SELECT job_id, count(*) FILTER (status IN ('done', 'error')) AS docs_done, coalesce(sum(pages_done), 0)::BIGINT AS pages_done, coalesce(sum(page_count), 0)::BIGINT AS pages_total FROM docs GROUP BY job_id",
    ),
    "K7_public_view": (lambda s, d: public_view(B.jobs(s, d)), _VIEW),
    "M10_json_view": (
        lambda s, d: public_view(B.jobs(s, d)).select("job_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")),
        f"SELECT job_id, to_json(v)::VARCHAR AS json FROM ({_VIEW}) v",
    ),
    "F12_request_guard": (
        lambda s, d: guard(B.jobs(s, d), B.documents(s, d), _requests(s, d)),
        f"""WITH {B.JOBS}, {B.DOCS}, {B.UPLOADS}, r AS (SELECT batch_id || '/' || ord AS request_id, batch_id AS job_id, ord + CASE WHEN ord % 7 = 6 THEN 1000 ELSE 0 END AS doc_index, CASE WHEN ord % 3 = 2 THEN 'both' ELSE 'cleaned' END AS side FROM uploads),
        c AS (SELECT request_id, CASE WHEN j.status IS NULL THEN 'job_not_found' WHEN d.status IS NULL THEN 'document_not_found' WHEN NOT coalesce(j.clean, false) OR d.status <> 'done' THEN 'preview_unavailable'
          WHEN side NOT IN ('original', 'cleaned') THEN 'invalid_side' END AS code FROM r LEFT JOIN jobs j USING (job_id) LEFT JOIN docs d ON d.job_id = r.job_id AND d.doc_index = r.doc_index)
        SELECT request_id, code, CASE WHEN code LIKE '%_not_found' THEN 404 WHEN code = 'preview_unavailable' THEN 409 WHEN code = 'invalid_side' THEN 400 END AS http FROM c""",
    ),
}
