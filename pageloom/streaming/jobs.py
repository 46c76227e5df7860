"""Job events as a stream: arrivals by the hour, and the closing state of each job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageloom.session import shared_folder


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """Job states as they arrive in a folder."""
    file = f"{folder}/ocr_job.parquet"
    return spark.readStream.schema(spark.read.parquet(file).schema).option("pathGlobFilter", "*.parquet").load(_watched(file), format="parquet")


def _watched(file: str) -> str:
    """A table that is one file is watched by a pattern, one that is a folder by its name."""
    import os

    return file if os.path.isdir(file) else file.rpartition("/")[0] + "/ocr_job*.parquet"


def arrivals(events: DataFrame, late: str = "2 hours", slot: str = "1 hour") -> DataFrame:
    """``slot, jobs``: distinct jobs created in each hour; what comes later than ``late`` is left out."""
    once = events.where("created_at is not null").withWatermark("created_at", late).dropDuplicatesWithinWatermark(["job_id"])
    return once.groupBy(F.window("created_at", slot).alias("slot")).agg(F.count("*").alias("jobs")).select(F.col("slot.start").alias("slot"), "jobs")


#: How long a job's state is kept after its last row, in milliseconds, and how late rows may come, both by ``seen_at``.
KEPT, LATE = 24 * 3600 * 1000, "1 day"


def _close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep a job's latest state; report it once, when it is closed; forget it when nothing has come for long."""
    if state.hasTimedOut:
        state.remove()
        return
    seen, status, reported = state.get if state.exists else (pd.Timestamp.min.value, "queued", False)
    for batch in batches:
        for at, now in zip(batch["seen_at"], batch["status"]):
            value = at.value if pd.notna(at) else pd.Timestamp.min.value
            if value >= seen and not (status in ("done", "error") and now not in ("done", "error")):
                seen, status = value, now
    fresh = status in ("done", "error") and not reported
    state.update((seen, status, reported or fresh))
    state.setTimeoutTimestamp(max(seen // 1_000_000, state.getCurrentWatermarkMs()) + KEPT)
    yield pd.DataFrame({"job_id": [key[0]], "status": [status]} if fresh else {"job_id": [], "status": []}, dtype=str)


def closings(events: DataFrame) -> DataFrame:
    """``job_id, status`` once for each job that is done or has failed; later rows of it change nothing.

    A job of which no row came for KEPT is forgotten, so the state doesn't grow
    for ever; rows later than LATE are left out.
    """
    return events.select("job_id", "status", "seen_at").withWatermark("seen_at", LATE).groupBy("job_id").applyInPandasWithState(
        _close, "job_id string, status string", "seen long, status string, reported boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there and return what was written; state lies in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


QUERIES = {
    "T1_job_stream": (
        lambda s, d: run_once(closings(job_events(s, d))),
        "SELECT job_id, max_by(status, seen_at) AS status FROM ocr_job WHERE status IN ('done', 'error') GROUP BY job_id",
    ),
    "T4_arrivals_stream": (lambda s, d: run_once(arrivals(job_events(s, d))), None),
}
