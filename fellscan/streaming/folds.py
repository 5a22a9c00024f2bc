"""Mutable state as folds over event tables: jobs, verdicts, cancellation, requests; batch and streaming forms agree."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["pending", "running"]
TERMINAL = ["completed", "failed", "cancelled"]


def _described(events: DataFrame) -> DataFrame:
    """Events with the columns ``summary map<string,string>`` and ``message``, null where the source has none."""
    extra = {"summary": "map<string,string>", "message": "string"}
    return events.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in events.columns})


def fold_jobs(events: DataFrame) -> DataFrame:
    """Latest state per job from (job_id, seq, ts, status, progress, stage), and summary and message where given.

    The first terminal event ends the job: later events change nothing. Up to there progress is the running maximum
    capped at 100, the stage is the last one named, the start is the first running stamp. A summary replaces
    ``result_summary``, a stage named without one is set in it; a failed job has its message in ``error_message``. All
    folds are combinable minima and maxima, so one job with most of the events still aggregates before the shuffle.
    """
    events, done = _described(events), F.col("status").isin(TERMINAL)
    end = events.groupBy("job_id").agg(F.min(F.when(done, F.col("seq"))).alias("_end"))
    live = events.join(end, "job_id").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    given = F.when(F.col("summary").isNotNull(), F.col("seq"))
    added = F.when(F.col("summary").isNull() & (F.col("stage") != ""), F.col("seq"))
    out = live.groupBy("job_id").agg(
        F.max_by("status", "seq").alias("status"), F.max(F.when(F.col("progress").isNotNull(), F.least("progress", F.lit(100)))).alias("progress"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.max(F.when(done, F.col("ts"))).alias("completed_at"),
        F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col("seq"))).alias("stage"), F.max("ts").alias("updated_at"),
        F.max_by("summary", given).alias("_s"), F.max(given).alias("_given"), F.max_by("stage", added).alias("_stage"), F.max(added).alias("_added"),
        F.max_by(F.coalesce("message", F.lit("")), F.when(F.col("status") == "failed", F.col("seq"))).alias("error_message"))
    rest = F.map_filter(F.coalesce("_s", F.create_map().cast("map<string,string>")), lambda k, _: k != "stage")
    later = F.col("_added").isNotNull() & (F.col("_given").isNull() | (F.col("_added") > F.col("_given")))
    summary = F.when(later, F.map_concat(rest, F.create_map(F.lit("stage"), F.col("_stage")))).otherwise(F.col("_s"))
    return out.withColumn("result_summary", summary).drop("_s", "_given", "_stage", "_added")


STATE = "status string, progress int, started_at timestamp, completed_at timestamp, stage string, updated_at timestamp, error_message string, result_summary string"
NAMES = [f.split()[0] for f in STATE.split(", ")]


def _advance(state: dict, rows: pd.DataFrame) -> dict:
    for r in rows.sort_values("seq").itertuples():
        if state["status"] in TERMINAL:
            break
        state["status"], state["updated_at"] = r.status, r.ts if state["updated_at"] is None else max(state["updated_at"], r.ts)
        if not pd.isna(r.progress):
            state["progress"] = min(100, int(r.progress)) if state["progress"] is None else max(state["progress"], min(100, int(r.progress)))
        if r.stage is not None:
            state["stage"] = r.stage
        if r.summary is not None:
            state["result_summary"] = r.summary
        elif r.stage:
            state["result_summary"] = json.dumps({**json.loads(state["result_summary"] or "{}"), "stage": r.stage})
        if r.status == "running" and state["started_at"] is None:
            state["started_at"] = r.ts
        if r.status in TERMINAL:
            state["completed_at"] = r.ts
        if r.status == "failed":
            state["error_message"] = r.message or ""
    return state


def _stepper(keep_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current = dict(zip(NAMES, state.get if state.exists else [None] * len(NAMES)))
        current = _advance(current, pd.concat(list(batches), ignore_index=True))
        current = {k: None if v is None or (not isinstance(v, str) and pd.isna(v)) else v for k, v in current.items()}
        state.update(tuple(current.values()))
        if keep_ms is not None and current["completed_at"] is not None:
            ended = int(pd.Timestamp(current["completed_at"]).timestamp() * 1000)
            state.setTimeoutTimestamp(max(ended + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{"job_id": key[0], **current}])

    return step


def fold_jobs_stream(events: DataFrame, keep_ended: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Streaming form: one updated row per job and trigger. Events of a job are expected in order across triggers.

    With ``keep_ended`` (such as "1 day") the state of an ended job goes once the watermark, ``delay`` behind the newest
    event, has passed its end by that time; active jobs stay. Until then later events of the job change nothing; one that
    comes after it would begin the job anew, so ``keep_ended`` is the longest that a worker may go on after its job ended.
    Null and absent summaries and messages are the same. Events older than the watermark are dropped.
    """
    events = _described(events).withColumn("summary", F.to_json("summary", {"ignoreNullFields": "false"}))
    if keep_ended is not None:
        events = events.withWatermark("ts", delay)
    keep_ms = None if keep_ended is None else int(pd.Timedelta(keep_ended).total_seconds() * 1000)
    timeout = "NoTimeout" if keep_ended is None else "EventTimeTimeout"
    out = events.groupBy("job_id").applyInPandasWithState(_stepper(keep_ms), f"job_id string, {STATE}", STATE, "update", timeout)
    return out.withColumn("result_summary", F.from_json("result_summary", "map<string,string>"))


def live_feed(jobs: DataFrame, now, window: str = "5 minutes", n: int = 50) -> DataFrame:
    """Active jobs and those finished within the window, newest first."""
    at = F.lit(now).cast("timestamp")
    recent = F.col("completed_at") >= at - F.expr(f"INTERVAL {window}")
    return jobs.where(F.col("status").isin(ACTIVE) | F.coalesce(recent, F.lit(False))).orderBy(F.desc("updated_at"), "job_id").limit(n)


def latest_verdict(events: DataFrame) -> DataFrame:
    """Per detection the last verdict (case ignored), whether it confirms, and its notes."""
    last = events.groupBy("detection_id").agg(F.max(F.struct("seq", F.lower("verdict").alias("verdict"), "notes")).alias("m"))
    return last.select("detection_id", F.col("m.verdict").alias("verdict"), (F.col("m.verdict") == "confirmed").alias("validated"), F.col("m.notes").alias("notes"))


def fence(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results stored before their job stopped; later ones are discarded."""
    ends = jobs.where(F.col("completed_at").isNotNull()).select("job_id", "completed_at")
    return results.join(ends, "job_id", "left").where(F.col("completed_at").isNull() | (F.col("ts") <= F.col("completed_at"))).drop("completed_at")


def request_rollup(log: DataFrame, slow_ms: int = 1000) -> DataFrame:
    """Request pairs by id: duration, status and whether it was slow or never answered."""
    opened, closed = F.min(F.when(F.col("phase") == "in", F.col("ts"))), F.max(F.when(F.col("phase") == "out", F.col("ts")))
    pair = log.groupBy("request_id").agg(opened.alias("started"), closed.alias("ended"), F.max("status").alias("status"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ms = (micros("ended") - micros("started")) / 1000
    return pair.withColumn("ms", ms).withColumn("slow", F.coalesce(F.col("ms") >= slow_ms, F.lit(False))).withColumn("open", F.col("ended").isNull())


def request_rollup_stream(log: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Answers per window and status; repeats of a request's phase inside the delay count once."""
    once = log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id", "phase"])
    return once.where(F.col("phase") == "out").groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"))


def upsert_verdicts(events: DataFrame, path: str, checkpoint: str):
    """Stream of review events into a table of each detection's latest verdict, one dated snapshot per micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("detection_id").agg(F.max(F.struct("seq", F.lower("verdict").alias("verdict"), "notes")).alias("m"))
        latest.select("detection_id", "m.*").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_verdicts(snapshots: DataFrame) -> DataFrame:
    """Fold the micro-batch snapshots to one row per detection (replayed batches change nothing)."""
    return latest_verdict(snapshots.select("detection_id", "seq", "verdict", "notes"))


def consecutive_revisions(reviews: DataFrame, key: str = "label_id") -> DataFrame:
    """Labels whose review revisions are not 1, 2, 3, ... or whose dates run backwards."""
    w = Window.partitionBy(key).orderBy("revision")
    step = reviews.withColumns({"_p": F.lag("revision").over(w), "_d": F.lag("reviewed_on").over(w)})
    bad = F.when(F.col("_p").isNull(), F.col("revision") != 1).otherwise((F.col("revision") != F.col("_p") + 1) | (F.col("reviewed_on") < F.col("_d")))
    return step.where(bad).select(key).distinct()


def latest_review(reviews: DataFrame, key: str = "label_id") -> DataFrame:
    return reviews.groupBy(key).agg(F.max_by("status", "revision").alias("status"), F.max("revision").alias("revision"))
