"""The ingestion ledger in event time: events take effect in order of time, whatever order they arrive in.

Events of a document wait in a list state until the watermark has passed them; a timer then applies them in order.
A run without an outcome is requeued at its due time, between the events before and after it, so that results depend
on the events alone and not on how they were cut into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ragframe.functions import text as tx
from ragframe.operators import ledger
from ragframe.sources import sinks
from ragframe.streaming.jobs import (
    _NEW_JOB, BOTH, WATERMARK, _both, _job, apply_event, both_jobs, job_rows, ledger_step, stored_jobs,
)

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "us bigint, kind string, seq bigint, action string, error string"
JOB = ", ".join(
    f"{k}_status string, {k}_attempts bigint, {k}_ignored bigint, {k}_error string, {k}_started bigint, {k}_finished bigint"
    for k in ("process", "embed")
)
OUT = (
    "document_id bigint, kind string, status string, attempts bigint, ignored bigint, error string, "
    "started_us bigint, finished_us bigint, version bigint"
)
NAMES = ["status", "attempts", "ignored", "error", "started_us", "finished_us"]


def timer_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep state that can hold lists and timers; ``spark`` keeps its own setting."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


class _Jobs(StatefulProcessor):
    """Both jobs of a document, and its events that the watermark has not passed."""

    def __init__(self, timeout_seconds: int):
        self.timeout = timeout_seconds * 1_000_000
        self.reason = f"no outcome after {timeout_seconds} s"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", f"version bigint, {JOB}")
        self.waiting = handle.getListState("waiting", EVENT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))
        events = [
            (int(us), kind, int(seq), action, error if isinstance(error, str) else None)
            for us, kind, seq, action, error in fresh[["us", "kind", "seq", "action", "error"]].itertuples(index=False, name=None)
        ]
        self.waiting.appendList(events)
        self._wake(min(e[0] for e in events), timerValues)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        old = self.jobs.get() if self.jobs.exists() else (0, *_NEW_JOB, *_NEW_JOB)
        jobs = {"process": tuple(old[1:7]), "embed": tuple(old[7:])}
        # What a process run does at some moment comes before the embed events of that moment.
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1] != "process", e[2])) if self.waiting.exists() else []
        due = [e for e in events if e[0] <= passed]
        for us, kind, _, action, error in due:
            self._requeue(jobs, us)
            jobs[kind], legal = apply_event(jobs[kind], action, us, error)
            if kind == "process" and action == "succeed" and legal and jobs["embed"][0] == "absent":
                jobs["embed"], _ = apply_event(jobs["embed"], "enqueue", us, None)
        self._requeue(jobs, passed)
        rest = events[len(due):]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        changed = (*jobs["process"], *jobs["embed"]) != tuple(old[1:])
        if changed:
            self.jobs.update((old[0] + 1, *jobs["process"], *jobs["embed"]))
        running = [job[4] + self.timeout + 1 for job in jobs.values() if job[0] == "processing"]
        if rest or running:
            self._wake(min([e[0] for e in rest[:1]] + running), timerValues)
        rows = [
            {"document_id": key[0], "kind": kind, **dict(zip(NAMES, job)), "version": old[0] + 1}
            for kind, job in jobs.items() if changed and job[0] != "absent"
        ]
        frame = pd.DataFrame(rows, columns=["document_id", "kind", *NAMES, "version"])
        yield frame.astype({"started_us": "Int64", "finished_us": "Int64"})

    def _requeue(self, jobs: dict[str, tuple], now: int) -> None:
        """Runs that were due before ``now`` go back to the queue."""
        for kind, job in jobs.items():
            if job[0] == "processing" and job[4] + self.timeout < now:
                jobs[kind], _ = apply_event(job, "requeue", now, self.reason)

    def _wake(self, us: int, timerValues) -> None:
        """A timer for the first moment the watermark has passed ``us``; an earlier one does as well."""
        passed = timerValues.getCurrentWatermarkInMs()
        at = max(-(-us // 1000), passed + 1)
        known = [t for t in self.handle.listTimers() if t > passed]  # one that fires now is still listed
        if not known or min(known) > at:
            for timer in known:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)


def timed_ledger(events: DataFrame, timeout_seconds: int = ledger.STALE_SECONDS) -> DataFrame:
    """New rows of each job whose events the watermark has passed, the run's time-out among them.

    ``events`` holds (document_id, kind, seq, at, action, error), arriving up to the watermark's delay out of order; a
    null ``at`` or document takes no part. An outcome at the due moment still counts. State is two jobs a document and
    the events of the watermark's delay.
    """
    known = events.filter("at is not null and document_id is not null")
    timed = known.withWatermark("at", WATERMARK).withColumn("us", F.unix_micros("at"))
    rows = timed.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=_Jobs(timeout_seconds), outputStructType=OUT, outputMode="Update", timeMode="EventTime"
    )
    return rows.select(
        "document_id", "kind", "status", "attempts", "ignored", "error",
        F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("finished_us").alias("finished_at"), "version",
    )


def _requeued(jobs: Column, now: Column, timeout_seconds: int) -> Column:
    """``_Jobs._requeue`` as an expression."""
    def one(job: Column) -> Column:
        due = (job.status == "processing") & (F.unix_micros(job.started_at) + timeout_seconds * 1_000_000 < F.unix_micros(now))
        reason = F.lit(f"no outcome after {timeout_seconds} s")
        return F.when(due, _job(F.lit("queued"), job.attempts, job.ignored, reason, F.lit(None), F.lit(None))).otherwise(job)

    return F.struct(one(jobs.process), one(jobs.embed)).cast(BOTH)


EVENTS = "document_id bigint, kind string, seq bigint, at timestamp, action string, error string"


def timed_merge_writer(path: str, timeout_seconds: int = ledger.STALE_SECONDS, delay: str = WATERMARK) -> Callable[[DataFrame, int], None]:
    """Micro-batches of ledger events to the rows of ``timed_ledger``; ``current_jobs`` of ``path``/jobs reads the result.

    Events that the batch's own watermark has passed are put in order and applied by expressions in their document's
    row, so that a document costs no call into Python; the others wait as rows of the batch, which the next batch reads.
    Events at or behind the watermark of the batches before take no part, as in a stateful stream. All that a batch
    reads is of the batches before it, so a batch delivered twice gives the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, jobs, marks, waiting = batch.sparkSession, f"{path}/jobs", f"{path}/marks", f"{path}/waiting"
        if number == 0:  # rows of no batch, which make the tables readable
            sinks.write_batch(spark.createDataFrame([(None,)], "latest timestamp"), marks, -1)
            sinks.write_batch(spark.createDataFrame([(None,) * 6], EVENTS), waiting, -1)
        known = batch.select("document_id", "kind", "seq", "at", "action", "error").filter("at is not null and document_id is not null")
        sinks.write_batch(known.agg(F.max("at").alias("latest")), marks, number)
        seen = spark.read.schema("latest timestamp, batch bigint").parquet(marks).filter(F.col("batch") <= number)
        # Spark's watermark is in whole milliseconds.
        mark = F.unix_micros(F.timestamp_millis(F.unix_millis("latest")) - F.expr(f"interval {delay}"))
        before, now = seen.agg(F.max(F.when(F.col("batch") < number, mark)), F.max(mark)).first()
        passed = F.timestamp_micros(F.lit(now).cast("long"))  # null while no event has a time
        fresh = known if before is None else known.filter(F.unix_micros("at") > before)
        held = spark.read.schema(f"{EVENTS}, batch bigint").parquet(waiting).filter(F.col("batch") == number - 1).drop("batch")
        open_events = fresh.unionByName(held.filter("at is not null"))
        sinks.write_batch(open_events.filter(F.col("at") > passed), waiting, number)
        due = open_events.filter(F.col("at") <= passed).groupBy("document_id").agg(F.sort_array(F.collect_list(ledger_step())).alias("steps"))
        joined = due.join(stored_jobs(spark, jobs, number), F.col("document_id") == F.col("_id"), "full")
        joined = joined.select(F.coalesce("document_id", "_id").alias("document_id"), "version", "steps", both_jobs().alias("old"))
        # The array of one binds the jobs after the time-outs, which the lambda would otherwise work out for each field.
        step = lambda acc, e: F.get(F.transform(F.array(_requeued(acc, e["at"], timeout_seconds)), lambda r: _both(r, e)), F.lit(0))
        applied = F.when(F.col("steps").isNull(), F.col("old")).otherwise(F.aggregate("steps", F.col("old"), step))
        folded = joined.select("document_id", "version", "old", tx.seal(applied).alias("new"))
        folded = folded.select("document_id", "version", "old", tx.seal(_requeued(F.col("new"), passed, timeout_seconds)).alias("s"))
        sinks.write_batch(job_rows(folded.filter(~F.col("s").eqNullSafe(F.col("old")))), jobs, number)

    return write
