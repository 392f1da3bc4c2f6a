"""Streaming versions of ingestion, telemetry, the ledger and conversation memory.

Each job is the batch operator over an unbounded input. Checkpoints give claim-once reading; sinks are
keyed, so a batch delivered again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragframe import schemas
from ragframe.functions import text as tx
from ragframe.operators import chunking, conversations, embedding, ledger, pages, telemetry
from ragframe.sources import sinks

# ---- fixed values: our own lateness rules --------------------------------------------------------
WATERMARK = "10 minutes"
IDLE_MS = 7 * 24 * 3600 * 1000
# -------------------------------------------------------------------------------------------------


def stream_table(spark: SparkSession, root: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A given table as a file stream with its declared schema."""
    return (
        spark.readStream.schema(schemas.INPUT[name])
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{root}/{name}*.parquet")
    )


def run_once(df: DataFrame, checkpoint: str, write: Callable, mode: str = "append"):
    """Drain what is there with ``availableNow`` and stop."""
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


# ---- ingestion ----------------------------------------------------------------------------------


def ingest(documents: DataFrame, strategy: str = "paragraph", **budgets) -> DataFrame:
    """Documents to embedded chunks: stateless, so the same plan serves batch and stream."""
    rows = chunking.chunk_bundles(pages.document_bundles(documents.drop("version")), strategy, **budgets)
    return embedding.hash_embed_batches(rows)


def ingest_writer(path: str, strategy: str = "paragraph", **budgets) -> Callable[[DataFrame, int], None]:
    """Micro-batches of documents with a ``version`` to chunks, one document replaced as a whole.

    Of several deliveries of a document in a batch the newest is chunked. Chunks are written before the list of
    documents they belong to, so a document appears whole or not at all; nothing stored is rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = sinks.latest(batch, ["document_id"], F.struct("version", "text"))
        sinks.write_batch(ingest(newest, strategy, **budgets), f"{path}/chunks", number)
        sinks.write_batch(newest.select("document_id", "version"), f"{path}/documents", number)

    return write


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the newest version of every document; of equal versions, the one delivered last."""
    listed = spark.read.parquet(f"{path}/documents")
    newest = listed.groupBy("document_id").agg(F.max(F.struct("version", "batch")).alias("v")).select("document_id", F.col("v.batch").alias("batch"))
    return spark.read.parquet(f"{path}/chunks").join(newest, ["document_id", "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current chunks and documents of ``path`` as the first batch of a new table."""
    sinks.write_batch(current_chunks(spark, path), f"{target}/chunks", 0)
    listed = spark.read.parquet(f"{path}/documents").groupBy("document_id").agg(F.max("version").alias("version"))
    sinks.write_batch(listed, f"{target}/documents", 0)


# ---- telemetry ----------------------------------------------------------------------------------


def deduplicated(requests: DataFrame) -> DataFrame:
    return requests.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def telemetry_rates(requests: DataFrame, label: str) -> DataFrame:
    return telemetry.sliding_rate(deduplicated(requests), label)


def telemetry_counts(requests: DataFrame, length: str = "1 hour") -> DataFrame:
    """Requests, errors and cumulative latency buckets per window and route, append mode."""
    buckets = [
        F.count_if(F.col("seconds") <= b).alias(f"le_{i}") for i, b in enumerate(telemetry.HTTP_BUCKETS)
    ]
    counted = deduplicated(requests).groupBy(F.window("ts", length), "method").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), *buckets
    )
    return counted.select(F.col("window.start").alias("window_start"), *[c for c in counted.columns if c != "window"])


def breaches(requests: DataFrame, limit: int, window: str = telemetry.RATE_WINDOW) -> DataFrame:
    return telemetry.rate_limit_breaches(deduplicated(requests), limit, window)


def split_writer(path: str, time: str = "ts", delay: str = WATERMARK) -> Callable[[DataFrame, int], None]:
    """Rows in time under ``path``/rows, rows behind the watermark under ``path``/late.

    The watermark of a micro-batch is the latest time of the batches before it less ``delay``, as in a stateful stream
    over the same source, which drops those rows without a trace. Times of batches are one stored row each, so a batch
    delivered twice splits the same way. Rows without a time are in neither.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, marks, batch = batch.sparkSession, f"{path}/marks", batch.filter(F.col(time).isNotNull())
        # The first row of this kind makes the table readable; it is of no batch and has no time.
        if number == 0:
            sinks.write_batch(spark.createDataFrame([(None,)], "latest timestamp"), marks, -1)
        earlier = spark.read.schema("latest timestamp, batch bigint").parquet(marks).filter(F.col("batch") < number)
        mark = earlier.agg((F.max("latest") - F.expr(f"interval {delay}")).alias("watermark")).first()["watermark"]
        late = F.lit(False) if mark is None else F.col(time) < F.lit(mark)
        sinks.write_batch(batch.filter(~late), f"{path}/rows", number)
        sinks.write_batch(batch.filter(late).withColumn("watermark", F.lit(mark).cast("timestamp")), f"{path}/late", number)
        sinks.write_batch(batch.agg(F.max(time).alias("latest")), marks, number)

    return write


def late_rows(query) -> int:
    """Rows a finished query dropped behind the watermark."""
    return sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )


# ---- ledger -------------------------------------------------------------------------------------

LEDGER_OUT = (
    "document_id bigint, kind string, status string, attempts bigint, ignored bigint, error string, "
    "started_at timestamp, finished_at timestamp, version bigint"
)
LEDGER_COLUMNS = [field.split()[0] for field in LEDGER_OUT.split(", ")]
LEDGER_STATE = (
    "version bigint, p_status string, p_attempts bigint, p_ignored bigint, p_error string, p_started timestamp, "
    "p_finished timestamp, e_status string, e_attempts bigint, e_ignored bigint, e_error string, "
    "e_started timestamp, e_finished timestamp"
)
_NEW_JOB = ("absent", 0, 0, None, None, None)


def apply_event(job: tuple, action: str, at, error: str | None) -> tuple[tuple, bool]:
    """The ledger's transition on one job row; the flag tells whether it was legal."""
    status, attempts, ignored, old_error, started, finished = job
    error = error[: ledger.ERROR_CHARS] if error else None
    if action == "enqueue" and status == "absent":
        return ("queued", attempts, ignored, None, None, None), True
    if action == "claim" and status == "queued":
        return ("processing", attempts + 1, ignored, None, at, None), True
    if action == "succeed" and status == "processing":
        return ("succeeded", attempts, ignored, None, started, at), True
    if action == "fail" and status != "absent":
        return ("failed", attempts, ignored, error, started, at), True
    if action == "requeue" and status in ("processing", "failed"):
        return ("queued", attempts, ignored, error, None, None), True
    return (status, attempts, ignored + 1, old_error, started, finished), False


def streaming_ledger(events: DataFrame, timeout_seconds: int | None = None) -> DataFrame:
    """Current row of each job after every batch, state keyed by document and bounded by two jobs.

    With a time-out, a run still processing that long after its claim (event time) is requeued.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (0, *_NEW_JOB, *_NEW_JOB)
        clean = [None if v is None or v != v else v for v in old]
        version, jobs = clean[0], {"process": tuple(clean[1:7]), "embed": tuple(clean[7:])}
        if state.hasTimedOut:
            now = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            for kind, job in jobs.items():
                if job[0] == "processing" and (now - pd.Timestamp(job[4])).total_seconds() >= timeout_seconds:
                    jobs[kind], _ = apply_event(job, "requeue", now, f"no outcome after {timeout_seconds} s")
        else:
            # What a process run does at some moment comes before the embed events of that moment.
            rows = [r for frame in batches for r in zip(*(frame[c].tolist() for c in ("at", "kind", "seq", "action", "error")))]
            rows.sort(key=lambda r: (r[0] is pd.NaT, r[0] if r[0] is not pd.NaT else None, r[1] != "process", r[2] != r[2], r[2]))
            for at, kind, _, action, error in rows:
                jobs[kind], legal = apply_event(jobs[kind], action, None if at is pd.NaT else at, error)
                if kind == "process" and action == "succeed" and legal and jobs["embed"][0] == "absent":
                    jobs["embed"], _ = apply_event(jobs["embed"], "enqueue", at, None)
        state.update((version + 1, *jobs["process"], *jobs["embed"]))
        running = [pd.Timestamp(j[4]) for j in jobs.values() if j[0] == "processing"]
        if timeout_seconds and running:
            due = int(min(running).timestamp() * 1000) + timeout_seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        out = [(key[0], kind, *job, version + 1) for kind, job in jobs.items() if job[0] != "absent"]
        columns = dict(zip(LEDGER_COLUMNS, zip(*out) if out else [()] * len(LEDGER_COLUMNS)))
        for c in ("started_at", "finished_at"):  # numbers of time, since parsing a frame of one job costs more than its events
            columns[c] = np.array([pd.NaT.value if t is None else pd.Timestamp(t).value for t in columns[c]], np.int64).view("M8[ns]")
        yield pd.DataFrame(columns)

    if timeout_seconds:
        events = events.withWatermark("at", WATERMARK)
    kind = GroupStateTimeout.EventTimeTimeout if timeout_seconds else GroupStateTimeout.NoTimeout
    return events.groupBy("document_id").applyInPandasWithState(update, LEDGER_OUT, LEDGER_STATE, "update", kind)


JOB = "struct<status:string,attempts:bigint,ignored:bigint,error:string,started_at:timestamp,finished_at:timestamp>"
BOTH = f"struct<process:{JOB},embed:{JOB}>"


def _job(*fields: Column) -> Column:
    return F.struct(*fields).cast(JOB)


def _applied(job: Column, e: Column) -> Column:
    """``apply_event`` as an expression."""
    status, action, null = job.status, e.action, F.lit(None)
    opens, claims = (action == "enqueue") & (status == "absent"), (action == "claim") & (status == "queued")
    succeeds, fails = (action == "succeed") & (status == "processing"), (action == "fail") & (status != "absent")
    requeues = (action == "requeue") & status.isin("processing", "failed")
    legal = opens | claims | succeeds | fails | requeues
    return _job(
        F.when(opens | requeues, "queued").when(claims, "processing").when(succeeds, "succeeded").when(fails, "failed").otherwise(status),
        job.attempts + claims.cast("bigint"),
        job.ignored + (~legal).cast("bigint"),
        F.when(fails | requeues, F.nullif(F.substring(e.error, 1, ledger.ERROR_CHARS), F.lit(""))).when(legal, null).otherwise(job.error),
        F.when(claims, e["at"]).when(opens | requeues, null).otherwise(job.started_at),
        F.when(succeeds | fails, e["at"]).when(legal, null).otherwise(job.finished_at),
    )


def _both(acc: Column, e: Column) -> Column:
    """One event on the two jobs of a document; a success of the process job opens an embed job that is not there."""
    opened = e.process & (e.action == "succeed") & (acc.process.status == "processing") & (acc.embed.status == "absent")
    null = F.lit(None)
    queued = _job(F.lit("queued"), acc.embed.attempts, acc.embed.ignored, null, null, null)
    return F.struct(
        F.when(e.process, _applied(acc.process, e)).otherwise(acc.process),
        F.when(~e.process, _applied(acc.embed, e)).when(opened, queued).otherwise(acc.embed),
    ).cast(BOTH)


def ledger_merge_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batches of ledger events folded onto the stored jobs of their documents; ``current_jobs`` reads the result.

    The rows are those of ``streaming_ledger`` without a time-out. A document's events of a batch are put in order and
    applied by expressions in its row, so that a document costs no call into Python; its jobs are the newest rows of
    the batches before, so a batch delivered twice gives the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        steps = batch.groupBy("document_id").agg(F.sort_array(F.collect_list(ledger_step())).alias("steps"))
        joined = steps.join(stored_jobs(batch.sparkSession, path, number), F.col("document_id").eqNullSafe(F.col("_id")), "left")
        folded = joined.select("document_id", "version", tx.seal(F.aggregate("steps", both_jobs(), _both)).alias("s"))
        sinks.write_batch(job_rows(folded), path, number)

    return write


def ledger_step() -> Column:
    """A ledger event as a struct whose order is that in which a document's events apply."""
    known = F.when(F.col("kind").isin("process", "embed"), F.col("kind") == "process").otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of job: "), F.coalesce("kind", F.lit("null")))).cast("boolean")
    )
    # What a process run does at some moment comes before the embed events of that moment.
    return F.struct(
        F.col("at").isNull().alias("_timeless"), "at", (~known).alias("_later"), F.col("seq").isNull().alias("_unnumbered"), "seq",
        F.coalesce("action", F.lit("")).alias("action"), "error", known.alias("process"),
    )


def stored_jobs(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(_id, version, process, embed): the newest rows of each document of the batches before ``number``."""
    schema = f"{LEDGER_OUT}, batch bigint"
    rows = spark.read.schema(schema).parquet(path).filter(F.col("batch") < number) if number else spark.createDataFrame([], schema)
    job = _job(*[F.col(c) for c in LEDGER_COLUMNS[2:-1]])
    newest = lambda kind: F.max_by(job, F.when(F.col("kind") == kind, F.col("version"))).alias(kind)
    return rows.groupBy(F.col("document_id").alias("_id")).agg(F.max("version").alias("version"), newest("process"), newest("embed"))


def both_jobs() -> Column:
    """The two stored jobs of a document, absent ones among them."""
    absent = _job(F.lit("absent"), F.lit(0), F.lit(0), F.lit(None), F.lit(None), F.lit(None))
    return F.struct(F.coalesce("process", absent), F.coalesce("embed", absent)).cast(BOTH)


def job_rows(folded: DataFrame) -> DataFrame:
    """(document_id, version, s) as one row per job; one that is not there yet counts the events that were ignored."""
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s.{k}").alias("j")) for k in ("process", "embed")])
    out = folded.select("document_id", "version", F.explode(both).alias("x"))
    return out.select("document_id", "x.kind", "x.j.*", (F.coalesce("version", F.lit(0)) + 1).cast("bigint").alias("version"))


def ledger_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        sinks.write_batch(sinks.latest(batch, ["document_id", "kind"], F.col("version")), path, number)

    return write


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every job."""
    rows = spark.read.parquet(path)
    return sinks.latest(rows, ["document_id", "kind"], F.col("version")).drop("batch").filter(F.col("status") != "absent")


# ---- conversation memory ------------------------------------------------------------------------

MEMORY_OUT = (
    "conversation_id bigint, position bigint, question string, "
    "history array<struct<position:bigint,role:string,content:string>>"
)
MEMORY_STATE = "positions array<bigint>, roles array<string>, contents array<string>"


def streaming_memory(
    messages: DataFrame, max_messages: int = conversations.HISTORY_MESSAGES, idle_ms: int | None = None
) -> DataFrame:
    """For every arriving user turn: the turns before it and the expanded question.

    The state keeps the ``max_messages`` turns of the highest positions; a turn that arrives late takes its place
    among them, and the turns of one trigger are read in order of position whatever order and pieces they arrive in; a
    trigger's size bounds what a task holds of a conversation. With ``idle_ms``, for streams that run on (a drained one would never end), a conversation idle
    for so long is forgotten; IDLE_MS is a fair value. Python only keeps the window; budget and
    expansion are the batch expressions over it.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns = list(zip(*state.get)) if state.exists else []
        # A group comes in pieces of the session's Arrow size, in no order: the turns of a trigger are put in theirs first.
        arrived = pd.concat([rows[["position", "role", "content"]] for rows in batches]).sort_values("position", kind="stable")
        out = []
        for position, role, content in arrived.itertuples(index=False, name=None):
            if role == "user":
                history = [{"position": int(p), "role": r, "content": c} for p, r, c in turns if p < position]
                out.append((key[0], position, content, history))
            turns.append((int(position), role, content))
            if len(turns) > 1 and turns[-1][0] < turns[-2][0]:
                turns.sort(key=lambda t: t[0])
            del turns[:-max_messages]
        state.update(tuple([t[i] for t in turns] for i in range(3)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conversation_id", "position", "question", "history"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    kept = messages.groupBy("conversation_id").applyInPandasWithState(
        update, MEMORY_OUT, MEMORY_STATE, "append", timeout
    )
    fitted = conversations.fit_history(F.col("history"))
    return kept.select(
        "conversation_id", "position",
        conversations.splice(
            F.col("question"), conversations.last_said(fitted, "user"), conversations.last_said(fitted, "assistant")
        ).alias("expanded"),
        F.transform(fitted, lambda t: t.position).alias("kept"),
    )
