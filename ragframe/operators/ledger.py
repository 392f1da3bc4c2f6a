"""Ingestion ledger: replay, pipeline state, retries, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.session import stored

# ---- fixed values -----------------------------------------------------------------------------
TERMINAL_PROCESS = ["pdf extraction failed"]
TERMINAL_EMBED = ["not retryable", "retries exhausted"]
ENTRY_STATES = ["absent", "queued", "processing", "succeeded", "failed"]
ERROR_CHARS = 2000
STALE_SECONDS = 600
# -----------------------------------------------------------------------------------------------

BLOCK = 4096
STATE = (
    "struct<status:string,claims:bigint,ignored:bigint,touched:boolean,error:string,own_start:boolean,"
    "started:timestamp,finished:timestamp,succeeded:timestamp>"
)


def _state(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(STATE)


def _initial(status: Column) -> Column:
    null, no, zero = F.lit(None), F.lit(False), F.lit(0)
    return _state(
        status=status, claims=zero, ignored=zero, touched=no, error=null, own_start=no,
        started=null, finished=null, succeeded=null,
    )


def transition(acc: Column, e: Column) -> Column:
    """One ledger event applied to one job row; events the current status forbids change nothing."""
    status, action = acc.status, e.action
    opens = action.isin("enqueue", "open") & (status == "absent")
    claims = (action == "claim") & (status == "queued")
    succeeds = (action == "succeed") & (status == "processing")
    fails = (action == "fail") & (status != "absent")
    requeues = (action == "requeue") & status.isin("processing", "failed")
    ends = succeeds | fails
    to = F.when(opens | requeues, "queued").when(claims, "processing").when(succeeds, "succeeded").otherwise("failed")
    moved = _state(
        status=to,
        claims=acc.claims + claims.cast("bigint"),
        ignored=acc.ignored,
        touched=F.lit(True),
        error=F.when(fails | requeues, F.substring(e.error, 1, ERROR_CHARS)),
        own_start=acc.own_start | ~ends,
        started=F.when(claims, e["at"]).when(ends, acc.started),
        finished=F.when(ends, e["at"]),
        succeeded=F.coalesce(acc.succeeded, F.when(succeeds, e["at"])),
    )
    same = {f: acc[f] for f in ("status", "claims", "touched", "error", "own_start", "started", "finished", "succeeded")}
    refused = F.when(action == "open", acc.ignored).otherwise(acc.ignored + 1)
    kept = _state(**{f: refused if f == "ignored" else same[f] for f in
                     ("status", "claims", "ignored", "touched", "error", "own_start", "started", "finished", "succeeded")})
    return F.when(opens | claims | ends | requeues, moved).otherwise(kept)


def _fold(events: DataFrame) -> DataFrame:
    """(document_id, kind, s): exit row of each job.

    A run of events is a function from entry status to exit row, and such functions compose. Blocks
    of ``BLOCK`` consecutive events are folded apart, once per possible entry status, and the few
    block results are chained: a document that owns a third of all events still spreads.
    """
    blocks = events.groupBy("document_id", "kind", F.floor(F.col("seq") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "late", "at", "action", "error"))).alias("steps")
    )
    entries = F.array(*map(F.lit, ENTRY_STATES))
    folded = blocks.select(
        "document_id", "kind", "block",
        F.transform(entries, lambda s: F.aggregate("steps", _initial(s), transition)).alias("exits"),
    )
    chain = folded.groupBy("document_id", "kind").agg(
        F.sort_array(F.collect_list(F.struct("block", "exits"))).alias("blocks")
    )

    def compose(acc: Column, b: Column) -> Column:
        out = F.element_at(b.exits, F.array_position(entries, acc.status).cast("int"))
        pick = lambda f: F.when(out.touched, out[f]).otherwise(acc[f])
        return _state(
            status=out.status, claims=acc.claims + out.claims, ignored=acc.ignored + out.ignored,
            touched=acc.touched | out.touched, error=pick("error"), own_start=acc.own_start | out.own_start,
            started=F.when(out.own_start, out.started).otherwise(acc.started), finished=pick("finished"),
            succeeded=F.coalesce(acc.succeeded, out.succeeded),
        )

    return chain.select("document_id", "kind", F.aggregate("blocks", _initial(F.lit("absent")), compose).alias("s"))


def replay(events: DataFrame) -> DataFrame:
    """Fold ledger events into the current row of each (document, kind).

    ``seq`` numbers the events of one job in order of time, densely and without repeats. The first success
    of a process job opens the document's embed job at that time, before the embed events of the same
    moment; embed events that came earlier met a job that was not there.
    """
    known = events.select("document_id", "kind", "seq", F.lit(0).alias("late"), "at", "action", "error")
    # Read for the result, for the embed jobs that open and for what came before them: folded once.
    process = stored(_fold(known.filter(F.col("kind") == "process")), "process-jobs")
    done = process.filter(F.col("s.succeeded").isNotNull()).select("document_id", F.col("s.succeeded").alias("done"))
    embeds = known.filter(F.col("kind") == "embed")
    before = embeds.join(done, "document_id").filter(F.col("at") < F.col("done")).groupBy("document_id").agg(F.max("seq").alias("seq"))
    opened = done.join(before, "document_id", "left").select(
        "document_id", F.lit("embed").alias("kind"), F.coalesce("seq", F.lit(-(2**40))).alias("seq"), F.lit(1).alias("late"),
        F.col("done").alias("at"), F.lit("open").alias("action"), F.lit(None).cast("string").alias("error"),
    )
    embed = _fold(embeds.unionByName(opened))
    return process.unionByName(embed).filter(F.col("s.status") != "absent").select(
        "document_id", "kind", F.col("s.status").alias("status"), F.col("s.claims").alias("attempts"),
        F.col("s.ignored").alias("ignored"), F.col("s.error").alias("error"),
        F.col("s.started").alias("started_at"), F.col("s.finished").alias("finished_at"),
    )


def state_column(status: Column, embedding: Column, process: Column, embed: Column) -> Column:
    """FAILED before READY before EMBEDDING before PROCESSING before UPLOADED; jobs may be null."""
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    return (
        F.when(is_(status, "failed") | is_(embedding, "failed") | is_(process, "failed") | is_(embed, "failed"), "FAILED")
        .when(is_(status, "ready") & is_(embedding, "ready"), "READY")
        .when(is_(embedding, "processing") | is_(embed, "processing") | is_(embed, "queued"), "EMBEDDING")
        .when(is_(status, "processing") | is_(process, "processing"), "PROCESSING")
        .when(is_(process, "queued"), "UPLOADED")
        .when(is_(status, "ready"), "READY")
        .otherwise("UPLOADED")
    )


def ingestion_state(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    by_kind = jobs.groupBy("document_id").agg(
        F.max(F.when(F.col("kind") == "process", F.col("status"))).alias("process_job"),
        F.max(F.when(F.col("kind") == "embed", F.col("status"))).alias("embed_job"),
    )
    d = documents.select("document_id", "status", "embedding_status")
    return d.join(by_kind, "document_id", "left").select(
        "document_id", "process_job", "embed_job",
        state_column(F.col("status"), F.col("embedding_status"), F.col("process_job"), F.col("embed_job")).alias("state"),
    )


def retry_schedule(jobs: DataFrame, backoff_seconds: float = 5.0) -> DataFrame:
    """What settling each failed run would do: retry after a doubling delay, or give up.

    Only an exhausted transient failure marks the document; terminal outcomes were dealt with by
    the phase that reported them.
    """
    markers = lambda words: F.greatest(*[F.col("error").contains(w) for w in words]) if len(words) > 1 else F.col("error").contains(words[0])
    terminal = F.when(F.col("kind") == "process", markers(TERMINAL_PROCESS)).otherwise(markers(TERMINAL_EMBED))
    transient = ~F.coalesce(terminal, F.lit(False))
    retry = transient & (F.col("attempts") < F.col("max_attempts"))
    delay = F.lit(backoff_seconds) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempts") - 1))
    return jobs.filter(F.col("status") == "failed").select(
        "document_id", "kind", "attempts", "error", transient.alias("transient"),
        F.when(retry, "retrying").otherwise("failed").alias("outcome"),
        F.when(retry, delay).alias("delay_seconds"),
        (transient & ~retry).alias("flags_document"),
    )


def run_outcomes(jobs: DataFrame) -> DataFrame:
    """(document_id, kind, outcome, seconds) of each settled run: processed or embedded, retrying or failed."""
    failed = retry_schedule(jobs).select("document_id", "kind", F.col("outcome").alias("_failed"))
    settled = jobs.filter(F.col("status").isin("succeeded", "failed"))
    done = F.when(F.col("kind") == "process", "processed").otherwise("embedded")
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000000
    return settled.join(failed, ["document_id", "kind"], "left").select(
        "document_id", "kind", F.coalesce("_failed", done).alias("outcome"), seconds.alias("seconds")
    )


def outcome_counts(runs: DataFrame) -> DataFrame:
    """(kind, processed, embedded, retrying, failed, failure_rate): failed runs over all that settled."""
    names = ("processed", "embedded", "retrying", "failed")
    counts = [F.count_if(F.col("outcome") == n).alias(n) for n in names]
    return runs.groupBy("kind").agg(*counts, (F.count_if(F.col("outcome") == "failed") / F.count("*")).alias("failure_rate"))


def job_timings(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Run and wait time in milliseconds."""
    micros = F.unix_micros
    return jobs.select(
        "document_id", "kind", "status",
        ((micros(F.coalesce("finished_at", as_of)) - micros("started_at")) / 1000).alias("run_ms"),
        ((micros("started_at") - micros("enqueued_at")) / 1000).alias("wait_ms"),
    )


def stale_jobs(jobs: DataFrame, as_of: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Jobs whose claim is older than the time-out and which a sweep should requeue."""
    age = F.unix_seconds(as_of) - F.unix_seconds("started_at")
    return jobs.filter((F.col("status") == "processing") & (age > seconds)).select(
        "document_id", "kind", "attempts", age.alias("age_seconds")
    )
