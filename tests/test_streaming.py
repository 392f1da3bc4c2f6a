"""A drained stream equals the batch result, whatever the batching and however often it is delivered."""

import datetime as dt
import os
import random
import uuid

from pyspark.sql import functions as F

from ragframe.operators import conversations, ledger
from ragframe.streaming import jobs as st
from ragframe.streaming import timed_ledger as tl
from helpers import EVENTS, random_events


def scratch():
    path = f"/tmp/spark-test-stream-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def staged(spark, parts, schema, path):
    """One input file per part, read one at a time in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_ledger_stream_equals_replay(spark):
    rows = random_events(21, 12, 9)
    parts = [[r for r in rows if r[0] % 3 == i] for i in range(3)]
    path = scratch()
    st.run_once(st.streaming_ledger(staged(spark, parts, EVENTS, path)), f"{path}/ck", st.ledger_writer(f"{path}/out"), "update")
    row = lambda r: (r.status, r.attempts, r.ignored, r.error)
    got = {(r.document_id, r.kind): row(r) for r in st.current_jobs(spark, f"{path}/out").collect()}
    want = {(r.document_id, r.kind): row(r) for r in ledger.replay(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == want and {k[1] for k in got} == {"process", "embed"}


def test_merged_ledger_equals_the_stateful_stream(spark):
    """Jobs split over batches, some events out of order, without a time, action or error; delivered again under a new checkpoint."""
    rows = random_events(33, 10, 12) + [(3, "embed", 90, None, "claim", None), (3, "process", 91, None, None, "x"), (4, "process", 92, None, "fail", "")]
    random.Random(5).shuffle(rows)
    parts = [rows[i::3] for i in range(3)]
    path = scratch()
    row = lambda r: (r.document_id, r.kind, r.status, r.attempts, r.ignored, r.error, r.started_at, r.finished_at, r.version)
    st.run_once(st.streaming_ledger(staged(spark, parts, EVENTS, f"{path}/a")), f"{path}/a/ck", st.ledger_writer(f"{path}/a/out"), "update")
    want = sorted(map(row, st.current_jobs(spark, f"{path}/a/out").collect()), key=repr)
    source = staged(spark, parts, EVENTS, f"{path}/b")
    for again in range(2):
        st.run_once(source, f"{path}/b/ck{again}", st.ledger_merge_writer(f"{path}/b/out"))
        assert sorted(map(row, st.current_jobs(spark, f"{path}/b/out").collect()), key=repr) == want
    assert max(r[-1] for r in want) == 3


def test_a_run_without_outcome_is_requeued(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    parts = [
        [(1, "process", 0, at(0), "enqueue", None), (1, "process", 1, at(0), "claim", None)],
        [(2, "process", 0, at(40), "enqueue", None)],
        [(2, "process", 1, at(90), "claim", None)],
    ]
    path = scratch()
    st.run_once(st.streaming_ledger(staged(spark, parts, EVENTS, path), 600), f"{path}/ck", st.ledger_writer(f"{path}/out"), "update")
    got = {r.document_id: (r.status, r.attempts, r.error) for r in st.current_jobs(spark, f"{path}/out").collect()}
    assert got == {1: ("queued", 1, "no outcome after 600 s"), 2: ("processing", 1, None)}


def test_memory_stream_equals_batch(spark):
    schema = "conversation_id bigint, position bigint, role string, content string"
    rows = [(c, p, ["user", "assistant", "user", "system"][p % 4], f"what about that {c} {p}") for c in range(4) for p in range(1, 31)]
    parts = [[r for r in rows if lo < r[1] <= lo + 8] for lo in (0, 8, 16, 24)]
    path = scratch()
    out = st.streaming_memory(staged(spark, parts, schema, path))
    st.run_once(out, f"{path}/ck", lambda b, n: b.write.mode("append").parquet(f"{path}/out"))
    got = sorted((r.conversation_id, r.position, r.expanded, r.kept) for r in spark.read.parquet(f"{path}/out").collect())
    m = spark.createDataFrame(rows, schema)
    e = {(r.conversation_id, r.position): r.expanded for r in conversations.expand_followups(m).collect()}
    h = {(r.conversation_id, r.position): [t.position for t in r.history] for r in conversations.history_window(m).collect()}
    assert got == sorted((*k, e[k], h[k]) for k in e)


REQ = "event_id bigint, ts timestamp, method string, status int, seconds double"


def test_telemetry_drops_duplicates_and_counts_late_rows(spark):
    t0 = dt.datetime(2024, 1, 1)
    row = lambda i, minutes, status=200: (i, t0 + dt.timedelta(minutes=minutes), "GET", status, 0.1)
    parts = [
        [row(1, 1), row(2, 2, 500), row(1, 1), row(3, 59)],
        [row(4, 100), row(5, 101)],
        [row(6, 3), row(7, 300)],  # 6 arrives behind the watermark
    ]
    path = scratch()
    q = st.run_once(
        st.telemetry_counts(staged(spark, parts, REQ, path)), f"{path}/ck",
        lambda b, n: b.write.mode("append").parquet(f"{path}/out"),
    )
    got = sorted((r.window_start, r.requests, r.errors, r.le_4) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [(t0, 3, 1, 3), (t0 + dt.timedelta(hours=1), 2, 0, 2)]
    assert st.late_rows(q) >= 1


def test_ingest_replaces_whole_documents(spark):
    schema = "document_id bigint, organization_id string, text string, version bigint"
    long = [(i, "org", f"Some words number {i}. " * 40, 1) for i in range(6)]
    short = [(2, "org", "Only this.", 2), (2, "org", "Only this.", 2), (4, "org", "", 2)]
    late = [(2, "org", "An older text. " * 30, 1), (5, "org", "New words. " * 50, 3)]
    path = scratch()
    key = lambda df: sorted(map(tuple, df.select("document_id", "chunk_index", "content", F.size("vector")).collect()))
    last = {r[0]: r for r in [*long, *short, late[1]]}
    want = key(st.ingest(spark.createDataFrame(list(last.values()), schema), "token", chunk_tokens=32))
    for run in ("a", "b"):  # the same files again under a new checkpoint
        docs = staged(spark, [long[:3], long[3:], short, late], schema, f"{path}/{run}")
        st.run_once(docs, f"{path}/{run}/ck", st.ingest_writer(f"{path}/out", "token", chunk_tokens=32))
        assert key(st.current_chunks(spark, f"{path}/out")) == want
    st.compact(spark, f"{path}/out", f"{path}/small")
    assert key(st.current_chunks(spark, f"{path}/small")) == want


def test_memory_puts_late_turns_in_place(spark):
    schema = "conversation_id bigint, position bigint, role string, content string"
    parts = [[(1, 1, "user", "first"), (1, 4, "assistant", "fourth")], [(1, 2, "user", "second"), (1, 5, "user", "and it?")]]
    path = scratch()
    st.run_once(st.streaming_memory(staged(spark, parts, schema, path)), f"{path}/ck", lambda b, n: b.write.mode("append").parquet(f"{path}/out"))
    kept = {r.position: list(r.kept) for r in spark.read.parquet(f"{path}/out").collect()}
    assert kept == {1: [], 2: [1], 5: [1, 2, 4]}


def test_memory_of_a_long_shuffled_conversation(spark):
    """A conversation that reaches the task in many pieces, and one whose turns arrive over three batches."""
    schema = "conversation_id bigint, position bigint, role string, content string"
    rows = [(1, p, ("user", "assistant")[p % 2], f"what about that {p}") for p in range(20_000)]
    rows += [(2, p, ("user", "assistant")[p % 2], f"and it {p}") for p in range(60)]
    random.Random(6).shuffle(rows)
    late = [[r for r in rows if r[0] == 2 and r[1] // 20 == part] for part in range(3)]
    parts = [[r for r in rows if r[0] == 1] + late[0], late[1], late[2]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        path = scratch()
        out = st.streaming_memory(staged(spark, parts, schema, path))
        st.run_once(out, f"{path}/ck", lambda b, n: b.write.mode("append").parquet(f"{path}/out"))
        got = sorted((r.conversation_id, r.position, r.expanded, list(r.kept)) for r in spark.read.parquet(f"{path}/out").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    m = spark.createDataFrame(rows, schema)
    e = {(r.conversation_id, r.position): r.expanded for r in conversations.expand_followups(m).collect()}
    h = {(r.conversation_id, r.position): [t.position for t in r.history] for r in conversations.history_window(m).collect()}
    assert got == sorted((*k, e[k], h[k]) for k in e)


def test_timed_ledger_is_a_fold_in_order_of_time(spark):
    """Shuffled events over several batches, runs without an outcome and one at its due second, beside a plain fold."""
    rng = random.Random(17)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "process", 0, 0, "enqueue"), (1, "process", 1, 10, "claim"), (1, "process", 2, 610, "succeed"),
            (2, "process", 0, 0, "enqueue"), (2, "process", 1, 10, "claim"), (2, "process", 2, 611, "succeed"),
            (3, "embed", 0, 5, "claim"), (3, "process", 0, 5, "enqueue")]
    for doc in range(4, 16):
        for seq, at in enumerate(sorted(rng.sample(range(7000), 12))):
            kind = rng.choice(["process", "process", "embed"])
            rows.append((doc, kind, seq, at, rng.choice(["enqueue", "claim", "claim", "succeed", "fail", "requeue"])))
    rows.append((99, "process", 0, 8000, "enqueue"))  # brings the watermark to 7400; waits itself
    delay = {r: rng.randrange(590) for r in rows}
    arrived = sorted(rows, key=lambda r: r[3] + delay[r])
    parts = [[(d, k, s, t0 + dt.timedelta(seconds=at), a, f"e{at}" if a == "fail" else None) for d, k, s, at, a in part]
             for part in (arrived[:40], arrived[40:90], arrived[90:])]

    want = {}
    for doc in {r[0] for r in rows}:
        jobs = {k: ("absent", 0, 0, None, None, None) for k in ("process", "embed")}

        def overdue(now):
            for k, j in jobs.items():
                if j[0] == "processing" and j[4] + 600 < now:
                    jobs[k] = ("queued", j[1], j[2], "no outcome after 600 s", None, None)

        for _, kind, _, at, action in sorted((r for r in rows if r[0] == doc and r[3] <= 7400), key=lambda r: (r[3], r[1] != "process", r[2])):
            overdue(at)
            status, tries, ignored, error, began, _ = job = jobs[kind]
            legal = {"enqueue": status == "absent", "claim": status == "queued", "succeed": status == "processing",
                     "fail": status != "absent", "requeue": status in ("processing", "failed")}[action]
            jobs[kind] = {
                "enqueue": ("queued", tries, ignored, None, None, None), "claim": ("processing", tries + 1, ignored, None, at, None),
                "succeed": ("succeeded", tries, ignored, None, began, at), "fail": ("failed", tries, ignored, f"e{at}", began, at),
                "requeue": ("queued", tries, ignored, None, None, None),
            }[action] if legal else (*job[:2], ignored + 1, *job[3:])
            if legal and action == "succeed" and kind == "process" and jobs["embed"][0] == "absent":
                jobs["embed"] = ("queued", 0, jobs["embed"][2], None, None, None)
        overdue(7400)
        want.update({(doc, k): j for k, j in jobs.items() if j[0] != "absent"})

    path, own = scratch(), tl.timer_session(spark)
    st.run_once(tl.timed_ledger(staged(own, parts, EVENTS, path)), f"{path}/ck", st.ledger_writer(f"{path}/out"), "update")
    since = lambda t: None if t is None else int((t - t0).total_seconds())
    got = {(r.document_id, r.kind): (r.status, r.attempts, r.ignored, r.error, since(r.started_at), since(r.finished_at))
           for r in st.current_jobs(own, f"{path}/out").collect()}
    assert got == want
    assert got[(1, "process")][0] == "succeeded" and got[(2, "process")][3] == "no outcome after 600 s"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != tl.PROVIDER


def timed_events(seed=5, documents=40):
    """Events of three arrivals, some behind the watermark by then, some without a time, a document or a number."""
    rng, t0 = random.Random(seed), dt.datetime(2024, 1, 1, 0, 0, 0, 417)
    rows = []
    for doc in range(documents):
        for seq, at in enumerate(sorted(rng.sample(range(9000), 14))):
            kind = rng.choice(["process", "process", "embed"])
            rows.append((doc, kind, seq, at, rng.choice(["enqueue", "claim", "claim", "succeed", "fail", "requeue", "?"])))
    rows.append((99, "process", 0, 9601, "enqueue"))
    delay = {r: rng.choice([0, 100, 590, 2500]) for r in rows}
    arrived = sorted(rows, key=lambda r: r[3] + delay[r])
    event = lambda d, k, s, at, a: (d, k, s, t0 + dt.timedelta(seconds=at), a, f"e{at}" if a == "fail" else None)
    third = len(rows) // 3
    parts = [[event(*r) for r in part] for part in (arrived[:third], arrived[third : 2 * third], arrived[2 * third :])]
    parts[1] += [(None, "process", 0, t0, "enqueue", None), (1, "embed", 5, None, "claim", None)]
    return parts


def test_timed_ledger_of_expressions_equals_the_stateful_stream(spark):
    parts = timed_events()
    path, own = scratch(), tl.timer_session(spark)
    for part in parts:  # a delivery each, after which the watermark takes effect
        source = staged(own, [part], EVENTS, path)
        st.run_once(tl.timed_ledger(source), f"{path}/ck", st.ledger_writer(f"{path}/out"), "update")
    want = sorted(map(tuple, st.current_jobs(own, f"{path}/out").drop("version").collect()), key=str)
    assert any("no outcome" in str(r) for r in want) and any("processing" in r for r in want)

    write, frames = tl.timed_merge_writer(f"{path}/merged"), [spark.createDataFrame(p, EVENTS) for p in parts]
    seen = lambda: sorted(map(tuple, st.current_jobs(spark, f"{path}/merged/jobs").drop("version").collect()), key=str)
    write(spark.createDataFrame([(1, "embed", 0, None, "claim", None)], EVENTS), 0)
    assert seen() == []
    for n, frame in enumerate(frames, 1):
        write(frame, n)
    assert seen() == want
    for n in (2, 3):  # deliveries after a failure
        write(frames[n - 1], n)
        assert seen() == want


def test_timeouts_query_calls_python_for_no_document(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(tl, "timed_ledger", None)
    assert entry.queries()["stream_ledger_timeouts"](spark, "/root/testdata/sf0.001").count() > 0


def test_late_rows_become_rows_of_a_table(spark, tmp_path):
    from ragframe.streaming import jobs as streams

    path = str(tmp_path / "out")
    write = streams.split_writer(path)
    batches = [
        [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:30:00"), (3, None)],
        [(4, "2024-01-01 10:20:00"), (5, "2024-01-01 10:19:59"), (6, "2024-01-01 12:00:00")],
        [],
        [(7, "2024-01-01 11:50:00"), (8, "2024-01-01 11:00:00"), (8, "2024-01-01 11:00:00")],
    ]
    frames = [spark.createDataFrame(rows, "event_id int, ts string").withColumn("ts", F.to_timestamp("ts")) for rows in batches]
    for n, frame in enumerate(frames):
        write(frame, n)

    def seen():
        late = spark.read.parquet(f"{path}/late").orderBy("event_id")
        kept = spark.read.parquet(f"{path}/rows").orderBy("event_id")
        return [(r.event_id, str(r.watermark)[11:]) for r in late.collect()], [r.event_id for r in kept.collect()]

    want = [(5, "10:20:00"), (8, "11:50:00"), (8, "11:50:00")], [1, 2, 4, 6, 7]
    assert seen() == want
    for n in (1, 3, 0):  # deliveries after a failure
        write(frames[n], n)
        assert seen() == want
