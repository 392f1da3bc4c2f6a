"""Ledger, telemetry, catalog, sources, sinks, evaluation."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import EVENTS, one, random_events
from ragframe.operators import catalog, evaluation as ev, ledger, telemetry
from ragframe.sources import files, sinks, tables
from ragframe.streaming import jobs as streams

def plain_replay(rows):
    """One event after the other in order of time, a process run's before the embed job's of the same moment."""
    jobs = {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[1] != "process", r[2])):
        absent = ("absent", 0, 0, None, None, None)
        jobs[r[:2]], legal = streams.apply_event(jobs.get(r[:2], absent), r[4], r[3], r[5])
        if r[1] == "process" and r[4] == "succeed" and legal and jobs.get((r[0], "embed"), absent)[0] == "absent":
            jobs[r[0], "embed"], _ = streams.apply_event(jobs.get((r[0], "embed"), absent), "enqueue", r[3], None)
    return {k: v for k, v in jobs.items() if v[0] != "absent"}


def test_a_claim_before_the_job_exists_is_ignored(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [
        (1, "embed", 0, at(0), "claim", None), (1, "embed", 1, at(1), "succeed", None),
        (1, "process", 0, at(2), "enqueue", None), (1, "process", 1, at(3), "claim", None), (1, "process", 2, at(4), "succeed", None),
    ]
    got = {r.kind: (r.status, r.attempts, r.ignored) for r in ledger.replay(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"process": ("succeeded", 1, 0), "embed": ("queued", 0, 2)}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_replay_matches_a_plain_fold(spark, monkeypatch, block):
    monkeypatch.setattr(ledger, "BLOCK", block)
    rows = random_events(block, 25, 14)
    got = ledger.replay(spark.createDataFrame(rows, EVENTS)).collect()
    assert {(r.document_id, r.kind): (r.status, r.attempts, r.ignored, r.error, r.started_at, r.finished_at) for r in got} == plain_replay(rows)


STATES = [
    ("queued", "none", None, None, "UPLOADED"), ("queued", "none", "queued", None, "UPLOADED"),
    ("processing", "none", "processing", None, "PROCESSING"), ("processing", "none", None, None, "PROCESSING"),
    ("ready", "none", None, "queued", "EMBEDDING"), ("ready", "processing", None, None, "EMBEDDING"),
    ("ready", "none", None, "processing", "EMBEDDING"), ("ready", "ready", None, None, "READY"),
    ("ready", "none", None, None, "READY"), ("failed", "none", None, None, "FAILED"), ("ready", "failed", None, None, "FAILED"),
    ("queued", "none", "failed", None, "FAILED"), ("ready", "ready", None, "failed", "FAILED"),
    ("queued", "none", "failed", "queued", "FAILED"), ("ready", "ready", "succeeded", "succeeded", "READY"),
]


def test_ingestion_states(spark):
    df = spark.createDataFrame(STATES, "s string, e string, p string, b string, want string")
    rows = df.select("*", ledger.state_column(F.col("s"), F.col("e"), F.col("p"), F.col("b")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_retries(spark):
    rows = [(1, "process", "failed", 1, 3, "connection reset"), (2, "process", "failed", 2, 3, "boom"), (3, "process", "failed", 3, 3, "boom"),
            (4, "process", "failed", 1, 3, "pdf extraction failed: x"), (5, "embed", "failed", 1, 3, "400 not retryable"), (6, "embed", "failed", 1, 3, "pdf extraction failed"),
            (7, "embed", "succeeded", 1, 3, None)]
    got = {r.document_id: (r.outcome, r.delay_seconds, r.flags_document) for r in ledger.retry_schedule(spark.createDataFrame(rows, "document_id int, kind string, status string, attempts int, max_attempts int, error string"), 2.0).collect()}
    assert got == {1: ("retrying", 2.0, False), 2: ("retrying", 4.0, False), 3: ("failed", None, True), 4: ("failed", None, False), 5: ("failed", None, False), 6: ("retrying", 2.0, False)}


@pytest.mark.parametrize("cells", [1, 4, 1024])
def test_index_percentiles(spark, cells):
    rng = random.Random(cells)
    groups = {"a": [round(rng.expovariate(1), 3) for _ in range(501)], "b": [1.0] * 40, "c": [float(i) for i in range(1, 11)], "d": [2.5]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for r in telemetry.latency_summary(df, "v", "g", cells).collect():
        vs = sorted(groups[r.g])
        pct = lambda p: vs[min(len(vs) - 1, int(p * len(vs)))]
        assert (r.n, r.p50, r.p90, r.p95, r.p99, r.max) == (len(vs), pct(0.5), pct(0.9), pct(0.95), pct(0.99), vs[-1])
        assert abs(r["mean"] - sum(vs) / len(vs)) < 1e-3


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("x", v) for v in (0.5, 0.5, 1.5, 1.5, 9.0)] + [("y", 99.0)], "l string, v double")
    h = telemetry.latency_histogram(df, "v", "l", [1.0, 2.0, 5.0])
    at = lambda q: {r.l: r.quantile for r in telemetry.histogram_quantile(h, "l", q).collect()}
    assert at(0.2) == {"x": 0.5, "y": 5.0} and at(0.6)["x"] == 1.5 and at(0.99)["x"] == 5.0


def test_rate_limit_and_clients(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i % 60), "c1") for i in range(103)] + [(i, t0, "c2") for i in range(100)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, client string")
    assert [(r.client, r.requests, r.rejected) for r in telemetry.rate_limit_breaches(df).collect()] == [("c1", 103, 3)]
    assert telemetry.rate_limit_breaches(df, telemetry.AUTH_RATE_LIMIT).count() == 2
    assert one(spark, telemetry.client_of(F.lit(" 1.2.3.4 , 5.6.7.8"), F.lit("r"))) == "1.2.3.4"
    assert one(spark, telemetry.client_of(F.lit(""), F.lit("r"))) == "r"


def scratch(name):
    path = f"/tmp/spark-test-{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def test_admission_of_stored_files(spark):
    root = scratch("files")
    os.makedirs(f"{root}/org1")
    pdf, zipped = b"%PDF-1.7 body", b"PK\x03\x04rest"
    cases = {
        "guide.pdf": (pdf, None), "report.docx": (zipped, None), "notes.md": (b"# hi", None), "page.html": (b"<p>hi</p>", None),
        "raw.TXT": (b"hello", None), "fake.pdf": (zipped, "FILE_TYPE_MISMATCH"), "fake.docx": (b"not a zip", "FILE_TYPE_MISMATCH"),
        "bin.md": (b"h\x00g", "FILE_TYPE_MISMATCH"), "late.md": (b"h" * 1024 + b"\x00", None), "virus.exe": (pdf, "UNSUPPORTED_FILE_TYPE"),
        "empty.pdf": (b"", "EMPTY_FILE"), "big.pdf": (pdf + b"x" * 3000, "FILE_TOO_LARGE"), "noext": (b"x", "UNSUPPORTED_FILE_TYPE"),
    }
    for name, (body, _) in cases.items():
        with open(f"{root}/org1/{name}", "wb") as f:
            f.write(body)
    scanned = files.scan_files(spark, root)
    got = {r.filename: r for r in files.admit(scanned, max_bytes=2000).collect()}
    assert {n: r.error for n, r in got.items()} == {n: e for n, (b, e) in cases.items() if b}
    rows = spark.createDataFrame([(n, b, len(b)) for n, (b, _) in cases.items()], "filename string, content binary, length int")
    assert {r.filename: r.error for r in files.admit(rows, max_bytes=2000).collect()} == {n: e for n, (_, e) in cases.items()}
    assert got["guide.pdf"].source_type == "pdf" and got["raw.TXT"].mime_type == "text/plain"
    assert got["guide.pdf"].source == "s3://org1/guide.pdf" and got["guide.pdf"].organization_id == "org1"
    names = spark.createDataFrame([("...\\..",), ("",), ("x" * 256 + ".md",)], "filename string")
    names = names.withColumn("content", F.lit(b"a")).withColumn("length", F.lit(1))
    assert [r.error for r in files.admit(names).collect()] == ["INVALID_FILENAME"] * 3
    manifest = spark.createDataFrame([("org1/guide.pdf",), ("org1/gone.pdf",), ("org1/empty.pdf",)], "storage_key string")
    assert sorted(r.storage_key for r in files.missing_objects(manifest, scanned).collect()) == ["org1/empty.pdf", "org1/gone.pdf"]


def test_upsert_takes_the_last_of_repeated_keys(spark):
    schema = "k bigint, v string, p int"
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema)
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (3, "z", 2)], schema)
    assert sorted((r.k, r.v) for r in sinks.upsert(old, new, ["k"], F.col("p")).collect()) == [(1, "y"), (2, "b"), (3, "z")]


def test_a_batch_delivered_again_replaces_itself(spark):
    path = scratch("batches") + "/t"
    schema = "k bigint, v string, version int"
    write = lambda n, rows: sinks.write_batch(spark.createDataFrame(rows, schema), path, n)
    write(0, [(1, "a", 1), (2, "b", 1)])
    first = sorted(os.listdir(f"{path}/batch=0"))
    for _ in range(2):
        write(1, [(1, "A", 2)])
    assert sorted(os.listdir(f"{path}/batch=0")) == first
    now = sinks.latest(spark.read.parquet(path), ["k"], F.col("version"))
    assert sorted((r.k, r.v) for r in now.collect()) == [(1, "A"), (2, "b")]


def test_reports_survive_a_round_trip(spark):
    path = scratch("report") + "/r"
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, value double")
    sinks.write_report(df, path)
    assert sorted(map(tuple, sinks.read_report(spark, path, "name string, value double").collect())) == [("a", 1.5), ("b", None)]


def test_access_reports(spark):
    as_of = F.lit(dt.datetime(2024, 1, 10))
    day = lambda n: F.lit(dt.datetime(2024, 1, n))
    assert one(spark, catalog.live_token(F.lit(None).cast("timestamp"), day(11), as_of)) is True
    assert one(spark, catalog.live_token(day(1), day(11), as_of)) is False
    assert one(spark, catalog.live_token(F.lit(None).cast("timestamp"), day(10), as_of)) is False
    assert [one(spark, catalog.invitation_status(F.lit(s), day(d), as_of)) for s, d in (("pending", 11), ("pending", 9), ("accepted", 11))] == ["pending", "expired", "spent"]
    people = spark.createDataFrame([("o1", "A@x", "owner"), ("o2", "a@x", "viewer"), ("o1", "b@x", "member")], "organization_id string, email string, role string")
    assert [(r.email, r.organizations) for r in catalog.multi_tenant_emails(people).collect()] == [("a@x", 2)]
    assert {r.organization_id: (r.members, r.at_least) for r in catalog.member_report(people, "member").collect()} == {"o1": (2, 2), "o2": (1, 0)}


def test_paging(spark):
    rows = [(i, "o", "u", f"T{i}", f"f{i}.md", "md", 1, "ready", "none", dt.datetime(2024, 1, 1 + i)) for i in range(5)]
    docs = spark.createDataFrame(rows, "document_id int, organization_id string, uploaded_by string, title string, filename string, source_type string, size int, status string, embedding_status string, created_at timestamp")
    page = catalog.document_list(docs, limit=2, offset=2).collect()
    assert [(r.document_id, r.matching_total, r.has_more) for r in page] == [(2, 5, True), (1, 5, True)]
    assert catalog.document_list(docs, limit=2, offset=9).count() == 0
    assert [r.document_id for r in catalog.document_list(docs, query="t3").collect()] == [3]


def test_passages_are_found_at_any_cut(spark):
    docs = spark.createDataFrame([(1, "xalpha beta gamma delta epsilonx tail"), (2, "alpha beta gamma delta  epsilon"), (3, "")], "document_id bigint, text string")
    p = spark.createDataFrame([(9, "alpha beta gamma delta epsilon")], "passage_id bigint, passage string")
    assert [(r.passage_id, r.document_id) for r in tables.passages_in_documents(p, docs).collect()] == [(9, 1)]
    brief = spark.createDataFrame([(7, "a gamma d"), (8, "not there"), (9, "alpha beta gamma delta epsilon")], "passage_id bigint, passage string")
    assert sorted((r.passage_id, r.document_id) for r in tables.passages_in_documents(brief, docs).collect()) == [(7, 1), (7, 2), (9, 1)]


def test_retrieval_fractions(spark):
    chunks = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 2, 3), (1, 2, 2, 2), (2, 0, 2, 2), (1, 3, 2, 2)], "document_id bigint, chunk_index int, page_start int, page_end int")
    g = spark.createDataFrame([(7, 1, 2), (8, 3, 1)], "item_id bigint, expected_document bigint, expected_page int")
    order = [(1, 1), (2, 0), (1, 2), (1, 0), (1, 3)]
    rows = [(q, pair, r + 1) for q in (7, 8) for r, pair in enumerate(order)]
    top = spark.createDataFrame(rows, "query_id bigint, item_id struct<document_id: bigint, chunk_index: int>, rank int")
    got = {(r.item_id, r.k): (r.document_hit, r.page_hit, r.precision, r.recall) for r in ev.retrieval_metrics(g, top, chunks, [1, 3, 5]).collect()}
    assert got[(7, 1)] == (True, True, 1.0, 1 / 3) and got[(7, 3)] == (True, True, 2 / 3, 2 / 3) and got[(7, 5)] == (True, True, 3 / 5, 1.0)
    assert got[(8, 5)] == (False, False, 0.0, None)
    rates = {r.k: r for r in ev.retrieval_rates(ev.retrieval_metrics(g, top, chunks, [1])).collect()}
    assert (rates[1].document_hit, rates[1].recall) == (0.5, round(1 / 3, 6))


def test_answer_flags(spark):
    ok = lambda a, b: one(spark, ev.answer_correct(F.lit(a), F.lit(b)))
    assert ok("annual leave is 20 working days", "leave: working days [1]") and not ok("annual leave is 20 working days", "leave")
    assert ok("a the", "anything") and not ok("a the", "  ") and not ok("annual leave", "")
    made_up = lambda a, *c: one(spark, ev.hallucinated(F.lit(a), F.array(*map(F.lit, c))))
    assert made_up("red cars", "blue boats") and not made_up("red cars [1]", "x", "cars") and made_up("", "cars") and made_up("[1] a", "1 a")
    flags = spark.createDataFrame([(True, None), (False, None)], "a boolean, b boolean")
    assert tuple(ev.flag_rates(flags, ["a", "b"]).collect()[0]) == (2, 0.5, 0.0)


def test_goldens_without_a_page(spark):
    pages = spark.createDataFrame([(1, 3, "some  thing\nhere now"), (1, 5, "some thing here now")], "document_id bigint, page_number int, content string")
    g = spark.createDataFrame([(1, "thing here", 1), (2, "not there", 1)], "item_id bigint, expected_answer string, expected_document bigint")
    assert {r.item_id: r.expected_page for r in ev.resolve_goldens(g, pages).collect()} == {1: 3, 2: None}
    with pytest.raises(Exception, match="golden without a page"):
        ev.resolve_goldens(g, pages, strict=True).collect()


@pytest.mark.parametrize("held", [0, 10_000])
def test_passages_of_every_length(spark, monkeypatch, held):
    """Passages of one to nine words, cut inside words too, and more short ones than a block holds."""
    monkeypatch.setattr(tables, "HELD_KEYS", held)
    rng = random.Random(17)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(14)]
    texts = [rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    cut = [t[i : i + rng.randint(1, 30)] for t in texts for i in [rng.randint(0, max(0, len(t) - 1))]]
    passages = list(dict.fromkeys([*cut, *words, "zzz", "a zzz b", "zz a b zz", " a", "", *[f"{a} {b}" for a in words for b in words]]))
    passages += [f"{a}{b}{c}{d}" for a in "abc" for b in "abc" for c in "abcdefg" for d in "abcdefghijklmnopqrstuvwxyz"]
    passages = [p for p in dict.fromkeys(passages) if p]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id bigint, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "passage_id bigint, passage string")
    assert sum(len(p.split()) < 3 for p in passages) > tables.SHORT_BLOCK
    got = sorted((r.passage_id, r.document_id) for r in tables.passages_in_documents(asked, docs).collect())
    assert got == sorted((i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if p in t)
