"""Helpers and plain restatements that several test modules share."""

import datetime as dt
import random

EVENTS = "document_id bigint, kind string, seq bigint, at timestamp, action string, error string"


def random_events(seed, documents, n):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for d in range(documents):
        for kind in ("process", "embed"):
            for s in range(rng.randint(0, n)):
                action = rng.choice(["enqueue", "claim", "claim", "succeed", "fail", "requeue"])
                rows.append((d, kind, s, t0 + dt.timedelta(minutes=d, seconds=s), action, f"e{s}" if action in ("fail", "requeue") else None))
    return rows


def one(spark, column):
    """Value of a column expression on a single row."""
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]
