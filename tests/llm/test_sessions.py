"""The operators' settings stay in a session of their own."""

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_url_filters", "op10_quality_classifier", "op12_conversation_repair"])
def test_settings_of_the_session_stay(spark, name):
    before = {k: v for k, v in spark.conf.getAll.items() if "arrow" in k or "shuffle" in k}
    assert entry.queries()[name](spark, ROOT).count() > 0
    assert {k: v for k, v in spark.conf.getAll.items() if "arrow" in k or "shuffle" in k} == before


def test_token_files_from_several_sessions(spark):
    """Whatever session is active, and whichever of them ran the query before."""
    for session in (spark, spark.newSession(), spark):
        session.createDataFrame([(1,)], "x int").count()  # makes it the active one
        for own in (spark, spark.newSession()):
            assert entry.queries()["op1_token_blocks"](own, ROOT).count() > 0
