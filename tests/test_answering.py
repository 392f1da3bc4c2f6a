from pyspark.sql import functions as F

from ragframe.plans import flows
from ragframe.operators import answering as an
from ragframe.operators import conversations as cv


def contexts(spark, items, budget=1200):
    rows = [(1, [(i, s, i, 0, f"t{i}", None, 1, text) for i, (text, s) in enumerate(items)])]
    df = spark.createDataFrame(rows, f"query_id bigint, items array<{an.ITEM}>")
    return df.select("query_id", an.budget(F.col("items"), budget).alias("context"))


def ask(spark, question, items, budget=1200, min_score=None):
    q = spark.createDataFrame([(1, question)], "query_id bigint, question string")
    return an.extractive_answers(q, contexts(spark, items, budget), min_score)


def kept(spark, items, budget):
    return [(c.pos, c.similarity) for c in contexts(spark, items, budget).collect()[0].context]


def test_budget_skips_and_goes_on(spark):
    sized = lambda n: "x" * (4 * n)
    assert kept(spark, [(sized(4), 0.3), (sized(4), 0.9), (sized(4), 0.5)], 8) == [(0, 0.9), (1, 0.5)]
    assert kept(spark, [(sized(5), 0.9), (sized(9), 0.8), (sized(3), 0.7), (sized(4), 0.6)], 10) == [(0, 0.9), (1, 0.7)]
    assert kept(spark, [(sized(50), 0.4)], 8) == [(0, 0.4)]
    assert kept(spark, [(sized(1), None), (sized(1), 0.0), (sized(1), 0.0)], 8) == [(0, 0.0), (1, 0.0), (2, None)]


FILLER = [
    ("Unrelated filler sentence.", 0.9), ("More filler content here.", 0.5),
    ("The return window is thirty days. " + "padding words " * 260, 0.1),
]


def test_extractive_answer_and_guards(spark):
    row = ask(spark, "what is the return window", FILLER).collect()[0]
    assert row.answer == "The return window is thirty days. [3]"
    assert (row.refused, row.evidence_index, row.citation, row.similarity, row.document_id) == (False, 2, 3, 0.1, 2)
    row = ask(spark, "what is the return window", FILLER, 50).collect()[0]
    assert (row.answer, row.refused, row.reason) == ("I don't know.", True, "no_overlap")
    assert ask(spark, "return window", FILLER, min_score=0.95).collect()[0].reason == "low_similarity"
    assert ask(spark, "return window", [("a an it.", 0.9)]).collect()[0].reason == "no_content"
    assert ask(spark, "return window", []).collect()[0].reason == "no_context"
    usage = an.answer_usage(ask(spark, "zebra", FILLER)).collect()[0]
    assert usage.prompt_tokens == usage.completion_tokens == usage.total_tokens == 0


def test_first_of_equal_sentences_wins(spark):
    items = [("Nothing. Red cars here. Red cars there.", 0.5), ("Red cars everywhere.", 0.4)]
    assert ask(spark, "red cars", items).collect()[0].answer == "Red cars here. [1]"


def test_citations_resolve_within_range(spark):
    a = ask(spark, "red cars", [("Red cars.", 0.5), ("Blue.", 0.4)]).withColumn("answer", F.lit("x [2] [7] [2] [1]"))
    assert [(r.ord, r.citation, r.document_id) for r in an.resolve_citations(a).orderBy("ord").collect()] == [(0, 2, 1), (2, 1, 0)]


def test_rendering_prompts_and_generation(spark):
    q = spark.createDataFrame([(1, "Why?", [("user", "Hi"), ("assistant", "Yo")])], "query_id bigint, question string, history array<struct<role:string,content:string>>")
    prompts = an.prompt_table(q, contexts(spark, [("Because.", 0.5)]), "SYS")
    row = prompts.collect()[0]
    assert row.messages[0].content == "SYS"
    assert row.messages[1].content == "Previous conversation:\nUser: Hi\nAssistant: Yo\n\nContext:\n[1] (page 1) Because.\n\nQuestion: Why?\n\nAnswer:"
    said = lambda model: an.generate_answers(prompts, model).collect()[0]
    assert said(lambda m: "It is so.").answer == "It is so. [1]"
    assert said(lambda m: "See [2].").answer == "See [2]. [2]"
    assert said(lambda m: "I don't know that").answer == "I don't know."
    empty = an.prompt_table(q.withColumn("query_id", F.lit(5).cast("bigint")), contexts(spark, []))
    assert an.generate_answers(empty, lambda m: "sure").collect()[0].refused


def thread(spark, rows):
    return spark.createDataFrame([(c, p, r, t) for c, p, r, t in rows], "conversation_id bigint, position bigint, role string, content string")


def plain_history(rows, conv, position, n, budget):
    est = lambda s: 0 if not s else max(1, __import__("math").ceil(len(s.strip().split()) * 1.3))
    prior = sorted(r for r in rows if r[0] == conv and r[1] < position)[-n:]
    used, out = 0, []
    for r in reversed(prior):
        if r[2] == "system" or (out and used + est(r[3]) > budget):
            continue
        used += est(r[3])
        out.append(r[1])
    return out[::-1]


def test_expansion_values(spark):
    rows = [(1, 1, "user", "What is the refund policy?"), (1, 2, "assistant", "The refund period is 30 days. [1]"),
            (1, 3, "user", "What about international customers?"), (1, 4, "user", "How do I file a warranty claim?"),
            (2, 1, "user", "What about this?")]
    got = {(r.conversation_id, r.position): r.expanded for r in cv.expand_followups(thread(spark, rows)).collect()}
    assert got[(1, 3)] == "What is the refund policy? — The refund period is 30 days. — What about international customers?"
    assert got[(1, 4)] == rows[3][3] and got[(2, 1)] == rows[4][3]


def test_windows_are_the_same_at_any_block_size(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows, p = [], 0
    for conv, n in ((1, 90), (2, 3), (3, 25)):
        p = 0
        for _ in range(n):
            p += rng.choice([1, 1, 1, 4])
            rows.append((conv, p, rng.choice(["user", "user", "assistant", "system"]), " ".join(["that word"] * rng.randint(1, 9))))
    m = thread(spark, rows)
    outs = []
    for block in (2, 7, 4096):
        monkeypatch.setattr(cv, "BLOCK", block)
        h = sorted((r.conversation_id, r.position, [t.position for t in r.history]) for r in cv.history_window(m, 6, 20).collect())
        e = sorted(map(tuple, cv.expand_followups(m).collect()))
        t = sorted(map(tuple, cv.turn_pairs(m).collect()), key=repr)
        outs.append((h, e, t))
    assert outs[0] == outs[1] == outs[2]
    assert outs[0][0] == sorted((c, p, plain_history(rows, c, p, 6, 20)) for c, p, r, _ in rows if r == "user")


def test_a_conversation_is_answered_with_its_memory(spark):
    docs = spark.createDataFrame(
        [(1, "a", "Annual leave is twenty five days. Leave requests go to the team lead."),
         (2, "b", "Expense reports close on Friday. Travel needs approval.")],
        "document_id bigint, organization_id string, text string",
    )
    chunks = flows.embedded_chunks(docs, "token", chunk_tokens=64)
    talk = [(1, 1, "user", "How many days of annual leave?", "a"), (1, 2, "assistant", "Twenty five days. [1]", "a"),
            (1, 3, "user", "And to whom do leave requests go?", "a"), (2, 1, "user", "When do expense reports close?", "a"),
            (3, 1, "assistant", "Hello", "a"), (4, 1, "user", "", "b"), (5, 1, "user", "When do expense reports close?", "b")]
    m = spark.createDataFrame(talk, "conversation_id bigint, position bigint, role string, content string, organization_id string")
    scope = ("organization_id", "model")
    for mode in ({}, {"broadcast_queries": 0}):
        rows = flows.converse(m, chunks, scope, **mode)
        got = {(r.conversation_id, r.position): r for r in rows.collect()}
        assert set(got) == {(1, 1), (1, 3), (2, 1), (4, 1), (5, 1)}
        # the expanded question decides what is quoted, so a follow-up stays with the thread's words
        assert got[(1, 1)].document_id == 1 and got[(1, 3)].answer == "Annual leave is twenty five days. [1]"
        assert got[(1, 3)].query.startswith("How many days of annual leave? — Twenty five days.") and got[(1, 1)].query == got[(1, 1)].question
        assert got[(2, 1)].document_id is None and got[(4, 1)].refused  # another tenant's document, an empty question
        assert got[(5, 1)].document_id == 2
    prompts = {(r.conversation_id, r.position): r.messages[1].content for r in flows.conversation_prompts(m, rows).collect()}
    assert prompts[(1, 3)].startswith("Previous conversation:\nUser: How many days of annual leave?\nAssistant: Twenty five days. [1]")
    assert prompts[(1, 1)].startswith("Context:\n") and set(prompts) == set(got)
    none = flows.converse(m.limit(0), chunks, scope)
    assert none.count() == 0 and none.columns[:2] == ["conversation_id", "position"]


def test_study_searches_a_repeated_passage_once(spark, monkeypatch):
    """A passage that stands in four documents is one query of the open pool and four of the gated one; all count."""
    from ragframe.operators import embedding as emb
    from ragframe.operators import evaluation as ev

    asked, original = [], ev.scored_grid
    monkeypatch.setattr(ev, "scored_grid", lambda q, *a, **kw: asked.append(q.count()) or original(q, *a, **kw))
    rows = [(d, 0, f"red fox {d}", "s", 1, 1) for d in range(4)]
    chunks = emb.hash_embed(spark.createDataFrame(rows, "document_id bigint, chunk_index int, content string, section string, page_start int, page_end int"))
    queries = spark.createDataFrame([(10 + d, "red fox", "red fox", d, "s") for d in range(4)],
                                    "query_id bigint, question string, gold string, document_id bigint, section string")
    got = {r.gate: (r.queries, r.coverage) for r in ev.section_gate_study(queries, chunks).collect()}
    assert asked == [1, 4] and got == {"none": (4, 1.0), "section": (4, 1.0)}
