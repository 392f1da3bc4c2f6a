"""From ranked chunks to cited answers, one row per question all the way.

A question's context holds at most k <= 20 chunks, so arrays of context items stay small and every
step below is a projection over one row per question; the only shuffle gathers the context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions import text as tx
from ragframe.operators.joins import reduce_to
from ragframe.session import cut_lineage

CONTEXT_TOKENS = 1200
EXTRACT = "extract"
SYSTEM_PROMPT = (
    "Answer only from the numbered context passages. Cite every claim as [n]. "
    "If the passages do not hold the answer, reply exactly: \"I don't know.\""
)
ITEM = (
    "struct<pos:int,similarity:double,document_id:bigint,chunk_index:int,title:string,section:string,"
    "page:int,text:string>"
)


def budget(items: Column, max_tokens: int) -> Column:
    """Greedy context: best first; the first item always stays, then each that still fits.

    Items that do not fit are skipped, later and smaller ones may still enter. ``pos`` restarts
    from zero over the kept items.
    """
    ranked = F.array_sort(
        items,
        lambda a, b: F.when(
            F.coalesce(a.similarity, F.lit(-1.0)) > F.coalesce(b.similarity, F.lit(-1.0)), -1
        )
        .when(F.coalesce(a.similarity, F.lit(-1.0)) < F.coalesce(b.similarity, F.lit(-1.0)), 1)
        .when(a.pos < b.pos, -1)
        .when(a.pos > b.pos, 1)
        .otherwise(0),
    )
    zero = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{ITEM}>").alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        cost = tx.estimate_tokens(item.text)
        fits = (F.size(acc.kept) == 0) | (acc.used + cost <= max_tokens)
        placed = F.struct(
            F.size(acc.kept).alias("pos"),
            *[item[f].alias(f) for f in ("similarity", "document_id", "chunk_index", "title", "section", "page", "text")],
        )
        return F.struct(
            F.when(fits, acc.used + cost).otherwise(acc.used).alias("used"),
            F.when(fits, F.concat(acc.kept, F.array(placed))).otherwise(acc.kept).alias("kept"),
        )

    return F.aggregate(ranked.cast(f"array<{ITEM}>"), zero, step, lambda acc: acc.kept)


def gather_context(hits: DataFrame, chunks: DataFrame, max_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """(query_id, context): ranked hits joined to their chunk texts and cut to the token budget.

    Hits are the small side (k rows a query), so chunk texts are filtered before they are moved;
    similarity is clamped to [0, 1] for display only.
    """
    wanted = chunks.select(
        "document_id", "chunk_index",
        F.col("title") if "title" in chunks.columns else F.lit(None).cast("string").alias("title"),
        "section", F.col("page_number").alias("page"), F.col("content").alias("text"),
    )
    # Hits are read twice, as keys that thin out the corpus and as rows, so they are kept.
    hits = cut_lineage(hits)
    key = ["document_id", "chunk_index"]
    joined = hits.join(reduce_to(wanted, hits, key), key)
    item = F.struct(
        F.col("rank").cast("int").alias("pos"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))).alias("similarity"),
        "document_id", "chunk_index", "title", "section", "page", "text",
    )
    return joined.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("_items")).select(
        "query_id", budget(F.col("_items"), max_tokens).alias("context")
    )


def render_context(context: Column) -> Column:
    """``[n] (page p, section "s") text`` blocks, a blank line between them."""

    def block(item: Column) -> Column:
        page = F.when(item.page.isNotNull(), F.concat(F.lit("page "), item.page.cast("string")))
        section = F.when(
            item.section.isNotNull() & (item.section != ""), F.concat(F.lit('section "'), item.section, F.lit('"'))
        )
        where = F.concat_ws(", ", page, section)
        place = F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise("")
        return F.concat(F.lit("["), (item.pos + 1).cast("string"), F.lit("]"), place, F.lit(" "), item.text)

    return F.array_join(F.transform(context, block), "\n\n")


def render_history(turns: Column) -> Column:
    """``User:`` / ``Assistant:`` lines of array<struct<role,content>>."""
    label = lambda t: F.when(t.role == "user", "User").otherwise("Assistant")
    return F.array_join(F.transform(turns, lambda t: F.concat(label(t), F.lit(": "), t.content)), "\n")


def candidates(context: Column, question_tokens: Column) -> Column:
    """Sentences of the context with their overlap, in context then sentence order."""
    kind = "struct<ratio:double,ctx:int,sent:int,text:string>"

    def of(item: Column) -> Column:
        return F.transform(
            tx.sentences(item.text),
            lambda s, i: F.struct(
                tx.overlap_ratio(question_tokens, tx.content_tokens(s)).alias("ratio"),
                item.pos.alias("ctx"),
                i.alias("sent"),
                s.alias("text"),
            ),
        )

    return F.flatten(F.transform(context, of)).cast(f"array<{kind}>")


def best_sentence(found: Column) -> Column:
    """Highest overlap; the first one wins ties; null when nothing overlaps."""
    kind = "struct<ratio:double,ctx:int,sent:int,text:string>"
    return F.aggregate(
        F.filter(found, lambda c: c.ratio > 0),
        F.lit(None).cast(kind),
        lambda best, c: F.when(best.isNull() | (c.ratio > best.ratio), c).otherwise(best),
    )


def extractive_answers(questions: DataFrame, contexts: DataFrame, min_score: float | None = None) -> DataFrame:
    """Answer or honest refusal for every question (query_id, question[, query]).

    ``query`` is the expanded question where a conversation is being continued. The reason column
    names the guard that refused.
    """
    asked = questions if "query" in questions.columns else questions.withColumn("query", F.col("question"))
    rows = asked.join(contexts, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.array().cast(f"array<{ITEM}>"))
    )
    rows = rows.withColumn("_qt", tx.content_tokens(F.col("query")))
    rows = rows.withColumn("_best", best_sentence(candidates(F.col("context"), F.col("_qt"))))
    top = F.array_max(F.transform("context", lambda c: F.coalesce(c.similarity, F.lit(0.0))))
    bare = ~F.exists("context", lambda c: F.size(tx.content_tokens(c.text)) > 0)
    reason = F.when(F.size("context") == 0, "no_context")
    if min_score is not None:
        reason = reason.when(top < min_score, "low_similarity")
    reason = reason.when(bare, "no_content").when(F.col("_best").isNull(), "no_overlap")
    rows = rows.withColumn("reason", reason)
    cited = F.when(F.col("reason").isNull(), F.get("context", F.col("_best.ctx")))
    rows = rows.withColumn("_cited", cited)
    quote = F.col("_best.text")
    answer = F.when(
        F.col("reason").isNull(), tx.mark_citations(quote, F.array((F.col("_best.ctx") + 1).cast("bigint")))
    ).otherwise(tx.DONT_KNOW)
    answered = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.select(
        "query_id",
        "question",
        "query",
        answer.alias("answer"),
        F.col("reason").isNotNull().alias("refused"),
        "reason",
        answered(F.col("_best.ratio")).alias("overlap"),
        answered(F.col("_best.ctx")).alias("evidence_index"),
        answered(F.col("_best.ctx") + 1).alias("citation"),
        F.col("_cited.document_id").alias("document_id"),
        F.col("_cited.chunk_index").alias("chunk_index"),
        F.col("_cited.page").alias("page"),
        F.col("_cited.section").alias("section"),
        F.col("_cited.similarity").alias("similarity"),
        answered(quote).alias("quote"),
        "context",
    )


def answer_usage(answers: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Token estimates of prompt, completion and total; refusals cost nothing."""
    prompt = tx.estimate_tokens(F.concat(render_context(F.col("context")), F.col("query"), F.lit(system_prompt)))
    completion = tx.estimate_tokens(F.col("quote"))
    count = lambda c: F.when(F.col("refused"), F.lit(0)).otherwise(c)
    return answers.select(
        "query_id",
        count(prompt).alias("prompt_tokens"),
        count(completion).alias("completion_tokens"),
        count(F.greatest(F.lit(1), tx.estimate_tokens(F.col("query")) + completion)).alias("total_tokens"),
    )


def resolve_citations(answers: DataFrame) -> DataFrame:
    """[n] marks of each answer led back to context items; numbers out of range are dropped."""
    ids = answers.select("query_id", "context", F.posexplode(tx.citation_ids(F.col("answer"))).alias("ord", "n"))
    hit = ids.filter((F.col("n") >= 1) & (F.col("n") <= F.size("context"))).withColumn(
        "c", F.element_at("context", F.col("n").cast("int"))
    )
    return hit.select(
        "query_id", "ord", F.col("n").alias("citation"), F.col("c.document_id").alias("document_id"),
        F.col("c.chunk_index").alias("chunk_index"), F.col("c.title").alias("title"),
        F.col("c.section").alias("section"), F.col("c.page").alias("page"), F.col("c.similarity").alias("similarity"),
    )


def prompt_table(questions: DataFrame, contexts: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """System and user message of every question; a ``history`` array column goes in front."""
    rows = questions.join(contexts, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.array().cast(f"array<{ITEM}>"))
    )
    user = F.concat(
        F.lit("Context:\n"), render_context(F.col("context")), F.lit("\n\nQuestion: "), F.col("question"),
        F.lit("\n\nAnswer:"),
    )
    if "history" in questions.columns:
        before = F.concat(F.lit("Previous conversation:\n"), render_history(F.col("history")), F.lit("\n\n"))
        user = F.concat(F.when(F.size("history") > 0, before).otherwise(""), user)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(
        "query_id",
        F.array(message("system", F.lit(system_prompt)), message("user", user)).alias("messages"),
        (F.size("context") > 0).alias("grounded"),
    )


def echo_model(messages: list[dict]) -> str:
    """Deterministic stand-in for a model: the last user turn, unchanged."""
    return next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")


def generate_answers(prompts: DataFrame, model: Callable[[list[dict]], str] = echo_model) -> DataFrame:
    """Run any ``messages -> reply`` callable over the prompt table, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            replies = [model([dict(m) for m in messages]) for messages in frame["messages"]]
            size = [sum(len(m["content"].split()) for m in messages) for messages in frame["messages"]]
            yield pd.DataFrame(
                {
                    "query_id": frame["query_id"],
                    "reply": replies,
                    "prompt_words": size,
                    "completion_words": [len(r.split()) for r in replies],
                    "grounded": frame["grounded"],
                }
            )

    raw = prompts.mapInPandas(
        run, "query_id bigint, reply string, prompt_words bigint, completion_words bigint, grounded boolean"
    )
    return post_check(raw, "reply", F.col("grounded"))


def post_check(replies: DataFrame, reply: str, grounded: Column) -> DataFrame:
    """Normalise model replies: refusals and ungrounded answers become the canonical refusal,
    and an answer that cites nothing is given the strongest source."""
    refused = tx.is_refusal(F.col(reply)) | ~grounded
    ids = tx.citation_ids(F.col(reply))
    ids = F.when(F.size(ids) == 0, F.array(F.lit(1).cast("bigint"))).otherwise(ids)
    return replies.withColumn("refused", refused).withColumn(
        "answer", F.when(F.col("refused"), F.lit(tx.DONT_KNOW)).otherwise(tx.mark_citations(F.col(reply), ids))
    )
