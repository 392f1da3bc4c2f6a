import random

import pytest
from pyspark.sql import functions as F

from ragframe import schemas
from ragframe.operators import chunking as ck
from ragframe.operators import pages as pg
from test_text import plain_paragraphs


def est(s):
    return max(1, -(-len(s) // 4))


def units_of(pages, paragraphs=False):
    for p in pages:
        for u in plain_paragraphs(p[3]) if paragraphs else p[3].split():
            yield u, p[2]


def pack(units, fits):
    groups = []
    for u in units:
        if groups and fits(groups[-1] + [u]):
            groups[-1].append(u)
        else:
            groups.append([u])
    return groups


def plain_chunks(pages, strategy, tokens=512, chars=2048, overlap=128):
    """The four strategies by their definitions, quadratic and obvious."""
    if strategy == "fixed":
        groups = pack(units_of(pages), lambda g: len(" ".join(u for u, _ in g)) <= chars)
    elif strategy == "token":
        groups = pack(units_of(pages), lambda g: est(" ".join(u for u, _ in g)) <= tokens)
    elif strategy == "paragraph":
        groups, closed = [], True
        for u in units_of(pages, True):
            if est(u[0]) > tokens:
                groups += pack([(w, u[1]) for w in u[0].split()], lambda g: est(" ".join(x for x, _ in g)) <= tokens)
                closed = True
            elif not closed and est("\n\n".join(x for x, _ in groups[-1] + [u])) <= tokens:
                groups[-1].append(u)
            else:
                groups.append([u])
                closed = False
    else:
        words, groups, start = list(units_of(pages)), [], 0
        while start < len(words):
            end = start + 1
            while end < len(words) and est(" ".join(w for w, _ in words[start:end + 1])) <= tokens:
                end += 1
            groups.append(words[start:end])
            if end >= len(words):
                break
            back = end - 1 if overlap else end
            while overlap and back > start and est(" ".join(w for w, _ in words[back - 1:end])) <= overlap:
                back -= 1
            start = max(back, start + 1)
    sep = "\n\n" if strategy == "paragraph" else " "
    # an over-long paragraph's pieces are words: joined as the paragraph strategy joins its units
    return [(i, sep.join(u for u, _ in g), g[0][1], g[-1][1]) for i, g in enumerate(groups)]


def table(spark, pages):
    rows = [(d, "org", n, text, est(text), None, f"s{d}") for d, _, n, text in pages]
    return spark.createDataFrame(rows, schemas.PAGES)


def got(df):
    out = {}
    for r in df.orderBy("document_id", "chunk_index").collect():
        out.setdefault(r.document_id, []).append((r.chunk_index, r.content, r.page_start, r.page_end))
    return out


CONFIGS = [
    ("fixed", {"chunk_chars": 40}, {"chars": 40}),
    ("fixed", {"chunk_chars": 1}, {"chars": 1}),
    ("token", {"chunk_tokens": 16}, {"tokens": 16}),
    ("overlap", {"chunk_tokens": 16, "overlap_tokens": 5}, {"tokens": 16, "overlap": 5}),
    ("overlap", {"chunk_tokens": 16, "overlap_tokens": 15}, {"tokens": 16, "overlap": 15}),
    ("overlap", {"chunk_tokens": 16, "overlap_tokens": 0}, {"tokens": 16, "overlap": 0}),
]


@pytest.mark.parametrize("strategy,ours,plain", CONFIGS)
def test_word_strategies_match_their_definitions(spark, strategy, ours, plain):
    rng = random.Random(len(strategy) + sum(plain.values()))
    words = ["a", "bb", "ccc", "dddd.", "Heading", "x" * 30, "y" * 90, "é漢😀"]
    pages = []
    for d in range(40):
        for n in range(1, rng.randint(1, 5)):
            text = rng.choice([" ", "\n", "  \t"]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))
            pages.append((d, "org", n, text))
    result = got(ck.chunk_pages(table(spark, pages), strategy, **ours))
    for d in {p[0] for p in pages}:
        assert result.get(d, []) == plain_chunks([p for p in pages if p[0] == d], strategy, **plain)


def test_paragraph_strategy_matches_its_definition(spark):
    rng = random.Random(2)
    parts = ["Head", "tail end.", "Some words here", "word " * 5, "long " * 30 + "end.", "Z?", "", "a;", "q" * 80 + "!"]
    pages = [
        (d, "org", n, "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 9))))
        for d in range(60) for n in range(1, rng.randint(2, 5))
    ]
    result = got(ck.chunk_pages(table(spark, pages), "paragraph", chunk_tokens=16))
    for d in range(60):
        mine = [p for p in pages if p[0] == d]
        want = plain_chunks(mine, "paragraph", tokens=16)
        # pieces of one over-long paragraph are one unit each: blanks inside, not paragraph breaks
        have = result.get(d, [])
        assert [(i, c.replace("\n\n", " "), a, b) for i, c, a, b in have] == [(i, c.replace("\n\n", " "), a, b) for i, c, a, b in want]
        assert all(est(c) <= 16 or " " not in c for _, c, _, _ in have)


def test_hand_cases(spark):
    blocks = "First block with words of its own.\n\nSecond block with words of its own.\n\nThird block with words of its own.\n"
    rows = got(ck.chunk_pages(table(spark, [(1, "o", 1, blocks)]), "paragraph", chunk_tokens=16))[1]
    assert [c for _, c, _, _ in rows] == [f"{w} block with words of its own." for w in ("First", "Second", "Third")]
    rows = got(ck.chunk_pages(table(spark, [(1, "o", 1, "ab " * 300)]), "token", chunk_tokens=32))[1]
    assert all(est(c) <= 32 for _, c, _, _ in rows) and " ".join(c for _, c, _, _ in rows).split() == ["ab"] * 300
    words = " ".join(f"w{i:03d}" for i in range(240))
    rows = got(ck.chunk_pages(table(spark, [(1, "o", 1, words)]), "overlap", chunk_tokens=40, overlap_tokens=12))[1]
    assert all(set(a[1].split()) & set(b[1].split()) for a, b in zip(rows, rows[1:]))


def test_bad_settings(spark):
    for bad in ({"strategy": "nope"}, {"strategy": "overlap", "chunk_tokens": 16, "overlap_tokens": 16},
                {"strategy": "overlap", "overlap_tokens": -1}, {"strategy": "fixed", "chunk_chars": -1}):
        with pytest.raises(ValueError):
            ck.chunk_pages(table(spark, [(1, "o", 1, "some words")]), **bad)
    with pytest.raises(Exception, match="page_number"):
        ck.chunk_pages(table(spark, [(1, "o", 0, "some words")]), "fixed").collect()


def test_sections_and_pages(spark):
    text = "\n".join(["Head one", "Body of the first page."] + ["line."] * 7 + ["Head two", "More."] + [""] * 30 + ["last."])
    docs = spark.createDataFrame([(7, "org", text)], "document_id bigint, organization_id string, text string")
    rows = {r.page_number: r for r in pg.assemble_pages(docs).collect()}
    assert set(rows) == {1, 2, 6}  # blank pages vanish, numbering goes on
    assert rows[1].section == "Head one" and rows[2].section == "Head two" and rows[6].section == "Head two"
    filled = pg.section_fill(pg.assemble_pages(docs), pg.text_outline(docs)).collect()
    assert {r.page_number: r.section for r in filled} == {n: r.section for n, r in rows.items()}
    chunk = ck.chunk_bundles(pg.document_bundles(docs), "fixed").collect()
    assert [(c.page_start, c.page_end, c.section) for c in chunk] == [(1, 6, "Head one")]
    cut = pg.extraction_summary(docs, page_limit=2).collect()[0]
    assert cut.truncated and cut.pages == 2


def test_no_shuffle_between_documents_and_vectors(spark):
    from ragframe.operators.embedding import hash_embed

    docs = spark.createDataFrame([(7, "org", "a b")], "document_id bigint, organization_id string, text string")
    for strategy in ck.STRATEGIES:
        plan = hash_embed(ck.chunk_bundles(pg.document_bundles(docs), strategy))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert ("Python" in plan) == (strategy == "overlap")


def test_report_of_all_settings_matches_the_chunks(spark):
    """One pass over lengths gives what chunking every document by every setting gives."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeé漢.") for _ in range(rng.choice([1, 3, 6, 9, 60])))
    text = lambda: rng.choice(["\n", " ", "\n\n"]).join(" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12)))
    docs = spark.createDataFrame([(i, "o", text()) for i in range(30)], "document_id bigint, organization_id string, text string")
    bundles = pg.document_bundles(docs)
    configs = {f"{s} {n}": {"strategy": s, "chunk_tokens": n, "chunk_chars": 4 * n, "overlap_tokens": n // 2} for s in ck.STRATEGIES for n in (16, 40)}
    got = {r.config: r for r in ck.chunking_report(bundles, configs).collect()}
    words = sum(len(w) + 1 for r in ck.chunk_bundles(bundles, "fixed", chunk_chars=1).collect() for w in r.content.split(" "))
    for label, config in configs.items():
        rows = ck.chunk_bundles(bundles, **config).collect()
        tokens, spans = [r.token_count for r in rows], [r.page_end - r.page_start + 1 for r in rows]
        again = sum(len(r.content) + 1 for r in rows) - words if config["strategy"] != "paragraph" else 0
        want = (len(rows), sum(tokens), max(tokens), sum(spans) / len(rows), -(-again // 4))
        r = got[label]
        assert (r.chunks, r.tokens, r.max_tokens, r.redundant_tokens) == (*want[:3], want[4])
        assert abs(r.mean_span - want[3]) < 1e-9
    assert got["overlap 40"].redundant_tokens > 0 and got["token 40"].redundant_tokens == 0
    empty = ck.chunking_report(bundles.limit(0), configs).collect()
    assert [(r.chunks, r.tokens, r.redundant_tokens) for r in empty] == [(0, None, 0)] * len(configs)


def test_chunks_do_not_copy_the_texts_of_their_pages(spark):
    page = "struct<page_number:int,content:string,section:string,source:string>"
    rows = spark.createDataFrame([(1, [(1, "a b c d", "S", "u"), (2, "e f", None, "u")])], f"document_id bigint, pages array<{page}>")
    for cut in (ck._cut_words(rows, ["document_id"], 3, None), ck._cut_words(rows, ["document_id"], 3, 1), ck._cut_paragraphs(rows, ["document_id"], 3)):
        assert cut.schema["_pages"].dataType.elementType.fieldNames() == ["page_number", "section", "source"]
        assert [r.content for r in cut.orderBy("chunk_index").collect()][0] == "a b"
