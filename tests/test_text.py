import collections
import hashlib
import math
import re
import random

import pytest
from pyspark.sql import functions as F

from helpers import one
from ragframe.functions import text as tx
from ragframe.functions import vectors as vx


def lit(s):
    return F.lit(s)


def test_normalize_keeps_paragraph_breaks(spark):
    raw = "  a \t b\xa0c \n  d\n\n\n\n e\x0b\x0cf  "
    assert one(spark, tx.normalize_text(lit(raw))) == "a b c\nd\n\ne f"


def test_token_estimates(spark):
    for text, tokens in (("", 1), ("abcd", 1), ("abcde", 2), ("x" * 2049, 513)):
        assert one(spark, tx.estimate_tokens(lit(text))) == tokens
    for text, tokens in (("", 0), ("one", 2), ("a b c d e f g h i j", 13), ("   ", 2)):
        assert one(spark, tx.estimate_words(lit(text))) == tokens


def test_words_split_like_python(spark):
    rng = random.Random(5)
    alphabet = "ab,.é漢" + tx.WS_CHARS
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.words(F.col("t")).alias("w"), tx.trim_ws(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r.w == r.t.split() and r.s == r.t.strip()


def test_sentences_and_tokens(spark):
    assert one(spark, tx.sentences(lit("The window is 30 days. Restocking\napplies!  v2.5 stays"))) == [
        "The window is 30 days.", "Restocking applies!", "v2.5 stays",
    ]
    assert one(spark, tx.tokenize(lit("It's é-42 OK"))) == ["it's", "42", "ok"]
    assert sorted(one(spark, tx.content_tokens(lit("The Return Window seen so yes")))) == ["return", "seen", "window"]
    assert sorted(one(spark, tx.eval_content_tokens(lit("yes here [12] re-use a")))) == ["here", "re-use", "yes"]


def test_overlap_ratio(spark):
    q = tx.content_tokens(lit("return window"))
    for s, want in (("the return window", 1.0), ("a window seat", 0.5), ("nothing else", 0.0), ("", 0.0)):
        assert one(spark, tx.overlap_ratio(q, tx.content_tokens(lit(s)))) == want
    assert one(spark, tx.overlap_ratio(tx.content_tokens(lit("the")), q)) == 0.0


def test_paragraphs(spark):
    raw = (
        "Introduction\nThis is a platform that turns uploaded documents into answerable,\ncitable ground truth.\n"
        "Every tenant owns its data outright.\nArchitecture\nThe ingest path is a small pipeline, and the storage trips are cheap.\n"
    )
    assert one(spark, tx.split_paragraphs(lit(raw))) == [
        "Introduction This is a platform that turns uploaded documents into answerable, citable ground truth.",
        "Every tenant owns its data outright.",
        "Architecture The ingest path is a small pipeline, and the storage trips are cheap.",
    ]
    assert one(spark, tx.split_paragraphs(lit(" \n \n"))) == []


def plain_paragraphs(text):
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    ends = lambda s: s[-1] in ".!?:;"
    out = []
    for i, line in enumerate(lines):
        nxt = lines[i + 1] if i + 1 < len(lines) else None
        heading = nxt is not None and len(line) <= 60 and not ends(line) and "A" <= nxt[0] <= "Z"
        if not out or ends(lines[i - 1]) or heading:
            out.append(line)
        else:
            out[-1] += " " + line
    return out


def test_paragraphs_against_a_plain_definition(spark):
    rng = random.Random(11)
    parts = ["Head", "tail end.", "Some words here", "x" * 60, "y" * 61, "Z?", " ", "", "a;", "\u2003", "Éa"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.split_paragraphs(F.col("t")).alias("p"))
    for r in rows.collect():
        assert r.p == plain_paragraphs(r.t), r.t


def test_names_and_routes(spark):
    for raw, want in (("../../etc/passwd", "passwd"), ("C:\\Users\\az\\doc.pdf", "doc.pdf"), ("...\\..", ""), (" a\x00b.md ", "ab.md")):
        assert one(spark, tx.sanitize_filename(lit(raw))) == want
    assert one(spark, tx.extension(lit("a.tar.GZ"))) == ".gz"
    assert one(spark, tx.extension(lit("none"))) == ""
    assert one(spark, tx.slugify(lit("  Acme Labs!! "))) == "acme-labs"
    assert one(spark, tx.slugify(lit("!!!"))) == "org"
    path = "/v1/documents/0b0f5c9e-0000-4000-8000-00000000abcd/pages/12/" + "a" * 32 + "/x1"
    assert one(spark, tx.normalize_route(lit(path))) == "/v1/documents/:id/pages/:id/:id/x1"
    assert one(spark, tx.normalize_route(lit(""))) == "unmatched"


def test_citations_and_refusals(spark):
    assert one(spark, tx.citation_ids(lit("a [2] b [0] [2][11] [x]"))) == [2, 11]
    assert one(spark, tx.mark_citations(lit("So."), F.array(F.lit(1), F.lit(3)))) == "So. [1][3]"
    for s, want in ((" I DON'T  know. ", True), ("i do not know that", True), ("I don't know about x", True), ("It is 30 days", False)):
        assert one(spark, tx.is_refusal(lit(s))) is want


@pytest.mark.parametrize("question,want", [
    ("What about international customers?", True), ("How about the free tier?", True), ("Is that refundable?", True),
    ("And the return window?", True), ("What is the refund policy?", False), ("How many days is the return window on shoes?", False),
])
def test_referential(spark, question, want):
    assert one(spark, tx.referential(lit(question))) is want


def test_hash_vectors_match_a_plain_definition(spark):
    from ragframe.operators.embedding import hash_embed

    def slot(token):
        digest = hashlib.sha256(token.encode()).hexdigest()
        return int(digest[:8], 16) % 384, -1 if int(digest[8:10], 16) % 2 else 1

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c'9-É\n") for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["", "---"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    rows = hash_embed(df).select("id", vx.to_dense(F.col("vector")).alias("v")).orderBy("id").collect()
    filled = 0
    for r, text in zip(rows, texts):
        sums = collections.Counter()
        for place, sign in map(slot, re.findall("[a-z0-9']+", text.lower())):
            sums[place] += sign
        norm = math.sqrt(sum(x * x for x in sums.values())) or 1.0
        filled += any(sums.values())
        assert len(r.v) == 384 and max(abs(r.v[i] - sums[i] / norm) for i in range(384)) < 1e-6
    # filters on the vector must not undo the once-only computation
    assert hash_embed(df).filter(F.size("vector") > 0).count() == filled


def test_batches_of_a_corpus_hash_as_rows_do(spark):
    """The two ways to the vectors give the same rows: null, empty and repeated tokens, halves when rounded, many rows."""
    from ragframe.operators.embedding import hash_embed, hash_embed_batches

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "don't", "É9", "İx", "K", "z-1", "漢"]) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += [None, "", "---", "a " * 127 + "b", " ".join(f"w{i}" for i in range(16384))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)
    plain, batched = hash_embed(df), hash_embed_batches(df)
    assert batched.columns == plain.columns and batched.schema["vector"].dataType.simpleString() == plain.schema["vector"].dataType.simpleString()
    assert plain.exceptAll(batched).count() == 0 and batched.exceptAll(plain).count() == 0
    assert batched.filter(F.size("vector") == 0).count() == plain.filter(F.size("vector") == 0).count() > 0
    assert "Exchange" not in batched._jdf.queryExecution().executedPlan().toString()


def test_dense_layout_has_every_slot_in_place(spark):
    rows = [(1, []), (2, [(0, 5)]), (3, [(383, 7)]), (4, [(3, 1), (4, -2), (380, 9)])]
    df = spark.createDataFrame(rows, "id int, v array<struct<slot:int,q:bigint>>")
    for r in df.select("id", "v", vx.to_dense(F.col("v")).alias("d")).collect():
        want = [0.0] * 384
        for slot, q in r.v:
            want[slot] = q / 1e6
        assert list(r.d) == want
    assert "accumulate" not in vx.to_dense(F.col("v"))._jc.toString() and "aggregate" not in vx.to_dense(F.col("v"))._jc.toString()


def test_white_space_is_pythons_and_runs_fold(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(chr(c),) for c in points], "t string").select("t", F.col("t").rlike(tx.WS).alias("ws")).collect()
    assert [r.t for r in rows if r.ws] == [chr(c) for c in points if chr(c).isspace()]
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab  \n\t　") for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fold_ws(F.col("t")).alias("f"), tx.normalize_text(F.col("t")).alias("n"))
    for r in df.collect():
        assert r.f == " ".join(r.t.split())
        folded = re.sub(r" *\n *", "\n", re.sub(r"[ \t\xa0\f\x0b]+", " ", r.t))
        assert r.n == re.sub(r"\n{3,}", "\n\n", folded).strip()
