import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ragframe.operators import ann, catalog, embedding, evaluation, retrieval as rt
from ragframe.operators import tiles

MODES = [{}, {"broadcast_queries": 0}, {"broadcast_queries": 0, "query_block": 3, "item_block": 17}]


def vectors(spark, n, seed, dim=8, scopes=("a",), weights=None):
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (n, dim))
    s = rng.choice(len(scopes), n, p=weights)
    rows = [(scopes[s[i]], i, list(range(dim)), [int(x) for x in v[i]], int((v[i] ** 2).sum())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "scope string, item_id bigint, features array<int>, weights array<bigint>, norm2 bigint")


def brute(queries, items, k, metric, floor=None):
    out = []
    for qs, qid, _, qv, qn in queries:
        scored = []
        for s, iid, _, iv, n in items:
            if s != qs:
                continue
            d = float(np.dot(qv, iv))
            score = {"dot": d, "cosine": 0.0 if qn * n == 0 else d / (np.sqrt(n) * np.sqrt(qn)),
                     "euclidean": -np.sqrt(max(n + qn - 2 * d, 0.0))}[metric]
            if floor is None or score >= floor:
                scored.append((-score, iid))
        out += [(qid, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_topk_is_exact_under_skewed_scopes(spark, mode, metric):
    # one scope holds most rows, another has queries without items
    items, di = vectors(spark, 300, 1, scopes=("hot", "b", "c"), weights=[0.8, 0.15, 0.05])
    queries, dq = vectors(spark, 12, 2, scopes=("hot", "b", "lonely"), weights=[0.5, 0.3, 0.2])
    found = rt.topk(rt.as_queries(dq), di, 5, metric, **mode).select("query_id", "item_id", "rank").collect()
    assert sorted(map(tuple, found)) == brute(queries, items, 5, metric)


def test_ties_and_copies_are_broken_by_id(spark):
    rows = [("", i, [0], [1], 1) for i in range(5000)]
    di = spark.createDataFrame(rows, "scope string, item_id bigint, features array<int>, weights array<bigint>, norm2 bigint").repartition(5)
    for mode in MODES:
        found = rt.topk(rt.as_queries(di.filter("item_id = 9")), di, 4, **mode).orderBy("rank").collect()
        assert [r.item_id for r in found] == [0, 1, 2, 3]


def test_floor_and_limits(spark):
    items, di = vectors(spark, 60, 3)
    found = rt.topk(rt.as_queries(di, 0.5), di, 20).select("query_id", "item_id", "rank").collect()
    assert sorted(map(tuple, found)) == brute(items, items, 20, "cosine", 0.5)
    for bad in (0, 21):
        with pytest.raises(ValueError):
            rt.topk(rt.as_queries(di), di, bad)
    with pytest.raises(ValueError):
        rt.topk(rt.as_queries(di), di, 3, "manhattan")


def test_sparse_and_dense_scoring_agree(spark, monkeypatch):
    items, di = vectors(spark, 80, 5)
    table = rt.as_queries(di).toArrow()
    batch = di.toArrow().combine_chunks().to_batches()[0]
    dense = tiles.Scorer(table)
    monkeypatch.setattr(tiles, "DENSE_CELLS", 0)
    sparse = tiles.Scorer(table)
    assert dense.dense and not sparse.dense
    a = dense.dots(batch.column("features"), batch.column("weights"))
    assert np.array_equal(a, sparse.dots(batch.column("features"), batch.column("weights")))


DOCS = "document_id bigint, organization_id string, uploaded_by string, source_type string, title string, filename string, status string, embedding_status string"


def library(spark):
    docs = spark.createDataFrame([
        (1, "o1", "u1", "pdf", "Alpha", "a.pdf", "ready", "ready"), (2, "o1", "u2", "pdf", "Beta", "b.pdf", "ready", "ready"),
        (3, "o2", "u1", "md", "Gamma", "c.md", "ready", "ready"), (4, "o1", "u1", "txt", "100%_x", "d.txt", "ready", "processing"),
        (5, "o1", "u1", "txt", "Epsilon", "e.txt", "queued", "none"), (6, "o1", "u1", "md", "Zeta", "f.md", "ready", "ready"),
    ], DOCS)
    chunks = spark.createDataFrame([(d, 0, "refund window is thirty days") for d in range(1, 7)], "document_id bigint, chunk_index int, content string")
    return docs, embedding.hash_embed(chunks)


def test_gates_tenant_owner_status_and_source(spark):
    docs, chunks = library(spark)
    asked = spark.createDataFrame([(9, "refund window", "o1", "u1")], "query_id bigint, question string, organization_id string, uploaded_by string")
    found = rt.search(asked, rt.retrievable(chunks, docs))
    assert [r.document_id for r in found.orderBy("rank").collect()] == [1, 6]
    only = rt.search(asked, rt.retrievable(chunks, docs, "md"))
    assert [r.document_id for r in only.collect()] == [6]
    named = found.withColumn("query_organization", F.lit("o1")).withColumn("query_owner", F.lit("u1"))
    audit = catalog.tenant_audit(named, docs).collect()[0]
    assert (audit.rows_checked, audit.leaks) == (2, 0)
    assert catalog.tenant_audit(named.withColumn("query_owner", F.lit("u2")), docs).collect()[0].leaks == 2


def test_self_distance_is_zero(spark):
    _, chunks = library(spark)
    asked = spark.createDataFrame([(1, "refund window is thirty days")], "query_id bigint, question string")
    found = rt.search(asked, chunks, 20, scope_columns=("model",)).collect()
    assert len(found) == 6 and all(abs(1 - r.similarity) < 1e-9 for r in found)


def test_title_search_escapes(spark):
    docs, _ = library(spark)
    names = lambda term: sorted(r.title for r in rt.title_search(docs, term).collect())
    assert names("%_") == ["100%_x"] and names("alp") == ["Alpha"] and names("F.MD") == ["Zeta"] and names("\\") == []


def test_metadata_containment(spark):
    odd = '{"a.b": 2, "it\'s [0]": true, "n": "1", "q": "say \\"é\\""}'
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1.0}',), ("{}",), (odd,), (None,)], "m string")
    count = lambda want: df.filter(rt.metadata_contains(F.col("m"), want)).count()
    assert count({"a": 1}) == 2 and count({"a": 1, "b": "x"}) == 1 and count({}) == 5
    assert count({"a": "1"}) == 0 and count({"n": 1}) == 0 and count({"n": "1"}) == 1
    assert count({"a.b": 2}) == 1 and count({"it's [0]": True}) == 1 and count({"it's [0]": False}) == 0 and count({"q": 'say "é"'}) == 1


@pytest.mark.parametrize("mode", MODES)
def test_any_document_and_chunk_number_is_an_item(spark, mode):
    # hashed 64-bit ids, negative ones and chunk numbers beyond a million, all tied
    pairs = [(d, c) for d in (-(2**63), -1, 0, 2**43, 2**63 - 1) for c in (0, 2**20, 2**31 - 1)]
    chunks = spark.createDataFrame(
        [(d, c, "tenant", [(3, 1000000)]) for d, c in reversed(pairs)],
        "document_id bigint, chunk_index int, organization_id string, vector array<struct<slot: int, q: bigint>>",
    )
    items = rt.sparse_items(chunks, ["organization_id"]).repartition(4)
    asked = spark.createDataFrame([("tenant", 5, [3], [1], 1)], "scope string, item_id bigint, features array<int>, weights array<bigint>, norm2 bigint")
    found = rt.topk(rt.as_queries(asked), items, 12, **mode).select("rank", *rt.split_item(F.col("item_id"))).orderBy("rank")
    assert [(r.document_id, r.chunk_index) for r in found.collect()] == sorted(pairs)[:12]
    # a target in the midst: as many of the tied items stand above it as have smaller pairs
    marked = rt.as_queries(asked).withColumn("target_id", rt.item_id(F.lit(-1).cast("bigint"), F.lit(2**20))).withColumn("target_score", F.lit(1000000.0))
    stood = tiles.run_tiles(marked, items, tiles.standing_kernel([0.5], "dot", 1e6), **mode)
    assert stood.agg(F.sum("above")).first()[0] == sorted(pairs).index((-1, 2**20))


def test_block_bounds_leave_blocks_out_and_keep_the_best():
    rng = np.random.default_rng(5)
    names = np.array([f"t{i}" for i in range(60)])

    def sparse(n: int, signed: bool) -> tuple[list, list]:
        sizes = rng.integers(0, 9, n)
        feats = [list(rng.choice(names, s, replace=False)) for s in sizes]
        return feats, [[int(w) for w in rng.integers(-50 if signed else 1, 900, s)] for s in sizes]

    for signed in (False, True):
        qf, qw = sparse(40, signed)
        qf[7], qw[7] = ["nowhere"], [5]
        norm = lambda ws: [float(sum(w * w for w in x)) for x in ws]
        kind = pa.list_(pa.string()), pa.list_(pa.int64())
        queries = pa.table({"query_id": list(range(40)), "features": pa.array(qf, kind[0]), "weights": pa.array(qw, kind[1]),
                            "norm2": norm(qw), "floor": [float("-inf")] * 20 + [0.2] * 20})
        f, w = sparse(6000, signed)
        # Most of the norm lies outside the question tokens for most items, as in the search.
        norm2 = np.array(norm(w)) * np.sort(rng.choice([1.0, 4.0, 400.0], 6000)) + (np.arange(6000) % 3 == 0)
        items = pa.RecordBatch.from_arrays(
            [pa.array(rng.permutation(6000)), pa.array(f, kind[0]), pa.array(w, kind[1]), pa.array(norm2)],
            names=["item_id", "features", "weights", "norm2"],
        )
        seen = []
        for skip in (False, True):
            run, _ = tiles.topk_kernel(4, "cosine", skip=skip)
            scored = []
            original = tiles.Scorer.dots
            tiles.Scorer.dots = lambda self, a, b, only=None: scored.append(len(a) * (self.n if only is None else len(only))) or original(self, a, b, only)
            try:
                out = pa.Table.from_batches(run(queries, iter([items]))).to_pydict()
            finally:
                tiles.Scorer.dots = original
            order = sorted(zip(out["query_id"], (-s for s in out["score"]), out["item_id"], strict=True))
            seen.append((order, sum(scored)))
        assert seen[0][0] == seen[1][0]
        assert seen[1][1] < 0.7 * seen[0][1]
    with pytest.raises(ValueError):
        tiles.topk_kernel(4, "euclidean", skip=True)


def test_tfidf_reads_the_texts_once(spark, tmp_path):
    from pyspark.sql import functions as F

    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(s):
        reads.add(1)
        return s

    df = spark.range(300).select(F.col("id").alias("document_id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("text"))
    df = df.withColumn("text", counted("text")).unionByName(spark.createDataFrame([(900, None), (901, "")], df.schema))
    qs = spark.createDataFrame([(1, "w3 word"), (2, None), (3, "unknown")], "query_id bigint, question string")
    found = rt.tfidf_topk(qs, df, "document_id", "text", 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.document_id) for r in found] == [(1, 3), (1, 10), (1, 17)] + [(q, d) for q in (2, 3) for d in (0, 1, 2)]
    assert reads.value == 300


def test_tfidf_against_a_plain_definition(spark):
    import math

    docs = ["the cat sat", "the dog sat on the mat", "a cat and a dog", "unrelated words entirely", ""]
    asked = ["cat dog", "the", "nothing known"]
    df = spark.createDataFrame(list(enumerate(docs)), "document_id bigint, text string")
    qs = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, question string")
    vocab = sorted({t for d in docs for t in d.split()})
    dfq = {t: sum(t in d.split() for d in docs) for t in vocab}
    idf = {t: round(math.log(len(docs) / (1 + n)) * 1e4) / 1e4 for t, n in dfq.items()}
    vec = lambda s: np.array([s.split().count(t) * idf[t] for t in vocab])
    for metric in ("cosine", "euclidean"):
        for mode in MODES:
            found = rt.tfidf_topk(qs, df, "document_id", "text", 5, metric, **mode).orderBy("query_id", "rank").collect()
            assert len(found) == 15
            for r in found:
                a, b = vec(asked[r.query_id]), vec(docs[r.document_id])
                n = np.linalg.norm(a) * np.linalg.norm(b)
                want = np.linalg.norm(a - b) if metric == "euclidean" else (a @ b / n if n else 0.0)
                assert abs(want - r.score) < 1e-3
    with pytest.raises(ValueError):
        rt.tfidf_topk(qs, df, "document_id", "text", 3, "dot")


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 16)) * 4
    rows = [(i, [int(x * 1e6) for x in centers[i % 8] + rng.normal(size=16)]) for i in range(400)]
    v = spark.createDataFrame(rows, "id bigint, q array<bigint>")
    cells = ann.train_cells(v, "id", "q", 8)
    items = rt.dense_items(v, "id", "q")
    exact = rt.topk(rt.as_queries(items), items, 5)
    scores = [ann.recall(ann.ann_topk(v, v, "id", "q", cells, 5, p), exact).collect()[0].recall for p in (1, 3, 8)]
    assert scores == sorted(scores) and scores[1] > 0.9 and scores[2] == 1.0


def test_stored_cells_are_pruned_and_probed(spark, tmp_path):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 16)) * 6
    rows = [(i, [int(x * 1e6) for x in centers[i % 12] + rng.normal(size=16)]) for i in range(600)]
    v = spark.createDataFrame(rows, "id bigint, q array<bigint>")
    path = str(tmp_path / "cells")
    ann.write_cells(v, "q", path, 16, planes=4)
    normals = np.array([ann.plane(n, 16) for n in range(4)], dtype=object)
    cell = lambda q: sum(1 << n for n, m in enumerate(normals @ np.array(q, dtype=object)) if m >= 0)
    table = spark.read.parquet(path)
    assert {r.id: r.cell for r in table.collect()} == {i: cell(q) for i, q in rows}
    asked = v.filter("id % 20 = 0")
    items = rt.dense_items(v, "id", "q")
    exact = rt.topk(rt.as_queries(rt.dense_items(asked, "id", "q")), items, 5)
    found = [ann.stored_topk(table, asked, "id", "q", 16, 5, 4, p) for p in (1, 6, 16)]
    scores = [ann.recall(f, exact).collect()[0].recall for f in found]
    assert scores == sorted(scores) and scores[1] > 0.9 and scores[2] == 1.0
    near = {r.id: [c.cell for c in r.cells] for r in ann.probe(asked, "q", 16, 4, 3).groupBy("id").agg(F.collect_list(F.struct("cell")).alias("cells")).collect()}
    for i, q in rows[::20]:
        m = [abs(int(x)) for x in normals @ np.array(q, dtype=object)]
        best = sorted(range(16), key=lambda k: (sum(x for n, x in enumerate(m) if k >> n & 1), k))[:3]
        assert sorted(near[i]) == sorted(cell(q) ^ k for k in best)
    tiles_plan = found[0]._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in tiles_plan and "PartitionFilters" in tiles_plan


def test_filters_come_before_the_best_k(spark):
    texts = ["alpha beta gamma", "alpha beta", "alpha", "beta gamma", "gamma delta"]
    docs = [(i, "o", "u", ("md", "pdf")[i % 2], "T", "ready", "ready") for i in range(10)]
    documents = spark.createDataFrame(docs, "document_id long, organization_id string, uploaded_by string, source_type string, title string, status string, embedding_status string")
    rows = [(i, 0, "o", "u", texts[i % 5], '{"page":%d}' % (i % 3)) for i in range(10)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_index int, organization_id string, uploaded_by string, content string, metadata string")
    chunks = embedding.hash_embed(chunks)
    q = spark.createDataFrame([(1, "alpha beta", "o", "u"), (2, "alpha beta", "other", "u")], "query_id long, question string, organization_id string, uploaded_by string")
    got = rt.filtered_search(q, chunks, documents, source_type="md", metadata={"page": 0}, floor=0.3, k=2, scope_columns=("organization_id", "uploaded_by"))
    found = [(r.query_id, r.document_id, r.similarity) for r in got.orderBy("rank").collect()]
    assert [f[:2] for f in found] == [(1, 6), (1, 0)]
    assert found[0][2] == 1.0 and all(s >= 0.3 for _, _, s in found)


def test_vector_drift(spark):
    df = embedding.hash_embed(spark.createDataFrame([(1, "one two"), (2, "three"), (3, ""), (4, "four five")], "id int, content string"))
    moved = F.when(F.col("id") == 2, F.array(F.struct(F.lit(400).alias("slot"), F.lit(1_000_000).cast("bigint").alias("q"))))
    stored = df.withColumn("vector", F.when(F.col("id") == 4, F.lit(None)).otherwise(F.coalesce(moved, "vector")))
    got = {r.id: (round(r.distance, 4), r.drifted) for r in embedding.vector_drift(stored, "content", "vector").collect()}
    assert got == {1: (0.0, False), 2: (1.4142, True), 3: (0.0, False), 4: (1.0, True)}


def test_batches_without_any_token_have_empty_vectors(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "\n")], "id int, content string").coalesce(1)
    assert [r.vector for r in embedding.hash_embed_batches(df).orderBy("id").collect()] == [[], [], []]


def test_validation_and_batches(spark):
    calls = []

    def model(texts):
        if len(texts) > 2:
            raise AssertionError("slice too large")
        if "flaky" in texts and not calls:
            calls.append(1)
            raise embedding.RetryableError
        return [[float(len(t)), 0.0] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "flaky", "c", ""])], "id int, content string").coalesce(1)
    got = embedding.score_in_batches(df, model, batch=2, backoff=0.0).orderBy("id").collect()
    assert [r.vector[0] for r in got] == [1.0, 2.0, 5.0, 1.0, 0.0]
    with pytest.raises(Exception, match="fatal"):
        def broken(texts):
            raise ValueError("fatal")
        embedding.score_in_batches(df, broken).collect()
    bad = spark.createDataFrame([("d", [1.0, 2.0]), ("d", [float("nan"), 1.0]), ("e", [0.0, 0.0]), ("f", [1.0]), ("g", [3.0, 4.0])], "d string, v array<double>")
    got = {r.d: (r.first_problem, r.publishable) for r in embedding.validate_vectors(bad, "d", "v", 2).collect()}
    assert got == {"d": ("not_finite", False), "e": ("all_zero", False), "f": ("dimension", False), "g": (None, True)}


def test_queries_are_met_by_few_copies_of_the_items(spark):
    """Items are shuffled once a block of queries: 3,000 queries are one block, and a block's matrices are bounded."""
    count = lambda queries, items: iter([pa.RecordBatch.from_arrays([pa.array([queries.num_rows])], ["n"])])
    _, di = vectors(spark, 3000, 21)
    tiled = tiles.run_tiles(rt.as_queries(di), di, (count, StructType().add("n", LongType())), broadcast_queries=0)
    assert [r.n for r in tiled.collect()] == [3000]
    rows = rt.as_queries(di).toArrow()
    assert tiles.Scorer(rows).step * 3000 <= tiles.STEP_CELLS


@pytest.mark.parametrize("mode", MODES)
def test_best_chunks_take_their_tokens_in_the_kernel(spark, mode):
    texts = ["Alpha beta beta", "beta GAMMA alpha", "", "delta", "gamma alpha beta", "ALPHA'S beta"]
    chunks = spark.createDataFrame([("s", i, 0, t) for i, t in enumerate(texts)], "scope string, document_id bigint, chunk_index int, content string")
    golds = ["alpha beta gamma", "delta zeta", "", "alpha's"]
    queries = spark.createDataFrame([("s", i, g) for i, g in enumerate(golds)], "scope string, query_id bigint, gold string")
    found = evaluation.best_chunks(queries, chunks, **mode)
    assert sorted((r.query_id, r.item_id.document_id, r.overlap) for r in found.collect()) == [(0, 1, 3), (1, 3, 1), (2, 0, 0), (3, 5, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(lower(content" not in plan


def test_questions_of_all_settings_travel_to_the_items(spark):
    items = spark.createDataFrame([(str(s), i, [0], [1], 1) for s in range(12) for i in range(3)], "scope string, item_id bigint, features array<int>, weights array<bigint>, norm2 bigint")
    asked = spark.range(2400).selectExpr("cast(id % 12 as string) scope", "id query_id", "array(0) features", "array(1L) weights", "1L norm2", "-1d floor")
    best = tiles.run_tiles(asked, items, tiles.topk_kernel(2, "dot"))
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString() and best.count() >= 4800


def test_blocks_of_queries_travel_to_items_that_stay(spark):
    """A scope of more queries than a block: passes over the items in place, not a copy of them for each block."""
    items, di = vectors(spark, 200, 21, scopes=("hot", "b"), weights=[0.8, 0.2])
    queries, dq = vectors(spark, 60, 22, scopes=("hot", "b"), weights=[0.95, 0.05])
    hot = [q for q in queries if q[0] == "hot"]
    for asked, table in ((hot, dq.filter("scope = 'hot'")), (queries, dq)):
        found = rt.topk(rt.as_queries(table), di, 4, broadcast_queries=0, query_block=20)
        assert sorted((r.query_id, r.item_id, r["rank"]) for r in found.collect()) == brute(asked, items, 4, "cosine")
        assert ("CoGroup" in found._jdf.queryExecution().executedPlan().toString()) == (asked is queries)


def test_a_block_of_many_scopes_is_sorted_out_once(monkeypatch):
    table = pa.table({"scope": [f"s{i % 700}" for i in range(2100)], "n": list(range(2100))})
    monkeypatch.setattr(tiles.pc, "equal", lambda *_: pytest.fail("the block is read once for each scope"))
    parts = dict(tiles._by_scope(table))
    assert len(parts) == 700 and all(parts[f"s{i}"].column("n").to_pylist() == [i, i + 700, i + 1400] for i in range(700))


def test_tokens_on_bytes_are_those_of_the_pattern():
    import re

    from ragframe.functions import text as tx
    from ragframe.operators import words

    texts = ["", None, "a b", "é'x", "a\0b", "9", "日本 it's", "zz\n", "x"]
    for at in (0, 3):
        part = pa.array(texts).slice(at)
        row, found = words.tokens(part)
        assert list(zip(row.tolist(), found.to_pylist())) == [(i, w) for i, t in enumerate(texts[at:]) for w in re.findall(tx.TOKEN, t or "")]
    assert list(words.steps(pa.array(texts), 4)) == [(0, 4), (4, 4), (8, 1)]


def test_queries_of_many_scopes_are_sent_once(spark, monkeypatch):
    from pyspark import cloudpickle

    n = 1500
    rows = [(f"s{i}", i, [i % 7], [1 + i % 3], (1 + i % 3) ** 2) for i in range(n)]
    df = spark.createDataFrame(rows, "scope string, item_id bigint, features array<int>, weights array<bigint>, norm2 bigint")
    sent, original = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a: sent.append(len(cloudpickle.dumps(f))) or original(self, f, *a))
    found = rt.topk(rt.as_queries(df), df, 2).select("query_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(i, i) for i in range(n)]
    assert sent[0] < 1_000_000
