"""Operators beside brute force on small tables with nulls, empty and long texts, repeats and odd columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragframe.llm import (
    components, decontaminate, lines, mixing, pieces, quality, simhash, substrings, suffixes, tokenstore, topk, urls,
)

SCHEMA = "doc_id long, text string, row string, score string, ids string"
WORDS = [a + b for a in ("th", "on", "er", "ou", "é", "st") for b in ("a", "ing", "re", "ly", "né", "")]


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ".\n", ", ", "  "]) for _ in range(n)).strip()


@pytest.fixture(scope="module")
def rows():
    """Ids with gaps, null and repeated ids, null, empty, blank, short and long texts, exact and near copies."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 250)) for _ in range(25)]
    texts = base + [None, "", " \n ", "one", "Te " * 300, "a" * 3000, prose(rng, 6000)]
    texts += [base[3], base[3], base[4] + " tail", base[5].replace(" ", "  ", 1), base[6][: len(base[6]) // 2] + base[7]]
    texts += [base[i].replace("tha", "THA", 1) for i in (8, 9)]
    out = [(10 * i, t) for i, t in enumerate(texts)]
    out += [out[3], (None, base[3]), (None, None), (30, "another text of the same id")]
    return [(i, t, "r", None, "x") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def unique(spark, rows):
    """Rows with distinct ids, for definitions that order by them."""
    seen = {}
    for r in rows:
        if r[0] is not None:
            seen.setdefault(r[0], r)
    return list(seen.values()), spark.createDataFrame(list(seen.values()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is not None, v) for v in row)


# ---- token store --------------------------------------------------------------------------------


def test_token_store_round_trip(spark, rows, docs, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    tokenstore.write_tokens(docs, str(tmp_path / "t"), path)
    got = tokenstore.read_tokens(spark, str(tmp_path / "t")).collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows]
    want = sorted(((i, r) for i, r in zip((r[0] for r in rows), ids, strict=True)), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    got = sorted(got, key=lambda r: r["start"])
    assert [r["n_tokens"] for r in got] == [len(r["ids"]) // 4 for r in got]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    have = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    assert have == want
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    tokenstore.write_tokens(none, str(tmp_path / "e"), path)
    assert tokenstore.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_damaged_file_is_refused(spark, docs, tmp_path):
    tokenstore.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    file = max((tmp_path / "t").glob("*.tok"), key=lambda f: f.stat().st_size)
    data = bytearray(file.read_bytes())
    data[40] ^= 255
    with pytest.raises(tokenstore.CorruptFile):
        source = pa.BufferReader(bytes(data))
        _, table, _, offsets = tokenstore.read_shard(source)
        tokenstore.Reader({"path": ""})._decode(source, table, offsets, 49408)
    with pytest.raises(tokenstore.CorruptFile):
        tokenstore.read_shard(pa.BufferReader(bytes(data[:-9])))


@pytest.mark.parametrize("kind", ["random", "constant", "text", "one"])
def test_coder_gives_back_ids(kind):
    rng = np.random.default_rng(1)
    n = {"one": 1}.get(kind, 700)
    ids = {"random": rng.integers(0, 49408, (5, n)), "constant": np.full((5, n), 49407), "one": np.full((5, 1), 3)}.get(kind)
    ids = np.minimum(rng.zipf(1.3, (5, n)), 49407) if ids is None else ids
    lengths = np.full(5, n)
    lengths[-1] = max(1, n // 3)
    payloads = mixing.encode_blocks(ids, lengths, 49408)
    back = mixing.decode_blocks(payloads, lengths, 49408)
    for i, m in enumerate(lengths):
        assert (back[i, :m] == ids[i, :m]).all()
    if kind == "constant":
        assert len(payloads[0]) < 2 * n // 20


def test_word_memo_equals_library(rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), tokenstore.Words(path)
    odd = ["don't stop... they'll", "áb ́x <|endoftext|>now ok<|endoftext|>", "x y z", "ΑΣ. ΣΑΣ,", "3.14%%% a1b2", "'s 's", "Ǆ!", "日本 語。"]
    texts = odd + [r[1] or "" for r in rows]
    ids, counts = words.ids(pa.array(texts))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# ---- pieces -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library_model(tmp_path_factory):
    """The public vocabulary as a unigram model, which the library itself searches for the best segmentation."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000.0)  # the library adds in single precision
    path = tmp_path_factory.mktemp("pieces") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_pieces_equal_library(library_model, rows):
    path, library = library_model
    ours = pieces.Pieces(path)
    texts = [r[1][i : i + 60] for r in rows if r[1] for i in range(0, min(len(r[1]), 600), 60)]
    for t in [*texts, "", " ", "  a  b ", "\n\nx\n", "日本語 🙂", "a\tb"]:
        assert ours.encode(t) == library.encode(t), t


def test_stream_commits_early_and_right():
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    text = "".join(rng.choice(WORDS) for _ in range(3000))
    parts = list(model.stream(text[i : i + 50] for i in range(0, len(text), 50)))
    assert len(parts) > 20
    whole = list(model.stream([text]))
    assert [i for p in parts for i in p] == [i for p in whole for i in p]
    assert model.decode(model.encode(text)) == text


def test_pieces_on_tables(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(docs, path), path)
    assert back.columns == ["doc_id", "text", "row", "score", "ids", "decoded"]
    assert back.filter("decoded <> coalesce(text, '')").count() == 0
    assert back.filter("text is null or text = ''").filter("size(ids) > 0").count() == 0
    assert pieces.encode(none, path).count() == 0


# ---- urls ---------------------------------------------------------------------------------------


def test_urls_and_aliases(spark):
    link = '<html><LINK href="{}" rel=canonical></html>'.format
    pages = [
        (1, "http://x.org/a", link("http://b.net/es/1")), (2, "http://y.org/b#f", link("http://X.org/a")),
        (3, "http://z.com/c", link("/d")), (4, "http://z.com/d", "<meta http-equiv='Refresh' content='0; URL=http://b.net/es/1'>"),
        (5, None, None), (6, "nourl", link("http://b.net/es/1")), (7, "http://b.net/en/", ""), (8, "http://y.org/b", None),
        (9, "HTTP://WWW.Example.com/en/x", None), (10, "https://a.example.com/en/?q", None), (11, "http://example.com", None),
        (12, "http://bnet/es/", None), (12, "http://bnet/es/", None), (None, "http://q.net/fr/", None),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = [tuple(r) for r in urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()]
    want = [
        (1, "x.org", "/a", None, "block"), (2, "y.org", "/b", None, "block"), (3, "z.com", "/c", "com/", "allow"),
        (4, "z.com", "/d", "com/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "b.net", "/en/", None, "allow"), (8, "y.org", "/b", None, "block"),
        (9, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (10, "a.example.com", "/en/", "example.com/en/", "block"),
        (11, "example.com", "", None, "allow"), (12, "bnet", "/es/", None, "allow"), (12, "bnet", "/es/", None, "allow"),
        (None, "q.net", "/fr/", "net/fr/", "block"),
    ]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert urls.judge(df.limit(0)).count() == 0
    redirects = spark.createDataFrame([("http://y.org/new", "http://y.org/b")], "source string, target string")
    moved = spark.createDataFrame([(1, "http://y.org/new", None), (2, "http://y.org/b", link("http://c.net/fr/"))], "page_id int, url string, html string")
    assert {r["verdict"] for r in urls.judge(moved, redirects=redirects).collect()} == {"block"}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "path": [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)],
        "star": [(500, i) for i in range(100)] + [(7, 500)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 3)],
    }[shape]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---- decontamination ----------------------------------------------------------------------------


def words13(text):
    out, word = [], []
    for c in (text or "").encode().decode():
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


@pytest.fixture(scope="module")
def bench(spark, rows):
    items = [(1, " ".join(words13(rows[2][1])[5:30])), (2, "one"), (3, None), (4, ""), (10, rows[4][1].upper()), (10, rows[4][1]), (None, "One; two")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(rows, docs, bench, none):
    items, table = bench
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words13(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    want = []
    for i, t, *_ in rows:
        w = words13(t)
        hit, met = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    met |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), len(met), ",".join(sorted(met)), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontaminate.scan(docs, table).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    kept = decontaminate.drop_documents(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.drop_spans(docs, table).filter("doc_id = 20").collect()}
    assert words13(cut[20]) == words13(rows[2][1])[:5] + words13(rows[2][1])[30:]
    assert decontaminate.scan(none, table).count() == 0
    assert decontaminate.scan(docs, table.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_without_broadcast(docs, bench, monkeypatch):
    want = sorted(map(tuple, decontaminate.scan(docs, bench[1]).drop("row", "items", "hits").collect()), key=key)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    assert sorted(map(tuple, decontaminate.scan(docs, bench[1]).drop("row", "items", "hits").collect()), key=key) == want


# ---- substrings ---------------------------------------------------------------------------------


def passages_by_force(rows, n):
    first, want = {}, []
    parts = sorted(((i, (t or "").encode().split()) for i, t, *_ in rows))
    for i, w in parts:
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
    for i, w in parts:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] != (i, k):
                gone |= set(range(k, k + n))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return want


@pytest.mark.parametrize("window", [20, 4])
def test_passages(unique, none, window):
    rows, docs = unique
    got = substrings.passages(docs, window)
    assert sorted(map(tuple, got.drop("spans").collect())) == passages_by_force(rows, window)
    assert got.filter("n_removed <> aggregate(spans, 0L, (a, s) -> a + s.words)").count() == 0
    assert substrings.passages(none).count() == 0


def test_passages_of_repeated_ids(docs):
    got = substrings.passages(docs).collect()
    assert len(got) == docs.count()
    assert {r["n_removed"] for r in got if r["doc_id"] == 30 and r["n_words"] > 20} <= {r["n_words"] for r in got if r["doc_id"] == 30}
    first = [r for r in got if r["doc_id"] is None and r["n_words"]]
    assert [r["n_removed"] for r in first] == [0]  # null comes before all ids


@pytest.mark.parametrize("length", [400, 60])
@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeated_bytes(rows, docs, none, length, hot):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    want = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) > 0).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffixes.repeated_bytes(docs, length, hot=hot).drop("spans").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    if length == 400:
        assert suffixes.repeated_bytes(none, length, hot=hot).count() == 0


# ---- top-k --------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [16, 8192])
def test_top_k(spark, shard):
    rng = np.random.default_rng(4)
    data = [(int(i), [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)]
    data += [(400 + i, data[0][1]) for i in range(20)] + [(500, None), (501, [1.0, None] + [0.0] * 4), (502, [math.nan] * 6)]
    data += [(550, [0.0] * 6), (None, [9.0] * 6), (600, [1.0, 2.0]), (650, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    vectors = topk.whole_vectors(df)
    got = topk.search(vectors.filter("id % 50 = 0"), vectors, shard=shard).collect()
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in data if i is not None and v and all(x is not None and x == x for x in v)}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        score = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(vectors.limit(0), vectors).count() == 0
    assert topk.search(vectors.filter("id = 0"), vectors.limit(0)).count() == 0
    small = topk.search(vectors.filter("id % 50 = 0"), vectors, block=2)
    assert sorted(map(tuple, small.collect())) == sorted(want)


# ---- lines --------------------------------------------------------------------------------------


def lines_by_force(rows, s=0.8):
    every = []
    for i, t in rows:
        for k, line in enumerate(t.split("\n") if t else ()):
            words = frozenset(line.encode().lower().split())
            if words:
                every.append((i, k, words))
    gone = collections.defaultdict(list)
    for n, (i, k, words) in enumerate(every):
        if any(len(words & e) >= s * len(words | e) - 1e-9 for _, _, e in every[:n]):
            gone[i].append(k)
    return [(i, len(t.split("\n")) if t else 0, gone[i]) for i, t in rows]


@pytest.mark.parametrize("tries", [0, 2])
def test_lines(spark, tries, monkeypatch):
    monkeypatch.setattr(lines, "TRIES", tries)
    rng = random.Random(6)
    pool = [" ".join(rng.choice(WORDS) + rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    near = [p.split() for p in rng.sample(pool, 30)]
    for p in near:
        p[rng.randrange(len(p))] = rng.choice(["x", "y", "z"])
    pool += [" ".join(p) for p in near] + ["", " ", "The of", "the OF of"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 8)))) for i in range(60)] + [(90, None), (91, ""), (92, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_lines"], list(r["removed"])) for r in lines.removed_lines(docs).collect()]
    assert sorted(got) == sorted(lines_by_force(rows))


def test_drop_lines(docs, none):
    kept = lines.drop_lines(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert None in texts and "" in texts  # nothing was taken from them
    assert lines.drop_lines(none).count() == 0
    worded = [line for t in texts if t for line in t.split("\n") if line.split()]
    sets = [frozenset(w.encode().lower().split()) for w in worded]
    assert len(set(sets)) == len(sets)


# ---- simhash ------------------------------------------------------------------------------------


def print_by_force(text, words):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(rows, docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [print_by_force(r[1], 4) for r in rows]
    assert sorted((r["fp"] % 2**64 for r in got)) == sorted(prints)
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (i, *_), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(r[0], p, least.get(c)) for r, p, c in zip(rows, prints, label, strict=True)]
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("tile", [simhash.TILE, 7])
def test_index_finds_every_link(spark, tile):
    rng = random.Random(8)
    center = [rng.getrandbits(64) for _ in range(30)]
    codes = {c for c in center} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for c in center for _ in range(12)}
    codes = sorted(codes)
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4, tile).collect()
    find = {c: c for c in codes}

    def root(x):
        while find[x] != x:
            x = find[x]
        return x

    def classes(pairs):
        find.update({c: c for c in codes})
        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            find[b] = a
        return [root(c) for c in codes]

    force = [(a, b) for i, a in enumerate(codes) for b in codes[:i] if (a ^ b).bit_count() <= 4]
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in edges]
    assert classes(got) == classes(force)


# ---- quality ------------------------------------------------------------------------------------


def test_quality_learns_held_out(spark, none):
    rng = random.Random(9)
    good = [(i, prose(rng, rng.randint(3, 200))) for i in range(0, 300)]
    bad = [(i, " ".join(w + "***" for w in prose(rng, 150).split())) for i in range(300, 420)]
    docs = spark.createDataFrame([*good, *bad, (900, None), (901, ""), (None, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score(docs.withColumn("score", F.lit("own")), model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.select("*", quality.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r for r in rows if r["h"] and r["doc_id"] < 500]
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] < 300) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 423
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(none.drop("score"), model).count() == 0
    blank = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs, blank).count() == 423


def test_gradients_are_right():
    rng = np.random.default_rng(3)
    model, x, counts = quality.new_model(), rng.random((7, quality.WIDTH)), np.array([3, 1, 3])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    loss = lambda: float(-(w * np.where(y == 1, np.log(model.forward(x, counts)[0]), np.log(1 - model.forward(x, counts)[0]))).sum() / w.sum())
    for name, grad in zip(vars(model), model.gradients(x, counts, y, w), strict=True):
        value = getattr(model, name)
        at = tuple(s // 2 for s in value.shape)
        old, step = value[at], 1e-5
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert abs((up - down) / (2 * step) - grad[at]) < 1e-6, name


def test_long_texts_are_encoded_whole(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 500)
    rng = random.Random(1)
    texts = [prose(rng, 400).encode(), b"", b"x" * 1700, b"a b"]
    x, counts = quality.encode_whole(texts)
    assert len(x) == counts.sum() and counts[1] == counts[3] == 1 and counts[0] >= 400 // quality.PASSAGE and counts[2] >= 3


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(11)
    good = [(i, prose(rng, 120), "en", "s", 0) for i in range(60)]
    bad = [(i, " ".join(w + "***" for w in prose(rng, 120).split()), "en", None, None) for i in range(60, 85)]
    more = [(90, good[0][1], "en", "s", 1), (91, None, None, None, None), (92, "", "en", "s", 0), (93, good[2][1].replace("\n", " "), "en", "s", 0)]
    spark.createDataFrame([*good, *bad, *more], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(85)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, good[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert name == "sentencepiece" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] >= set(range(60)) and not seen[0] & set(range(60, 85))
    assert 90 not in seen[1] and {0, 91, 92} <= seen[1] | {91, 92}
    assert 3 not in seen[3] and len(seen[3]) >= 55
    assert docs.filter("not round_trip").count() == 0
    assert cp.run(spark, str(tmp_path)).count() == docs.count()
