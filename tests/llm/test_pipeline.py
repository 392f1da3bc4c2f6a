"""The classifier against a plain scorer, and the pipeline's rows against plain versions of its stages."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers

from ragframe.llm import pieces, quality
from test_operators import lines_by_force, prose

NONE = set()


def features_by_force(text):
    """One row a passage of 64 words: shape pairs from its first byte to the next passage's, then word statistics."""
    out = []
    for piece in quality.pieces_of(text):
        words = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", piece)]
        for at in range(0, max(1, len(words)), quality.PASSAGE):
            own = words[at : at + quality.PASSAGE]
            row = np.zeros(quality.WIDTH)
            if own:
                end = words[at + quality.PASSAGE][0] if at + quality.PASSAGE < len(words) else len(piece)
                shape = [int(quality.SHAPES[b]) for b in piece + b"\n"]
                for i in range(own[0][0], end):
                    row[quality._PAIR_OF[shape[i], shape[i + 1]]] += 1
                row[: quality.PAIRS] = np.sqrt(row[: quality.PAIRS] / row[: quality.PAIRS].sum())
                said = [piece[a:b] for a, b in own]
                n = len(said)
                row[quality.PAIRS :] = [
                    math.log1p(n) / 4, sum(map(len, said)) / n / 8, sum(x == y for x, y in zip(said, said[1:])) / n,
                    len(set(said)) / n, sum(65 <= w[0] <= 90 and 65 <= w[-1] <= 90 for w in said) / n,
                    sum(quality.SHAPES[w[-1]] >= 6 for w in said) / n,
                ]
            out.append(row)
    return out


def score_by_force(text, model):
    hidden = [np.tanh(x @ model.E + model.e) for x in features_by_force((text or "").encode())]
    raw = [sum(model.w * np.tanh(h @ model.V) / (1 + np.exp(-(h @ model.U)))) for h in hidden]
    share = [math.exp(r - max(raw)) for r in raw]
    z = sum(a / sum(share) * h for a, h in zip(share, hidden))
    return 1 / (1 + math.exp(-(z @ model.c + model.b[0])))


def some_texts(rng):
    shouts = [" ".join(w.upper() + "***" for w in prose(rng, 90).split()) for _ in range(5)]
    return [None, "", "  \n", "one", " é leading", "trailing \n\n", *(prose(rng, n) for n in (3, 64, 65, 128, 400)), *shouts, "x x x x"]


def test_scores_equal_a_plain_scorer_in_any_batch():
    rng = random.Random(3)
    texts = some_texts(rng)
    model = quality.new_model(11)
    want = [score_by_force(t, model) for t in texts]
    raw = [(t or "").encode() for t in texts]
    for order in (range(len(raw)), random.Random(4).sample(range(len(raw)), len(raw))):
        for size in (1, 3, len(raw)):
            dealt = list(order)
            for at in range(0, len(dealt), size):
                part = dealt[at : at + size]
                x, counts = quality.encode_whole([raw[i] for i in part])
                got, _ = model.forward(x.astype(np.float64), counts)
                assert np.allclose(got, [want[i] for i in part], atol=1e-6)


# ---- pipeline -----------------------------------------------------------------------------------


def near_by_force(rows):
    """The rows that stay: least id of each component of five-word shingle sets that are 0.8 alike."""
    sets = []
    for _, text, *_ in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else NONE)
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return [r for r in rows if r[0] in least.values()]


def clean_by_force(rows, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12)):
            if w:
                windows[len(w[i : i + 13])].add(tuple(w[i : i + 13]))
    out = []
    for r in rows:
        w = split(r[1])
        hit = {j for n, held in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in held for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def lines_gone(rows):
    """Rows without lines equal or similar to an earlier one; rows that lost a line and hold no word go."""
    gone = {i: set(numbers) for i, _, numbers in lines_by_force(sorted((r[0], r[1]) for r in rows))}
    out = []
    for r in rows:
        drop = gone[r[0]]
        text = r[1] if not drop else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in drop)
        if not drop or re.search(r"[^\x20\x09-\x0D]", text):
            out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return out


def corpus(rng):
    """Rows with near copies between 0.7 and 0.95, repeated and similar lines, benchmark passages, junk and nothing."""
    rows = [(i, prose(rng, rng.randint(40, 160))) for i in range(50)]
    for n, i in enumerate(range(100, 130)):  # one line each, so that lines do not tell the copies before shingles do
        words = rows[n][1].split()
        words = [w + "q" for w in words] if n % 3 else [rng.choice("abc") + w for w in words]
        near = list(words)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = "changed"
        rows += [(i, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))), (i + 100, "\n".join(" ".join(near[k : k + 7]) for k in range(0, len(near), 7)))]
    rows += [(300 + i, " ".join(w.upper() + "***" for w in prose(rng, 100).split())) for i in range(40)]
    rows += [(400, rows[0][1]), (401, None), (402, ""), (403, " \n\t"), (404, rows[1][1].upper()), (405, "one"), (406, "One")]
    bench = [prose(rng, 30), prose(rng, 6), "", None]
    rows += [(410, f"{prose(rng, 60)} {bench[0]} {prose(rng, 60)}"), (411, f"{prose(rng, 900)} {' '.join(bench[0].split()[:13])}"), (412, f"{prose(rng, 20)} {bench[1]}")]
    return [(i, t, "en", None if i % 5 == 0 else "s", None if t is None else len(t)) for i, t in rows], bench


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(8)
    rows, items = corpus(rng)
    rng.shuffle(rows)
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, fields).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not 300 <= i < 400), 0) for i, *_ in rows if i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r[0]: score_by_force(r[1], model) for r in rows}
    assert all(abs(p - 0.3) > 1e-6 for p in scores.values())
    plain = [
        lambda kept: [r for r in kept if scores[r[0]] >= 0.3], lines_gone, near_by_force, lambda kept: clean_by_force(kept, items),
    ]
    want, sizes = rows, [len(rows)]
    for (name, stage), by_force in zip(cp.STAGES, plain):
        want = by_force(want)
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(map(tuple, docs.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0]), name
        sizes.append(len(want))
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes  # every stage has something to take away
    path = public_tokenizers.path("piece_bpe_32k.model")
    search = pieces.Pieces(path)
    ids = {r[0]: search.encode(r[1] or "") for r in want}
    got = {r["doc_id"]: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert got.keys() == ids.keys()
    for r in want:
        row = got[r[0]]
        assert (row["lang"], row["source"], row["n_ids"], list(row["ids"]), row["round_trip"]) == (r[2], r[3], len(ids[r[0]]), ids[r[0]], True)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, row int, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_columns_of_clashing_names_pass_through(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(9)
    names = ["row", "key", "words", "removed", "id", "component", "window", "score", "hits"]
    rows = [(i, prose(rng, 50), "en", "s", *(f"{n}{i}" for n in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that occurs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {(r["doc_id"], *(r[n] for n in names)) for r in out.collect()} <= {(r[0], *r[4:]) for r in rows}
