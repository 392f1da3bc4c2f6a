"""Registered queries of the operators, one each, over whole tables with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.llm import codes, decontaminate, lines, minhash, pieces, quality, repair, simhash, substrings, suffixes, tokenstore, topk, urls
from ragframe.llm.common import own_session, shared_path, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return fn(own_session(spark), root)

    REGISTRY[fn.__name__] = run
    return fn


@query
def op1_token_blocks(spark, root):
    path = shared_path(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    tokenstore.write_tokens(table(spark, root, "documents"), path, tokenizer)
    stored = tokenstore.read_tokens(spark, path)
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_sentencepiece(spark, root):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, root, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    encoded = pieces.encode(docs, model).select("doc_id", "sha", "ids")
    back = pieces.decode(encoded, model)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"),
    )


@query
def op3_url_filters(spark, root):
    return urls.judge(table(spark, root, "pages")).select("page_id", "host", "path", "rule", "verdict")


_HOST_SQL = "translate(regexp_extract(coalesce({u}, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH_SQL = "regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_NODE_SQL = (
    "CASE WHEN instr({u}, '://') > 0 THEN lower(regexp_extract({u}, '^(.*?)://', 1, 's')) || '://' || "
    + _HOST_SQL + " || regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's') END"
)
_RULE_SQL = (
    "(SELECT max_by(r, len(r.host || r.path)) FROM rules r WHERE ({h} = r.host OR ends_with({h}, '.' || r.host)) "
    "AND starts_with({p}, r.path))"
)
ORACLES["op3_url_filters"] = f"""
WITH RECURSIVE rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
tags AS (
  SELECT url, unnest(
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '<link\\b[^>]*>', 0, 'is'),
                               lambda t: regexp_matches(t, '\\brel\\s*=\\s*["'']?canonical\\b', 'is')),
                   lambda t: regexp_extract(t, '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is'))
    || list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '<meta\\b[^>]*>', 0, 'is'),
                                  lambda t: regexp_matches(t, '\\bhttp-equiv\\s*=\\s*["'']?refresh\\b', 'is')),
                      lambda t: regexp_extract(t, '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is'))) AS href
  FROM pages
),
links AS (
  SELECT {_NODE_SQL.format(u="url")} AS s, {_NODE_SQL.format(u="target")} AS t FROM (
    SELECT url, replace(href, '&amp;', '&') AS target FROM tags WHERE href LIKE '%://%')
),
step AS (SELECT s AS a, t AS b FROM links UNION SELECT t, s FROM links),
reach(a, b) AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
blocked AS (
  SELECT DISTINCT a FROM (SELECT a, {_RULE_SQL.format(h=_HOST_SQL.format(u="b"), p=_PATH_SQL.format(u="b"))} AS r FROM reach)
  WHERE r.verdict = 'block'
),
p AS (
  SELECT page_id, {_HOST_SQL.format(u="url")} AS host, {_PATH_SQL.format(u="url")} AS path, {_NODE_SQL.format(u="url")} AS node
  FROM pages
),
j AS (SELECT *, {_RULE_SQL.format(h="p.host", p="p.path")} AS r FROM p)
SELECT page_id, j.host, j.path, r.host || r.path AS rule,
       coalesce(r.verdict, CASE WHEN node IN (SELECT a FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""


@query
def op4_decontaminate(spark, root):
    hits = decontaminate.scan(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLES["op4_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS win
  FROM (SELECT item, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
),
met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN met USING (doc_id)
"""


@query
def op5_substring_dedup(spark, root):
    out = substrings.passages(table(spark, root, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op6_threshold_topk(spark, root):
    vectors = topk.whole_vectors(table(spark, root, "embeddings"))
    found = topk.search(vectors.filter(F.col("id") % topk.EVERY == 0), vectors)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLES["op6_threshold_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_line_dedup(spark, root):
    found = lines.removed_lines(table(spark, root, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


@query
def op8_simhash(spark, root):
    out = simhash.near_duplicates(table(spark, root, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_suffix_dedup(spark, root):
    found = suffixes.repeated_bytes(table(spark, root, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_quality_classifier(spark, root):
    docs = table(spark, root, "documents")
    model = quality.train(docs, table(spark, root, "labels"))
    held = quality.held_out(F.col("doc_id")).alias("held_out")
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")


@query
def op11_vector_codes(spark, root):
    coded, books = codes.compress(table(spark, root, "embeddings"))
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    return codes.label_errors(coded).select(
        "doc.vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    nearest = """
a{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x,
         min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'i': i}}) AS m
  FROM v JOIN b{r} USING (p) GROUP BY vec_id, p
)"""
    mean = """
s{r} AS (SELECT p, m.i AS i, generate_subscripts(x, 1) AS pos, CAST(unnest(x) AS BIGINT) AS x FROM a{r}),
m{r} AS (SELECT p, i, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM s{r} GROUP BY ALL),
f{r} AS (SELECT p, i, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS c FROM m{r} GROUP BY ALL),
b{next} AS MATERIALIZED (SELECT b.p, b.i, coalesce(f.c, b.c) AS c FROM b{r} b LEFT JOIN f{r} f ON f.p = b.p AND f.i = b.i)"""
    steps = [nearest.format(r=0)]
    for r in range(rounds):
        steps += [mean.format(r=r, next=r + 1), nearest.format(r=r + 1)]
    return f"""
WITH w AS (
  SELECT vec_id, label, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS MATERIALIZED (
  SELECT vec_id, label, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS x FROM w, range({parts}) t(p)
),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, x AS c FROM v
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}
),{",".join(steps)},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(m.i AS INTEGER)), '' ORDER BY p) AS code,
         CAST(sum(m.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
),
books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, i, pos)) AS digest
  FROM (SELECT p, i, generate_subscripts(c, 1) AS pos, unnest(c) AS x FROM b{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM coded, books
"""


ORACLES["op11_vector_codes"] = _codes_sql(parts=4, entries=256, rounds=4, scale=1024)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the query repairs, chosen by a checksum of conversation and turn."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = (F.crc32(key) % 20).alias("fault")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), fault)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.filter("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query
def op12_conversation_repair(spark, root):
    rows = table(spark, root, "conversations")
    found = repair.repair_digests(damaged(rows))
    none = hashlib.sha256(b"").hexdigest()
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def _repair_sql() -> str:
    def add(way: str, cost: str, edit: str) -> str:
        return f"(lpad(CAST(CAST({way}[1:8] AS INTEGER) + {cost} AS VARCHAR), 8, '0') || {way}[9:] || '{edit}')"

    gone, cut = "blank OR again", "(CASE WHEN cut THEN 1 ELSE 0 END)"
    def taken(way: str, initial: str) -> str:
        return (f"CASE WHEN {gone} THEN NULL WHEN initial = '{initial}' THEN {add(way, cut, 'K')} "
                f"ELSE {add(way, '2 + ' + cut, 'R')} END")

    inserted = ", ".join([
        "w0", "w1", f"least(w2, {add('w0', '2', 'I')}, {add('w1', '2', 'I')}, {add('w3', '2', 'I')}) AS i2", "w3"])
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS fault
  FROM conversations, bits
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(2) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, substr(role, 1, 1) AS initial
  FROM damaged
),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed),
r AS MATERIALIZED (
  SELECT *, seen AND NOT blank AS again, NOT blank AND NOT seen AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM marked
),
way(conv_id, i, w0, w1, w2, w3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '00000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM r
  UNION ALL
  SELECT conv_id, i,
         {add('w0', '3', 'D')},
         least({add('w1', '3', 'D')}, CASE WHEN initial = 's' AND NOT ({gone}) THEN {add('w0', cut, 'K')} END),
         least({add('i2', '3', 'D')}, {taken('w0', 'u')}, {taken('w1', 'u')}, {taken('i3', 'u')}),
         least({add('i3', '3', 'D')}, {taken('i2', 'a')})
  FROM (
    SELECT *, least(w3, {add('i2', '2', 'I')}) AS i3 FROM (
      SELECT r.conv_id, r.i, initial, blank, again, cut, {inserted}
      FROM way JOIN r ON r.conv_id IS NOT DISTINCT FROM way.conv_id AND r.i = way.i + 1)
  )
),
best AS (
  SELECT conv_id, least(w0, w3, {add('i2', '2', 'I')}) AS w FROM (
    SELECT way.conv_id, {inserted} FROM way JOIN (SELECT DISTINCT conv_id, n FROM r) e
      ON e.conv_id IS NOT DISTINCT FROM way.conv_id AND e.n = way.i)
),
steps AS (
  SELECT conv_id, j, w[8 + j] AS edit, CAST(len(replace(w[9 : 8 + j], 'I', '')) AS BIGINT) AS i
  FROM (SELECT *, unnest(range(1, len(w) - 7)) AS j FROM best)
),
lines AS (
  SELECT s.conv_id, s.j, s.edit, CASE WHEN s.edit = 'I' THEN '' ELSE r.text END AS text, r.role,
         row_number() OVER (PARTITION BY s.conv_id ORDER BY s.j) AS k
  FROM steps s LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE s.edit <> 'D'
),
shaped AS (
  SELECT *, k - CAST(max(CASE WHEN k = 1 AND edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS p FROM lines
),
mended AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN p % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS body
  FROM shaped GROUP BY conv_id
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w[1:8], '0') AS BIGINT) AS cost,
       coalesce(w[9:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended ON mended.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLES["op12_conversation_repair"] = _repair_sql()


@query
def op13_minhash(spark, root):
    out = minhash.near_duplicates(table(spark, root, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op13_minhash"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(sh) AS h, sh FROM (
    SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS sh
    FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
  )
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL
  ) c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.c >= 85 * (p.n + q.n - c.c)
),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON s.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""
