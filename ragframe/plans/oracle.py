"""SQL for the registered queries, written for DuckDB over the same tables.

The definitions are stated a second time and another way (windows and recursive queries where the
Spark side uses folds, patterns and kernels), so that an error has to be made twice to pass.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# ---- fixed values, stated again so that a wrong one in the library shows -------------------------
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
EVAL_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her hers him his how i if in "
    "into is it its me my no not of on or our ours out over she so than that the their theirs them then there these "
    "they this those to too up us was we were what when where which who why will with would you your yours"
).split()
ANSWER_WORDS = [*EVAL_WORDS, "here", "yes"]
HTTP_LADDER = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
AI_LADDER = [0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60]
JOB_LADDER = [0.01, 0.05, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 300]
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
CONTEXT_BUDGET = 1200
FOLLOW_UP = (
    r"(?i)\b(what about|how about|whats with|what's with|and then|and the|and why|what is that|is that|are those|these|"
    r"those|them|they|it this|it that|same thing|same rule|same policy|and|about that|on that)\b"
)
PRONOUNS = r"(?i)\b(it|this|that|those|them|they|these)\b"
PROMPT = (
    "Answer only from the numbered context passages. Cite every claim as [n]. "
    "If the passages do not hold the answer, reply exactly: \"I don''t know.\""
)
# -------------------------------------------------------------------------------------------------

WS = "[" + "".join(f"\\x{{{c:x}}}" for c in SPACES) + "]"
WSC = "concat(" + ",".join(f"chr({c})" for c in SPACES) + ")"
STOP = "[" + ",".join(f"'{w}'" for w in ANSWER_WORDS) + "]"
EVAL_STOP = "[" + ",".join(f"'{w}'" for w in EVAL_WORDS) + "]"
NL = "chr(10)"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def trim(s: str) -> str:
    return f"trim({s}, (SELECT c FROM wsc))"


def words(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '{WS}+'), lambda x: x <> '')"


def tok(s: str) -> str:
    return f"regexp_extract_all(lower({s}), '[a-z0-9'']+')"


def ctok(s: str, stop: str = STOP) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({s}), '[0-9a-z][0-9a-z''-]*'), "
        f"lambda t: length(t) >= 3 AND NOT list_contains({stop}, t)))"
    )


def ectok(s: str) -> str:
    return ctok(f"regexp_replace({s}, '\\[\\d+\\]', '', 'g')", EVAL_STOP)


def est(s: str) -> str:
    return f"greatest(1, (length({s}) + 3) // 4)"


def word_est(s: str) -> str:
    t = trim(s)
    return f"CASE WHEN {s} = '' THEN 0 ELSE greatest(1, ceil(len(regexp_split_to_array({t}, '{WS}+')) * 1.3::DOUBLE)::INT) END"


def sentences(s: str) -> str:
    flat = f"replace({s}, {NL}, ' ')"
    cut = f"string_split(regexp_replace({flat}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: trim(x, {WSC})), lambda x: x <> '')"


def normalize(s: str) -> str:
    a = f"regexp_replace({s}, '[ \\t\\x{{a0}}\\f\\x{{0b}}]+', ' ', 'g')"
    b = f"regexp_replace({a}, ' *\\n *', {NL}, 'g')"
    return trim(f"regexp_replace({b}, '\\n{{3,}}', {NL} || {NL}, 'g')")


def fold(s: str) -> str:
    return trim(f"regexp_replace({s}, '{WS}+', ' ', 'g')")


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


WSC_CTE = f"wsc AS (SELECT {WSC} AS c)"
DOCS = """docs AS (SELECT doc_id AS document_id, source AS organization_id, concat('u', doc_id % 3) AS uploaded_by,
 concat(source, ' note ', doc_id) AS title,
 concat('note-', doc_id, '.', CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'md' WHEN 3 THEN 'html' ELSE 'txt' END) AS filename,
 CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'md' WHEN 3 THEN 'html' ELSE 'txt' END AS source_type,
 n_chars AS size,
 CASE doc_id % 11 WHEN 8 THEN 'queued' WHEN 9 THEN 'processing' WHEN 10 THEN 'failed' ELSE 'ready' END AS status,
 CASE WHEN doc_id % 11 >= 8 THEN 'none' WHEN doc_id % 7 = 5 THEN 'processing' WHEN doc_id % 7 = 6 THEN 'failed' ELSE 'ready' END AS embedding_status,
 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, text FROM documents)"""
REQUESTS = """requests AS (SELECT event_id, ts, user_id AS client, CASE event_type WHEN 'view' THEN 'GET' ELSE 'POST' END AS method,
 concat('/api/v1/documents/', user_id) AS path, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS status,
 value / 100.0 AS seconds, event_type AS operation, props FROM events)"""
MESSAGES = "messages AS (SELECT conv_id AS conversation_id, turn + 1 AS position, role, text AS content FROM conversations)"
GOLDENS = """goldens AS (SELECT b.item_id, b.text AS expected_answer, d.doc_id AS expected_document
 FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"


def pages(limit: int = 1 << 30) -> str:
    heading = (
        "line <> '' AND length(line) <= 60 AND NOT regexp_matches(line, '[.!?:;]$') AND regexp_matches(coalesce(nxt, ''), '^[A-Z]')"
    )
    return f"""lines AS MATERIALIZED (SELECT document_id, organization_id, raw, {trim('raw')} AS line, i FROM
  (SELECT document_id, organization_id, unnest(string_split(text, {NL})) AS raw, generate_subscripts(string_split(text, {NL}), 1) - 1 AS i FROM docs)),
outline AS MATERIALIZED (SELECT document_id, (i // 8 + 1)::INT AS page_number, i AS ord, line AS title FROM
  (SELECT *, lead(line) OVER (PARTITION BY document_id ORDER BY i) AS nxt FROM lines) WHERE {heading}),
all_pages AS MATERIALIZED (SELECT document_id, organization_id, page_number, {normalize('raw')} AS content FROM
  (SELECT document_id, organization_id, (i // 8 + 1)::INT AS page_number, string_agg(raw, {NL} ORDER BY i) AS raw FROM lines GROUP BY ALL)),
pgs AS MATERIALIZED (SELECT p.document_id, p.organization_id, p.page_number, p.content, arg_max(o.title, o.ord) AS section
  FROM all_pages p LEFT JOIN outline o ON o.document_id = p.document_id AND o.page_number <= p.page_number
  WHERE p.content <> '' AND p.page_number <= {limit} GROUP BY ALL)"""


BASE = [WSC_CTE, DOCS, pages()]

WORDS = f"""wd AS MATERIALIZED (SELECT document_id, page_number, w, row_number() OVER (PARTITION BY document_id ORDER BY page_number, j) AS i FROM
  (SELECT document_id, page_number, unnest({words('content')}) AS w, generate_subscripts({words('content')}, 1) AS j FROM pgs)),
we AS MATERIALIZED (SELECT *, (sum(length(w) + 1) OVER (PARTITION BY document_id ORDER BY i))::BIGINT AS e FROM wd)"""


def greedy(budget: int, src: str = "we", out: str = "cut") -> str:
    """Recursive greedy packing: from each start, the first unit that no longer fits starts anew."""
    return f"""{out} AS (SELECT document_id, 0 AS chunk_index, 1::BIGINT AS s, 0::BIGINT AS b FROM {src} WHERE i = 1
  UNION ALL SELECT c.document_id, c.chunk_index + 1, min(u.i), min(u.e - length(u.w) - 1)
  FROM {out} c JOIN {src} u ON u.document_id = c.document_id AND u.i > c.s AND u.e - 1 - c.b > {budget} GROUP BY c.document_id, c.chunk_index)"""


def placed(span: str, sections: str = "pgs") -> str:
    """Chunk rows from spans (document_id, chunk_index, s, t) of word numbers, t exclusive or null."""
    return f"""placed AS MATERIALIZED (SELECT s.document_id, s.chunk_index, string_agg(w.w, ' ' ORDER BY w.i) AS content,
  min(w.page_number) AS page_start, max(w.page_number) AS page_end
  FROM {span} s JOIN we w ON w.document_id = s.document_id AND w.i >= s.s AND (s.t IS NULL OR w.i < s.t) GROUP BY s.document_id, s.chunk_index),
chunks AS MATERIALIZED (SELECT c.document_id, c.chunk_index, any_value(c.page_start) AS page_number, any_value(c.content) AS content,
  {est('any_value(c.content)')} AS token_count, any_value(c.page_start) AS page_start, any_value(c.page_end) AS page_end,
  arg_min(p.section, p.page_number) FILTER (WHERE p.section IS NOT NULL AND p.section <> '') AS section
  FROM placed c LEFT JOIN {sections} p ON p.document_id = c.document_id AND p.page_number BETWEEN c.page_start AND c.page_end
  GROUP BY c.document_id, c.chunk_index)"""


def fixed(chars: int = 2048, sections: str = "pgs") -> list[str]:
    return BASE + [
        WORDS, greedy(chars),
        "span AS (SELECT *, lead(s) OVER (PARTITION BY document_id ORDER BY chunk_index) AS t FROM cut)",
        placed("span", sections),
    ]


CHUNK_OUT = "SELECT document_id, chunk_index, page_number, content, token_count, section, page_start, page_end FROM chunks"


def hashed(src: str, keys: str, text: str, name: str) -> str:
    """Sparse hash vectors of ``src`` rows as (keys, slot, q) in {name}."""
    return f"""{name}_t AS (SELECT {keys}, unnest({tok(text)}) AS t FROM {src}),
{name}_h AS MATERIALIZED (SELECT t, sha256(t) AS h FROM (SELECT DISTINCT t FROM {name}_t)),
{name}_c AS MATERIALIZED (SELECT {keys}, slot, sum(sg)::BIGINT AS s FROM (SELECT {keys}, (('0x' || substr(h, 1, 8))::BIGINT % 384)::INT AS slot,
  CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sg FROM {name}_t JOIN {name}_h USING (t)) GROUP BY ALL HAVING sum(sg) <> 0),
{name}_n AS (SELECT {keys}, sqrt(sum(s * s)::DOUBLE) AS n FROM {name}_c GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, slot, round(s / n * 1000000)::BIGINT AS q FROM {name}_c JOIN {name}_n USING ({keys}) WHERE round(s / n * 1000000) <> 0)"""


VEC = hashed("chunks", "document_id, chunk_index", "content", "vec")
QVEC = hashed("questions", "query_id", "question", "qv")
# every (query, chunk) pair with its exact dot product and cosine
SCORES = """ids AS (SELECT document_id, chunk_index FROM chunks),
dots AS MATERIALIZED (SELECT query_id, document_id, chunk_index, sum(a.q * b.q)::BIGINT AS dot FROM qv a JOIN vec b USING (slot) GROUP BY ALL),
qn AS (SELECT query_id, sum(q * q)::DOUBLE AS n FROM qv GROUP BY ALL),
cn AS (SELECT document_id, chunk_index, sum(q * q)::DOUBLE AS n FROM vec GROUP BY ALL),
scores AS MATERIALIZED (SELECT q.query_id, i.document_id, i.chunk_index, coalesce(d.dot, 0) AS dot,
  CASE WHEN coalesce(qn.n, 0) = 0 OR coalesce(cn.n, 0) = 0 THEN 0.0 ELSE coalesce(d.dot, 0)::DOUBLE / (sqrt(cn.n) * sqrt(qn.n)) END AS cos
  FROM (SELECT query_id FROM questions) q CROSS JOIN ids i LEFT JOIN dots d USING (query_id, document_id, chunk_index)
  LEFT JOIN qn USING (query_id) LEFT JOIN cn ON cn.document_id = i.document_id AND cn.chunk_index = i.chunk_index)"""


def search(k: int = 5, floor: float | None = None) -> str:
    where = f"WHERE cos >= {floor}" if floor else ""
    return f"""hits AS MATERIALIZED (SELECT query_id, document_id, chunk_index, cos, round(cos, 6) AS similarity, rank::INT AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM scores {where}) WHERE rank <= {k})"""


def corpus(k: int = 5, floor: float | None = None, chars: int = 2048) -> list[str]:
    return fixed(chars) + [QUESTIONS, VEC, QVEC, SCORES, search(k, floor)]


def context(budget: int = CONTEXT_BUDGET) -> str:
    """The greedy budget by recursion over ranks: the first stays, later ones enter where they fit."""
    return f"""cand AS MATERIALIZED (SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY greatest(0.0, least(1.0, h.similarity)) DESC, h.rank) AS r,
  greatest(0.0, least(1.0, h.similarity)) AS similarity, h.document_id, h.chunk_index, c.content AS text, c.page_number AS page, c.section, c.token_count AS cost
  FROM hits h JOIN chunks c USING (document_id, chunk_index)),
walk AS (SELECT query_id, r, cost AS used, true AS kept FROM cand WHERE r = 1
  UNION ALL SELECT c.query_id, c.r, CASE WHEN w.used + c.cost <= {budget} THEN w.used + c.cost ELSE w.used END, w.used + c.cost <= {budget}
  FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.r = w.r + 1),
ctx AS MATERIALIZED (SELECT c.*, (row_number() OVER (PARTITION BY c.query_id ORDER BY c.r) - 1)::INT AS pos FROM cand c JOIN walk w USING (query_id, r) WHERE w.kept)"""


def answers(min_score: float | None = None) -> str:
    low = f"WHEN top < {min_score} THEN 'low_similarity'" if min_score else ""
    return f"""qt AS MATERIALIZED (SELECT query_id, question, {ctok('question')} AS qt FROM questions),
sent AS (SELECT query_id, pos, unnest({sentences('text')}) AS s, generate_subscripts({sentences('text')}, 1) AS sp FROM ctx),
ratio AS MATERIALIZED (SELECT s.query_id, s.pos, s.sp, s.s, CASE WHEN len(q.qt) = 0 THEN 0.0 ELSE len(list_intersect(q.qt, {ctok('s.s')})) / len(q.qt)::DOUBLE END AS r
  FROM sent s JOIN qt q USING (query_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, pos, sp) AS n FROM ratio WHERE r > 0) WHERE n = 1),
facts AS (SELECT query_id, count(*) AS n, max(similarity) AS top, bool_or(len({ctok('text')}) > 0) AS meaty FROM ctx GROUP BY query_id),
verdict AS (SELECT q.query_id, q.question, CASE WHEN coalesce(f.n, 0) = 0 THEN 'no_context' {low} WHEN NOT f.meaty THEN 'no_content' WHEN b.query_id IS NULL THEN 'no_overlap' END AS reason,
  b.pos, b.s, b.r FROM qt q LEFT JOIN facts f USING (query_id) LEFT JOIN best b USING (query_id)),
answers AS MATERIALIZED (SELECT v.query_id, v.question, v.reason, v.reason IS NOT NULL AS refused,
  CASE WHEN v.reason IS NULL THEN concat(v.s, ' [', v.pos + 1, ']') ELSE 'I don''t know.' END AS answer,
  CASE WHEN v.reason IS NULL THEN v.s END AS quote, CASE WHEN v.reason IS NULL THEN v.r END AS overlap,
  CASE WHEN v.reason IS NULL THEN v.pos END AS evidence_index, CASE WHEN v.reason IS NULL THEN v.pos + 1 END AS citation,
  CASE WHEN v.reason IS NULL THEN c.document_id END AS document_id, CASE WHEN v.reason IS NULL THEN c.chunk_index END AS chunk_index,
  CASE WHEN v.reason IS NULL THEN c.page END AS page, CASE WHEN v.reason IS NULL THEN c.similarity END AS similarity
  FROM verdict v LEFT JOIN ctx c ON c.query_id = v.query_id AND c.pos = v.pos)"""


RENDER = f"""concat('[', pos + 1, ']', CASE WHEN page IS NOT NULL OR coalesce(section, '') <> '' THEN
  concat(' (', concat_ws(', ', 'page ' || page, CASE WHEN coalesce(section, '') <> '' THEN concat('section "', section, '"') END), ')') ELSE '' END, ' ', text)"""
RENDERED = f"rendered AS (SELECT query_id, string_agg({RENDER}, {NL} || {NL} ORDER BY pos) AS rendered FROM ctx GROUP BY query_id)"

RESOLVED = f"""resolved AS MATERIALIZED (SELECT g.item_id, g.expected_document, any_value(g.expected_answer) AS expected_answer, min(p.page_number) AS expected_page FROM goldens g
  LEFT JOIN pgs p ON p.document_id = g.expected_document AND contains({fold('p.content')}, {fold('g.expected_answer')}) GROUP BY g.item_id, g.expected_document)"""

# ---- sources and sinks
ORACLES["scan_documents"] = with_(DOCS) + """SELECT document_id, organization_id, uploaded_by, title, filename, source_type, size, status, embedding_status,
 epoch(created_at)::BIGINT AS created_s FROM docs"""
ORACLES["admit_files"] = with_(DOCS, WSC_CTE, f"""up AS (SELECT document_id, concat('C:\\up/', CASE WHEN document_id % 13 = 0 THEN '...' ELSE concat('..', filename) END, CASE WHEN document_id % 17 = 0 THEN '.exe' ELSE '' END) AS raw,
 CASE WHEN source_type = 'pdf' AND document_id % 2 = 0 THEN '%PDF-1.7 ' WHEN source_type = 'docx' AND document_id % 3 = 0 THEN concat('PK', chr(3), chr(4)) WHEN document_id % 7 = 0 THEN concat('a', chr(0), 'b') ELSE '' END AS head, text FROM docs),
 safe AS (SELECT document_id, {trim("regexp_replace(list_last(regexp_split_to_array(raw, '[\\\\/]')), '^\\.+', '')")} AS filename, concat(head, text) AS content FROM up),
 typed AS (SELECT *, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS kind, strlen(content) AS bytes FROM safe),
 judged AS (SELECT *, CASE WHEN filename = '' OR length(filename) > 255 THEN 'INVALID_FILENAME' WHEN kind NOT IN ('pdf', 'docx', 'md', 'html', 'txt') THEN 'UNSUPPORTED_FILE_TYPE'
  WHEN bytes = 0 THEN 'EMPTY_FILE' WHEN bytes > 20000 THEN 'FILE_TOO_LARGE' WHEN kind = 'pdf' AND NOT starts_with(content, '%PDF-') THEN 'FILE_TYPE_MISMATCH'
  WHEN kind = 'docx' AND NOT starts_with(content, concat('PK', chr(3), chr(4))) THEN 'FILE_TYPE_MISMATCH'
  WHEN kind IN ('md', 'html', 'txt') AND contains(content, chr(0)) THEN 'FILE_TYPE_MISMATCH' END AS error FROM typed)""") + """SELECT document_id, filename, regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1') AS title, CASE WHEN error IS NULL THEN kind END AS source_type,
 CASE WHEN error IS NULL THEN CASE kind WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html' ELSE 'text/plain' END END AS mime_type, error FROM judged"""
ORACLES["upsert_embeddings"] = with_(DOCS) + """SELECT document_id, 'hash-384' AS model, CASE WHEN embedding_status = 'ready' THEN 1 ELSE 2 END AS version,
 length(text) * CASE WHEN embedding_status = 'ready' THEN 1 ELSE 2 END AS payload FROM docs WHERE embedding_status <> 'none'"""
ORACLES["ensure_jobs"] = with_(DOCS) + "SELECT document_id, 'embed' AS kind FROM docs WHERE status <> 'ready'"
ORACLES["scan_raw_files"] = "SELECT source AS organization_id, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY source"
ORACLES["report_round_trip"] = with_(DOCS) + "SELECT organization_id, source_type, count(*) AS documents, sum(size)::BIGINT AS size FROM docs GROUP BY ALL"
ORACLES["upsert_repeated_embeddings"] = with_(DOCS) + """SELECT document_id, 'hash-384' AS model, v AS version, (length(text) * v)::BIGINT AS payload
 FROM (SELECT *, CASE embedding_status WHEN 'ready' THEN 1 WHEN 'processing' THEN 2 ELSE 3 END AS v FROM docs WHERE embedding_status IN ('ready', 'processing', 'failed'))"""
ORACLES["publishable_documents"] = with_(*fixed(), f"ok AS (SELECT document_id, len({tok('content')}) > 0 AND token_count <= 510 AS good FROM chunks)") + """SELECT d.document_id, count(good) AS rows, count(*) FILTER (WHERE NOT good) AS bad_rows, coalesce(bool_and(good), false) AS publish FROM docs d LEFT JOIN ok USING (document_id) GROUP BY d.document_id"""

JOBS = """jobs AS (SELECT document_id, organization_id, kind, st AS status, CASE WHEN st = 'queued' THEN 0 WHEN st = 'failed' THEN document_id % 4 + 1 ELSE 1 END AS attempts, 3 AS max_attempts,
 CASE WHEN st = 'failed' THEN ['pdf extraction failed: bad header', 'connection reset', 'model said 400, not retryable', 'retries exhausted after 3'][document_id % 4 + 1] END AS error,
 created_at AS enqueued_at, CASE WHEN st <> 'queued' THEN created_at + to_seconds(document_id % 17) END AS started_at,
 CASE WHEN st IN ('succeeded', 'failed') THEN created_at + to_seconds(document_id % 17) + to_milliseconds(size // 100) END AS finished_at
 FROM (SELECT *, 'process' AS kind, CASE status WHEN 'ready' THEN 'succeeded' ELSE status END AS st FROM docs
  UNION ALL SELECT *, 'embed', CASE embedding_status WHEN 'ready' THEN 'succeeded' ELSE embedding_status END FROM docs WHERE status = 'ready'))"""
ORACLES["cascade_delete"] = with_(*fixed(), JOBS) + """SELECT child, count(*) FILTER (WHERE status <> 'failed') AS rows FROM (
 SELECT 'documents' AS child, document_id FROM docs UNION ALL SELECT 'document_pages', document_id FROM pgs UNION ALL SELECT 'chunks', document_id FROM chunks UNION ALL SELECT 'ingestion_jobs', document_id FROM jobs) JOIN docs USING (document_id) GROUP BY child"""
ORACLES["orphan_audit"] = with_(*fixed(), JOBS) + """SELECT child, count(*) FILTER (WHERE status = 'failed') AS orphans FROM (
 SELECT 'document_pages' AS child, document_id FROM pgs UNION ALL SELECT 'chunks', document_id FROM chunks UNION ALL SELECT 'ingestion_jobs', document_id FROM jobs) JOIN docs USING (document_id) GROUP BY child"""

# ---- text
ORACLES["normalize_text"] = with_(WSC_CTE) + f"SELECT doc_id AS document_id, {normalize('text')} AS normalized FROM documents"
ORACLES["estimate_tokens"] = with_(WSC_CTE) + f"SELECT doc_id AS document_id, {est('text')} AS tokens, {word_est('text')} AS word_tokens FROM documents"
ORACLES["assemble_pages"] = with_(*BASE) + f"SELECT document_id, page_number, content, {est('content')} AS token_count, section, concat('s3://', organization_id, '/', document_id) AS source FROM pgs"
ORACLES["extraction_summary"] = with_(*BASE) + f"""SELECT d.document_id, any_value(r.n) AS raw_pages, count(p.page_number) AS pages, any_value(r.n) - count(p.page_number) AS blank_pages,
 coalesce(sum({est('p.content')}) FILTER (WHERE p.content IS NOT NULL), 0)::BIGINT AS total_tokens, count(p.page_number) = 0 AS empty, false AS truncated
 FROM docs d LEFT JOIN pgs p USING (document_id) LEFT JOIN (SELECT document_id, max(page_number) AS n FROM all_pages GROUP BY 1) r USING (document_id) GROUP BY d.document_id"""
ORACLES["section_fill"] = with_(*BASE) + "SELECT document_id, page_number, section FROM pgs"
ORACLES["html_outline"] = with_(WSC_CTE, """h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS raw, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>'), 1) - 1 AS ord FROM pages)""") + f"""SELECT page_id, ord, substr(raw, 3, 1)::INT AS level, {fold("regexp_replace(raw, '<[^>]*>', ' ', 'g')")} AS title FROM h"""
PARAGRAPHS = f"""pl AS (SELECT document_id, page_number, i, {trim('l')} AS l FROM (SELECT document_id, page_number, unnest(string_split(content, {NL})) AS l, generate_subscripts(string_split(content, {NL}), 1) AS i FROM pgs)),
pf AS (SELECT *, lag(l) OVER w AS prv, lead(l) OVER w AS nxt FROM pl WHERE l <> '' WINDOW w AS (PARTITION BY document_id, page_number ORDER BY i)),
pb AS (SELECT *, sum(CASE WHEN prv IS NULL OR regexp_matches(prv, '[.!?:;]$') OR (length(l) <= 60 AND NOT regexp_matches(l, '[.!?:;]$') AND regexp_matches(coalesce(nxt, ''), '^[A-Z]')) THEN 1 ELSE 0 END)
  OVER (PARTITION BY document_id, page_number ORDER BY i) AS g FROM pf),
paras AS MATERIALIZED (SELECT document_id, page_number, (g - 1)::INT AS pos, string_agg(l, ' ' ORDER BY i) AS paragraph FROM pb GROUP BY ALL)"""
ORACLES["split_paragraphs"] = with_(*BASE, PARAGRAPHS) + "SELECT document_id, page_number, pos, paragraph FROM paras"
ORACLES["sentences"] = with_(WSC_CTE) + f"SELECT doc_id AS document_id, unnest({sentences('text')}) AS sentence, generate_subscripts({sentences('text')}, 1) - 1 AS pos FROM documents"
ORACLES["tokenize"] = f"SELECT doc_id AS document_id, array_to_string({tok('text')}, ' ') AS tokens, len({tok('text')}) AS n FROM documents"
ORACLES["content_tokens"] = f"SELECT doc_id AS document_id, array_to_string(list_sort({ctok('text')}), ' ') AS tokens, array_to_string(list_sort({ectok('text')}), ' ') AS eval_tokens FROM documents"
ORACLES["slugify"] = "SELECT doc_id AS document_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'org') AS slug FROM documents"
ORACLES["sanitize_filename"] = with_(WSC_CTE, DOCS, """named AS (SELECT document_id, concat(repeat('.', (document_id % 3)::INT), ' note ', document_id, '.Tar.', upper(source_type)) AS base FROM docs)""",
    f"safe AS (SELECT document_id, {trim("regexp_replace(base, '^\\.+', '')")} AS safe FROM named)") + """SELECT document_id, safe, lower(regexp_extract(safe, '\\.[^.]*$')) AS extension, regexp_replace(safe, '\\.[^.]*$', '') AS title FROM safe"""
ORACLES["normalize_route"] = with_(REQUESTS) + """SELECT CASE event_id % 5 WHEN 0 THEN 'unmatched' WHEN 1 THEN '/api/v1/documents/:id/pages/:id' WHEN 2 THEN '/api/v1/documents/:id/:id/chunks'
 WHEN 3 THEN concat('/api/v1/documents/:id/x', md5(event_id::VARCHAR)) ELSE '/api/v1/documents/:id' END AS route, count(*) AS requests FROM requests GROUP BY 1"""

# ---- chunking
ORACLES["chunk_fixed"] = with_(*fixed(512)) + CHUNK_OUT
ORACLES["chunk_token"] = with_(*fixed(2048)) + CHUNK_OUT
def windows(budget: int, overlap: int, n: str = "") -> list[str]:
    """Overlapping windows as spans of word numbers in span{n}, found window after window."""
    return [f"""win{n} AS (SELECT document_id, 0 AS chunk_index, 1::BIGINT AS s, 0::BIGINT AS b FROM we WHERE i = 1
 UNION ALL SELECT n.document_id, n.chunk_index, n.s, y.e - length(y.w) - 1 FROM
  (SELECT h.document_id, h.chunk_index + 1 AS chunk_index, greatest(h.s + 1, coalesce(min(x.i), h.stop - 1)) AS s FROM
   (SELECT c.document_id, c.chunk_index, c.s, min(u.i) AS stop, min(u.e - length(u.w) - 1) AS full_e FROM win{n} c JOIN we u ON u.document_id = c.document_id AND u.i > c.s AND u.e - 1 - c.b > {budget} GROUP BY ALL) h
   LEFT JOIN we x ON x.document_id = h.document_id AND x.i > h.s AND x.i < h.stop AND h.full_e - 1 - (x.e - length(x.w) - 1) <= {overlap} GROUP BY h.document_id, h.chunk_index, h.s, h.stop) n
  JOIN we y ON y.document_id = n.document_id AND y.i = n.s)""",
  f"span{n} AS (SELECT c.document_id, c.chunk_index, c.s, min(u.i) AS t FROM win{n} c LEFT JOIN we u ON u.document_id = c.document_id AND u.i > c.s AND u.e - 1 - c.b > {budget} GROUP BY c.document_id, c.chunk_index, c.s)"]


ORACLES["chunk_overlap"] = with_(*BASE, WORDS, *windows(2048, 512), placed("span")) + CHUNK_OUT
def packed_paragraphs(budget: int, n: str = "") -> list[str]:
    """Units in ue{n} (paragraphs, or pieces of one over the budget) and their spans in pspan{n}."""
    return [f"""long_w{n} AS (SELECT document_id, page_number, pos, w, row_number() OVER (PARTITION BY document_id, page_number, pos ORDER BY j) AS i FROM
  (SELECT document_id, page_number, pos, unnest({words('paragraph')}) AS w, generate_subscripts({words('paragraph')}, 1) AS j FROM paras WHERE length(paragraph) > {budget})),
lw{n} AS MATERIALIZED (SELECT concat_ws('/', document_id, page_number, pos) AS document_id, document_id AS d, page_number, pos, w, i, (sum(length(w) + 1) OVER (PARTITION BY document_id, page_number, pos ORDER BY i))::BIGINT AS e FROM long_w{n})""",
  greedy(budget, f"lw{n}", f"lcut{n}"),
  f"lspan{n} AS (SELECT *, lead(s) OVER (PARTITION BY document_id ORDER BY chunk_index) AS t FROM lcut{n})",
  f"""units{n} AS (SELECT w.d AS document_id, w.page_number, w.pos, s.chunk_index AS piece, string_agg(w.w, ' ' ORDER BY w.i) AS text, true AS solo FROM lspan{n} s JOIN lw{n} w ON w.document_id = s.document_id AND w.i >= s.s AND (s.t IS NULL OR w.i < s.t) GROUP BY ALL
  UNION ALL SELECT document_id, page_number, pos, 0, paragraph, false FROM paras WHERE length(paragraph) <= {budget}),
un{n} AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, pos, piece) AS i FROM units{n}),
ue{n} AS MATERIALIZED (SELECT *, (sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY i))::BIGINT AS e, solo OR coalesce(lag(solo) OVER (PARTITION BY document_id ORDER BY i), false) AS wall FROM un{n}),
pcut{n} AS (SELECT document_id, 0 AS chunk_index, 1::BIGINT AS s, 0::BIGINT AS b FROM ue{n} WHERE i = 1
  UNION ALL SELECT c.document_id, c.chunk_index + 1, min(u.i), min(u.e - length(u.text) - 2) FROM pcut{n} c JOIN ue{n} u ON u.document_id = c.document_id AND u.i > c.s AND (u.wall OR u.e - 2 - c.b > {budget}) GROUP BY c.document_id, c.chunk_index),
pspan{n} AS (SELECT *, lead(s) OVER (PARTITION BY document_id ORDER BY chunk_index) AS t FROM pcut{n})"""]


_PLACED_PARAGRAPHS = f"""placed AS (SELECT s.document_id, s.chunk_index, {trim("string_agg(u.text, chr(10) || chr(10) ORDER BY u.i)")} AS content, min(u.page_number) AS page_start, max(u.page_number) AS page_end
  FROM pspan s JOIN ue u ON u.document_id = s.document_id AND u.i >= s.s AND (s.t IS NULL OR u.i < s.t) GROUP BY s.document_id, s.chunk_index),
chunks AS (SELECT c.document_id, c.chunk_index, any_value(c.page_start) AS page_number, any_value(c.content) AS content, {est('any_value(c.content)')} AS token_count, any_value(c.page_start) AS page_start, any_value(c.page_end) AS page_end,
  arg_min(p.section, p.page_number) FILTER (WHERE p.section IS NOT NULL AND p.section <> '') AS section
  FROM placed c LEFT JOIN pgs p ON p.document_id = c.document_id AND p.page_number BETWEEN c.page_start AND c.page_end GROUP BY c.document_id, c.chunk_index)"""
ORACLES["chunk_paragraph"] = with_(*BASE, PARAGRAPHS, *packed_paragraphs(512), _PLACED_PARAGRAPHS) + CHUNK_OUT


def _measured(label: str, chunks: str, repeated: str) -> str:
    """A line of the report from chunks(len, ps, pe)."""
    return f"""SELECT '{label}' AS config, count(*) AS chunks, sum({"greatest(1, (len + 3) // 4)"})::BIGINT AS tokens, max(greatest(1, (len + 3) // 4)) AS max_tokens,
 round(avg((pe - ps + 1)::DOUBLE), 6) AS mean_span, {repeated} AS redundant_tokens FROM {chunks}"""


def _word_report(label: str, n: str, spans: list[str]) -> tuple[list[str], str]:
    shaped = f"""rep{n} AS (SELECT s.document_id, s.chunk_index, (sum(length(w.w) + 1) - 1)::BIGINT AS len, min(w.page_number) AS ps, max(w.page_number) AS pe
 FROM span{n} s JOIN we w ON w.document_id = s.document_id AND w.i >= s.s AND (s.t IS NULL OR w.i < s.t) GROUP BY ALL)"""
    return [*spans, shaped], _measured(label, f"rep{n}", "((sum(len + 1) - (SELECT sum(length(w) + 1) FROM we) + 3) // 4)::BIGINT")


def _greedy_report(label: str, n: str, budget: int) -> tuple[list[str], str]:
    cut = [greedy(budget, "we", f"cut{n}"), f"span{n} AS (SELECT *, lead(s) OVER (PARTITION BY document_id ORDER BY chunk_index) AS t FROM cut{n})"]
    return _word_report(label, n, cut)


def _paragraph_report(label: str, n: str, budget: int) -> tuple[list[str], str]:
    shaped = f"""rep{n} AS (SELECT s.document_id, s.chunk_index, (sum(length(u.text) + 2) - 2)::BIGINT AS len, min(u.page_number) AS ps, max(u.page_number) AS pe
 FROM pspan{n} s JOIN ue{n} u ON u.document_id = s.document_id AND u.i >= s.s AND (s.t IS NULL OR u.i < s.t) GROUP BY ALL)"""
    return [*packed_paragraphs(budget, n), shaped], _measured(label, f"rep{n}", "0::BIGINT")


_REPORTS = [
    _paragraph_report("paragraph 512", "1", 2048), _paragraph_report("paragraph 256", "2", 1024), _paragraph_report("paragraph 128", "3", 512),
    _greedy_report("token 256", "4", 1024), _greedy_report("token 128", "5", 512), _greedy_report("token 64", "6", 256),
    _word_report("overlap 256/128", "7", windows(1024, 512, "7")), _word_report("overlap 256/32", "8", windows(1024, 128, "8")),
    _word_report("overlap 128/32", "9", windows(512, 128, "9")), _greedy_report("fixed 512 chars", "10", 512),
    _greedy_report("fixed 1024 chars", "11", 1024), _greedy_report("token 512", "12", 2048),
]
ORACLES["chunking_report"] = with_(*BASE, WORDS, PARAGRAPHS, *[part for parts, _ in _REPORTS for part in parts]) + " UNION ALL ".join(line for _, line in _REPORTS)

# ---- embedding
ORACLES["hash_embed_sparse"] = with_(*fixed(), VEC) + "SELECT document_id, chunk_index, slot, q FROM vec"
_CHECK = """SELECT c.document_id, c.chunk_index, 384 AS dimensions, coalesce(sum(v.q * (v.slot + 1)), 0)::BIGINT AS checksum
 FROM chunks c LEFT JOIN vec v ON v.document_id = c.document_id AND v.chunk_index = c.chunk_index GROUP BY c.document_id, c.chunk_index"""
ORACLES["hash_embed_dense"] = with_(*fixed(), VEC) + _CHECK
ORACLES["score_in_batches"] = with_(*fixed(), """u AS (SELECT document_id, chunk_index, [unicode(x) FOR x IN string_split(content, '')] AS c FROM chunks),
tri AS (SELECT document_id, chunk_index, unnest([(c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 256 FOR i IN range(1, len(c) - 1)]) AS slot FROM u)""") + """SELECT u.document_id, u.chunk_index, 256 AS dimensions, coalesce(sum(t.slot + 1), 0)::BIGINT AS checksum
 FROM u LEFT JOIN tri t ON t.document_id = u.document_id AND t.chunk_index = u.chunk_index GROUP BY u.document_id, u.chunk_index"""
ORACLES["validate_vectors"] = """WITH v AS (SELECT concat(label, '/', vec_id % 7) AS owner, CASE WHEN vec_id % 28 = 21 THEN 'empty' WHEN vec_id % 28 = 7 THEN 'not_finite' WHEN vec_id % 28 = 0 THEN 'dimension' WHEN vec_id % 28 = 14 THEN 'all_zero' END AS problem FROM embeddings)
SELECT owner, count(*) AS vectors, count(problem) AS bad_vectors, min(problem) AS first_problem, count(problem) = 0 AS publishable FROM v GROUP BY owner"""
ORACLES["vector_integrity"] = with_(*fixed(), VEC, "whole AS (SELECT c.document_id, c.chunk_index, list(struct_pack(slot := slot, q := q) ORDER BY slot) FILTER (WHERE slot IS NOT NULL) AS v FROM chunks c LEFT JOIN vec USING (document_id, chunk_index) GROUP BY ALL)") + """SELECT copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM whole GROUP BY v HAVING count(*) > 1) GROUP BY copies"""
ORACLES["vector_drift"] = with_(*fixed(), VEC) + """SELECT c.document_id, c.chunk_index, CASE WHEN c.document_id % 50 = 7 AND count(v.slot) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS distance,
 c.document_id % 50 = 7 AND count(v.slot) > 0 AS drifted FROM chunks c LEFT JOIN vec v ON v.document_id = c.document_id AND v.chunk_index = c.chunk_index GROUP BY c.document_id, c.chunk_index"""
VOCAB = f"""tt AS MATERIALIZED (SELECT doc_id AS document_id, unnest({tok('text')}) AS token FROM documents),
n AS (SELECT count(*) AS n FROM documents),
vocab AS MATERIALIZED (SELECT token, df, n, round(ln(n / (df + 1)::DOUBLE) * 10000)::BIGINT AS idf_q FROM (SELECT token, count(DISTINCT document_id) AS df FROM tt GROUP BY token) CROSS JOIN n),
tw AS MATERIALIZED (SELECT document_id, token, count(*) AS tf, count(*) * any_value(idf_q) AS w FROM tt JOIN vocab USING (token) GROUP BY document_id, token)"""
ORACLES["idf"] = with_(VOCAB) + "SELECT token, df, n, idf_q FROM vocab"
ORACLES["tfidf"] = with_(VOCAB) + "SELECT document_id, token, tf, w FROM tw"
ORACLES["l2_normalize"] = """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: e * (label + 1)) AS x FROM embeddings),
 u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS n FROM v)
SELECT vec_id, generate_subscripts(x, 1) - 1 AS pos, round(unnest(x) / n, 6) AS x FROM u"""

# ---- retrieval
ORACLES["retrievable_chunks"] = with_(*fixed()) + """SELECT c.document_id, c.chunk_index, c.token_count, d.organization_id, d.uploaded_by, d.source_type
 FROM chunks c JOIN docs d USING (document_id) WHERE d.status = 'ready' AND d.embedding_status = 'ready'"""
ORACLES["metadata_filter"] = "SELECT event_id, user_id AS client, props FROM events WHERE json_extract(props, '$.k')::VARCHAR = '69'"
ORACLES["similarity_floor"] = with_(*corpus(20, 0.4)) + "SELECT query_id, rank, document_id, chunk_index, similarity FROM hits"
DENSE = """q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: round(e::DOUBLE * 1000000)::BIGINT) AS v FROM embeddings),
l AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS slot, unnest(v) AS x FROM q),
nn AS (SELECT vec_id, sum(x * x)::DOUBLE AS n FROM l GROUP BY ALL)"""
ORACLES["topk_cosine"] = with_(DENSE, """d AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::DOUBLE AS dot FROM l a JOIN l b USING (slot) GROUP BY ALL),
s AS (SELECT query_id, d.vec_id, dot / (sqrt(b.n) * sqrt(a.n)) AS cos FROM d JOIN nn a ON a.vec_id = d.query_id JOIN nn b ON b.vec_id = d.vec_id)""") + """SELECT query_id, rank, vec_id, round(cos, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
_CELLS = with_(DENSE, """plane AS (SELECT h, j + 1 AS slot, ((x * x * x * 2654435761 + x * 40503) % 4294967296) // 65536 % 2001 - 1000 AS c FROM
 (SELECT h, j, (h * 64 + j + 1)::BIGINT AS x FROM range(5) a(h), range(64) b(j))),
m AS MATERIALIZED (SELECT vec_id, list(m ORDER BY h) AS m FROM (SELECT vec_id, h, sum(x * c)::BIGINT AS m FROM l JOIN plane USING (slot) GROUP BY ALL) GROUP BY vec_id),
cell AS (SELECT vec_id, list_sum([CASE WHEN m[h + 1] >= 0 THEN 1 << h ELSE 0 END FOR h IN range(5)])::INT AS cell FROM m),
mask AS (SELECT vec_id AS query_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum([CASE WHEN k & (1 << h) <> 0 THEN abs(m[h + 1]) ELSE 0 END FOR h IN range(5)]), k) AS n
 FROM m, range(32) t(k) WHERE vec_id % 20 = 0),
probe AS (SELECT query_id, xor(c.cell, k::INT) AS cell FROM mask JOIN cell c ON c.vec_id = query_id WHERE n <= 26),
d AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::DOUBLE AS dot FROM l a JOIN l b USING (slot) WHERE a.vec_id % 20 = 0 GROUP BY ALL),
s AS (SELECT query_id, d.vec_id, dot / (sqrt(b.n) * sqrt(a.n)) AS cos FROM d JOIN nn a ON a.vec_id = d.query_id JOIN nn b ON b.vec_id = d.vec_id),
ex AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM s),
ap AS (SELECT query_id, vec_id, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM s JOIN cell USING (vec_id) JOIN probe USING (query_id, cell))""")
ORACLES["ann_topk"] = _CELLS + "SELECT query_id, rank, vec_id, round(cos, 6) AS similarity FROM ap WHERE rank <= 5"
ORACLES["ann_recall"] = _CELLS + """SELECT count(*) AS neighbours, count(a.vec_id) AS found, round(count(a.vec_id) / count(*)::DOUBLE, 6) AS recall
 FROM ex LEFT JOIN (SELECT * FROM ap WHERE rank <= 5) a USING (query_id, vec_id) WHERE ex.rank <= 5"""
ORACLES["topk_sparse"] = with_(*corpus()) + "SELECT query_id, rank, document_id, chunk_index, similarity FROM hits"


def _scoped(where: str) -> list[str]:
    return fixed() + [QUESTIONS, VEC, QVEC, SCORES, f"""own AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, s.document_id, chunk_index) AS rank FROM scores s JOIN docs d USING (document_id)
 WHERE d.status = 'ready' AND d.embedding_status = 'ready' AND d.organization_id = concat('src', query_id % 20) AND d.uploaded_by = concat('u', query_id % 3) {where})"""]


ORACLES["scoped_search"] = with_(*_scoped("AND d.source_type IN ('pdf', 'md', 'txt')")) + "SELECT query_id, rank, document_id, chunk_index, round(cos, 6) AS similarity FROM own WHERE rank <= 5"
ORACLES["filtered_search"] = with_(*_scoped("AND d.source_type = 'md' AND cos >= 0.1 AND (document_id, chunk_index) IN (SELECT (document_id, chunk_index) FROM chunks WHERE page_start = 1)")) + "SELECT query_id, rank, document_id, chunk_index, round(cos, 6) AS similarity FROM own WHERE rank <= 10"
ORACLES["tenant_audit"] = with_(*_scoped("")) + "SELECT count(*) AS rows_checked, 0 AS leaks FROM own WHERE rank <= 5"
ORACLES["vector_distances"] = with_(DENSE, """p AS (SELECT a.vec_id, sum(a.x * b.x)::BIGINT AS dot, sum(a.x * a.x)::DOUBLE AS na, sum(b.x * b.x)::DOUBLE AS nb, sum((a.x - b.x) * (a.x - b.x))::DOUBLE AS sq FROM l a JOIN l b ON b.vec_id = a.vec_id + 1 AND a.slot = b.slot GROUP BY ALL)""") + "SELECT vec_id, dot, round(dot / (sqrt(na) * sqrt(nb)), 6) AS cosine, round(sqrt(sq) / 1000000, 6) AS euclidean FROM p"
TFIDF = [VOCAB, QUESTIONS, f"""qw AS (SELECT query_id, token, count(*) * any_value(idf_q) AS w FROM (SELECT query_id, unnest({tok('question')}) AS token FROM questions) JOIN vocab USING (token) GROUP BY ALL),
dd AS (SELECT query_id, document_id, sum(a.w * b.w)::DOUBLE AS dot FROM qw a JOIN tw b USING (token) GROUP BY ALL),
qn AS (SELECT query_id, sum(w::HUGEINT * w)::DOUBLE AS n FROM qw GROUP BY ALL), dn AS (SELECT document_id, sum(w::HUGEINT * w)::DOUBLE AS n FROM tw GROUP BY ALL),
s AS (SELECT q.query_id, d.doc_id AS document_id, coalesce(dd.dot, 0) AS dot, coalesce(qn.n, 0) AS a, coalesce(dn.n, 0) AS b FROM questions q CROSS JOIN documents d
 LEFT JOIN dd ON dd.query_id = q.query_id AND dd.document_id = d.doc_id LEFT JOIN qn ON qn.query_id = q.query_id LEFT JOIN dn ON dn.document_id = d.doc_id)"""]
ORACLES["tfidf_topk"] = with_(*TFIDF) + """SELECT query_id, rank, document_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM
 (SELECT *, CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE dot / (sqrt(b) * sqrt(a)) END AS score FROM s)) WHERE rank <= 3"""
ORACLES["tfidf_euclidean"] = with_(*TFIDF) + """SELECT query_id, rank, document_id, round(score / 10000, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, document_id) AS rank FROM
 (SELECT *, sqrt(greatest(b + a - 2 * dot, 0.0)) AS score FROM s)) WHERE rank <= 3"""
ORACLES["title_search"] = with_(DOCS) + "SELECT document_id, title, filename FROM docs WHERE title ILIKE '%note-1%' OR filename ILIKE '%note-1%'"

# ---- answering
ORACLES["overlap_ratio"] = with_(*BASE, GOLDENS, f"""r AS (SELECT g.item_id, p.document_id, p.page_number, {ctok('g.expected_answer')} AS a, {ctok('p.content')} AS b FROM goldens g JOIN pgs p ON p.document_id = g.expected_document)""") + """SELECT item_id, document_id, page_number, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END, 6) AS overlap FROM r"""
ORACLES["context_budget"] = with_(*corpus(20), context(800)) + "SELECT query_id, pos, document_id, chunk_index, cost AS tokens FROM ctx"
ANSWERED = [*corpus(), context(), answers()]
ORACLES["refusals"] = with_(*corpus(), context(), answers(0.5)) + "SELECT query_id, refused, reason FROM answers"
ORACLES["extractive_answers"] = with_(*ANSWERED) + "SELECT query_id, answer, refused, round(overlap, 6) AS overlap, evidence_index, citation, document_id, chunk_index, page, similarity FROM answers"
ORACLES["ask_corpus"] = with_(*ANSWERED) + "SELECT query_id, document_id, chunk_index, similarity, answer, refused FROM answers"
ORACLES["parse_citations"] = """WITH t AS (SELECT conv_id, turn, concat(text, ' [', turn, '] [0] [x] [', turn % 3, '][12] [', turn, ']') AS s FROM conversations),
 m AS (SELECT conv_id, turn, n, min(o) AS o FROM (SELECT conv_id, turn, unnest(regexp_extract_all(s, '\\[(\\d+)\\]', 1))::BIGINT AS n, generate_subscripts(regexp_extract_all(s, '\\[(\\d+)\\]', 1), 1) AS o FROM t) WHERE n >= 1 GROUP BY ALL)
SELECT conv_id, turn, string_agg(n::VARCHAR, ',' ORDER BY o) AS citations FROM m GROUP BY conv_id, turn"""
ORACLES["resolve_citations"] = with_(*ANSWERED, """marks AS (SELECT query_id, n, min(o) AS o FROM (SELECT query_id, unnest(list_concat(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), ['2', '99', '1']))::BIGINT AS n,
  generate_subscripts(list_concat(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), ['2', '99', '1']), 1) AS o FROM answers) WHERE n >= 1 GROUP BY ALL),
 seq AS (SELECT query_id, n, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS ord FROM marks)""") + """SELECT s.query_id, s.ord, s.n AS citation, c.document_id, c.chunk_index, c.page FROM seq s JOIN ctx c ON c.query_id = s.query_id AND c.pos = s.n - 1"""
ORACLES["render_context"] = with_(*corpus(), context(), RENDERED) + "SELECT query_id, rendered FROM rendered"


def history(messages: int, tokens: int) -> str:
    """The last turns before each user turn, then the newest-first budget by recursion."""
    return f"""prior AS MATERIALIZED (SELECT u.conversation_id, u.position AS asked, m.position, m.role, m.content, {word_est('m.content')} AS cost,
  row_number() OVER (PARTITION BY u.conversation_id, u.position ORDER BY m.position DESC) AS back FROM messages u JOIN messages m ON m.conversation_id = u.conversation_id AND m.position < u.position WHERE u.role = 'user'),
talk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conversation_id, asked ORDER BY position DESC) AS r FROM prior WHERE back <= {messages} AND role <> 'system'),
hw AS (SELECT conversation_id, asked, r, cost AS used, true AS kept FROM talk WHERE r = 1
  UNION ALL SELECT t.conversation_id, t.asked, t.r, CASE WHEN h.used + t.cost <= {tokens} THEN h.used + t.cost ELSE h.used END, h.used + t.cost <= {tokens}
  FROM hw h JOIN talk t ON t.conversation_id = h.conversation_id AND t.asked = h.asked AND t.r = h.r + 1),
hist AS (SELECT t.* FROM talk t JOIN hw USING (conversation_id, asked, r) WHERE hw.kept)"""


ORACLES["render_history"] = with_(WSC_CTE, MESSAGES, history(4, 200)) + f"""SELECT u.conversation_id, u.position, coalesce(string_agg(concat(CASE h.role WHEN 'user' THEN 'User' ELSE 'Assistant' END, ': ', h.content), {NL} ORDER BY h.position) FILTER (WHERE h.position IS NOT NULL), '') AS rendered
 FROM messages u LEFT JOIN hist h ON h.conversation_id = u.conversation_id AND h.asked = u.position WHERE u.role = 'user' GROUP BY u.conversation_id, u.position"""
ORACLES["prompt_table"] = with_(*corpus(), context(), RENDERED) + f"""SELECT query_id, 0 AS pos, 'system' AS role, '{PROMPT}' AS content FROM questions
 UNION ALL SELECT query_id, 1, 'user', concat('Context:', {NL}, coalesce(rendered, ''), {NL}, {NL}, 'Question: ', question, {NL}, {NL}, 'Answer:') FROM questions LEFT JOIN rendered USING (query_id)"""
ORACLES["generate_answers"] = with_(WSC_CTE, *[p for p in corpus() if p != WSC_CTE], context(), RENDERED, f"""said AS (SELECT query_id, concat('Context:', {NL}, coalesce(rendered, ''), {NL}, {NL}, 'Question: ', question, {NL}, {NL}, 'Answer:') AS reply FROM questions LEFT JOIN rendered USING (query_id)),
marks AS (SELECT query_id, n, min(o) AS o FROM (SELECT query_id, unnest(regexp_extract_all(reply, '\\[(\\d+)\\]', 1))::BIGINT AS n, generate_subscripts(regexp_extract_all(reply, '\\[(\\d+)\\]', 1), 1) AS o FROM said) WHERE n >= 1 GROUP BY ALL),
line AS (SELECT query_id, string_agg(concat('[', n, ']'), '' ORDER BY o) AS m FROM marks GROUP BY query_id)""") + f"""SELECT query_id, concat(reply, ' ', m) AS answer, false AS refused, len({words("'" + PROMPT + "'")}) + len({words('reply')}) AS prompt_words, len({words('reply')}) AS completion_words FROM said JOIN line USING (query_id)"""
ORACLES["post_check"] = """WITH c AS (SELECT conv_id, turn, conv_id % 4 AS k, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, k < 2 AS refused, CASE WHEN k < 2 THEN 'I don''t know.' WHEN k = 2 THEN concat(text, ' [2] [2]') ELSE concat(text, ' [1]') END AS answer FROM c"""
ORACLES["answer_usage"] = with_(*ANSWERED, RENDERED) + f"""SELECT query_id, CASE WHEN refused THEN 0 ELSE {est("concat(rendered, question, '" + PROMPT + "')")} END AS prompt_tokens,
 CASE WHEN refused THEN 0 ELSE {est('quote')} END AS completion_tokens, CASE WHEN refused THEN 0 ELSE greatest(1, {est('question')} + {est('quote')}) END AS total_tokens FROM answers LEFT JOIN rendered USING (query_id)"""

# ---- conversations
REF = f"(regexp_matches(content, '{FOLLOW_UP.replace(chr(39), chr(39) * 2)}') OR regexp_matches(content, '{PRONOUNS}'))"
ORACLES["referential_turns"] = with_(MESSAGES) + f"SELECT conversation_id, position, {REF} AS referential FROM messages WHERE role = 'user'"
_EXPANDED = (f"""sides AS (SELECT conversation_id, asked, max_by(content, position) FILTER (WHERE role = 'user') AS u, max_by(content, position) FILTER (WHERE role = 'assistant') AS a FROM hist GROUP BY ALL),
 seen AS (SELECT m.*, u, a FROM messages m LEFT JOIN sides s ON s.conversation_id = m.conversation_id AND s.asked = m.position WHERE role = 'user'),
 clipped AS (SELECT *, regexp_replace({trim('a')}, '{WS}*\\[\\d+\\]{WS}*$', '') AS c FROM seen),
 tailed AS (SELECT *, nullif(CASE WHEN length(c) <= 400 THEN c ELSE rtrim(substr(c, 1, 400), ' ,;') END, '') AS tail FROM clipped)""", f"""SELECT conversation_id, position, CASE WHEN {REF} AND (u IS NOT NULL OR tail IS NOT NULL) THEN concat_ws(' — ', nullif(u, ''), tail, content) ELSE content END AS expanded FROM tailed""")
ORACLES["expand_followups"] = with_(WSC_CTE, MESSAGES, history(20, 800), _EXPANDED[0]) + _EXPANDED[1]
ORACLES["history_window"] = with_(WSC_CTE, MESSAGES, history(5, 150)) + """SELECT u.conversation_id, u.position, coalesce(string_agg(concat(h.position, ':', h.role), ',' ORDER BY h.position) FILTER (WHERE h.position IS NOT NULL), '') AS kept
 FROM messages u LEFT JOIN hist h ON h.conversation_id = u.conversation_id AND h.asked = u.position WHERE u.role = 'user' GROUP BY u.conversation_id, u.position"""
_CONTINUED = "questions AS MATERIALIZED (SELECT conversation_id * 1048576 + position AS query_id, expanded AS question FROM expanded)"
ORACLES["conversation_answers"] = with_(
    *fixed(), MESSAGES, history(20, 800), _EXPANDED[0], f"expanded AS MATERIALIZED ({_EXPANDED[1]})", _CONTINUED, VEC, QVEC, SCORES, search(5), context(), answers()
) + "SELECT query_id // 1048576 AS conversation_id, query_id % 1048576 AS position, question AS query, document_id, chunk_index, similarity, answer, refused FROM answers"
ORACLES["turn_pairs"] = with_(MESSAGES) + """SELECT u.conversation_id, u.position AS user_position, a.position AS assistant_position, m.p + 1 AS next_position FROM messages u
 LEFT JOIN messages a ON a.conversation_id = u.conversation_id AND a.position = u.position + 1 AND a.role = 'assistant'
 JOIN (SELECT conversation_id, max(position) AS p FROM messages GROUP BY 1) m ON m.conversation_id = u.conversation_id WHERE u.role = 'user'"""
ORACLES["conversation_list"] = with_(MESSAGES) + """SELECT conversation_id, count(*) AS message_count, max(position) AS last_position, sum(length(content))::BIGINT AS characters, count(*) OVER () AS matching_total
 FROM messages GROUP BY conversation_id ORDER BY last_position DESC, conversation_id LIMIT 25 OFFSET 10"""
ORACLES["transcripts"] = with_(MESSAGES) + "SELECT conversation_id, position, role, content FROM messages"

# ---- library
ORACLES["document_list"] = with_(DOCS) + """SELECT document_id, title, filename, source_type, count(*) OVER () AS matching_total, count(*) OVER () > 75 AS has_more FROM docs
 WHERE status = 'ready' AND embedding_status = 'ready' AND (title ILIKE '%note%' OR filename ILIKE '%note%') ORDER BY created_at DESC, document_id LIMIT 50 OFFSET 25"""
ORACLES["document_status"] = with_(*fixed(), "pc AS (SELECT document_id, count(*) AS n FROM pgs GROUP BY 1), cc AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1)") + """SELECT document_id, status, embedding_status,
 CASE WHEN status = 'ready' THEN coalesce(pc.n, 0) ELSE 0 END AS pages, CASE WHEN status = 'ready' THEN coalesce(cc.n, 0) ELSE 0 END AS chunks,
 CASE WHEN status = 'ready' AND embedding_status = 'ready' THEN coalesce(cc.n, 0) ELSE 0 END AS embeddings,
 CASE WHEN status = 'failed' OR embedding_status = 'failed' THEN 'failed' WHEN embedding_status = 'ready' THEN 'ready' WHEN embedding_status = 'processing' THEN 'embedding' WHEN status = 'processing' THEN 'processing' ELSE 'uploaded' END AS stage
 FROM docs LEFT JOIN pc USING (document_id) LEFT JOIN cc USING (document_id)"""
ORACLES["ingestion_state"] = with_(DOCS, JOBS) + """SELECT d.document_id, p.status AS process_job, e.status AS embed_job, CASE WHEN d.status = 'failed' OR d.embedding_status = 'failed' OR p.status = 'failed' OR e.status = 'failed' THEN 'FAILED'
 WHEN d.status = 'ready' AND d.embedding_status = 'ready' THEN 'READY' WHEN d.embedding_status = 'processing' OR e.status IN ('processing', 'queued') THEN 'EMBEDDING'
 WHEN d.status = 'processing' OR p.status = 'processing' THEN 'PROCESSING' WHEN p.status = 'queued' THEN 'UPLOADED' WHEN d.status = 'ready' THEN 'READY' ELSE 'UPLOADED' END AS state
 FROM docs d LEFT JOIN jobs p ON p.document_id = d.document_id AND p.kind = 'process' LEFT JOIN jobs e ON e.document_id = d.document_id AND e.kind = 'embed'"""
ORACLES["source_view"] = with_(*BASE) + """SELECT document_id, title, filename, source_type, CASE source_type WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
 WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html' ELSE 'text/plain' END AS mime_type, size, status, coalesce(n, 0) AS page_count FROM docs LEFT JOIN (SELECT document_id, count(*) AS n FROM pgs GROUP BY 1) USING (document_id)"""
MEMBERS = """members AS (SELECT organization_id, concat(organization_id, '/', uploaded_by) AS user_id, concat(uploaded_by, '@example.org') AS email,
 ['owner', 'admin', 'member', 'viewer'][(substr(uploaded_by, 2)::INT + length(organization_id)) % 4 + 1] AS role, count(*) AS documents, max(created_at) AS last_seen_at FROM docs GROUP BY organization_id, uploaded_by)"""
ORACLES["member_report"] = with_(DOCS, MEMBERS) + """SELECT organization_id, count(*) AS members, count(*) FILTER (WHERE role IN ('admin', 'owner')) AS at_least,
 max(CASE role WHEN 'owner' THEN 4 WHEN 'admin' THEN 3 WHEN 'member' THEN 2 ELSE 1 END) AS top_rank FROM members GROUP BY organization_id"""
ORACLES["expiry_report"] = with_(DOCS, MEMBERS) + """SELECT user_id, role <> 'viewer' AND last_seen_at + INTERVAL 7 DAY > TIMESTAMP '2024-01-08 00:00:00' AS token_live,
 CASE WHEN role = 'owner' THEN 'spent' WHEN last_seen_at + INTERVAL 448 MINUTE + INTERVAL 6 DAY <= TIMESTAMP '2024-01-08 00:00:00' THEN 'expired' ELSE 'pending' END AS invitation FROM members"""
ORACLES["duplicate_invitations"] = with_(DOCS) + """SELECT organization_id, concat(uploaded_by, '@example.org') AS email, count(*) AS pending FROM docs WHERE status <> 'ready' GROUP BY ALL HAVING count(*) > 1"""
ORACLES["multi_tenant_emails"] = with_(DOCS, MEMBERS) + "SELECT email, count(DISTINCT organization_id) AS organizations FROM members GROUP BY email HAVING count(DISTINCT organization_id) > 1"
ORACLES["child_tenant_audit"] = with_(*fixed()) + "SELECT count(*) AS rows_checked, 0 AS mismatched, 0 AS orphans FROM chunks"

# ---- evaluation


def study(chars: int = 2048, chunked: list[str] | None = None) -> list[str]:
    """Per query: gold tokens, best chunk, its standing, and what each rank covers."""
    return (chunked or fixed(chars)) + [QUESTIONS, VEC, QVEC, SCORES, f"""gold AS MATERIALIZED (SELECT query_id, list_distinct({tok('question')}) AS g FROM questions),
ct AS MATERIALIZED (SELECT document_id, chunk_index, list_distinct({tok('content')}) AS t FROM chunks),
over AS (SELECT query_id, document_id, chunk_index, len(list_intersect(g, t)) AS o FROM gold CROSS JOIN ct),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, document_id, chunk_index) AS n FROM over) WHERE n = 1),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, document_id, chunk_index) AS rank FROM scores),
bestr AS MATERIALIZED (SELECT b.query_id, r.rank, r.dot, c.page_end - c.page_start + 1 AS span FROM best b JOIN rk r USING (query_id, document_id, chunk_index) JOIN chunks c USING (document_id, chunk_index)),
cover AS MATERIALIZED (SELECT query_id, token, min(rank) AS rank, max(dot) AS dot FROM (SELECT r.query_id, r.rank, r.dot, unnest(list_intersect(g.g, ct.t)) AS token FROM rk r JOIN gold g USING (query_id) JOIN ct USING (document_id, chunk_index) WHERE r.rank <= 10) GROUP BY ALL),
grid AS (SELECT k, f AS floor FROM (SELECT unnest([1, 3, 5, 10]) AS k) CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS f)),
cells AS MATERIALIZED (SELECT g.query_id, grid.k, grid.floor,
  (SELECT count(*) FROM cover c WHERE c.query_id = g.query_id AND c.rank <= grid.k AND c.dot / 1e12 >= grid.floor) / greatest(len(g.g), 1)::DOUBLE AS coverage,
  CASE WHEN b.dot / 1e12 >= grid.floor THEN b.rank ELSE 0 END AS rank,
  (SELECT count(*) FROM scores s WHERE s.query_id = g.query_id AND s.dot >= grid.floor * 1e12) AS kept, b.span
  FROM gold g CROSS JOIN grid JOIN bestr b ON b.query_id = g.query_id)"""]


ORACLES["coverage_at_k"] = with_(*study()) + "SELECT query_id, k, round(coverage, 6) AS coverage FROM cells WHERE floor = 0"
ORACLES["hit_mrr"] = with_(*study()) + "SELECT query_id, rank, rank > 0 AND rank <= k AS hit, round(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END, 6) AS rr, kept, span AS best_span FROM cells WHERE floor = 0 AND k = 5"
ORACLES["eval_misses"] = with_(*study(512)) + "SELECT query_id, rank, round(coverage, 6) AS coverage FROM cells WHERE floor = 0 AND k = 5 AND (rank = 0 OR coverage < 0.5)"
_ROLL = """count(*) AS queries, round(avg(coverage), 6) AS coverage, round(avg((rank > 0 AND rank <= k)::INT::DOUBLE), 6) AS hit,
 round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(kept::DOUBLE), 6) AS kept"""


def _sweep(label: str, chunked: list[str]) -> str:
    return "(" + with_(*study(chunked=chunked)) + f"SELECT '{label}' AS config, k, floor, {_ROLL}, round(avg(span::DOUBLE), 6) AS best_span FROM cells GROUP BY k, floor)"


_SWEPT = {
    **{f"paragraph {n}": [*BASE, PARAGRAPHS, *packed_paragraphs(4 * n), _PLACED_PARAGRAPHS] for n in (512, 256, 128)},
    **{f"token {n}": fixed(4 * n) for n in (256, 128, 64)},
    **{f"overlap {a}/{b}": [*BASE, WORDS, *windows(4 * a, 4 * b), placed("span")] for a, b in ((256, 128), (256, 32), (128, 32))},
    **{f"fixed {n} chars": fixed(n) for n in (512, 1024, 2048)},
}
ORACLES["eval_sweep"] = " UNION ALL ".join(f"SELECT * FROM {_sweep(label, chunked)}" for label, chunked in _SWEPT.items())
ORACLES["resolve_goldens"] = with_(*BASE, GOLDENS, RESOLVED) + "SELECT item_id, expected_document, expected_page FROM resolved"
_METRICS = [*study(), GOLDENS, RESOLVED, """metrics AS (SELECT g.item_id, g.expected_document, k.k,
  count(*) FILTER (WHERE r.rank <= k.k AND c.document_id = g.expected_document) > 0 AS document_hit,
  count(*) FILTER (WHERE r.rank <= k.k AND c.document_id = g.expected_document AND g.expected_page BETWEEN c.page_start AND c.page_end) AS rel,
  (SELECT count(*) FROM chunks a WHERE a.document_id = g.expected_document AND g.expected_page BETWEEN a.page_start AND a.page_end) AS total
  FROM resolved g CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) k JOIN rk r ON r.query_id = g.item_id JOIN chunks c ON c.document_id = r.document_id AND c.chunk_index = r.chunk_index GROUP BY g.item_id, g.expected_document, g.expected_page, k.k)"""]
ORACLES["retrieval_metrics"] = with_(*_METRICS) + "SELECT item_id, expected_document, k, document_hit, rel > 0 AS page_hit, round(rel / k::DOUBLE, 6) AS precision, round(CASE WHEN total > 0 THEN rel / total::DOUBLE END, 6) AS recall FROM metrics"
ORACLES["retrieval_report"] = with_(*_METRICS) + """SELECT k, count(*) AS queries, round(avg(document_hit::INT::DOUBLE), 6) AS document_hit, round(avg((rel > 0)::INT::DOUBLE), 6) AS page_hit,
 round(avg(rel / k::DOUBLE), 6) AS precision, coalesce(round(avg(CASE WHEN total > 0 THEN rel / total::DOUBLE END), 6), 0.0) AS recall FROM metrics GROUP BY k"""
_JUDGED = [*ANSWERED, GOLDENS, RESOLVED, f"""j AS (SELECT g.item_id, g.expected_document, a.refused, {ectok('g.expected_answer')} AS want, {ectok('a.answer')} AS got, a.answer,
  a.document_id, c.page_start, c.page_end, g.expected_page, (SELECT bool_or(len(list_intersect({ectok('a.answer')}, {ectok('x.text')})) > 0) FROM ctx x WHERE x.query_id = a.query_id) AS grounded
  FROM resolved g JOIN answers a ON a.query_id = g.item_id LEFT JOIN chunks c ON c.document_id = a.document_id AND c.chunk_index = a.chunk_index),
judged AS (SELECT item_id, expected_document, refused, NOT refused AND (CASE WHEN len(want) = 0 THEN answer <> '' ELSE len(list_intersect(want, got)) >= len(want) * 0.5 END) AS answer_correct,
  NOT refused AND (len(got) = 0 OR NOT coalesce(grounded, false)) AS hallucinated, NOT refused AND coalesce(document_id = expected_document, false) AS citation_document_correct,
  NOT refused AND coalesce(page_start = expected_page, false) AS citation_page_exact, NOT refused AND coalesce(expected_page BETWEEN page_start AND page_end, false) AS citation_page_covers FROM j)"""]
ORACLES["answer_correct"] = with_(*_JUDGED) + "SELECT item_id, expected_document, answer_correct FROM judged"
ORACLES["citation_metrics"] = with_(*_JUDGED) + "SELECT item_id, expected_document, citation_document_correct, citation_page_exact, citation_page_covers, citation_document_correct AND citation_page_covers AS citation_correct FROM judged"
_RATE = lambda c: f"coalesce(round(avg(({c})::INT::DOUBLE), 6), 0.0)"
ORACLES["eval_report"] = with_(*_JUDGED) + "SELECT count(*) AS queries, " + ", ".join(
    f"{_RATE(c)} AS {n}" for n, c in [(x, x) for x in ("answer_correct", "hallucinated", "citation_document_correct", "citation_page_exact", "citation_page_covers", "refused")]
    + [("citation_correct", "citation_document_correct AND citation_page_covers")]
) + " FROM judged"
ORACLES["hallucination"] = with_(MESSAGES, f"t AS (SELECT a.conversation_id, a.position, {ectok('a.content')} AS x, {ectok('p.content')} AS y FROM messages a LEFT JOIN messages p ON p.conversation_id = a.conversation_id AND p.position = a.position - 1 WHERE a.role = 'assistant')") + """SELECT conversation_id, position, len(x) = 0 OR coalesce(len(list_intersect(x, y)), 0) = 0 AS hallucinated FROM t"""
ORACLES["demo_check"] = with_(*ANSWERED, GOLDENS) + f"""SELECT g.item_id, g.expected_document, NOT a.refused AND coalesce(a.document_id = g.expected_document, false) AND coalesce(contains({fold('c.content')}, {fold('g.expected_answer')}), false) AS passed
 FROM goldens g JOIN answers a ON a.query_id = g.item_id LEFT JOIN chunks c ON c.document_id = a.document_id AND c.chunk_index = a.chunk_index"""


def _gate(label: str, chars: int, gate: str) -> str:
    pool = "true" if gate == "none" else "c.document_id = q.document_id AND c.section = q.section"
    return "(" + with_(
        *BASE, f"heads AS MATERIALIZED (SELECT document_id, page_number, string_split(content, {NL})[1] AS section FROM pgs)",
        WORDS, greedy(chars), "span AS (SELECT *, lead(s) OVER (PARTITION BY document_id ORDER BY chunk_index) AS t FROM cut)", placed("span", "heads"),
        GOLDENS, RESOLVED,
        """questions AS MATERIALIZED (SELECT r.item_id * 1048576 + r.expected_document AS query_id, r.expected_answer AS question, r.expected_document AS document_id, h.section
 FROM resolved r JOIN heads h ON h.document_id = r.expected_document AND h.page_number = r.expected_page)""",
        VEC, QVEC, SCORES,
        f"""pool AS MATERIALIZED (SELECT s.query_id, s.document_id, s.chunk_index, s.dot, len(list_intersect(list_distinct({tok('q.question')}), list_distinct({tok('c.content')}))) AS o, {tok('c.content')} AS t, list_distinct({tok('q.question')}) AS g
 FROM scores s JOIN questions q USING (query_id) JOIN chunks c ON c.document_id = s.document_id AND c.chunk_index = s.chunk_index WHERE {pool}),
 ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, document_id, chunk_index) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, document_id, chunk_index) AS b FROM pool),
 cov AS (SELECT query_id, count(DISTINCT token) AS n FROM (SELECT query_id, unnest(list_intersect(g, t)) AS token FROM ranked WHERE rank <= 3 AND dot >= 0) GROUP BY 1),
 per AS (SELECT q.query_id, coalesce(cov.n, 0) / len(list_distinct({tok('q.question')}))::DOUBLE AS coverage, coalesce(CASE WHEN b.dot >= 0 THEN b.rank END, 0) AS rank,
  (SELECT count(*) FROM pool p WHERE p.query_id = q.query_id AND p.dot >= 0) AS kept, EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = q.document_id AND c.section = q.section) AS reach
  FROM questions q LEFT JOIN cov ON cov.query_id = q.query_id LEFT JOIN ranked b ON b.query_id = q.query_id AND b.b = 1)""",
    ) + f"""SELECT '{label}' AS config, '{gate}' AS gate, count(*) AS queries, round(avg(reach::INT::DOUBLE), 6) AS reach, round(avg(coverage), 6) AS coverage, round(avg((rank > 0 AND rank <= 3)::INT::DOUBLE), 6) AS hit,
 round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(kept::DOUBLE), 6) AS kept FROM per)"""


ORACLES["section_gate_study"] = " UNION ALL ".join(
    f"SELECT * FROM {_gate(label, chars, gate)}" for label, chars in (("fixed 512", 512), ("fixed 2048", 2048)) for gate in ("none", "section")
)

# ---- ledger and telemetry
ORACLES["request_counts"] = with_(REQUESTS) + "SELECT method, '/api/v1/documents/:id' AS route, status, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors FROM requests GROUP BY method, status"
ORACLES["sliding_rate"] = with_(REQUESTS, "e AS (SELECT method, epoch_us(ts) // 60000000 AS m FROM requests), w AS (SELECT (m - o) * 60 AS start_s, method FROM e CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS o))") + "SELECT start_s, method, count(*) AS events, round(count(*) / 300.0::DOUBLE, 9) AS per_second FROM w GROUP BY ALL"
ORACLES["error_pct"] = with_(REQUESTS) + "SELECT method, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors, round(100.0::DOUBLE * count(*) FILTER (WHERE status >= 400) / greatest(count(*)::DOUBLE, 0.0001), 6) AS error_pct FROM requests GROUP BY method"


def les(ladder: list[float]) -> str:
    return "[" + ", ".join(f"{b}::DOUBLE" for b in ladder) + ", 'inf'::DOUBLE]"


LE_NAME = "CASE WHEN isinf(le) THEN '+Inf' ELSE format('{:.3f}', le) END AS le"
HIST = f"hist AS (SELECT operation, le, count(*) FILTER (WHERE seconds <= le) AS cumulative FROM requests CROSS JOIN (SELECT unnest({les(HTTP_LADDER)}) AS le) GROUP BY ALL)"
ORACLES["latency_histogram"] = with_(REQUESTS, HIST) + "SELECT operation, CASE WHEN isinf(le) THEN '+Inf' ELSE format('{:.3f}', le) END AS le, cumulative FROM hist"
ORACLES["histogram_quantile"] = with_(REQUESTS, HIST, """b AS (SELECT *, lag(le, 1, 0.0::DOUBLE) OVER w AS lo, lag(cumulative, 1, 0) OVER w AS below, max(cumulative) OVER (PARTITION BY operation) AS n, max(CASE WHEN NOT isinf(le) THEN le END) OVER (PARTITION BY operation) AS top
 FROM hist WINDOW w AS (PARTITION BY operation ORDER BY le)),
 f AS (SELECT b.*, q, row_number() OVER (PARTITION BY operation, q ORDER BY le) AS r FROM b CROSS JOIN (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS q) WHERE cumulative >= n * q)""") + """SELECT operation, q, round(CASE WHEN isinf(le) THEN top WHEN cumulative = below THEN le ELSE lo + (le - lo) * ((n * q - below) / (cumulative - below)) END, 6) AS quantile FROM f WHERE r = 1"""
ORACLES["token_usage"] = with_(WSC_CTE, MESSAGES, f"c AS (SELECT role, {est('content')} AS p, CASE WHEN role = 'assistant' THEN {word_est('content')} ELSE 0 END AS m FROM messages), u AS (SELECT role, 'prompt' AS kind, p AS t FROM c UNION ALL SELECT role, 'completion', m FROM c UNION ALL SELECT role, 'total', p + m FROM c)") + "SELECT role AS operation, 'hash' AS provider, kind, sum(t)::BIGINT AS tokens, count(*) AS calls FROM u WHERE t > 0 GROUP BY role, kind"
ORACLES["job_timings"] = with_(DOCS, JOBS) + f"""SELECT document_id, kind, status, (epoch_us(coalesce(finished_at, TIMESTAMP '2024-02-01 00:00:00')) - epoch_us(started_at)) / 1000.0::DOUBLE AS run_ms, (epoch_us(started_at) - epoch_us(enqueued_at)) / 1000.0::DOUBLE AS wait_ms FROM jobs"""
ORACLES["stale_jobs"] = with_(DOCS, JOBS) + "SELECT document_id, kind, attempts, epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - epoch(started_at)::BIGINT AS age_seconds FROM jobs WHERE status = 'processing' AND epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - epoch(started_at)::BIGINT > 600"
ORACLES["latency_summary"] = with_(REQUESTS, "s AS (SELECT operation, list_sort(list(seconds)) AS v, sum(round(seconds * 1000000)::BIGINT) AS micro FROM requests GROUP BY 1)") + "SELECT operation, len(v) AS n, round(micro / len(v) / 1000000, 4) AS mean, " + ", ".join(
    f"v[least(len(v) - 1, floor({p}::DOUBLE * len(v))::BIGINT) + 1] AS {n}" for n, p in PERCENTILES.items()
) + ", v[len(v)] AS max FROM s"
ORACLES["throughput"] = with_(REQUESTS, "s AS (SELECT operation, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM requests GROUP BY 1)") + "SELECT operation, n, round(seconds, 3) AS seconds, round(n * 60.0::DOUBLE / seconds, 6) AS per_minute FROM s"
ORACLES["retry_schedule"] = with_(DOCS, JOBS, """t AS (SELECT *, NOT CASE kind WHEN 'process' THEN contains(error, 'pdf extraction failed') ELSE contains(error, 'not retryable') OR contains(error, 'retries exhausted') END AS transient FROM jobs WHERE status = 'failed')""") + """SELECT document_id, kind, attempts, error, transient, CASE WHEN transient AND attempts < max_attempts THEN 'retrying' ELSE 'failed' END AS outcome,
 CASE WHEN transient AND attempts < max_attempts THEN 5.0::DOUBLE * pow(2.0::DOUBLE, greatest(0, attempts - 1)) END AS delay_seconds, transient AND attempts >= max_attempts AS flags_document FROM t"""
OUTCOMES = """runs AS (SELECT kind, CASE WHEN status = 'succeeded' AND kind = 'process' THEN 'processed' WHEN status = 'succeeded' THEN 'embedded'
 WHEN attempts < max_attempts AND NOT CASE kind WHEN 'process' THEN contains(error, 'pdf extraction failed') ELSE contains(error, 'not retryable') OR contains(error, 'retries exhausted') END THEN 'retrying'
 ELSE 'failed' END AS outcome, (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS seconds FROM jobs WHERE status IN ('succeeded', 'failed'))"""
ORACLES["job_outcomes"] = with_(DOCS, JOBS, OUTCOMES) + "SELECT kind, " + ", ".join(f"sum((outcome = '{o}')::INT)::BIGINT AS {o}" for o in ("processed", "embedded", "retrying", "failed")) + ", round(avg((outcome = 'failed')::INT::DOUBLE), 6) AS failure_rate FROM runs GROUP BY kind"
ORACLES["job_duration_histogram"] = with_(DOCS, JOBS, OUTCOMES) + f"SELECT outcome, {LE_NAME}, cumulative FROM (SELECT outcome, le, sum((seconds <= le)::INT)::BIGINT AS cumulative FROM runs CROSS JOIN (SELECT unnest({les(JOB_LADDER)}) AS le) GROUP BY ALL)"
ORACLES["ai_duration_histogram"] = with_(REQUESTS) + f"SELECT operation, {LE_NAME}, cumulative FROM (SELECT operation, le, sum((seconds <= le)::INT)::BIGINT AS cumulative FROM requests CROSS JOIN (SELECT unnest({les(AI_LADDER)}) AS le) WHERE method = 'POST' GROUP BY ALL)"
ORACLES["auth_rate_breaches"] = with_(REQUESTS) + """SELECT epoch_us(ts) // 604800000000 * 604800 AS start_s, CASE WHEN client % 2 = 0 THEN client::VARCHAR ELSE concat('socket ', client) END AS client, count(*) AS requests, count(*) - 10 AS rejected
 FROM requests WHERE operation IN ('signup', 'error') GROUP BY ALL HAVING count(*) > 10"""
# Every job's events are known by construction: r bounced runs, then the last step of its status.
LEDGER = """led AS (SELECT document_id, kind, status, epoch(enqueued_at)::BIGINT AS t0, CASE WHEN status = 'queued' THEN 0 ELSE document_id % 4 END AS r FROM jobs),
led_out AS (SELECT document_id, kind, status, CASE WHEN status = 'queued' THEN 0 ELSE r + 1 END AS attempts,
 CASE WHEN status = 'queued' THEN 1 ELSE 0 END + CASE WHEN kind = 'embed' AND document_id % 5 = 1 THEN 1 ELSE 0 END AS ignored,
 CASE WHEN status = 'failed' THEN concat('attempt ', 3 * r + 2) END AS error,
 CASE WHEN status <> 'queued' THEN t0 + 3 * r + 1 END AS started_s, CASE WHEN status IN ('succeeded', 'failed') THEN t0 + 3 * r + 2 END AS finished_s FROM led)"""
ORACLES["ledger_replay"] = with_(DOCS, JOBS, LEDGER) + "SELECT * FROM led_out"
ORACLES["rate_limit_breaches"] = with_(REQUESTS) + "SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, client, count(*) AS requests, count(*) - 3 AS rejected FROM requests GROUP BY ALL HAVING count(*) > 3"

# ---- streaming: what the drained stream must equal
# Every third document is delivered again cut to half, every fifth then once more, turned round.
_CHANGED = DOCS.replace("created_at, text FROM documents)", """created_at, text FROM (SELECT * REPLACE (
 CASE WHEN doc_id % 5 = 0 THEN reverse(text) WHEN doc_id % 3 = 0 THEN substr(text, 1, (length(text) // 2)::BIGINT) ELSE text END AS text) FROM documents))""")
ORACLES["stream_ingest"] = with_(*[_CHANGED if p == DOCS else p for p in fixed()], VEC) + "SELECT c.document_id, c.chunk_index, any_value(c.token_count) AS token_count, count(v.slot) AS slots FROM chunks c LEFT JOIN vec v ON v.document_id = c.document_id AND v.chunk_index = c.chunk_index GROUP BY c.document_id, c.chunk_index"
ORACLES["stream_telemetry"] = with_(REQUESTS) + f"""SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, method, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors, count(*) FILTER (WHERE seconds <= 0.25) AS le_5
 FROM requests WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE GROUP BY ALL"""
ORACLES["stream_rates"] = with_(REQUESTS, "e AS (SELECT method, epoch_us(ts) // 60000000 AS m FROM requests), w AS (SELECT (m - o) * 60 AS start_s, method FROM e CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS o))") + """SELECT start_s, method, count(*) AS events, round(count(*) / 300.0::DOUBLE, 9) AS per_second FROM w
 WHERE (start_s + 300) * 1000000 <= (SELECT epoch_us(max(ts)) FROM requests) - 600000000 GROUP BY ALL"""
ORACLES["stream_breaches"] = with_(REQUESTS) + """SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, client, count(*) AS requests, count(*) - 3 AS rejected FROM requests
 WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE GROUP BY ALL HAVING count(*) > 3"""
ORACLES["stream_late"] = with_(REQUESTS, """span AS (SELECT min(epoch_us(ts) // 1000000) AS lo, max(epoch_us(ts) // 1000000) AS hi FROM requests),
dealt AS (SELECT r.*, (epoch_us(ts) // 1000000 - lo) * 4 // (hi - lo + 1) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS part FROM requests r, span),
mark AS (SELECT p.part, max(epoch_us(ts)) - 600000000 AS watermark_us FROM (SELECT DISTINCT part FROM dealt) p JOIN dealt d ON d.part < p.part GROUP BY ALL)""") + """SELECT event_id, method, watermark_us FROM dealt JOIN mark USING (part) WHERE epoch_us(ts) < watermark_us"""
ORACLES["stream_ledger"] = with_(DOCS, JOBS, LEDGER) + "SELECT document_id, kind, status, attempts, ignored, error FROM led_out"
# What the watermark has passed, from the number of the last event that it passed: claims come first, third, ...
ORACLES["stream_ledger_timeouts"] = with_(DOCS, JOBS, LEDGER, """ends AS (SELECT *, CASE status WHEN 'queued' THEN 1 WHEN 'processing' THEN 3 * r + 1 ELSE 3 * r + 2 END AS final FROM led),
mark AS (SELECT max(t0 + final) - 600 AS w FROM ends),
upto AS (SELECT ends.*, w, least(final, w - t0) AS n FROM ends, mark WHERE w >= t0),
shown AS (SELECT *, CASE WHEN status = 'queued' OR n % 3 = 0 THEN 'queued' WHEN n % 3 = 1 THEN 'processing' WHEN n = final THEN status ELSE 'failed' END AS st FROM upto),
late AS (SELECT *, st = 'processing' AND t0 + n + 600 < w AS lost FROM shown)""") + """SELECT document_id, kind, CASE WHEN lost THEN 'queued' ELSE st END AS status, CASE WHEN status = 'queued' THEN 0 ELSE (n + 2) // 3 END AS attempts,
 CASE WHEN status = 'queued' AND n = 1 THEN 1 ELSE 0 END + CASE WHEN kind = 'embed' AND document_id % 5 = 1 THEN 1 ELSE 0 END AS ignored,
 CASE WHEN lost THEN 'no outcome after 600 s' WHEN st = 'failed' OR (st = 'queued' AND status <> 'queued' AND n > 0) THEN concat('attempt ', n) END AS error,
 CASE WHEN lost OR st = 'queued' THEN NULL WHEN st = 'processing' THEN t0 + n ELSE t0 + n - 1 END AS started_s, CASE WHEN st IN ('succeeded', 'failed') THEN t0 + n END AS finished_s FROM late"""
ORACLES["stream_memory"] = with_(
    WSC_CTE, MESSAGES, history(20, 800), _EXPANDED[0], f"expanded AS ({_EXPANDED[1]})"
) + """SELECT e.conversation_id, e.position, any_value(e.expanded) AS expanded, coalesce(string_agg(h.position::VARCHAR, ',' ORDER BY h.position) FILTER (WHERE h.position IS NOT NULL), '') AS kept
 FROM expanded e LEFT JOIN hist h ON h.conversation_id = e.conversation_id AND h.asked = e.position GROUP BY e.conversation_id, e.position"""
