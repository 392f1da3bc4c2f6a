"""Text preparation as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------
# Whitespace as Python's str.split sees it, as characters and as a class for Java. Characters below 256 stand singly, so
# that they become one look-up in a bit set; the others are only tried inside the range that holds them all.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&"
    r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
TOKEN = r"[a-z0-9']+"
CONTENT_TOKEN = r"[0-9a-z][0-9a-z'-]*"
CITATION = r"\[(\d+)\]"
SENTENCE_END = ".!?:;"
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
HEX32 = r"[0-9a-f]{32}"
DONT_KNOW = "I don't know."

STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her here "
    "hers him his how i if in into is it its me my no not of on or our ours out over she so than "
    "that the their theirs them then there these they this those to too up us was we were what "
    "when where which who why will with would you your yours yes"
).split()
# The evaluation side keeps two words that the answering side drops.
EVAL_STOPWORDS = [w for w in STOPWORDS if w not in ("yes", "here")]

REFERENTIAL = (
    r"(?i)\b(what about|how about|whats with|what's with|and then|and the|and why|what is that|"
    r"is that|are those|these|those|them|they|it this|it that|same thing|same rule|same policy|"
    r"and|about that|on that)\b"
)
PRONOUN = r"(?i)\b(it|this|that|those|them|they|these)\b"
# -----------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``, also within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def seal(value: Column) -> Column:
    """Compute a column once and keep it so, as a generator of exactly one row.

    Catalyst copies a projected expression into the filters and lambdas that use it, where an array
    would be computed again for every element. Nothing is copied or pushed through a generator.
    """
    return F.explode_outer(F.array(value))


def trim_ws(s: Column) -> Column:
    return F.btrim(s, F.lit(WS_CHARS))


def fold(s: Column, blank: str) -> Column:
    """Runs of ``blank`` (a class that holds the blank) as single blanks; a run that is one already is not touched."""
    return F.regexp_replace(s, f"{blank}(?:(?<! ){blank}*|{blank}+)", " ")


def fold_ws(s: Column) -> Column:
    """Words separated by single blanks."""
    return trim_ws(fold(s, WS))


def normalize_text(s: Column) -> Column:
    """Fold blanks, tidy line ends, keep at most one blank line, trim."""
    s = fold(s, r"[ \t\xa0\f\x0b]")
    s = F.regexp_replace(s, r"(?: \n ?|\n )", "\n")  # blanks are single by now, and a bare line end stays
    s = F.regexp_replace(s, r"\n\n\n+", "\n\n")
    return trim_ws(s)


def tokens_for_length(n: Column) -> Column:
    """Four characters to a token, rounded up, never below one."""
    return F.greatest(F.lit(1), F.floor((n + 3) / 4).cast("int"))


def estimate_tokens(s: Column) -> Column:
    return tokens_for_length(F.length(s))


def words(s: Column) -> Column:
    return F.filter(F.split(s, f"{WS}+"), lambda w: w != "")


def estimate_words(s: Column) -> Column:
    """Word-based estimate: 1.3 tokens a word, rounded up; nothing for an empty text."""
    n = F.size(F.split(trim_ws(s), f"{WS}+"))
    est = F.greatest(F.lit(1), F.ceil(n * F.lit(1.3)).cast("int"))
    return F.when(s.isNull() | (s == ""), F.lit(0)).otherwise(est)


def sentences(s: Column) -> Column:
    parts = F.split(F.translate(s, "\n", " "), rf"(?<=[.!?]){WS}+")
    return F.filter(F.transform(parts, trim_ws), lambda x: x != "")


def tokenize(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(TOKEN), 0)


def _content(s: Column, stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(s), F.lit(CONTENT_TOKEN), 0)
    kept = F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*stop))
    return F.array_distinct(kept)


def content_tokens(s: Column) -> Column:
    """Distinct meaning-bearing tokens used to match questions with sentences."""
    return _content(s, STOPWORDS)


def eval_content_tokens(s: Column) -> Column:
    """The evaluation variant: citation marks dropped first, its own stop list."""
    return _content(F.regexp_replace(s, r"\[\d+\]", ""), EVAL_STOPWORDS)


def overlap_ratio(question_tokens: Column, candidate_tokens: Column) -> Column:
    shared = F.size(F.array_intersect(question_tokens, candidate_tokens))
    return F.when(F.size(question_tokens) == 0, F.lit(0.0)).otherwise(
        shared.cast("double") / F.size(question_tokens)
    )


def slugify(s: Column) -> Column:
    slug = F.regexp_replace(F.lower(trim_ws(s)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("org"))


def sanitize_filename(name: Column) -> Column:
    base = F.element_at(F.split(name, r"[\\/]"), -1)
    base = F.regexp_replace(base, r"[\x00-\x1f\x7f]", "")
    return trim_ws(F.regexp_replace(base, r"^\.+", ""))


def extension(name: Column) -> Column:
    """Lower-cased suffix from the last dot on, with the dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1))


def title_from_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def normalize_route(path: Column) -> Column:
    part = lambda p: F.when(p.rlike(rf"^(?:{UUID}|{HEX32}|\d+)$"), F.lit(":id")).otherwise(p)
    route = F.array_join(F.transform(F.split(path, "/"), part), "/")
    return F.when(path.isNull() | (path == ""), F.lit("unmatched")).otherwise(route)


def split_paragraphs(page: Column) -> Column:
    """Author paragraphs of one page.

    Lines are trimmed and blank ones dropped. A line break becomes a paragraph break after a line
    that ends a sentence and before a heading-looking line (at most 60 characters, no sentence
    end, followed by a capital); every other line break becomes a blank.
    """
    lines = F.regexp_replace(trim_ws(page), rf"{WS}*\n{WS}*", "\n")
    marked = F.regexp_replace(lines, f"(?<=[{SENTENCE_END}])\n", "\x01")
    heading = f"\n(?=[^\n\x01]{{0,59}}[^\n\x01{SENTENCE_END}]\n[A-Z])"
    marked = F.regexp_replace(marked, heading, "\x01")
    return F.filter(F.split(F.translate(marked, "\n", " "), "\x01"), lambda p: p != "")


def referential(question: Column) -> Column:
    """Does a turn point back at the conversation instead of standing alone?"""
    return question.rlike(REFERENTIAL) | question.rlike(PRONOUN)


def clip_reply(s: Column, max_chars: int = 400) -> Column:
    cleaned = F.regexp_replace(trim_ws(s), rf"{WS}*\[\d+\]{WS}*$", "")
    cut = F.regexp_replace(F.substring(cleaned, 1, max_chars), "[ ,;]+$", "")
    return F.when(F.length(cleaned) <= max_chars, cleaned).otherwise(cut)


def citation_ids(s: Column) -> Column:
    """Distinct positive [n] marks in the order they first appear."""
    marks = F.transform(F.regexp_extract_all(s, F.lit(CITATION), 1), lambda d: d.cast("decimal(38,0)"))
    return F.array_distinct(F.filter(marks, lambda n: n >= 1)).cast("array<bigint>")


def mark_citations(answer: Column, ids: Column) -> Column:
    marker = F.array_join(F.transform(ids, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    return F.when(F.size(ids) > 0, F.concat(answer, F.lit(" "), marker)).otherwise(answer)


def is_refusal(s: Column) -> Column:
    folded = fold(F.lower(trim_ws(s)), WS)
    return folded.startswith("i don't know") | folded.startswith("i do not know")
