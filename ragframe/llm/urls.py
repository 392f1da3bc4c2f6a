"""URL filters that see through aliases.

Rules name a host and a path prefix; the longest that fits a URL decides it. Redirects and canonical links make URLs
equivalent: connected components over those edges, found by Spark, hand a blocked URL's verdict to its aliases. A
URL that a rule allows stays allowed whatever its aliases are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import ascii_lower, written
from ragframe.llm.components import connected_components

# A rule list is written into the plan, so its length is bounded.
MOST_RULES = 500


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest fitting rule as (rule, verdict), else null. Of equally long rules, one that allows wins, then
    the longer host."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def node_of(url: Column) -> Column:
    """The resource a URL names: scheme and host in lower case, no fragment."""
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def absolute(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``; null where it only names a place in the page. Dot segments stay as they are."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when((href == "") | href.startswith("#"), F.lit(None))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, path_of(base), href))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) of the canonical links and refresh redirects in ``pages(url, html)``."""
    html = F.coalesce("html", F.lit(""))

    def hrefs(tag: str, kind: str, attribute: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(kind))
        return F.transform(tags, lambda t: F.replace(F.regexp_extract(t, attribute, 1), F.lit("&amp;"), F.lit("&")))

    canonical = hrefs("link", r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = hrefs("meta", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    linking = pages.filter(html.rlike("(?i)canonical|http-equiv"))
    found = linking.select("url", F.explode(F.concat(canonical, refresh)).alias("href")).filter("href <> ''")
    return found.select(F.col("url").alias("source"), absolute(F.col("url"), F.col("href")).alias("target"))


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, id_column: str = "page_id"
) -> DataFrame:
    """(id_column, host, path, rule, verdict, component), one row per row of ``pages(id_column, url, html)``.

    A URL without a fitting rule is blocked if a rule blocks one of its aliases, else allowed. Aliases come from the
    pages themselves and from ``redirects(source, target)``. URLs that are null or have no ``://`` fit no rule and
    have no alias. Rows that repeat an id or a URL are judged one by one and alike. ``component`` is null for a URL
    without aliases. Nodes are told apart by 64-bit hashes.
    """
    url = F.col("url")
    rows = pages.select(
        F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.xxhash64(node_of(url)).alias("node"), node_of(url).isNotNull().alias("named"),
    ).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    ends = links.select(node_of(F.col("source")).alias("s"), node_of(F.col("target")).alias("t")).filter("s is not null and t is not null")
    ends = written(ends.distinct(), "links")
    roots = connected_components(ends.select(F.xxhash64("s").alias("a"), F.xxhash64("t").alias("b")))
    nodes = ends.select(F.explode(F.array("s", "t")).alias("u")).distinct()
    ruled = nodes.select(
        F.xxhash64("u").alias("node"), rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("v")
    )
    blocked = ruled.filter("v = 'block'").join(roots, "node").select("root").distinct().withColumn("blocked", F.lit(True))
    aliases = roots.join(blocked, "root", "left").select("node", F.col("root").alias("component"), "blocked").withColumn("named", F.lit(True))
    passed_on = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(aliases, ["node", "named"], "left").select(
        F.col("id").alias(id_column), "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", passed_on).alias("verdict"), "component",
    )
