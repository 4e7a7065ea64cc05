"""URL filters: rules on hosts and paths, and block decisions that travel along redirects and canonical links.

A page's redirects (``<meta http-equiv="refresh">``) and canonical links (``<link rel="canonical">``) join its URL with
another one. The distributed connected components of these links are classes of aliases. A page that a rule fits has the
rule's verdict. Any other page takes its class's verdict: allow if a member of the class has an allow rule, else block if
a member has a block rule, else allow.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; a null html has no links; tags inside comments, scripts, styles,
text areas and code are no links; equal URLs are one node; relative link targets are resolved against the page's URL; rows without an id and repeated rows are kept; very long pages are read whole. Input columns named host,
path, rule, verdict or alias_class are replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null. Of equal lengths the more specific host wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The node of an absolute URL: without its fragment, the host's letters in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.regexp_replace(bare, r"(?s)^.*?://[^/?]*", ""))


#: What holds no tags of the page: comments and raw text, each up to its end or the page's.
_DEAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<textarea\b.*?(?:</textarea|\z)|<pre\b.*?(?:</pre|\z)|<code\b.*?(?:</code|\z)"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_REFRESH = r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]+\s*;\s*url\s*=\s*[\"']?\s*([^\"'\s>]+)"


def links(pages: DataFrame) -> DataFrame:
    """(url, target): the redirect and canonical-link edges of the pages, as nodes."""
    tags = pages.select("url", F.explode(F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), _DEAD, " "), F.lit(_TAG), 0)).alias("tag"))
    low = F.lower("tag")
    raw = F.when(low.rlike(r"(?s)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), F.regexp_extract("tag", _HREF, 1)).when(
        low.rlike(r"(?s)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"), F.regexp_extract("tag", _REFRESH, 1)
    )
    found = tags.withColumn("raw", F.replace(raw, F.lit("&amp;"), F.lit("&"))).where("raw <> '' AND url LIKE '%://%'")
    scheme, root = F.regexp_extract("url", r"(?s)^(.*?:)//", 1), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace("url", r"(?s)[?#].*$", ""), r"(?s)(?<=[^:/])/[^/]*$", "")
    full = (
        F.when(F.col("raw").contains("://"), F.col("raw"))
        .when(F.col("raw").startswith("//"), F.concat(scheme, "raw"))
        .when(F.col("raw").startswith("/"), F.concat(root, "raw"))
        .otherwise(F.concat(folder, F.lit("/"), "raw"))
    )
    return found.select(node_of(F.col("url")).alias("url"), node_of(full).alias("target"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, extra_links: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` but html, with host, path, rule and verdict. ``extra_links`` (url, target) may add redirects from crawl logs."""
    edges = links(pages.select("url", "html"))
    if extra_links is not None:
        edges = edges.unionByName(extra_links.select(node_of(F.col("url")).alias("url"), node_of(F.col("target")).alias("target")))
    pages = pages.drop("html", "host", "path", "rule", "verdict", "alias_class")
    node, fit, of_class, at = (fresh(pages, n) for n in ("node", "fit", "class", "at"))
    judged = pages.withColumns({node: node_of(F.coalesce("url", F.lit(""))), "host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumn(fit, fitting_rule(F.col("host"), F.col("path"), rules))
    alias = components(edges)
    known = alias.select("node", "component", fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"].alias("v"))
    # Aliases that are no pages count as members too, for their URL alone says which rule fits.
    classes = known.groupBy("component").agg(F.bool_or(F.col("v") == "allow").alias("allowed"), F.bool_or(F.col("v") == "block").alias("blocked"))
    by_class = alias.join(classes, "component").select(
        F.col("node").alias(at), F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias(of_class), F.col("component").alias("alias_class")
    )
    out = judged.join(by_class, F.col(node) == F.col(at), "left")
    return out.withColumns({"rule": F.col(fit)["rule"], "verdict": F.coalesce(F.col(fit)["verdict"], of_class, F.lit("allow"))}).drop(node, fit, of_class, at)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(coalesce(url, ''), '(?s)#.*$', '') AS bare FROM pages),
n AS (SELECT *, translate(regexp_extract(bare, '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(bare, '(?s)^.*?://[^/?]*', '') AS node FROM p),
t AS (SELECT node, url, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<textarea\b.*?(?:</textarea|\z)|<pre\b.*?(?:</pre|\z)|<code\b.*?(?:</code|\z)', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM n WHERE url LIKE '%://%'),
r AS (SELECT node, url, replace(CASE
    WHEN regexp_matches(lower(tag), '(?s)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(lower(tag), '(?s)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]+\s*;\s*url\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    ELSE '' END, '&amp;', '&') AS raw FROM t),
f AS (SELECT node, regexp_replace(CASE WHEN contains(raw, '://') THEN raw
    WHEN raw LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || raw
    WHEN raw LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || raw
    ELSE regexp_replace(regexp_replace(url, '(?s)[?#].*$', ''), '(?s)([^:/])/[^/]*$', '\1') || '/' || raw END, '(?s)#.*$', '') AS full_url FROM r WHERE raw <> ''),
g AS (SELECT node AS a, translate(regexp_extract(full_url, '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(full_url, '(?s)^.*?://[^/?]*', '') AS b FROM f),
e AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
reach(x, y) AS (SELECT a, b FROM e UNION SELECT a, a FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
members AS (SELECT DISTINCT y AS node FROM reach),
member_rule AS (SELECT node, arg_max(verdict, length(rhost || rpath)) AS v FROM (
    SELECT node, translate(regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM members) m
    JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY node),
class AS (SELECT x AS node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' ELSE 'allow' END AS cv FROM reach LEFT JOIN member_rule ON y = member_rule.node GROUP BY x),
own AS (SELECT n.page_id, n.url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM n JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n.page_id, n.url)
SELECT n.page_id, n.host, n.path, own.rule, coalesce(own.verdict, class.cv, 'allow') AS verdict
FROM n LEFT JOIN own ON own.page_id = n.page_id AND own.url IS NOT DISTINCT FROM n.url LEFT JOIN class ON class.node = n.node
"""
