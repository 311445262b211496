"""Operator 8, URL filters with redirect equivalence, in DataFrame operations
only.

A rule (action, host, path) fits its host and all subdomains where the URL's
path starts with the rule's; the longest fitting rule wins (of two equally
long ones an allow). A URL without a rule takes part in an equivalence class:
URLs joined by redirects (meta refresh, or rows of a redirect table) and by
canonical links, however long the chain. Within a class an explicit allow
takes precedence over a block, and either reaches all aliases without a rule
of their own; a class without a rule is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule, has no alias and is allowed; null or empty HTML has no
links; repeated URLs are one node and repeated rows repeat; empty tables (of
pages, rules or redirects) give empty results or none. Columns besides the
named ones are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_broadcast, prepare, stage
from tessera.llm.components import connected_components

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: scheme, host, path, query
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
_TARGET = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*\burl\s*=\s*([^\"'\s>]+)"

#: the rules of the registered query
RULES = [(ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``action, host, path`` rows of a rule list."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("action", "host", "path")])
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3)


def node_of(url: Column) -> Column:
    """What stands for a URL among its aliases: host, path and query, without
    scheme and fragment; null for a URL without a host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), F.regexp_extract(url, _URL, 4)))


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, action`` of the distinct (host, path) pairs of
    ``urls`` that a rule fits: host suffixes and path prefixes, of those
    lengths that rules have, are joined to the rules by equality."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), "action").distinct()
    lengths = [r["n"] for r in rules.select(F.length("r_path").alias("n")).distinct().orderBy("n").collect()]  # at most a path's length
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    tried = (urls.filter("host <> ''").select("host", "path").distinct()
             .select("host", "path", F.explode(suffixes).alias("r_host"), prefixes.alias("ps"))
             .select("host", "path", "r_host", F.explode("ps").alias("r_path")))
    rank = F.struct(F.length(F.concat("r_host", "r_path")), F.col("action") == ALLOW, F.concat("r_host", "r_path"))
    won = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "action"), rank)
    return (tried.join(bounded_broadcast(rules, rules.count()), ["r_host", "r_path"])
            .groupBy("host", "path").agg(won.alias("w")).select("host", "path", "w.rule", "w.action"))


def _absolute(url: Column, target: Column) -> Column:
    """A link target against the page's URL."""
    scheme, host, path = F.regexp_extract(url, _URL, 1), F.regexp_extract(url, _URL, 2), path_of(url)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (F.when(target.contains("://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host, target))
            .when(target != "", F.concat(scheme, F.lit("://"), host, folder, target)))


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``u, v``: URLs that a page's canonical link or meta refresh equates."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_TAG), F.lit(0))
    found = pages.filter(F.col(url).contains("://")).select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
    tag = F.col("tag")
    target = F.when(tag.rlike(_CANONICAL), F.regexp_extract(tag, _HREF, 1)).when(tag.rlike(_REFRESH), F.regexp_extract(tag, _TARGET, 1))
    found = found.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("t")).filter("t <> ''")
    return found.select(F.col("url").alias("u"), _absolute(F.col("url"), F.col("t")).alias("v"))


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``alias_of`` (the smallest
    URL node of its class, or its own) of every row of ``pages``.
    ``redirects`` may add ``source, target`` URLs."""
    prepare(pages.sparkSession)
    links = alias_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("source").alias("u"), F.col("target").alias("v")))
    links = stage(links.filter("u is not null and v is not null").distinct(), "aliases")
    classes = connected_components(links.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")))
    ends = links.select(F.col("u").alias("url")).unionByName(links.select(F.col("v").alias("url")))
    ends = ends.select(node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("node is not null").distinct()
    named = stage(ends.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("node"))
    fits = best_rules(rows.select("host", "path").unionByName(named.select("host", "path")), rules)
    fits = stage(fits, "fits")
    decided = (named.join(fits, ["host", "path"]).groupBy("root")
               .agg(F.max(F.col("action") == ALLOW).alias("allowed")))
    aliases = named.select("node", "root").join(decided, "root", "left")
    out = rows.join(fits, ["host", "path"], "left").join(aliases, "node", "left")
    verdict = F.when(F.col("action").isNotNull(), F.col("action")).when(~F.col("allowed"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("root", "node").alias("alias_of"))


_N = r"regexp_extract({c}, '(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)', {i})"


def _sql(column: str, i: int) -> str:
    return f"coalesce({_N.format(c=column, i=i)}, '')"


def _node(column: str) -> str:
    host = f"translate({_sql(column, 2)}, '{_UPPER}', '{_LOWER}')"
    return f"CASE WHEN {host} <> '' THEN {host} || {_sql(column, 3)} || {_sql(column, 4)} END"


#: the same rows in DuckDB SQL: rules by prefix and suffix tests, aliases by a recursive walk
ORACLE_SQL = f"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {', '.join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}),
tags AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
targets AS (SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?\\s*canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b') THEN regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*["'']?[^"''>]*\\burl\\s*=\\s*([^"''\\s>]+)', 1) END, '&amp;', '&') AS t FROM tags),
links AS (SELECT url AS u, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN {_sql('url', 1)} || ':' || t
    WHEN starts_with(t, '/') THEN {_sql('url', 1)} || '://' || {_sql('url', 2)} || t
    ELSE {_sql('url', 1)} || '://' || {_sql('url', 2)} || CASE WHEN regexp_extract({_sql('url', 3)}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({_sql('url', 3)}, '(?s)^(.*/)', 1) END || t END AS v
    FROM targets WHERE t <> ''),
ends AS (SELECT u AS url FROM links UNION SELECT v FROM links),
nodes AS (SELECT DISTINCT {_node('url')} AS node, translate({_sql('url', 2)}, '{_UPPER}', '{_LOWER}') AS host, {_sql('url', 3)} AS path FROM ends),
steps AS (SELECT {_node('u')} AS a, {_node('v')} AS b FROM links UNION SELECT {_node('v')}, {_node('u')} FROM links),
walk(node, other) AS (SELECT node, node FROM nodes WHERE node IS NOT NULL UNION SELECT w.node, s.b FROM walk w JOIN steps s ON s.a = w.other WHERE s.b IS NOT NULL),
judged AS (SELECT page_id, url, translate({_sql('url', 2)}, '{_UPPER}', '{_LOWER}') AS host, {_sql('url', 3)} AS path, {_node('url')} AS node FROM pages),
places AS (SELECT DISTINCT host, path FROM judged UNION SELECT host, path FROM nodes),
fits AS (SELECT p.host, p.path, max_by(struct_pack(rule := r.host || r.path, action := r.action), length(r.host || r.path)) AS w
    FROM places p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL),
fate AS (SELECT w.node, min(w.other) AS root, bool_or(f.w.action = 'allow') AS allowed, bool_or(f.w.action = 'block') AS blocked
    FROM walk w JOIN nodes n ON n.node = w.other LEFT JOIN fits f ON f.host = n.host AND f.path = n.path GROUP BY w.node)
SELECT j.page_id, j.host, j.path, f.w.rule AS rule,
    CASE WHEN f.w.action IS NOT NULL THEN f.w.action WHEN coalesce(t.allowed, false) THEN 'allow' WHEN coalesce(t.blocked, false) THEN 'block' ELSE 'allow' END AS verdict,
    coalesce(t.root, j.node) AS alias_of
FROM judged j LEFT JOIN fits f ON f.host = j.host AND f.path = j.path LEFT JOIN fate t ON t.node = j.node
"""
