"""URL filters by hash prefixes.

A URL's host and path are expanded into expressions: suffixes of the host's labels with prefixes of the path that end in a
slash, and the path's empty prefix; only those of as many labels and slashes as some rule has, so a URL of any length gives few. The expressions' SHA-256 digests are joined with the rules' on their first four bytes; then the full
digest, the host and the path's start are confirmed, and of the rules that fit the longest wins (ties: the longer host, then
code points). A rule whose path does not end in a slash is keyed by its path up to the last slash and confirmed on the whole.

Each distinct URL is judged once, so a URL or host of most rows costs no more than others; the rules are broadcast up to
BROADCAST_RULES rows and joined by shuffle beyond.

Defined results: a null url, or one without ://, has host and path empty, no rule, and the default verdict. An empty host fits no rule.
Rows that repeat are judged alike; null page_ids stay. Other columns are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import broadcast_up_to, lower_az, table

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT, BROADCAST_RULES = "allow", 100_000


def _host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_az(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, depths: list[tuple[int, int]]) -> Column:
    """For each (labels, slashes) the host's last labels + the path up to that many slashes, where the URL has as many; each is linear in the URL."""
    hosts = {n: F.when(F.length(host) - F.length(F.replace(host, F.lit("."))) >= n - 1, F.substring_index(host, ".", -n)) for n in {x for x, _ in depths}}
    paths = {n: F.when(F.length(path) - F.length(F.replace(path, F.lit("/"))) >= n, F.concat(F.substring_index(path, "/", n), F.lit("/"))) if n else F.lit("") for n in {x for _, x in depths}}
    return F.array_compact(F.array(*[F.concat(hosts[a], F.lit("\x00"), paths[b]) for a, b in depths]))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, url), (host, path, verdict) -> page_id, host, path, rule, verdict."""
    pages = pages.select("page_id", "url")
    digest = F.sha2(F.concat(F.col("rule_host"), F.lit("\x00"), F.regexp_extract("rule_path", "(?s)^(.*/|)", 1)), 256)
    keyed = rules.select(lower_az(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host <> '' and rule_path is not null")
    keyed = keyed.withColumn("_full", digest).select(F.substring("_full", 1, 8).alias("_short"), "_full", "rule_host", "rule_path", "verdict").distinct()
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x)))).cast("int")
    # Pairs of small numbers: hosts have at most 127 labels.
    depths = sorted(map(tuple, keyed.select(count(F.col("rule_host"), ".") + 1, count(F.col("rule_path"), "/")).distinct().collect()))
    host, path = _host_path(F.col("url"))
    urls = pages.select("url").where("url is not null").distinct().select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    asked = urls.select("url", "host", "path", F.explode(_expressions(F.col("host"), F.col("path"), depths) if depths else F.array().cast("array<string>")).alias("_e")).withColumn("_digest", F.sha2("_e", 256))
    hits = asked.withColumn("_short", F.substring("_digest", 1, 8)).join(broadcast_up_to(keyed, BROADCAST_RULES), "_short")
    confirmed = hits.where("_digest = _full").where((F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host")))).where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = confirmed.groupBy(F.col("url").alias("_url")).agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), "verdict")).alias("_best"))
    out = pages.join(best, F.col("url") == F.col("_url"), "left")
    return out.select("page_id", host.alias("host"), path.alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT p.k, arg_max(r, (length(r.host || r.path), length(r.host), r.host || r.path)) AS best
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.k)
SELECT page_id, host, path, b.best.host || b.best.path AS rule, coalesce(b.best.verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (k)
"""
