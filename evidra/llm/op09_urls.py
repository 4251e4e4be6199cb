"""URL rules by hashed host-suffix and path-prefix expressions [native].

A URL is expanded into host suffixes times path prefixes (cut after a slash). Each expression
has a SHA-256 digest; URLs and rules meet in an equi-join on the first eight hex digits, the
full digest is then compared, and among the rules that fit the longest wins.

Hosts and paths are looked at once per distinct pair, so a host with a third of all URLs
costs no more than its distinct paths; rows without a host need no lookup, and a pair or an
expression with many rows is joined in parts. Expressions are made only for the label counts and
depths that occur among the rules, which loses nothing. The rules are joined like any other
table: Spark broadcasts them only below its own size threshold.

Edge cases: a null URL, or one without "://", has empty host and path and fits no rule. Rules
with a null or empty host or a null path are left out. If one rule is listed with several
verdicts, "block" holds. Repeated rows are judged alike; other columns of the input are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    names = ("rule_host", "rule_path", "rule_verdict")
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rules], pa.string()) for i in range(3)], names=list(names)))


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (null if none fits), verdict of every row of pages."""
    host, path = host_path(F.col(url))
    seen = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))

    anchor = F.regexp_extract("rule_path", "^(.*/)?", 0)
    known = (
        rules.where("rule_host is not null and rule_host <> '' and rule_path is not null and rule_verdict is not null")
        .withColumn("rule_host", F.translate("rule_host", UPPER, LOWER))
        .withColumns({"anchor": anchor, "labels": F.size(F.split("rule_host", "\\."))})
        .withColumn("depth", F.length("anchor") - F.length(F.replace("anchor", F.lit("/"), F.lit(""))))
        .withColumn("digest", F.sha2(F.concat("rule_host", "anchor"), 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    shape = known.agg(F.coalesce(F.max("labels"), F.lit(1)).alias("l"), F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()

    urls = seen.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    parts = urls.select("host", "path", F.split("host", "\\.").alias("p"), (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).alias("n"))
    hosts = F.expr(f"transform(sequence(1, least(size(p), {shape['l']})), k -> array_join(slice(p, size(p) - k + 1, k), '.'))")
    paths = F.expr(f"transform(sequence(0, least(n, {shape['d']})), d -> if(d = 0, '', concat(substring_index(path, '/', d), '/')))")
    expressions = (
        parts.select("host", "path", F.explode(hosts).alias("h"), paths.alias("ps"))
        .select("host", "path", F.explode(F.transform("ps", lambda x: F.concat("h", x))).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("url_digest"))
        .withColumn("short", F.substring("url_digest", 1, SHORT))
    )
    asked = expressions.groupBy("short").agg(F.count("*").alias("n"))
    fits = (
        spread_join(expressions, known, ["short"], hot_keys(asked, ["short"]), ["host", "path"])
        .where((F.col("url_digest") == F.col("digest")) & F.startswith("path", F.col("rule_path")))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "rule", "rule_verdict")).alias("best"))
    )
    found = spread_join(seen.where("host <> ''"), fits, ["host", "path"], hot_keys(urls, ["host", "path"]), ["page_id"], "left").select("page_id", "host", "path", "best")
    rows = found.unionByName(seen.where("host = ''"), allowMissingColumns=True)
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


ORACLE = """
with rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a as (select page_id, row_number() over () as r,
             case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
b as (select page_id, r, regexp_extract(rest, '^[^/?#]*') as raw, rest from a),
c as (select page_id, r, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
d as (select c.r, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
      from c join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by c.r)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from c left join d using (r)
"""
