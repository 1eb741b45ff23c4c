"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes.

A url is expanded into expressions ``host suffix + path prefix``; each is hashed with
SHA-256 and meets the rules by equality on the first four bytes of the digest.  A hit
counts only if the full digests agree.  Of several rules the longest expression decides,
then the longer host.

Defined cases: a null url, or one without ``://``, has an empty host and path and meets
no rule.  A rule with an empty path fits every path.  Two rules with one expression: the
blocking one holds.  Without any fitting rule the verdict is ``default`` (allow).
Repeated rows are judged alike and each is returned.  Extra columns of the input are
kept unless they have the name of a result column, in which case the result replaces them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.operators.joins import lookup_join

PREFIX_HEX = 8  # four bytes
RESULT = ["host", "path", "rule", "verdict"]
# Fixed values of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(_lower_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) as one row per digest prefix, with their full digests."""
    host = _lower_ascii(F.coalesce(F.col("host"), F.lit("")))
    path = F.coalesce(F.col("path"), F.lit(""))
    one = (
        rules.select(host.alias("host"), path.alias("path"), "action")
        .where((F.col("host") != "") & F.col("action").isin("allow", "block"))
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))
    )
    rule = F.concat("host", "path")
    return (
        one.withColumn("digest", F.sha2(rule, 256))
        .groupBy(F.substring("digest", 1, PREFIX_HEX).alias("prefix"))
        .agg(
            F.collect_list(
                F.struct(
                    "digest", F.length(rule).alias("size"), F.length("host").alias("host_size"),
                    rule.alias("rule"), "action",
                )
            ).alias("rules")
        )
    )


def _expressions(host: Column, path: Column, label_counts: list[int], path_sizes: list[int]) -> Column:
    """All expressions of a url that a rule of these shapes could have."""
    labels = _labels(host)
    n = F.size(labels)
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(c) for c in label_counts]), lambda c: c <= n),
        lambda c: F.array_join(F.slice(labels, n - c + 1, c), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(s) for s in path_sizes]), lambda s: s <= F.length(path)),
        lambda s: F.substring(path, F.lit(1), s),
    )
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Urls are judged once each, so a url that holds a third of all rows is one row of the
    expansion.  The rules are broadcast only if measured small; else the join is salted.
    The shapes fetched to the driver are distinct small numbers: label counts and path lengths.
    """
    shapes = (
        rules.agg(
            F.collect_set(F.size(_labels(F.coalesce("host", F.lit(""))))).alias("labels"),
            F.collect_set(F.length(F.coalesce("path", F.lit("")))).alias("paths"),
        ).first()
    )
    kept = [c for c in pages.columns if c not in RESULT]
    pages = pages.select(*kept)
    best = None
    if shapes["labels"] and shapes["paths"]:
        urls = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("_url")).distinct()
        expressions = _expressions(
            host_of(F.col("_url")), path_of(F.col("_url")), sorted(shapes["labels"]), sorted(shapes["paths"])
        )
        asked = (
            urls.withColumn("_expression", F.explode(F.array_distinct(expressions)))
            .select("_url", F.sha2("_expression", 256).alias("digest"))
            .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
        )
        hit = F.explode(F.filter("rules", lambda r: r["digest"] == F.col("digest")))
        best = (
            lookup_join(asked, compile_rules(rules), "prefix", "_url")
            .select("_url", hit.alias("hit"))
            .groupBy("_url")
            .agg(F.max(F.struct("hit.size", "hit.host_size", "hit.rule", "hit.action")).alias("_best"))
        )
    if best is None:
        judged = pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    else:
        judged = pages.join(best, pages[url] == best["_url"], "left").select(
            *[pages[c] for c in kept],
            F.col("_best.rule").alias("rule"),
            F.coalesce("_best.action", F.lit(default)).alias("verdict"),
        )
    return judged.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return f"""
with rules(rule_host, rule_path, action) as (values {values}),
cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), parts as (
  select page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from cut
), fits as (
  select page_id, host, path, rule_host || rule_path as rule, action,
         row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) as rn
  from parts left join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from fits where rn = 1"""


SQL = {"op10_url_filter": _sql()}
