"""URL filtering by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions "host suffix + path prefix" that a
rule could be written as. Expressions and rules meet in an equi-join on a short
hash prefix; the full digest confirms a match, and the longest rule decides.
Suffixes and prefixes are cut only at the label counts and path lengths that
some rule has, so a URL with thousands of labels expands no further than the
rules ask for. Distinct URLs are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHORT_HEX = 8      # the short prefix: 32 bits


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_verdict string, rule_host string, rule_path string")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring_index(_rest(url), "/", 1)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when(_has_scheme(url), F.translate(
        rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(_has_scheme(url) & (F.instr(rest, "/") > 0),
                  F.concat(F.lit("/"), _after(rest, "/"))).otherwise("")


def _has_scheme(url: Column) -> Column:
    return F.coalesce(F.instr(url, "://") > 0, F.lit(False))


def _after(text: Column, mark: str) -> Column:
    return text.substr(F.instr(text, mark) + len(mark), F.length(text))


def _rest(url: Column) -> Column:
    return _after(url, "://")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule (host and path together) wins, of equally long ones the
    first by code point. URLs that no rule fits get ``default`` and a null rule.

    A null URL, or one without ``://``, has an empty host and path and fits no
    rule. Repeated rows each get their row; null ids are carried through. Other
    columns are ignored, whatever their names; empty tables are fine.
    """
    rule = F.concat("rule_host", "rule_path")
    wanted = rules.select("rule_verdict", "rule_host", "rule_path").filter(
        "rule_host is not null and rule_path is not null").dropDuplicates().select(
        "rule_verdict", rule.alias("rule"),
        F.sha2(rule, 256).alias("rule_digest"),
        F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("length"))
    # How rules are cut: a few small integers, at most as many as a host has labels
    # or a path has characters.
    cuts = wanted.agg(F.array_sort(F.collect_set("labels")).alias("labels"),
                      F.array_sort(F.collect_set("length")).alias("lengths"))
    one = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = one.filter("url is not null").select("url").distinct().select(
        "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).filter("host <> ''")
    parts = urls.withColumn("n", F.size(F.split("host", r"\.")))
    hosts = parts.select("url", "host", "path", "n",
                         F.explode(cuts.select("labels").scalar()).alias("labels")).filter("labels <= n")
    expressions = hosts.select(
        "url", F.expr("substring_index(host, '.', -labels)").alias("suffix"), "path",
        F.explode(cuts.select("lengths").scalar()).alias("length")).filter("length <= length(path)").select(
        "url", F.sha2(F.concat("suffix", F.expr("substring(path, 1, length)")), 256).alias("digest"))
    short = lambda c: F.substring(c, 1, SHORT_HEX)
    found = (expressions.withColumn("short", short("digest"))
             .join(wanted.withColumn("short", short("rule_digest")), "short")
             .filter("digest = rule_digest")
             .groupBy("url").agg(F.min_by(F.struct("rule", "rule_verdict"),
                                          F.struct(-F.length("rule"), F.col("rule"), F.col("rule_verdict")))
                                 .alias("hit")))
    return one.join(found, "url", "left").select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.rule_verdict"), F.lit(default)).alias("verdict"))
