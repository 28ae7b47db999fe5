"""URL filters: a sort-merge range join of urls with nested host and path rules, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path. Hosts are compared with
their labels reversed, so a host and its subdomains share a prefix; for each number of labels that rules have, the url's host
is cut to so many labels, and (reversed cut host, path) turns each rule into an interval [path, path + 0xFF) of binary paths
within one host. Intervals nest or are disjoint. One sort of rule openings, urls and rule ends sweeps each host: a running sum
of +1 and -1 is the height of the stack of open rules, and the last rule opened at that height is its top, the longest that
fits. Hosts with many urls are dealt over `salts` sweeps that each get the host's rules, LEAST_SALTS or one for each SWEEP pages if not given.

Rows with a null url, or one without "://", have an empty host and path and meet no rule. Repeated rows, and rows with a null page_id, stay; other
columns of the input are dropped. Urls may have any length. An empty table gives an empty result; without rules all get `default`.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: verdict, host, path
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


LEAST_SALTS, SWEEP = 256, 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _heights(rules: DataFrame) -> DataFrame:
    """Rules with level, the number of rules of the same host whose path starts theirs, themselves included."""
    lo = rules.select("host", "path", "rule", "verdict", F.col("path").cast("binary").alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"))
    hi = rules.select("host", "path", "rule", "verdict", F.concat(F.col("path").cast("binary"), F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"))
    w = Window.partitionBy("host").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lo.unionByName(hi).withColumn("level", F.sum("step").over(w))


def match(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, default: str = "allow", salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row. Longest rule wins, counted over host and path; of equal lengths that with the longer host. No rule: `default`."""
    spark = pages.sparkSession
    salts = salts or max(LEAST_SALTS, -(-pages.count() // SWEEP))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", "host", "path", F.concat("host", "path").alias("rule")).groupBy("host", "path", "rule").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("labels", F.size(F.split("host", r"\.")))
    host, path = split_url(F.coalesce(F.col("url"), F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")).withColumn("best", F.lit(None).cast("struct<size:int,hostsize:int,rule:string,verdict:string>"))
    rows = rows.withColumn("turned", F.reverse(F.split("host", r"\.")))
    for depth in sorted(r[0] for r in rules.select("labels").distinct().collect()):
        events = _heights(rules.where(F.col("labels") == depth))
        highest = events.agg(F.max("level")).first()[0]
        opened = events.select(
            F.reverse(F.split("host", r"\.")).alias("cut"), "key", "kind", "step", F.when(F.col("kind") == 0, F.col("level")).alias("level"),
            F.struct(F.length("rule").alias("size"), F.length("host").alias("hostsize"), "rule", "verdict").alias("top"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        )
        cut = F.when(F.size("turned") >= depth, F.slice("turned", 1, depth)).otherwise(F.array(F.lit("")))
        urls = rows.select("*", cut.alias("cut"), F.col("path").cast("binary").alias("key"), F.lit(1).alias("kind"))
        w = Window.partitionBy("cut", "salt").orderBy("key", "kind")
        swept = urls.unionByName(opened, allowMissingColumns=True).withColumn("height", F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
        top = F.lit(None)
        for level in range(1, highest + 1):
            last = F.last(F.when(F.col("level") == level, F.col("top")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            top = F.when(F.col("height") == level, last).otherwise(top)
        best = F.when(F.col("best").isNull() | (F.col("found.size") > F.col("best.size")) | ((F.col("found.size") == F.col("best.size")) & (F.col("found.hostsize") > F.col("best.hostsize"))), F.coalesce("found", "best")).otherwise(F.col("best"))
        rows = swept.withColumn("found", top).where(F.col("kind") == 1).select("page_id", "host", "path", "salt", "turned", best.alias("best"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
