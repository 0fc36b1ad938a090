"""URL filters by host-suffix and path-prefix expressions, native DataFrame code throughout.

A rule is a host and the beginning of a path; it fits its host and all subdomains. A URL is expanded into one
expression per number of host labels and length of path that any rule has, so a URL has as many expressions as the
rules have shapes, however long it is. Expressions meet rules in an equi-join on the first PREFIX_BITS bits of a
SHA-256 digest; the full digest then confirms. The longest rule wins; of equally long ones the longer host, then
block before allow, then the lesser rule.

Work is done once per distinct URL: copies are merged before anything is expanded, and verdicts come back by an outer
join on the URL, which adaptive execution splits where a URL is very common. Rules may outgrow a broadcast: Spark
chooses by their size.

A null URL or one without :// has an empty host and path; no rule fits an empty host. Rules with nulls or an empty
host are ignored. Repeated pages are judged each. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_BITS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    """Host and path are parted by a byte that neither holds."""
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def _key(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_BITS // 4)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with rules (host, path, verdict): id_col, host, path, rule, verdict."""
    listed = rules.where("host <> '' and path is not null and verdict is not null").select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    digested = listed.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("key", _key(F.col("digest")))
    # one row with the shapes that the rules have: two integers each, at most as many as lengths of hosts times paths
    shapes = listed.select(_labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("chars")).distinct()
    shapes = shapes.agg(F.collect_list(F.struct("labels", "chars")).alias("shapes"))
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = narrow.where("url is not null").select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    fits = F.filter("shapes", lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["chars"] <= F.length("path")))
    expressions = urls.crossJoin(F.broadcast(shapes)).select("url", "host", "path", F.explode(fits).alias("s"))
    suffix = F.expr("substring_index(host, '.', -s.labels)")
    beginning = F.expr("substring(path, 1, s.chars)")
    keyed = expressions.select("url", _digest(suffix, beginning).alias("digest")).withColumn("key", _key(F.col("digest")))
    hits = keyed.withColumnRenamed("digest", "seen").join(digested, "key").where("seen = digest")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"),
        F.length("rule_host").alias("host_length"),
        (F.col("verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("verdict"),
    )
    won = hits.groupBy("url").agg(F.max(rank).alias("won"))
    return (
        narrow.join(won, "url", "left")
        .select(
            F.col("id").alias(id_col),
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            F.col("won.rule").alias("rule"),
            F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
        )
    )


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(host and path, verdict) pairs, such as ("example.org/en/1", "block")."""
    rows = [(host, "/" + path, verdict) for text, verdict in rules for host, _, path in [text.partition("/")]]
    parts = [spark.range(1).select(*(F.lit(v).alias(c) for v, c in zip(row, ("host", "path", "verdict"), strict=True))) for row in rows]
    return reduce(DataFrame.unionByName, parts) if parts else spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
