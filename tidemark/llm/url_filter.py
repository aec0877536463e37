"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes of their digests.

A URL is expanded into every (host suffix, path prefix) pair whose shape (labels in the host, characters in the path)
occurs among the rules. Each pair is hashed; an equi-join on the first digest characters finds candidate rules,
the full digest confirms them, and the longest rule decides. Verdicts are a function of the URL, so they are worked
out once per distinct URL and joined back; a URL that many rows repeat is one row until that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, stored

#: Hex characters of the digest that the equi-join uses.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`.

    `rules`: host, path, action (allow or block). A rule fits its host and all subdomains where the path starts
    with the rule's. The longest rule (host and path together) wins; equal lengths: the longer host, then block.
    A null URL or one without `://` has an empty host and path and fits no rule with a host. Repeated rows and ids
    stay; an empty table gives no rows; other columns of `pages` are not read. The rule shapes collected to the
    driver are pairs of small numbers (labels of a host, length of a path), not rules.
    """
    hashed = rules.select(
        F.translate(F.col("host"), UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.lower("action").alias("rule_action")
    ).dropDuplicates()
    hashed = hashed.withColumn("full", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("full", 1, PREFIX))
    shapes = hashed.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()
    distinct = pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    split = distinct.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    labels = F.split("host", r"\.")
    # one struct for each rule shape: the last `labels` labels of the host, the first `chars` characters of the path
    pairs = [
        F.when(
            (F.size(labels) >= s.labels) & (F.length("path") >= s.chars),
            _digest(F.array_join(F.slice(labels, -s.labels, s.labels), "."), F.substring(F.col("path"), 1, s.chars)),
        )
        for s in shapes
    ] or [F.lit(None).cast("string")]
    expanded = split.select("url", F.explode(F.array_distinct(F.array_compact(F.array(*pairs)))).alias("full"))
    candidates = expanded.withColumn("short", F.substring("full", 1, PREFIX)).withColumnRenamed("full", "own")
    confirmed = candidates.join(hashed, "short").where(F.col("own") == F.col("full"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("both"), F.length("rule_host").alias("host"), F.when(F.col("rule_action") == "block", 1).otherwise(0).alias("block")
    )
    best = confirmed.groupBy("url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_action").alias("verdict")), rank).alias("best"))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    # a URL that many rows have, and null, are salted; only URLs that a rule fits come back
    return salted_join(rows, stored(best, "verdicts"), ["url"], F.xxhash64(F.col(id_col)), "left").select(
        F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
