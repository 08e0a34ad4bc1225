"""URL filters by expression lists (operator 3).

A URL stands for every pair of a suffix of its host (whole labels) and a prefix
of its path. Rules are such pairs too, so a rule fits a URL exactly when one of
the URL's expressions equals it. Expressions and rules meet in an equi-join on
a short prefix of a digest; the full digests are then compared, and of the
rules that fit, the longest wins (of equally long ones the one with the longer
host, then a blocking one). URLs without a fitting rule get the default.

Equal (host, path) pairs are judged once, so many copies of a URL or one very
common host cost one row each before the join; only path prefixes as long as
some rule's path are made (one scalar list, as long as the longest rule path at
most).

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, fits no rule and gets the default; repeated rows are each judged;
an empty rule list or table works; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hexadecimal digits of the digest that the join compares.
SHORT = 8


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the winner, or null) and
    verdict. ``rules`` has host, path and verdict (allow or block)."""
    host, path = free_name(pages, "host"), free_name(pages, "path")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    listed = rules.select(F.col("host").alias("r_host"), F.concat("host", "path").alias("r_rule"),
                          F.col("verdict").alias("r_verdict"), F.sha2(F.concat("host", "path").cast("binary"), 256).alias("r_digest"))
    listed = listed.withColumn("short", F.substring("r_digest", 1, SHORT))

    named = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    once = named.select(F.col(host).alias("host"), F.col(path).alias("path")).where(F.col(host) != "").distinct()
    expressions = once.withColumn("suffix", F.explode(_suffixes(F.col("host")))).withColumn("n", F.explode(prefixes))
    expressions = expressions.select("host", "path", F.sha2(F.concat(
        "suffix", F.substr(F.col("path"), F.lit(1), F.col("n"))).cast("binary"), 256).alias("digest"))
    expressions = expressions.withColumn("short", F.substring("digest", 1, SHORT))
    fits = expressions.join(listed, "short").where(F.col("digest") == F.col("r_digest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        F.length("r_rule").alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"),
        F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    b_host, b_path, won = (free_name(named, c) for c in ("b_host", "b_path", "best"))
    best = best.select(F.col("host").alias(b_host), F.col("path").alias(b_path), F.col("best").alias(won))
    out = named.join(best, (F.col(host) == F.col(b_host)) & (F.col(path) == F.col(b_path)), "left")
    return out.select(*pages.columns, host, path, F.col(won)["rule"].alias(free_name(pages, "rule")),
                      F.coalesce(F.col(won)["verdict"], F.lit(default)).alias(free_name(pages, "verdict")))
