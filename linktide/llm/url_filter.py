"""URL rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.llm.common import others
from linktide.operators.keyed import attach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join compares first.
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substr(known, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _expression(host_length: int, path_length: int) -> Column:
    """Digest of the host suffix and path prefix of these lengths, null if the url has none."""
    host, path = F.col("__host"), F.col("__path")
    longer = F.char_length(host) - host_length
    at_label = (longer == 0) | ((longer > 0) & (F.substr(host, longer, F.lit(1)) == "."))
    fits = at_label & (F.char_length(path) >= path_length)
    suffix = F.substr(host, longer + 1, F.lit(host_length))
    return F.when(fits, _digest(suffix, F.substr(path, F.lit(1), F.lit(path_length))))


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict): the winning rule of each distinct url that a rule fits.

    ``rules`` has (host, path, verdict). A url is expanded into one expression
    for each pair of a host and a path length that occurs among the rules, where
    the host suffix starts at a label. Expressions and rules are joined on the
    first digits of their digests, then full digests are compared. The longest
    rule wins, then the longer host, then block before allow. Only the distinct
    pairs of lengths, bounded by the longest host and path of a rule, reach the
    driver; Spark broadcasts the rules if they are small and else joins by shuffle.
    """
    listed = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("__rule_host"),
        F.coalesce("path", F.lit("")).alias("__rule_path"),
        F.col("verdict"),
    ).withColumn("__rule_digest", _digest(F.col("__rule_host"), F.col("__rule_path")))
    lengths = listed.select(F.char_length("__rule_host"), F.char_length("__rule_path")).distinct().collect()
    host, path = host_and_path(F.col("url"))
    parsed = urls.select("url").where("url is not null").distinct().select(
        "url", host.alias("__host"), path.alias("__path")
    )
    made = F.array_compact(F.array(F.lit(None).cast("string"), *[_expression(*pair) for pair in sorted(lengths)]))
    expressions = parsed.select("url", F.explode(made).alias("__digest"))
    near = expressions.withColumn("__short", F.left("__digest", F.lit(PREFIX))).join(
        listed.withColumn("__short", F.left("__rule_digest", F.lit(PREFIX))), "__short"
    )
    rank = F.struct(
        (F.char_length("__rule_host") + F.char_length("__rule_path")).alias("long"),
        F.char_length("__rule_host").alias("host"),
        (F.col("verdict") == "block").alias("block"),
        F.concat("__rule_host", "__rule_path").alias("rule"),
        F.col("verdict"),
    )
    best = near.where("__digest = __rule_digest").groupBy("url").agg(F.max(rank).alias("__best"))
    return best.select("url", F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Every row with ``host, path, rule, verdict``; where no rule fits, ``otherwise``.

    Null urls and urls without ``://`` have an empty host and path. Repeated rows
    and repeated urls are judged alike; the join back is split where a url is hot.
    """
    given = others(pages, "host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*given)
    joined = attach(rows, matched_rules(rows, rules), ["url"], "left")
    return joined.select(
        *given,
        host.alias("host"),
        path.alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(otherwise)).alias("verdict"),
    )
