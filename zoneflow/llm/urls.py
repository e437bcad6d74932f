"""URL rules by host suffixes and path prefixes.

Each distinct (host, path) is expanded into the expressions a rule could be filed under: every host
suffix of at most as many labels as a rule has, joined with every path prefix that ends in ``/`` (and
the empty one). Expressions meet rules by an equi-join on four bytes of a SHA-256 digest; the full
digest, the rest of the rule's path and the precedence of rules are checked afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8  # hexadecimal digits of the short digest
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    rows = [
        F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
        for v, h, p in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _digest(host: Column, directory: Column) -> Column:
    # A host holds no slash, and a directory is empty or begins with one.
    return F.sha2(F.concat(host, directory), 256)


def url_verdicts(
    pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per distinct (host, path): ``host``, ``path``, ``rule``, ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of several, the
    one with the longest host and path together wins, then the longer host, then ``block``. Without
    one, ``rule`` is null and ``verdict`` is ``default``. A null url, or one without ``://``, has an
    empty host and path. Rules may repeat; rows of a rule with a null column are passed over.
    """
    rules = rules.select(
        "verdict", F.translate("host", UPPER, LOWER).alias("host"), "path"
    ).dropna().distinct()
    filed = rules.select(
        "verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
        _digest(F.col("host"), _directory(F.col("path"))).alias("rule_digest"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.size(F.split("path", "/")).alias("levels"),
    )
    # Two numbers: how deep an expression must go to reach every rule.
    labels, levels = filed.agg(F.max("labels"), F.max("levels")).first()
    filed = filed.drop("labels", "levels").withColumn(
        "short", F.substring("rule_digest", 1, PREFIX_HEX)
    )
    places = pages.select(
        url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path")
    ).distinct()
    host_parts, path_parts = F.split("host", r"\."), F.split("path", "/")
    n_hosts = F.least(F.size(host_parts), F.lit(labels or 1))
    suffixes = F.transform(
        F.sequence(F.lit(1), n_hosts),
        lambda k: F.array_join(F.slice(host_parts, -k, k), "."),
    )
    n_paths = F.least(F.size(path_parts), F.lit(levels or 1))
    prefixes = F.transform(
        F.sequence(F.lit(1), n_paths),
        lambda k: F.when(k == 1, "").otherwise(
            F.concat(F.array_join(F.slice(path_parts, 1, k - 1), "/"), F.lit("/"))
        ),
    )
    # The directory "" is in every list once; "/" follows where the path has a slash.
    expressions = F.flatten(F.transform(
        suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))
    ))
    expanded = places.select("host", "path", F.explode(expressions).alias("digest")).withColumn(
        "short", F.substring("digest", 1, PREFIX_HEX)
    )
    hits = expanded.join(filed, "short").filter(
        (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
        & ((F.col("host") == F.col("rule_host"))
           | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host"))))
    )
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("total"),
        F.length("rule_host").alias("host_length"), "verdict",
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return places.join(best, ["host", "path"], "left").select(
        "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def url_filter(
    pages: DataFrame, rules: DataFrame, url_column: str = "url", id_column: str = "page_id",
    default: str = "allow",
) -> DataFrame:
    """One row per page: the id, ``host``, ``path``, ``rule``, ``verdict`` (see ``url_verdicts``).

    Repeated rows stay; ids may be null; other columns are not read.
    """
    # A written table: Spark can then split an address that many pages share when it joins.
    verdicts = materialize(url_verdicts(pages, rules, url_column, default))
    return pages.select(
        F.col(id_column), url_host(F.col(url_column)).alias("host"),
        url_path(F.col(url_column)).alias("path"),
    ).join(verdicts, ["host", "path"]).select(id_column, "host", "path", "rule", "verdict")
