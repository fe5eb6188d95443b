"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Every url is expanded into expressions `host suffix || path prefix`. An
expression and a rule meet in an equi-join on the first hex digits of their
SHA-256 digests; the full digest then confirms the match, and of the rules that
fit the longest wins.

Defined results: a url that is null or has no `://` has an empty host and path
and no rule fits it; of two rules of equal length that both fit, the one with
the longer host wins, then `block` over `allow`; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_DIGITS = 8
#: Rule lists of at most so many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_RULES = 200_000


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """All pairs of a host suffix (at label boundaries) and a path prefix of one of the lengths.

    The lengths are those that occur among the rules, so that no prefix which
    no rule can equal is ever hashed.
    """
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(int(n)) for n in path_lengths]), lambda n: n <= F.char_length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct(s.alias("s"), F.substring(path, F.lit(1), n).alias("p")))))
    return F.when(host != "", pairs).otherwise(F.slice(pairs, 1, 0))


def rule_table(rules: DataFrame) -> DataFrame:
    """Digests and precedence of rules (host, path, verdict); equal rules keep `block`."""
    text = F.concat("host", "path")
    return (
        rules.groupBy(ascii_lower(F.col("host")).alias("host"), "path")
        .agg(F.max(F.col("verdict")).alias("verdict"))  # "block" sorts after "allow"
        .select(
            text.alias("rule"),
            "verdict",
            F.char_length("host").alias("host_len"),
            F.char_length(text).alias("rule_len"),
            F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"),
        )
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of those names that `pages` has are replaced.

    Rules are looked up for distinct urls only, so a url that fills a third of
    the table is expanded once; the last join is one that adaptive execution
    can split.
    """
    lengths = [r[0] for r in rules.select(F.char_length("path").alias("n")).distinct().orderBy("n").collect()]
    table = rule_table(rules)
    if rules.count() <= BROADCAST_RULES:
        table = F.broadcast(table)
    urls = (
        pages.select(F.col(url).alias("_url"))
        .where(F.col("_url").isNotNull())
        .distinct()
        .select("_url", F.explode(expressions(url_host(F.col("_url")), url_path(F.col("_url")), lengths)).alias("e"))
        .select("_url", F.sha2(F.concat_ws("\n", "e.s", "e.p"), 256).alias("_digest"))
        .withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS))
    )
    best = (
        urls.join(table, F.col("_short") == F.col("short"))
        .where(F.col("_digest") == F.col("digest"))
        .groupBy("_url")
        .agg(F.max(F.struct("rule_len", "host_len", "verdict", "rule")).alias("_best"))
    )
    out = pages.drop("host", "path", "rule", "verdict")
    return (
        out.join(best, out[url] == best["_url"], "left")
        .withColumns({
            "host": url_host(F.col(url)),
            "path": url_path(F.col(url)),
            "rule": F.col("_best.rule"),
            "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default)),
        })
        .drop("_best", "_url")
    )
