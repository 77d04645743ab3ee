"""URL filters: host-suffix and path-prefix expressions against a rule list.

Every URL is expanded into the expressions a rule could have (each suffix of its
host at a dot, joined with each prefix of its path that has the length of some
rule's path). Expressions meet rules in an equi-join on the first four bytes of
their SHA-256; the full digest then confirms, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rule lists up to so many rules are sent to every task; longer ones are joined by a shuffle.
MOST_SENT = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. Null or no `://`: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_sent: int = MOST_SENT
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    A rule fits its host and all subdomains if the path starts with the rule's
    path; of several, the longest (host and path together) wins, then the longer
    host, then block before allow. No rule: rule is null, verdict is ``default``.
    Null URLs have an empty host and path, which no rule with a host fits. Other
    columns are ignored. Rows of one id are judged one by one and all returned,
    since nothing is grouped by id. Up to ``most_sent`` rules are broadcast, more
    are joined by a shuffle.
    """
    spark = pages.sparkSession
    listed = spark.createDataFrame(
        [(h.lower() + p, v, h.lower(), p) for v, h, p in rules], "expression string, verdict string, rule_host string, rule_path string"
    ).select(
        F.substring(F.sha2("expression", 256), 1, 8).alias("short"),
        F.sha2("expression", 256).alias("digest"),
        F.struct(
            F.length("expression").alias("size"),
            F.length("rule_host").alias("host_size"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("rule_host", "rule_path").alias("rule"),
            "verdict",
        ).alias("found"),
    )
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in rules})]) if rules else F.array().cast("array<int>")
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(lengths, lambda n: n <= F.length("path"))
    expressions = F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(fits, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n))))))
    sent = F.broadcast(listed) if len(rules) <= most_sent else listed
    # A row's expressions fold back onto the row, told apart by number even where ids repeat.
    return (
        urls.withColumn("row", F.monotonically_increasing_id())
        .withColumn("expression", F.explode_outer(expressions))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, 8))
        .join(sent.withColumnRenamed("digest", "rule_digest"), "short", "left")
        .groupBy("row", id_col, "host", "path")
        .agg(F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))).alias("found"))
        .select(id_col, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
    )
