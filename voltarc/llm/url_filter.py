"""URL rules by hashed host-suffix and path-prefix expressions.

A rule is a host and a path. It fits a URL whose host is the rule's host or a subdomain of it and
whose path starts with the rule's path. The longest fitting rule decides.

Each distinct (host, path) is expanded into the expressions ``host suffix + path prefix`` whose
two lengths occur among the rules; no other expression can equal a rule. Expressions meet the
rules on a 32-bit prefix of their SHA-256, and the full digest confirms each meeting. Only built-in
functions are used. Repeated URLs are judged once: the distinct step combines before its shuffle,
so a host or URL that holds a third of all rows is small by the time it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltarc.llm.common import LOWER, UPPER, others, shielded

RESULTS = ["host", "path", "rule", "verdict"]
PREFIX_HEX = 8  # hex digits of the digest that are joined on


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table whose size Spark knows."""
    if not rules:
        return spark.sql("SELECT '' host, '' path, '' verdict WHERE false")
    def text(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


@shielded
def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (host + path of the deciding rule, else NULL) and verdict.

    ``rules``: host, path, verdict ("allow" / "block"). A NULL host makes a rule void, a NULL path
    counts as empty. Equal rules with different verdicts block. Of fitting rules of equal length the
    one with the longer host wins, then a blocking one. A NULL URL or one without ``://`` has an
    empty host and path and gets ``default``, as does every URL that no rule fits. Repeated rows
    stay repeated. Input columns named like a result are replaced. An empty table or an empty rule
    list gives the same columns. The rules' distinct (host length, path length) pairs are read by
    the driver: numbers only, as many as the list has shapes.
    """
    keep = others(urls, RESULTS)
    rules = (rules.where("host is not null")
             .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict"))
    shapes = [tuple(r) for r in
              rules.select(F.length("host"), F.length("path")).distinct().collect()]
    placed = urls.select(*keep, F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
                         F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
    if not shapes:
        return placed.select("*", F.lit(None).cast("string").alias("rule"),
                             F.lit(default).alias("verdict"))

    host, path = F.col("host"), F.col("path")
    def expression(h: int, p: int) -> Column:
        fits = (F.length(path) >= p) & ((F.length(host) == h)
                                        | ((F.length(host) > h)
                                           & (F.substr(host, F.length(host) - h, F.lit(1)) == ".")))
        suffix = F.right(host, F.lit(h)) if h else F.lit("")
        return F.when(fits, F.concat(suffix, F.left(path, F.lit(p)) if p else F.lit("")))

    digests = (placed.select("host", "path").distinct()
               .select("host", "path", F.explode(F.array_distinct(F.array_compact(
                   F.array(*[expression(*s) for s in sorted(shapes)])))).alias("_e"))
               .select("host", "path", F.sha2("_e", 256).alias("_full"))
               .withColumn("_short", F.left("_full", F.lit(PREFIX_HEX))))
    listed = (rules.select(F.concat("host", "path").alias("rule"), "verdict",
                           F.struct(F.length(F.concat("host", "path")), F.length("host"),
                                    (F.col("verdict") == "block").cast("int")).alias("_rank"))
              .withColumn("_digest", F.sha2("rule", 256))
              .withColumn("_key", F.left("_digest", F.lit(PREFIX_HEX))))
    best = (digests.join(listed, F.col("_short") == F.col("_key"))
            .where("_full = _digest")
            .groupBy("host", "path")
            .agg(F.max_by(F.struct("rule", "verdict"), "_rank").alias("_best")))
    return (placed.join(best, ["host", "path"], "left")
            .select(*[c for c in keep], "host", "path", F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))
