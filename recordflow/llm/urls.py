"""URL filters: rules on hosts and paths, found by hashed expressions. Native columns only.

A URL is expanded into the expressions ``host suffix + path prefix`` that a rule on it could be
written as. Expressions meet the rules in an equi-join on a short hash prefix; the full digest of
the survivors is then compared, and of several rules that fit the longest one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import fold

#: Hex digits of the digest that the join compares; the digest itself is confirmed afterwards.
SHORT = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return fold(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A line feed never occurs in a host, so host and path cannot run into one another.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _expressions(urls: DataFrame, lengths: list[int], labels: list[int]) -> DataFrame:
    """One row per host suffix and path prefix of (host, path), of the numbers of labels and the
    lengths that rules have."""
    held = F.size(F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[
        F.when(held >= n, F.substring_index("host", ".", -n)) for n in labels]).cast("array<string>"))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    return (urls.select("host", "path", F.explode(suffixes).alias("_on"))
            .select("*", F.explode(sizes).alias("_size"))
            .withColumn("_digest", _digest(F.col("_on"), F.expr("substring(path, 1, _size)"))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains where the URL's
    path starts with the rule's. The longest rule (host and path together, then the longer host)
    wins; of equal ones with both verdicts, ``block`` wins. Where no rule fits, ``rule`` is NULL
    and the verdict ``default``. A NULL URL, or one without ``://``, has empty host and path.
    Every row keeps its place; columns of ``pages`` with the names of the result are replaced.
    Rules with a NULL host or path are left out; an empty rule table gives ``default`` throughout.

    Work is done per distinct (host, path), so rows with one URL cost one look-up. The lengths of
    rule paths and the numbers of labels of rule hosts, at most as many as the longest path has
    characters and the longest host labels, are read first; a URL gives no other expressions, so a
    host of very many labels costs no more than its length.
    """
    rules = (rules.where("host is not null and path is not null and verdict is not null")
             .select(fold(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"),
                     F.col("verdict").alias("rule_verdict")))
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    labels = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect())
    base = pages.drop("host", "path", "rule", "verdict")
    base = base.select(*(F.col(f"`{c}`") for c in base.columns),
                       host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = (rules.withColumn("_rule_digest", _digest(F.col("rule_host"), F.col("rule_path")))
             .groupBy("rule_host", "rule_path", "_rule_digest")
             .agg(F.max("rule_verdict").alias("rule_verdict"))
             .withColumn("_short", F.substring("_rule_digest", 1, SHORT)))
    found = (_expressions(base.select("host", "path").distinct(), lengths, labels)
             .withColumn("_short", F.substring("_digest", 1, SHORT))
             .join(known, "_short").where("_digest = _rule_digest"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"),
                    F.length("rule_host").alias("host_size"))
    best = (found.groupBy("host", "path")
            .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"),
                                   F.col("rule_verdict").alias("verdict")), rank).alias("_best"))
            .select("host", "path", "_best.rule", "_best.verdict"))
    return (base.join(best, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("verdict", F.lit(default))))
