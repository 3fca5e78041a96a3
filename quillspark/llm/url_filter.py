"""URL filtering by pattern rules, indexed by the rarest literal token of each rule.

DataFrame functions only: URL tokens fetch candidate rules through an equi-join, and only the fetched candidates
run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh

#: Up to so many rules the index is broadcast (a rule is some hundred bytes); beyond it the joins shuffle.
BROADCAST_RULES = 50_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(text: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9, and the empty token that stands for rules without a literal token."""
    return F.array_distinct(F.concat(F.split(ascii_lower(text), "[^a-z0-9]+"), F.array(F.lit(""))))


def parse_rule(rule: str, action: str) -> dict:
    """A rule ``host/path`` as a row: its regular expression over host + path and the tokens any match must hold whole.

    The last token of a path that does not end in a separator may go on in the url, so it cannot serve as index key.
    """
    host, slash, path = rule.partition("/")
    host = host.lower() if host.isascii() else host
    literal = host + slash + path
    words = re.findall(r"[a-z0-9]+|[^a-z0-9]+", "." + literal.translate({c: c + 32 for c in range(65, 91)}))
    whole = [w for w in words[:-1] if re.fullmatch("[a-z0-9]+", w)]
    quoted = re.sub(r"([^A-Za-z0-9])", r"\\\1", literal)
    return {"rule": rule, "action": action, "rank": len(literal), "pattern": rf"^(?:[^/]*\.)?{quoted}", "tokens": whole or [""]}


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url of ``pages`` by ``rules``, pairs of (action, ``host/path``).

    Adds ``host``, ``path``, ``rule`` (the longest that fits, null if none) and ``verdict`` (its action, else
    ``default``). A rule fits its host and all subdomains if the url's path starts with the rule's path; of two
    equally long rules the smaller string wins, of equal strings the smaller action.

    Edge cases: a null url, or one without ``://``, has empty host and path and gets the default; repeated rows stay
    repeated; an empty table gives an empty one; extra columns pass through, but columns named like the four
    results are replaced.
    """
    spark = pages.sparkSession
    pages = pages.drop(*(c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url_col))
    key, judged = fresh(pages, "_url", "_judged")
    schema = "rule string, action string, rank int, pattern string, tokens array<string>"
    table = spark.createDataFrame([tuple(parse_rule(rule, action).values()) for action, rule in rules], schema)
    near = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)

    # A url is judged once however often it occurs; the distinct combines before it shuffles.
    urls = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("url")).distinct()
    urls = urls.select("url", F.concat(url_host(F.col("url")), url_path(F.col("url"))).alias("target"))
    tokens = urls.select("url", "target", F.explode(url_tokens(F.col("target"))).alias("token"))
    literals = table.select("rule", "action", F.explode("tokens").alias("token"))
    seen = tokens.join(near(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literals.join(seen, "token", "left").groupBy("rule", "action").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = table.drop("tokens").join(rarest, ["rule", "action"])
    hits = tokens.join(near(index), "token").filter(F.expr("target rlike pattern"))
    best = hits.groupBy("url").agg(F.min(F.struct((-F.col("rank")).alias("rank"), "rule", "action")).alias(judged))
    out = pages.withColumn(key, F.coalesce(F.col(url_col), F.lit(""))).join(best.withColumnRenamed("url", key), key, "left")
    return out.select(
        *pages.columns,
        url_host(F.col(key)).alias("host"),
        url_path(F.col(key)).alias("path"),
        F.col(f"{judged}.rule").alias("rule"),
        F.coalesce(F.col(f"{judged}.action"), F.lit(default)).alias("verdict"),
    )
