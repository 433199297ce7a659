"""URL filters by hashed host-suffix and path-prefix expressions.

A URL expands to the expressions (host suffix, path prefix) that a rule could
be: only suffixes of as many labels and prefixes of as many characters as some rule has. Each
is joined with the rules on the first 32 bits of its SHA-256; the full
digests confirm a match. The rule with the longest text wins, then the one with
the longer host, then block before allow.

While the rules have few shapes and fit a broadcast, each shape is one join of the
pages, so that no page is shuffled. Otherwise the expressions are exploded and
joined once, and since verdicts depend on the URL alone, they are found once for each distinct one.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
matches no rule and gets the default verdict; repeated rows are all returned;
an empty table or rule list gives an empty result or defaults. Of rules with one host and
path, block comes before allow. Columns host, path, rule and verdict of the input
give way to those of the result; others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, stored

UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER_LETTERS, LOWER_LETTERS), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filters(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", broadcast_rows: int = 100_000, most_shapes: int = 16) -> DataFrame:
    """``pages`` with host, path, rule (null for none) and verdict.

    ``rules`` has verdict, host and path. Its distinct shapes (labels of the
    host, characters of the path) come to the driver; hosts have at most 127
    labels and paths are short, so they are few. The rules are broadcast if
    they are at most ``broadcast_rows`` (a digest and two short strings each).
    """
    rules = rules.select("verdict", F.translate("host", UPPER_LETTERS, LOWER_LETTERS).alias("host"), "path").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shapes = sorted((r[0], r[1]) for r in rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect())
    listed = rules.select(
        F.col("verdict").alias("_verdict"), F.concat("host", "path").alias("_rule"), F.length("host").alias("_wide"),
        _expression(F.col("host"), F.col("path")).alias("_digest"),
    ).withColumn("_short", F.substring("_digest", 1, 8))
    host, path = parts(F.col(url))
    few = listed.count() <= broadcast_rows
    if few and len(shapes) <= most_shapes:
        return _joined_by_shape(pages, rules, shapes, url, default)
    # one row for each URL, so that a hot one is expanded once
    urls = pages.select(F.col(url).alias("_url")).filter("_url IS NOT NULL").distinct().withColumn("_host", parts(F.col("_url"))[0]).withColumn("_path", parts(F.col("_url"))[1]).withColumn("_labels", F.split("_host", r"\."))
    fits = [
        F.when((F.size("_labels") >= labels) & (F.length("_path") >= chars), _expression(F.array_join(F.slice("_labels", -labels, labels), "."), F.substring("_path", 1, chars)))
        for labels, chars in shapes
    ]
    expanded = urls.select("_url", F.explode(F.array_compact(F.array(*fits))).alias("_full")) if fits else urls.select("_url", F.lit("").alias("_full")).limit(0)
    side = F.broadcast(listed) if few else listed
    hits = expanded.withColumn("_short", F.substring("_full", 1, 8)).join(side, "_short").filter("_full = _digest")
    url_name, best_name = fresh(pages.columns, "a_url", "a_best")
    best = F.max(F.struct(F.length("_rule").alias("n"), F.col("_wide"), F.col("_verdict"), F.col("_rule"))).alias(best_name)
    # written first, so that the last join stands alone in its stage and Spark can split a hot URL's rows
    found = stored(hits.groupBy(F.col("_url").alias(url_name)).agg(best))
    rows = pages.join(found, pages[url] == found[url_name], "left")
    return _result(rows, pages, host, path, F.col(best_name)["_rule"], F.col(best_name)["_verdict"], default)


def _result(rows: DataFrame, pages: DataFrame, host: Column, path: Column, rule: Column, verdict: Column, default: str) -> DataFrame:
    others = [pages[c] for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return rows.select(*others, host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))


def _joined_by_shape(pages: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], url: str, default: str) -> DataFrame:
    """Each shape of rules joined with the pages' one expression of that shape, and the best of the matches."""
    host, path = parts(F.col(url))
    labels = F.split(host, r"\.")
    rows, best = pages, []
    for k, (n, chars) in enumerate(shapes):
        short, full, match = fresh(pages.columns, f"short_{k}", f"full_{k}", f"match_{k}")
        mine = F.when((F.size(labels) >= n) & (F.length(path) >= chars), _expression(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, chars)))
        digest = _expression(F.col("host"), F.col("path"))
        rule = F.concat("host", "path")
        of = rules.filter((F.size(F.split("host", r"\.")) == n) & (F.length("path") == chars))
        of = of.select(F.substring(digest, 1, 8).alias(short), digest.alias(full), F.struct(F.length(rule).alias("n"), F.length("host").alias("wide"), "verdict", rule.alias("rule")).alias(match))
        rows = rows.join(F.broadcast(of), (F.substring(mine, 1, 8) == F.col(short)) & (mine == F.col(full)), "left")
        best.append(F.col(match))
    top = F.array_max(F.array(*best)) if best else F.lit(None).cast("struct<n:int,wide:int,verdict:string,rule:string>")
    return _result(rows, pages, host, path, top["rule"], top["verdict"], default)
