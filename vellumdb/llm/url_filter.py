"""URL filtering with allow and block rules, in DataFrame operations only.

A rule is a canonical URL start (host, then path); it fits the host and all subdomains
where the path starts with the rule's.  Each distinct (host, path) is turned into the
canonical starts that a rule could have: the host's last labels and the path's first
characters, for the (labels, length) shapes that occur in the list.  A blocked Bloom
filter of the listed starts passes possible hits to an exact hash join, which removes
false positives; the longest rule wins.  A URL without a listed start is allowed.

Only distinct (host, path) pairs are shuffled, after map-side combining, so a hot host
costs no more than its distinct paths.  URLs without a host take part in no join.  Filter,
rules and the verdicts of pairs that a rule fits are counted and broadcast up to
``BROADCAST_ROWS``; beyond that the rules' join shuffles, and URLs meet the verdicts dealt
out by pair and one of ``SALTS`` parts, so no hot URL meets in one task.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no
rule; rules of equal length: the longer host, then block; repeated rows are judged each;
an empty list allows everything; other columns are kept out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._common import BROADCAST_ROWS, stored

#: More shapes than this are not listed in the plan: all starts are probed instead.
MOST_SHAPES = 256
#: Parts of the URLs of one (host, path), each with its copy of the verdict.
SALTS = 16


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.lit(2**31 - 1)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def parsed(rules: DataFrame) -> DataFrame:
    """(rule, action) to one row for each rule string: start, verdict, labels, chars."""
    host = F.substring_index("rule", "/", 1)
    start = F.concat(lower_ascii(host), F.substring(F.col("rule"), F.length(host) + 1, F.lit(2**31 - 1)))
    rows = rules.where("rule IS NOT NULL AND rule != ''").select(start.alias("start"), "rule", (F.col("action") == "block").alias("block"), F.size(F.split(host, "\\.")).alias("labels"), (F.length("rule") - F.length(host)).alias("chars"))
    best = F.max(F.struct("block", "rule", "labels", "chars"))
    return rows.groupBy("start").agg(best.alias("r")).select("start", "r.*")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rules = parsed(rules)
    n = rules.count()
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    if not n:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    shapes = rules.select("labels", "chars").distinct().limit(MOST_SHAPES + 1).collect()
    if len(shapes) <= MOST_SHAPES:
        listed = F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["chars"]).alias("chars")) for r in shapes])
    else:
        listed = F.flatten(F.transform(F.sequence(F.lit(1), F.size(F.split("host", "\\."))), lambda k: F.transform(F.sequence(F.lit(0), F.length("path")), lambda c: F.struct(k.alias("labels"), c.alias("chars")))))
    pairs = urls.select("host", "path").where("host != ''").distinct()
    fits = F.filter(listed, lambda s: (s["labels"] <= F.size(F.split("host", "\\."))) & (s["chars"] <= F.length("path")))
    # a host's last labels and a path's first characters
    starts = F.transform(fits, lambda s: F.concat(F.reverse(F.call_function("substring_index", F.reverse("host"), F.lit("."), s["labels"])), F.substring(F.col("path"), F.lit(1), s["chars"])))
    probes = pairs.select("host", "path", F.explode(F.array_distinct(starts)).alias("start"))
    hits = bloom.build(rules, F.col("start"), n).possible(probes, F.col("start"))
    exact = hits.join(F.broadcast(rules) if n <= BROADCAST_ROWS else rules.hint("shuffle_hash"), "start")
    best = F.max(F.struct(F.length("start").alias("size"), F.expr("length(start) - chars").alias("host_size"), "block", "rule"))
    verdicts = stored(exact.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.block"), "verdicts")
    hosted = urls.where("host != ''")
    if verdicts.count() <= BROADCAST_ROWS:
        judged = hosted.join(F.broadcast(verdicts), ["host", "path"], "left")
    else:
        parts = verdicts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = hosted.withColumn("part", F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(parts, ["host", "path", "part"], "left")
    judged = judged.select("page_id", "host", "path", "rule", F.when(F.col("block"), "block").otherwise("allow").alias("verdict"))
    return judged.unionByName(urls.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule string")
