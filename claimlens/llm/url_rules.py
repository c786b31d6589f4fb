"""URL filters (12): a sort-merge range join of reversed-host keys with nested rules, by DataFrame functions only.

A rule (host, path) fits a url whose host is the rule's or a subdomain of it
and whose path starts with the rule's. The canonical key of a host and a path is
the labels in reverse, '/', and the path (``net.example//en/``); a host holds no
'/', so the keys that start with a rule's key are an interval, [key, key + 0xFF)
in byte order, and intervals of one host nest or lie apart. A url asks at one
point for itself and one for each of its parent hosts that has as many labels as
some rule. Points and interval ends are dealt by key ranges and swept in key
order: an opening interval is pushed, a closing one popped, and a point sees the
top of the stack. The stack is kept as window columns -- the running depth and,
for each depth, the rule last pushed there -- and every range starts with the
stack that the ranges before it leave, one row per range.

Each distinct (host, path) is swept once, so a url that a third of all rows hold
is one point; the verdicts go back by a join that Spark may split.

Defined results: a url that is null or has no '://' has an empty host and path,
which no rule fits; of the fitting rules the longest (host and path together)
wins, then the longer host; a rule that is both blocked and allowed blocks;
urls that no rule fits get ``default``. A host keeps a port or a name before
'@', if it has one. Repeated rows are judged each; texts of any length; other
columns are not read; empty tables of pages or rules give an empty result or
``default`` throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.stage import partitions, staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical_key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path), "UTF-8")


def _rules(rules: DataFrame) -> DataFrame:
    """host, path, verdict, rule, key, depth (how many intervals are open inside this one, itself included), labels."""
    host = F.translate("host", _UPPER, _LOWER)
    one = (rules.select(host.alias("host"), "path", "verdict").where("host is not null and path is not null and host != ''")
           .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))  # 'block' comes after 'allow'
    labels = F.split("host", r"\.")
    one = one.select("host", "path", "verdict", F.concat("host", "path").alias("rule"), canonical_key(labels, F.col("path")).alias("key"), F.size(labels).alias("labels"))
    ends = _ends(one.select("host", "key"))
    inside = F.sum("step").over(Window.partitionBy("host").orderBy("at"))  # intervals nest within one host only
    depth = ends.withColumn("depth", inside).where("step = 1").select("key", "depth")
    return one.join(depth, "key")


def _ends(rules: DataFrame) -> DataFrame:
    """A row for each end of an interval: ``at``, and ``step`` 1 where it opens and -1 where it closes."""
    close = F.concat("key", F.unhex(F.lit("FF")))  # a byte that no UTF-8 text holds
    return rules.select("*", F.inline(F.array(F.struct(F.col("key").alias("at"), F.lit(1).alias("step")), F.struct(close.alias("at"), F.lit(-1).alias("step")))))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of every (host, path) of ``urls`` (distinct rows) that a rule fits."""
    rules = staged(_rules(rules), "url-rules")
    shape = rules.agg(F.max("depth"), F.collect_set("labels")).first()  # numbers of labels: 127 at most in a name
    if not shape[0]:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    depth, sizes = shape[0], sorted(shape[1])
    levels = [f"level_{k}" for k in range(1, depth + 1)]

    labels = F.split("host", r"\.")
    parents = F.filter(F.array(*[F.when(F.size(labels) >= n, F.slice(labels, -n, n)) for n in sizes]), lambda x: x.isNotNull())
    points = urls.where("host != ''").select("host", "path", F.explode(parents).alias("parent"))
    points = points.select("host", "path", canonical_key(F.col("parent"), F.col("path")).alias("at"), F.lit(0).alias("step"))
    # at equal keys an opening interval comes before a point; a closing one equals no other key
    top = F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "rule", "verdict")
    ends = _ends(rules).select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "at", "step",
                               *[F.when((F.col("step") == 1) & (F.col("depth") == k), top).alias(name) for k, name in enumerate(levels, 1)])
    spread = (points.unionByName(ends, allowMissingColumns=True).repartitionByRange(partitions(urls.sparkSession), "at", F.xxhash64("host", "path"))
              .withColumn("slice", F.spark_partition_id()))
    # Written: the ranges are those of one sampling, whatever is read again later.
    spread = staged(spread, "url-sweep")

    # What each range leaves to those after it: one row per range.
    last = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col("at"))).alias(name) for name in levels]
    left = spread.groupBy("slice").agg(F.sum("step").alias("open"), *last)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = left.select("slice", F.coalesce(F.sum("open").over(before), F.lit(0)).alias("open"),
                        *[F.last(name, ignorenulls=True).over(before).alias(f"from_{name}") for name in levels])

    sweep = Window.partitionBy("slice").orderBy("at", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [F.coalesce(F.last(name, ignorenulls=True).over(sweep), F.col(f"from_{name}")).alias(name) for name in levels]
    swept = (spread.join(start, "slice").select("host", "path", "step", (F.col("open") + F.sum("step").over(sweep)).alias("now"), *stack)
             .where("step = 0 and now > 0"))
    top = reduce(lambda rest, k: F.when(F.col("now") == k, F.col(levels[k - 1])).otherwise(rest), range(1, depth + 1), F.lit(None))
    # A group holds the points of one url: as many as there are numbers of labels.
    return swept.groupBy("host", "path").agg(F.max(top).alias("top")).select("host", "path", "top.rule", "top.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``rules``: rows of verdict, host, path."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = matches(parts.select("host", "path").distinct(), rules)
    return parts.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
