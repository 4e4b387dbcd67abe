"""URL filters: a sort-merge range join between reversed-host keys and rule prefixes.

A rule (host, path) covers its host and every subdomain of it, below its path. A url is turned into one
key per suffix of its host: the labels reversed, an end mark, then the path. In the order of these keys
all that a rule covers is one interval that starts at the rule's own key, and intervals nest or are apart.
Keys and rules are sorted together; the sweep carries the rules that were open at the last rule start (a
stack, outermost first), and a key closes those that do not cover it. The innermost left is the longest
rule for that suffix; the longest over a url's suffixes wins.

Repeated urls are swept once, and so is a suffix that many hosts share. Ranges of keys are swept side by side: each begins with the stack of the
last rule start before it. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import pin
from .common import LOWER, UPPER, range_bucket

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Keys whose order gives the bounds of the ranges; it sets their balance, not the result.
SAMPLE = 4096
LABEL_END, HOST_END = "\x01", "\x00"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def key_of(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, LABEL_END), F.lit(HOST_END), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each distinct rule with its key and the rules open at its start, itself last.

    Of rules with the same host and path but different verdicts `block` wins.
    """
    own = (rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("r_host"),
                        F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
           .groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict")))
    starts = own.select("r_host", F.col("r_path").alias("full"), F.explode(
        F.transform(F.sequence(F.lit(0), F.length("r_path")), lambda n: F.substr("r_path", F.lit(1), n))).alias("r_path"))
    return (starts.join(own, ["r_host", "r_path"])
            .groupBy("r_host", "full")
            .agg(F.sort_array(F.collect_list(F.struct(F.length("r_path").alias("n"), "r_host", "r_path", "r_verdict")))
                 .alias("stack"))
            .select(key_of(reversed_labels(F.col("r_host")), F.col("full")).alias("key"), "stack"))


def sweep(probes: DataFrame, stacks: DataFrame, ranges: int) -> DataFrame:
    """Add to each probe (with a column `key`) the stack at the last rule start at or before its key."""
    spark = probes.sparkSession
    sample = [r["key"] for r in probes.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()]
    sample.sort(key=lambda k: k.encode())
    splits = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)} if sample else set(),
                    key=lambda k: k.encode())
    starts = stacks.withColumn("bucket", range_bucket(F.col("key"), splits))
    last = starts.groupBy("bucket").agg(F.max_by("stack", "key").alias("stack"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = (spark.range(len(splits) + 1).select(F.col("id").cast("int").alias("bucket")).join(last, "bucket", "left")
               .select("bucket", F.lit("").alias("key"), F.lit(0).alias("kind"),
                       F.last("stack", True).over(earlier).alias("stack"))
               .where("stack IS NOT NULL"))
    rows = (carried.unionByName(starts.withColumn("kind", F.lit(1)))
            .unionByName(probes.withColumns({"bucket": range_bucket(F.col("key"), splits), "kind": F.lit(2)}),
                         allowMissingColumns=True))
    order = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("stack", F.last("stack", True).over(order))
            .where("kind = 2").drop("bucket", "kind"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
               ranges: int | None = None) -> DataFrame:
    """Add host, path, rule and verdict to every page.

    A url that is null or has no `://` has an empty host and path; an empty host is only covered by a rule
    with an empty host. No rule: `rule` is null and `verdict` is `default`. The longest rule by its host and
    path together wins, then the one with the longer host. Rows are neither dropped nor merged; columns of
    these four names are replaced.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = (pages.drop("host", "path", "rule", "verdict")
              .withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}))
    suffixed = (parsed.select("host", "path").distinct()
                .withColumn("labels", reversed_labels(F.col("host")))
                .select("host", "path", F.explode(F.transform(
                    F.sequence(F.lit(1), F.size("labels")), lambda n: F.slice("labels", F.lit(1), n))).alias("labels"))
                .select("host", "path", "labels", F.array_join(F.reverse("labels"), ".").alias("suffix")))
    # All hosts below one suffix meet a rule alike: each (suffix, path) is swept once, however many hosts there are.
    probes = suffixed.select("suffix", "path", key_of(F.col("labels"), F.col("path")).alias("key")).distinct()
    open_rules = F.filter("stack", lambda s: (s["r_host"] == F.col("suffix")) & F.startswith(F.col("path"), s["r_path"]))
    # Written out: few suffixes have a rule, and by its size Spark plans the join back to their hosts.
    swept = pin(sweep(probes, rule_stacks(rules), ranges).select("suffix", "path", F.try_element_at(open_rules, F.lit(-1)).alias("r"))
                .where("r IS NOT NULL"), "swept")
    text = F.concat("r.r_host", "r.r_path")
    best = (suffixed.select("host", "suffix", "path").join(swept, ["suffix", "path"]).groupBy("host", "path")
            .agg(F.max(F.struct(F.length(text), F.length("r.r_host"), text.alias("rule"), F.col("r.r_verdict").alias("verdict"))).alias("best"))
            .select("host", "path", "best.rule", F.col("best.verdict").alias("verdict")))
    return (parsed.join(best, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
            .select(*[c for c in parsed.columns], "rule", "verdict"))
