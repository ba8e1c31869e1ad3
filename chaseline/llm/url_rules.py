"""URL filters by a sort-merge range join (operator 9), with SQL functions only.

A host is written backwards by its labels (``net.example.www.``), so a rule's host and
all its subdomains are one interval of keys. Intervals nest or are apart; between two
neighbouring ends the same rules are active, a stack. The sweep sorts the pages' keys
among the ends and lets each key see the stack of the last end before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rules as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a url; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.net`` as ``net.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = [F.struct(*(F.lit(x).alias(n) for x, n in zip(rule, ("verdict", "host", "path"), strict=True))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def stacks(rules: DataFrame) -> DataFrame:
    """``key, stack``: the rules active from each interval end on, longest first, ties by rule text then verdict."""
    rules = rules.select(host_key(F.col("host")).alias("start"), F.struct((-F.char_length(F.concat("host", "path"))).alias("order"), F.concat("host", "path").alias("rule"), "verdict", "path").alias("entry")).distinct()
    hosts = rules.groupBy("start").agg(F.collect_set("entry").alias("own"))
    ends = hosts.select(F.explode(F.array("start", F.concat(F.expr("substr(start, 1, length(start) - 1)"), F.lit("/")))).alias("key")).distinct()
    # An end lies within exactly those intervals whose start is a whole-label prefix of it: an equi-join on its prefixes.
    labels = F.split(F.expr("substr(key, 1, length(key) - 1)"), r"\.")
    shut = F.col("key").endswith("/")  # behind a closed interval, only the shorter prefixes are active
    depth = F.size(labels) - shut.cast("int")
    prefixes = F.transform(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    inside = ends.select("key", F.explode_outer(prefixes).alias("start")).join(hosts, "start", "left")
    return inside.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", salts: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    The longest rule (host and path together) whose host is the url's or a parent of it and
    whose path the url's path starts with gives the verdict; without one ``rule`` is null
    and the verdict ``otherwise``. Two rules of one length: the smaller text, then the
    smaller verdict. Null urls and those without ``://`` fit no rule, for their host is
    empty. Repeated rows and null ids stay; an empty table gives an empty table; other
    columns are not read. Keys are dealt out by a hash of url and id over ``salts`` (default:
    the shuffle partitions) sweeps, each with all interval ends, so a hot host is shared by
    all tasks; the rule list must be small enough to be repeated that often.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.pmod(F.xxhash64(url_col, id_col), F.lit(salts)).cast("int").alias("salt"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("page", F.lit(True))
    ends = stacks(rules).select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", "stack", F.lit(False).alias("page"))
    both = urls.unionByName(ends, allowMissingColumns=True)
    sweep = Window.partitionBy("salt").orderBy("key", "page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("page")
    hit = F.try_element_at(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    found = seen.withColumn("hit", F.when(F.col("host") != "", hit))
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(otherwise)).alias("verdict"))
