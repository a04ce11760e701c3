"""URL allow and block rules by a sort-merge range join, with DataFrame functions only.

A host's canonical key is its labels reversed, each followed by a slash, so that a host and all its subdomains are one
interval of keys, and a path prefix of a host is one interval of that host's keys with paths. Such intervals are nested or apart.
A sorted sweep over the ends of intervals and the rows between them keeps a stack: the depth is the running sum of the ends, and what
lies at a level of the stack is the last interval that began at that depth. Rows are dealt by range of key; a range starts with
the depth and the levels that the ranges before it left. A first sweep finds the rule hosts around each page's host, a
second one the innermost path rule of each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storepulse.plans.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """No host holds a slash, so no two hosts have one key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


def path_key(key: Column, path: Column) -> Column:
    """Neither part holds a question mark."""
    return F.concat(key, F.lit("?"), path)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table (verdict, host, path) of rules given as tuples."""
    rows = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules))
    return spark.range(1).select(F.inline(rows)) if rules else spark.createDataFrame([], "verdict string, host string, path string")


def around(rows: DataFrame, intervals: DataFrame, whole_stack: bool) -> DataFrame:
    """id, row, mark: the marks of the intervals around each row, all of them or the innermost, and a null mark where there is none.

    rows has key, id (unique), row; intervals has key (unique), mark, and stands for all keys that begin with its own. A range of keys takes a
    bounded share of rows and ends, however many have one key. What passes from range to range is a number, and a mark for each level."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = lambda name, of: F.lit(None).cast(of.schema[name].dataType).alias(name)
    begin, zero = F.col("key").cast("binary"), F.lit(0).cast("long")
    # no UTF-8 text holds the byte FF, so this is after all keys that begin with the interval's
    end = F.concat(begin, F.unhex(F.lit("FF")))
    entries = (
        rows.select(begin.alias("key"), F.lit(1).alias("side"), "id", F.lit(0).alias("step"), none("mark", intervals), "row")
        .union(intervals.select(begin, F.lit(0), zero, F.lit(1), "mark", none("row", rows)))
        .union(intervals.select(end, F.lit(0), zero, F.lit(-1), none("mark", intervals), none("row", rows)))
    )
    ranged = cut(entries.repartitionByRange(parts, "key", "side", "id").withColumn("range", F.spark_partition_id()), "ranges")
    steps = ranged.groupBy("range").agg(F.sum("step").alias("steps"))
    # one row per range: their number is the shuffle's number of partitions
    before = F.broadcast(steps.select("range", F.coalesce(F.sum("steps").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("before")))
    sweep = Window.partitionBy("range").orderBy("key", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    depth = (F.sum("step").over(sweep) + F.col("before")).cast("int").alias("depth")
    begun = ranged.filter("side = 0").join(before, "range").select("range", "key", "step", "mark", depth).filter("step = 1")
    last = begun.groupBy("range", F.col("depth").alias("level")).agg(F.max_by("mark", "key").alias("mark"))
    until = F.coalesce(F.lead("range").over(Window.partitionBy("level").orderBy("range")), F.lit(parts - 1))
    left = last.withColumn("until", until).filter("range < until").select(F.explode(F.sequence(F.col("range") + 1, F.col("until"))).alias("range"), "level", "mark")
    carried = left.select(F.lit("").cast("binary").alias("key"), F.lit(-1).alias("side"), zero.alias("id"), F.lit(0).alias("step"), "mark", none("row", rows), "range", "level")
    seen = F.sequence(F.lit(1), F.col("depth")) if whole_stack else F.array("depth")
    levels = F.when(F.col("side") == -1, F.array("level")).when(F.col("step") == 1, F.array("depth")).when(F.col("side") == 1, F.when(F.col("depth") > 0, seen).otherwise(F.array(F.lit(0))))
    swept = ranged.withColumn("level", F.lit(None).cast("int")).union(carried).join(before, "range").withColumn("depth", depth).withColumn("level", F.explode(levels))
    at_level = Window.partitionBy("range", "level").orderBy("key", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    return swept.withColumn("mark", F.last("mark", ignorenulls=True).over(at_level)).filter("side = 1").select("id", "row", "mark")


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of pages.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
    wins, on a tie the longer host; of rules equal but for the verdict the last verdict by name. Without a fitting rule the verdict is
    `default` and rule is null. Null urls and urls without :// have an empty host and path. Rules of a null host or path, or with characters
    that no host (/?#) or path (?#) can hold, fit nothing. Rows with equal urls may lie in several ranges. An empty table gives no rows;
    without rules every url gets `default`. Any number of rules will do, on one host or under one domain; a page is a row for each
    rule host around its own, at most as many as the host has labels.
    """
    host, path = url_parts(F.col(url))
    pages = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    named = F.concat("host", "path")
    usable = rules.filter(~F.coalesce(F.col("host").rlike("[/?#]") | F.col("path").rlike("[?#]"), F.lit(True))).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = usable.select(host_key(F.col("host")).alias("key")).distinct().select("key", F.col("key").alias("mark"))
    mark = F.struct(F.length(named).alias("size"), F.length("host").alias("host_size"), named.alias("rule"), "verdict").alias("mark")
    paths = usable.select(path_key(host_key(F.col("host")), F.col("path")).alias("key"), mark)
    rows = pages.select(host_key(F.col("host")).alias("key"), F.monotonically_increasing_id().alias("id"), F.struct("page_id", "host", "path").alias("row"))
    of_hosts = cut(around(rows, hosts, whole_stack=True), "hosts")
    inside = of_hosts.filter("mark is not null").select(path_key(F.col("mark"), F.col("row.path")).alias("key"), F.monotonically_increasing_id().alias("id"), F.struct("id", "row").alias("row"))
    fitting = around(inside, paths, whole_stack=False).select("row.id", "row.row", "mark")
    best = fitting.groupBy("id").agg(F.first("row").alias("row"), F.max("mark").alias("best"))
    alone = of_hosts.filter("mark is null").select("id", "row", F.lit(None).cast(fitting.schema["mark"].dataType).alias("best"))
    return best.union(alone).select("row.page_id", "row.host", "row.path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR right(p.host, length(r.host) + 1) = '.' || r.host) AND left(p.path, length(r.path)) = r.path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
