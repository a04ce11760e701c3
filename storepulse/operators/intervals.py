"""Joins of time intervals without inequality-only plans.

With other keys, intervals are dealt to fixed-width buckets and joined on keys and bucket; a pair is kept only in the bucket where it first can be, so
no pair is found twice and nothing has to be made distinct. Without other keys, a plane sweep runs in ranges of time: see person_pairs().
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.functions.scalars import seconds_between
from storepulse.operators.folds import whole_groups
from storepulse.plans.lineage import cut


def epoch(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return seconds_between(F.greatest(s1, s2), F.least(e1, e2))


def gap_seconds(s1: Column, e1: Column, s2: Column, e2: Column, touching: float | None = 0.0) -> Column:
    """Seconds between two intervals; null if they overlap; intervals that touch have gap 0."""
    gap = F.greatest(seconds_between(e1, s2), seconds_between(e2, s1))
    return F.when(gap >= 0, gap)


def bucketed(df: DataFrame, start: Column, end: Column, seconds: int) -> DataFrame:
    """df with first_bucket and one row per bucket that [start, end] touches. Rows with a null end point go; ends before starts count as points."""
    width = seconds * 1_000_000
    first, last = F.floor(epoch(start) / width), F.floor(F.greatest(epoch(start), epoch(end)) / width)
    return df.filter(start.isNotNull() & end.isNotNull()).withColumn("first_bucket", first).withColumn("bucket", F.explode(F.sequence(first, last)))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], within_s: float = 0.0, bucket_s: int = 3600) -> DataFrame:
    """Pairs l, r (structs) of rows with equal keys whose intervals (start, end) overlap, touch, or are at most within_s apart.

    Left intervals are widened by within_s, then both are bucketed."""
    wide = F.make_dt_interval(secs=F.lit(float(within_s)))
    l = bucketed(left, F.col("start") - wide, F.col("end") + wide, bucket_s)
    r = bucketed(right, F.col("start"), F.col("end"), bucket_s)
    ls = l.select(*(F.col(k) for k in keys), "bucket", F.col("first_bucket").alias("lb"), F.struct(*left.columns).alias("l"))
    rs = r.select(*(F.col(k) for k in keys), "bucket", F.col("first_bucket").alias("rb"), F.struct(*right.columns).alias("r"))
    meet = ls.join(rs, [*keys, "bucket"]).filter(F.col("bucket") == F.greatest("lb", "rb"))
    touch = (F.col("l.start") - wide <= F.col("r.end")) & (F.col("r.start") <= F.col("l.end") + wide)
    return meet.filter(touch).select("l", "r")


def spans(sessions: DataFrame) -> DataFrame:
    """session_id, camera_id, person_id, start, end."""
    return sessions.select("session_id", "camera_id", "person_id", F.col("started_at").alias("start"), F.coalesce("ended_at", "last_seen_at").alias("end"))


def overlapping_sessions(sessions: DataFrame, least_s: float = 10.0, same_person: bool = True, closed: bool = False) -> DataFrame:
    """a, b (session ids, a < b), person, overlap: same camera and person, at least least_s together; closed: any common instant."""
    one = spans(sessions).filter("person_id IS NOT NULL")
    pairs = near_pairs(one, one, ["camera_id", *(["person_id"] if same_person else [])])
    over = overlap_seconds(*(F.col(c) for c in ("l.start", "l.end", "r.start", "r.end")))
    pairs = pairs.filter("l.session_id < r.session_id").withColumn("overlap", over)
    if not same_person:
        pairs = pairs.filter("l.person_id <> r.person_id")
    pairs = pairs.filter(F.col("overlap") >= (0.0 if closed else least_s))
    return pairs.select(F.col("l.session_id").alias("a"), F.col("r.session_id").alias("b"), F.col("l.person_id").alias("person_a"), F.col("r.person_id").alias("person_b"), F.col("l.camera_id").alias("camera_id"), "overlap")


#: Starts of intervals that a task of the sweep takes, and intervals that it holds open.
SWEEP = 8192


def dealt_for_sweep(rows: DataFrame, most: int = SWEEP) -> DataFrame:
    """rows (id, person, camera, s, e; s not null, microseconds) as tasks of a sweep: task, probe, and the rows' columns.

    Time is cut at quantiles of the starts. A range takes the starts in it (probes) and every interval that starts before its end and is still
    open at its beginning (holders). A range with over `most` of either is dealt as a grid of parts of both, so that no task has over about
    2 * most rows, however many intervals start or are open at one time. A pair meets once: in its later start's range and part."""
    n = rows.count()
    cuts = rows.withColumn("_s", F.col("s").cast("double")).approxQuantile("_s", [i / ceil(n / most) for i in range(1, ceil(n / most))], 0.1 / ceil(n / most)) if n > most else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    placed = rows.withColumn("_s", F.col("s").cast("double")).withColumn("_e", F.greatest("s", "e").cast("double"))
    if len(splits) > 2:
        placed = Bucketizer(splitsArray=[splits, splits], inputCols=["_s", "_e"], outputCols=["first", "last"]).transform(placed)
    else:
        placed = placed.withColumns({"first": F.lit(0.0), "last": F.lit(0.0)})
    placed = placed.withColumns({"first": F.col("first").cast("int"), "last": F.col("last").cast("int")}).drop("_s", "_e")
    probes = placed.withColumn("range", F.col("first")).withColumn("probe", F.lit(True))
    holders = placed.withColumn("range", F.explode(F.sequence("first", "last"))).withColumn("probe", F.lit(False))
    parts = lambda c: F.ceil(F.count("*") / most).cast("int").alias(c)
    sizes = cut(probes.groupBy("range").agg(parts("own")).join(holders.groupBy("range").agg(parts("open")), "range"), "ranges")
    both = probes.union(holders.select(probes.columns)).join(F.broadcast(sizes), "range")  # sizes: a row for each range, n / most at most
    part = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    mine, theirs = F.when(F.col("probe"), F.array(part("own"))).otherwise(every("own")), F.when(F.col("probe"), every("open")).otherwise(F.array(part("open")))
    grid = both.withColumn("i", F.explode(mine)).withColumn("j", F.explode(theirs))
    return grid.select(F.xxhash64("range", "i", "j").alias("task"), "probe", "id", "person", "camera", "s", "e")


def person_pairs(rows: DataFrame, touching: bool, other_camera: bool, most: int = SWEEP) -> DataFrame:
    """person_a < person_b, n: pairs of intervals (id, person, camera, s, e) of different persons that overlap (touching: or touch), on different cameras
    if so asked, counted. Each task sweeps its starts in order, holds the intervals that are open, and sums its pairs before they are shuffled.

    Rows with a null person, start or end go; intervals that end before they start overlap nothing unless the other's ends are outside. Equal ids are rows of their own."""
    known = rows.filter("person IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL").withColumn("id", F.monotonically_increasing_id())

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in whole_groups(batches, "task"):
            yield from swept({c: table.column(c).to_numpy() for c in ("probe", "id", "person", "camera", "s", "e")})

    def swept(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        persons, code = np.unique(c["person"], return_inverse=True)
        sides = []
        for own in (c["probe"], ~c["probe"]):
            order = np.lexsort((c["id"][own], c["s"][own]))
            sides.append({k: v[own][order] for k, v in (c | {"code": code}).items()})
        p, h = sides
        keys, counts, held = [], [], 0
        open_, next_ = np.zeros(0, dtype=np.int64), 0
        for lo in range(0, len(p["s"]), 256):
            hi = min(lo + 256, len(p["s"]))
            upto = int(np.searchsorted(h["s"], p["s"][hi - 1], side="right"))
            open_ = np.concatenate([open_, np.arange(next_, max(upto, next_))])
            next_ = max(upto, next_)
            open_ = open_[h["e"][open_] >= p["s"][lo]]
            x, y = {k: v[open_][None, :] for k, v in h.items()}, {k: v[lo:hi][:, None] for k, v in p.items()}
            met = ((x["s"] < y["s"]) | ((x["s"] == y["s"]) & (x["id"] < y["id"]))) & (x["code"] != y["code"])
            met &= (y["s"] <= x["e"]) & (x["s"] <= y["e"]) if touching else (y["s"] < x["e"]) & (x["s"] < y["e"])
            if other_camera:
                met &= x["camera"] != y["camera"]
            i, j = np.nonzero(met)
            a, b = p["code"][lo:hi][i], h["code"][open_][j]
            found, times = np.unique(np.minimum(a, b) * len(persons) + np.maximum(a, b), return_counts=True)
            keys.append(found)
            counts.append(times)
            held += len(found)
            if held > 1 << 20:
                yield told(persons, keys, counts)
                keys, counts, held = [], [], 0
        if held:
            yield told(persons, keys, counts)

    def told(persons: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(persons[found // len(persons)]), pa.array(persons[found % len(persons)]), pa.array(n)], ["person_a", "person_b", "n"])

    tasks = dealt_for_sweep(cut(known.select("id", "person", F.col("camera").cast("bigint").alias("camera"), "s", "e"), "intervals"), most)
    sums = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(sweep, "person_a bigint, person_b bigint, n bigint")
    return sums.groupBy("person_a", "person_b").agg(F.sum("n").alias("n"))


def concurrent_persons(sessions: DataFrame, most: int = SWEEP) -> DataFrame:
    """person_a < person_b, overlaps: different persons on different cameras at the same time."""
    one = spans(sessions).filter("camera_id IS NOT NULL").select(F.col("person_id").alias("person"), F.col("camera_id").alias("camera"), epoch(F.col("start")).alias("s"), epoch(F.col("end")).alias("e"))
    pairs = person_pairs(one, touching=False, other_camera=True, most=most)
    return pairs.withColumnRenamed("n", "overlaps")


def persons_within(sessions: DataFrame, within_s: float, most: int = SWEEP) -> DataFrame:
    """a < b: different persons with sessions at most within_s apart, on any cameras."""
    slack = round(within_s * 1e6)
    one = spans(sessions).select(F.col("person_id").alias("person"), F.lit(0).alias("camera"), epoch(F.col("start")).alias("s"), (epoch(F.col("end")) + slack).alias("e"))
    return person_pairs(one, touching=True, other_camera=False, most=most).select(F.col("person_a").alias("a"), F.col("person_b").alias("b"))


def neighbouring_sessions(sessions: DataFrame, within_s: float = 60.0, keys: tuple[str, ...] = ("camera_id",)) -> DataFrame:
    """a < b, gap: sessions with equal keys at most within_s apart; gap is null where they overlap and 0 where they touch."""
    one = spans(sessions)
    pairs = near_pairs(one, one, list(keys), within_s).filter("l.session_id < r.session_id")
    return pairs.select(F.col("l.session_id").alias("a"), F.col("r.session_id").alias("b"), gap_seconds(*(F.col(c) for c in ("l.start", "l.end", "r.start", "r.end"))).alias("gap"))


def points_in_sessions(points: DataFrame, sessions: DataFrame, point_id: str, ts: str, bucket_s: int = 3600) -> DataFrame:
    """session_id and the earliest point (ties: smallest id) of its camera within it."""
    p = points.select("camera_id", F.col(point_id), F.col(ts)).withColumn("bucket", F.floor(epoch(F.col(ts)) / (bucket_s * 1_000_000)))
    s = bucketed(spans(sessions), F.col("start"), F.col("end"), bucket_s).select("session_id", "camera_id", "start", "end", "bucket")
    inside = s.join(p, ["camera_id", "bucket"]).filter((F.col(ts) >= F.col("start")) & (F.col(ts) <= F.col("end")))
    return inside.groupBy("session_id").agg(F.min_by(point_id, F.struct(ts, point_id)).alias(point_id), F.count("*").alias("points"))


def unbilled(sessions: DataFrame, billing: DataFrame, slack_s: float = 30.0) -> DataFrame:
    """Sessions without billing, by their id or by a billing of their camera and person within them and slack_s around.

    The two conditions are two anti joins, so neither becomes a nested loop."""
    own = billing.filter("session_id IS NOT NULL").select("session_id")
    rest = sessions.join(own, "session_id", "left_anti")
    bills = billing.filter("person_id IS NOT NULL").select("camera_id", "person_id", F.col("entered_at").alias("start"), F.col("entered_at").alias("end"))
    near = near_pairs(spans(rest).filter("person_id IS NOT NULL"), bills, ["camera_id", "person_id"], slack_s).select(F.col("l.session_id").alias("session_id"))
    return rest.join(near, "session_id", "left_anti")
