"""Window-shaped operators: best N, visits, staff, sessions of detections, transitions, dwell, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.scalars import seconds_between
from storepulse.functions.timeslots import local
from storepulse.thresholds import DEFAULTS, Thresholds


def best_per_person(gallery: DataFrame, key: str, score: str, most: int) -> DataFrame:
    """Each person's `most` best rows: by score, then the latest, then the larger key."""
    w = Window.partitionBy("person_id").orderBy(F.desc(score), F.desc("captured_at"), F.desc(key))
    return gallery.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def visits(sessions: DataFrame, gap_s: float = 60.0, keys: tuple[str, ...] = ("person_id", "camera_id")) -> DataFrame:
    """sessions (start, end) with `visit`, a number per key: a session over gap_s after the one before, or overlapping it, starts a new visit."""
    w = Window.partitionBy(*keys).orderBy("start", "session_id")
    before = F.lag("end").over(w)
    new = before.isNull() | (F.col("start") < before) | (seconds_between(before, F.col("start")) > gap_s)
    return sessions.withColumn("new_visit", new.cast("int")).withColumn("visit", F.sum("new_visit").over(w)).drop("new_visit")


def staff_by_days(days: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """person_id of distinct (person_id, day): staff_streak_days in a row, or staff_days within any staff_span_days."""
    n = F.datediff("day", F.lit("2000-01-01").cast("date"))
    d = days.select("person_id", n.alias("n")).distinct()
    w = Window.partitionBy("person_id").orderBy("n")
    streak = d.withColumn("island", F.col("n") - F.row_number().over(w)).groupBy("person_id", "island").agg(F.count("*").alias("c")).filter(F.col("c") >= t.staff_streak_days)
    span = d.withColumn("c", F.count("*").over(w.rangeBetween(0, t.staff_span_days - 1))).filter(F.col("c") >= t.staff_days)
    return streak.select("person_id").union(span.select("person_id")).distinct()


def staff_rule(sessions: DataFrame, persons: DataFrame, t: Thresholds = DEFAULTS, offset: int = 330) -> DataFrame:
    """Persons with a face whose local days make them staff."""
    days = sessions.filter("person_id IS NOT NULL").select("person_id", F.to_date(local(F.col("started_at"), offset)).alias("day"))
    return staff_by_days(days, t).join(persons.filter("has_face").select("person_id"), "person_id", "left_semi")


TRACK = ("camera_id", "local_track_id")


def sessionise(detections: DataFrame, gap_s: float = 5.0) -> DataFrame:
    """detections with `session`, a number per camera and local track: silence over gap_s closes a session."""
    w = Window.partitionBy(*TRACK).orderBy("frame_ts")
    silent = seconds_between(F.lag("frame_ts").over(w), F.col("frame_ts"))
    return detections.withColumn("session", F.sum(F.coalesce((silent > gap_s).cast("int"), F.lit(0))).over(w))


def track_sessions(detections: DataFrame, gap_s: float = 5.0) -> DataFrame:
    return sessionise(detections, gap_s).groupBy(*TRACK, "session").agg(F.min("frame_ts").alias("started_at"), F.max("frame_ts").alias("last_seen_at"), F.count("*").alias("total_frames"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def zone_transitions(frames: DataFrame, keys: tuple[str, ...] = (*TRACK, "session")) -> DataFrame:
    """zone_enter and zone_exit rows, frame by frame, of frames with an array column zones. The last frame's zones are not left."""
    w = Window.partitionBy(*keys).orderBy("frame_ts")
    before = F.coalesce(F.lag("zones").over(w), F.array().cast("array<int>"))
    both = frames.withColumn("entered", F.array_except("zones", before)).withColumn("left", F.array_except(before, F.col("zones")))
    one = lambda column, name: both.select(*keys, "frame_ts", F.explode(column).alias("zone_id"), F.lit(name).alias("event_type"))
    return one("entered", "zone_enter").union(one("left", "zone_exit"))


def zone_dwell(frames: DataFrame, keys: tuple[str, ...] = (*TRACK, "session")) -> DataFrame:
    """One row per frame and zone it is in, with the seconds since the track entered; leaving starts it anew."""
    w = Window.partitionBy(*keys).orderBy("frame_ts")
    rows = frames.withColumn("n", F.row_number().over(w)).select(*keys, "frame_ts", "n", F.explode("zones").alias("zone_id"))
    z = Window.partitionBy(*keys, "zone_id").orderBy("n")
    stays = rows.withColumn("stay", F.col("n") - F.row_number().over(z))
    return stays.withColumn("dwell", seconds_between(F.min("frame_ts").over(Window.partitionBy(*keys, "zone_id", "stay")), F.col("frame_ts"))).drop("n")


def milestones(dwell: DataFrame, steps: tuple[int, ...] = (30, 60, 120), keys: tuple[str, ...] = (*TRACK, "session", "zone_id", "stay")) -> DataFrame:
    """The highest step not yet told, at most one per frame: a frame tells the highest step it has reached if it is above all told before."""
    reached = F
    for s in sorted(steps, reverse=True):
        reached = reached.when(F.col("dwell") >= s, s)
    w = Window.partitionBy(*keys).orderBy("frame_ts").rowsBetween(Window.unboundedPreceding, -1)
    rows = dwell.withColumn("step", reached.otherwise(0))
    return _told(rows, steps, keys)


def _told(rows: DataFrame, steps: tuple[int, ...], keys: tuple[str, ...]) -> DataFrame:
    """Each frame tells the highest reached step that was not told; lower ones skipped by a jump are told by the frames after it.

    While a reached step stays the same, the frames since it was reached tell the untold ones in falling order: the k-th of these
    frames tells the k-th highest of the steps that are reached and were untold when it was reached."""
    ordered = F.array(*(F.lit(s) for s in sorted(steps, reverse=True)))

    def fold(acc, r):
        open_steps = F.filter(ordered, lambda s: (s <= r["dwell"]) & ~F.array_contains(acc["fired"], s))
        step = F.get(open_steps, 0)
        return F.struct(
            F.when(step.isNotNull(), F.array_append(acc["fired"], step)).otherwise(acc["fired"]).alias("fired"),
            F.when(step.isNotNull(), F.array_append(acc["out"], F.struct(r["frame_ts"].alias("frame_ts"), step.alias("step")))).otherwise(acc["out"]).alias("out"),
        )

    # only frames that can tell something: per stay and reached step, as many first frames as there are steps
    w = Window.partitionBy(*keys, "step").orderBy("frame_ts")
    few = rows.filter("step > 0").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= len(steps))
    start = F.struct(F.array().cast("array<int>").alias("fired"), F.array().cast("array<struct<frame_ts:timestamp_ntz,step:int>>").alias("out"))
    lists = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame_ts", "dwell"))).alias("rows"))
    return lists.select(*keys, F.inline(F.aggregate("rows", start, fold, lambda a: a["out"])))


def stability(frames: DataFrame, keys: tuple[str, ...] = (*TRACK, "session")) -> DataFrame:
    """Per frame: how still the last 10 centres are (0 with fewer than 3), .7, and the track's age up to 3 s, .3."""
    w = Window.partitionBy(*keys).orderBy("frame_ts")
    ten = w.rowsBetween(-9, 0)
    x, y = (F.col("bbox.x1") + F.col("bbox.x2")) / 2, (F.col("bbox.y1") + F.col("bbox.y2")) / 2
    spread = F.max(x).over(ten) - F.min(x).over(ten) + F.max(y).over(ten) - F.min(y).over(ten)
    age = seconds_between(F.min("frame_ts").over(w), F.col("frame_ts"))
    still = F.greatest(F.lit(0.0), 1 - spread / 400.0)
    value = F.when(F.row_number().over(w) < 3, 0.0).otherwise(0.7 * still + 0.3 * F.least(F.lit(1.0), age / 3.0))
    return frames.select(*keys, "frame_ts", F.round(value, 6).alias("stability"))


def best_of_windows(samples: DataFrame, keys: tuple[str, ...], score: str, size: int = 5) -> DataFrame:
    """Of every `size` samples of a track, in order, the best (the earliest of ties); unfinished windows give none."""
    w = Window.partitionBy(*keys).orderBy("frame_ts")
    groups = samples.withColumn("window", F.floor((F.row_number().over(w) - 1) / size))
    best = F.max_by(F.col("frame_ts"), F.struct(F.col(score), -F.unix_micros(F.col("frame_ts").cast("timestamp"))))
    return groups.groupBy(*keys, "window").agg(best.alias("best_ts"), F.max(score).alias("best_score"), F.count("*").alias("n")).filter(F.col("n") == size).drop("n")
