"""Dashboard aggregations. Slots are local; spines make series gapless; distinct counts are made per slot, never added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storepulse.functions import scalars
from storepulse.functions.json_fields import dwell_seconds
from storepulse.functions.timeslots import local, resolved, slot, spine
from storepulse.operators.scopes import at, in_scope, not_staff, seen_in_window, within
from storepulse.thresholds import DEFAULTS, Thresholds

CROSSINGS = ("line_crossing_forward", "line_crossing_backward")


def session_end() -> Column:
    return F.coalesce("ended_at", "last_seen_at")


def session_seconds() -> Column:
    return scalars.seconds_between(F.col("started_at"), session_end())


def by_slot(df: DataFrame, ts: str, granularity: str, offset: int, *measures: Column) -> DataFrame:
    return df.groupBy(slot(F.col(ts), granularity, offset).alias("slot")).agg(*measures)


def gapless(spark: SparkSession, series: DataFrame, start, end, granularity: str, offset: int = 330) -> DataFrame:
    """The series on its spine, zeros where it has no row."""
    measures = [c for c in series.columns if c != "slot"]
    joined = F.broadcast(spine(spark, start, end, granularity, offset)).join(series, "slot", "left")
    return joined.select("slot", *(F.coalesce(c, F.lit(0)).alias(c) for c in measures))


def footfall(events: DataFrame, start, end, granularity: str = "hour", event_types=CROSSINGS, scope=None, offset: int = 0) -> DataFrame:
    """slot, total, unique_persons of the crossings; a row with slot null has the whole window."""
    rows = in_scope(within(events, "occurred_at", start, end), scope).filter(F.col("event_type").isin(*event_types))
    measures = (F.count("*").alias("total"), F.count_distinct("person_id").alias("unique_persons"))
    whole = rows.agg(*measures).select(F.lit(None).cast("timestamp_ntz").alias("slot"), "total", "unique_persons")
    return by_slot(rows, "occurred_at", granularity, offset, *measures).unionByName(whole)


def billing_stats(billing: DataFrame, persons: DataFrame, start, end, granularity: str = "hour", offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Totals, where the count leaves out staff and unknown persons and the dwell does not; and the timeline of all."""
    rows = within(billing, "entered_at", start, end)
    total = not_staff(rows, persons).agg(F.count("*").alias("customer_interactions"))
    dwell = rows.agg(F.round(F.avg("dwell_seconds"), 6).alias("avg_dwell_all"), F.max("dwell_seconds").alias("max_dwell_all"))
    return total.crossJoin(dwell), by_slot(rows, "entered_at", granularity, offset, F.count("*").alias("interactions"))


def dwell_stats(sessions: DataFrame, start, end, scope=None) -> DataFrame:
    """sessions, avg_dwell, max_dwell over all and by camera (camera_id null: all) in one pass."""
    rows = in_scope(within(sessions, "started_at", start, end), scope).select("camera_id", session_seconds().alias("s"))
    measures = (F.count("*").alias("sessions"), F.round(F.avg("s"), 6).alias("avg_dwell"), F.max("s").alias("max_dwell"))
    return rows.groupBy("camera_id").agg(*measures).unionByName(rows.agg(*measures).select(F.lit(None).cast("int").alias("camera_id"), "sessions", "avg_dwell", "max_dwell"))


def zone_activity(events: DataFrame, zones: DataFrame, start, end) -> DataFrame:
    return within(events, "occurred_at", start, end).groupBy("zone_id").agg(F.count("*").alias("events")).join(F.broadcast(zones.select("zone_id", "name")), "zone_id").orderBy(F.desc("events"), "zone_id")


def customers(persons: DataFrame, sessions: DataFrame, start, end, scope=None) -> DataFrame:
    """Non-staff persons seen in the window."""
    return seen_in_window(persons.filter("NOT is_staff"), sessions, start, end, scope)


def purchasers(billing: DataFrame, persons: DataFrame, start, end, scope=None) -> DataFrame:
    return not_staff(in_scope(within(billing, "entered_at", start, end), scope), persons)


def dashboard_summary(persons, sessions, events, billing, start, end, scope=None) -> DataFrame:
    """One row: visitors, entries, purchasers, conversion, genders and coarse age groups."""
    seen = customers(persons, sessions, start, end, scope)
    gender, age = scalars.gender_loose(F.col("gender")), scalars.coarse_age(F.col("estimated_age"))
    people = seen.agg(
        F.count("*").alias("visitors"), *(F.count_if(gender == g).alias(g) for g in ("male", "female")), *(F.count_if(F.coalesce(age, F.lit("")) == a).alias(a) for a in ("child", "young_adult", "adult", "senior")),
    )
    entries = in_scope(within(events, "occurred_at", start, end), scope).filter(F.col("event_type") == CROSSINGS[0]).agg(F.count("*").alias("entries"))
    bought = purchasers(billing, persons, start, end, scope).agg(F.count_distinct("person_id").alias("purchasers"))
    return people.crossJoin(entries).crossJoin(bought).withColumn("conversion", scalars.conversion(F.col("purchasers"), F.col("visitors")))


def demographics(persons, sessions, billing, start, end, bins=scalars.AGE_BINS, scope=None) -> DataFrame:
    """age_group x gender counts and purchasers per group; every group has a row."""
    spark = persons.sparkSession
    group = scalars.binned(F.col("estimated_age"), bins).alias("age_group")
    seen = customers(persons, sessions, start, end, scope).groupBy(group).agg(*(F.count_if(scalars.gender_strict(F.col("gender")) == g).alias(g) for g in ("male", "female", "unidentified")), F.count("*").alias("total"))
    buyers = persons.join(purchasers(billing, persons, start, end, scope).select("person_id"), "person_id", "left_semi").groupBy(group).agg(F.count("*").alias("purchasers"))
    names = spark.range(1).select(F.explode(F.array(*(F.lit(k) for k in [*(b[0] for b in bins), "unidentified"]))).alias("age_group"))
    joined = names.join(seen, "age_group", "left").join(buyers, "age_group", "left")
    return joined.select("age_group", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("male", "female", "unidentified", "total", "purchasers")))


def entry_exit(events: DataFrame, start, end, granularity: str = "hour", offset: int = 330, scope=None) -> DataFrame:
    """slot, entries, exits, gapless."""
    rows = in_scope(within(events, "occurred_at", start, end), scope).filter(F.col("event_type").isin(*CROSSINGS))
    series = by_slot(rows, "occurred_at", granularity, offset, F.count_if(F.col("event_type") == CROSSINGS[0]).alias("entries"), F.count_if(F.col("event_type") == CROSSINGS[1]).alias("exits"))
    return gapless(events.sparkSession, series, start, end, granularity, offset)


def visitors_by_slot(sessions, persons, start, end, granularity: str = "hour", offset: int = 330, scope=None) -> DataFrame:
    """slot, visitors (distinct non-staff persons whose session starts in it), gapless; auto granularity is by hour up to a day, else by day."""
    granularity = resolved(granularity, start, end)
    rows = not_staff(in_scope(within(sessions, "started_at", start, end), scope), persons)
    return gapless(sessions.sparkSession, by_slot(rows, "started_at", granularity, offset, F.count_distinct("person_id").alias("visitors")), start, end, granularity, offset)


def gender_by_slot(sessions, persons, start, end, granularity: str = "day", offset: int = 330) -> DataFrame:
    rows = not_staff(within(sessions, "started_at", start, end).drop("gender"), persons).join(persons.select("person_id", "gender"), "person_id")
    named = rows.select("person_id", "started_at", scalars.gender_strict(F.col("gender")).alias("g"))
    measures = [F.count_distinct(F.when(F.col("g") == g, F.col("person_id"))).alias(g) for g in ("male", "female", "unidentified")]
    return gapless(sessions.sparkSession, by_slot(named, "started_at", granularity, offset, *measures), start, end, granularity, offset)


def purchases_by_slot(billing, persons, start, end, granularity: str = "hour", offset: int = 330) -> DataFrame:
    rows = purchasers(billing, persons, start, end)
    return gapless(billing.sparkSession, by_slot(rows, "entered_at", granularity, offset, F.count_distinct("person_id").alias("purchasers")), start, end, granularity, offset)


def persons_by_camera(facts: DataFrame, persons: DataFrame, cameras: DataFrame, ts: str, start, end) -> DataFrame:
    """camera_id, name, persons: distinct non-staff persons, most first."""
    rows = not_staff(within(facts, ts, start, end), persons)
    return rows.groupBy("camera_id").agg(F.count_distinct("person_id").alias("persons")).join(F.broadcast(cameras.select("camera_id", "name")), "camera_id").orderBy(F.desc("persons"), "camera_id")


def compare_periods(now: DataFrame, before: DataFrame, measure: str) -> DataFrame:
    """Slot i of one gapless series against slot i of another: position, slot, current, previous, change. The series are as long as their spines."""
    order = Window.orderBy("slot")
    number = lambda df, name: df.select(F.row_number().over(order).alias("position"), F.col("slot").alias(f"{name}_slot"), F.col(measure).alias(name))
    both = number(now, "current").join(number(before, "previous"), "position", "left")
    return both.select("position", F.col("current_slot").alias("slot"), "current", "previous", scalars.percent_change(F.col("current"), F.col("previous")).alias("change"))


def peaks(series: DataFrame, measure: str) -> DataFrame:
    """From an hourly series of local slots: the peak hour and the busiest day (the earliest of ties), the mean per day that has data (whole), and per hour of the series."""
    best = lambda value, key: F.max_by(key, F.struct(value, -F.unix_seconds(key.cast("timestamp"))))
    hours = series.agg(best(F.col(measure), F.col("slot")).alias("peak_hour"), F.max(measure).alias("peak"), F.sum(measure).alias("total"), F.count("*").alias("hours"))
    days = series.groupBy(F.date_trunc("day", "slot").cast("timestamp_ntz").alias("day")).agg(F.sum(measure).alias("n")).filter("n > 0")
    busiest = days.agg(best(F.col("n"), F.col("day")).alias("busiest_day"), F.max("n").alias("busiest"), F.count("*").alias("days"))
    return hours.crossJoin(busiest).select("peak_hour", "peak", "busiest_day", "busiest", F.floor(F.col("total") / F.greatest("days", F.lit(1))).alias("per_day"), F.round(F.col("total") / F.col("hours"), 4).alias("per_hour"))


def hour_text(hour: Column) -> Column:
    """12 AM for 0 and 24."""
    return F.concat((F.pmod(hour + 11, F.lit(12)) + 1).cast("string"), F.when(F.pmod(hour, F.lit(24)) < 12, " AM").otherwise(" PM"))


def peak_hours_label(series: DataFrame, measure: str, share: float = 0.7) -> DataFrame:
    """The first two runs of hours with at least `share` of the peak. Of several days the last one's count stands for an hour."""
    hours = series.groupBy(F.hour("slot").alias("hour")).agg(F.max_by(measure, "slot").alias("n"))
    # 24 rows at most
    top = Window.partitionBy()
    hot = hours.withColumn("peak", F.greatest(F.max("n").over(top), F.lit(1))).filter(F.col("n") >= F.col("peak") * share)
    runs = hot.withColumn("run", F.col("hour") - F.row_number().over(Window.orderBy("hour"))).groupBy("run").agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    text = F.concat(hour_text(F.col("x.first")), F.lit(" – "), hour_text(F.col("x.last") + 1))
    listed = runs.select(F.struct("first", "last").alias("x")).select(F.struct(F.col("x.first"), text.alias("text")).alias("y"))
    return listed.agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("y")), 1, 2), lambda y: y["text"]), " and ").alias("peak_hours"))


def gender_tab(persons, sessions, start, end) -> DataFrame:
    """gender, persons, percent of the seen customers."""
    seen = customers(persons, sessions, start, end).groupBy(scalars.gender_strict(F.col("gender")).alias("gender")).agg(F.count("*").alias("persons"))
    whole = Window.partitionBy()  # three rows
    return seen.withColumn("percent", F.round(F.col("persons") * 100.0 / F.sum("persons").over(whole), 1))


def age_tab(persons, sessions, billing, start, end) -> DataFrame:
    """One row: identified, unidentified and the label of the dominant group (the first of ties in bin order)."""
    table = demographics(persons, sessions, billing, start, end)
    keys = F.array(*(F.lit(b[0]) for b in scalars.AGE_BINS))
    known = F.array_position(keys, F.col("age_group"))
    return table.agg(
        F.sum(F.when(known > 0, F.col("total")).otherwise(0)).alias("identified"), F.sum(F.when(known == 0, F.col("total")).otherwise(0)).alias("unidentified"),
        F.concat(F.max_by("age_group", F.when(known > 0, F.struct("total", -known))), F.lit(" dominant")).alias("peak_group"),
    )


def metric_tab(series: DataFrame, previous: DataFrame, measure: str) -> DataFrame:
    """One row for a footfall or purchase tab: totals of both periods, the change, peaks and the label of peak hours."""
    total = series.agg(F.sum(measure).alias("total"))
    before = previous.agg(F.sum(measure).alias("previous_total"))
    change = total.crossJoin(before).withColumn("change", scalars.percent_change(F.col("total"), F.col("previous_total")))
    return change.crossJoin(peaks(series, measure)).crossJoin(peak_hours_label(series, measure))


def dashboard(persons, sessions, events, billing, cameras, start, end) -> DataFrame:
    """The whole dashboard as one row of structs and arrays; each array is as long as a spine, a set of bins or the cameras."""
    pack = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    out = dashboard_summary(persons, sessions, events, billing, start, end)
    out = out.select(F.struct(*out.columns).alias("summary"))
    parts = {
        "visitors": visitors_by_slot(sessions, persons, start, end, "day"), "entry_exit": entry_exit(events, start, end, "day"), "demographics": demographics(persons, sessions, billing, start, end),
        "genders": gender_by_slot(sessions, persons, start, end), "purchases": purchases_by_slot(billing, persons, start, end, "day"), "cameras": persons_by_camera(sessions, persons, cameras, "started_at", start, end),
    }
    for name, df in parts.items():
        out = out.crossJoin(pack(df, name))  # one row each
    return out


def daily_summary(sessions, persons, events, billing, offset: int = 0) -> DataFrame:
    """Per day: crossings, visitors, mean dwell, purchasers, events and a map of crossings by hour."""
    day = lambda c: F.date_trunc("day", local(F.col(c), offset)).cast("date").alias("summary_date")
    crossings = events.filter(F.col("event_type").isin(*CROSSINGS))
    hours = crossings.groupBy(day("occurred_at"), F.hour(local(F.col("occurred_at"), offset)).alias("h")).agg(F.count("*").alias("n"))
    by_hour = hours.groupBy("summary_date").agg(F.sum("n").alias("total_footfall"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("h").cast("string").alias("h"), "n")))).alias("hourly_footfall"))
    seen = not_staff(sessions, persons).groupBy(day("started_at")).agg(F.count_distinct("person_id").alias("unique_visitors"), F.round(F.avg(session_seconds()), 4).alias("avg_dwell_seconds"))
    bought = not_staff(billing, persons).groupBy(day("entered_at")).agg(F.count_distinct("person_id").alias("purchasers"))
    every = events.groupBy(day("occurred_at")).agg(F.count("*").alias("total_events"))
    out = every.join(by_hour, "summary_date", "left").join(seen, "summary_date", "left").join(bought, "summary_date", "left")
    return out.select("summary_date", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_footfall", "unique_visitors", "purchasers", "total_events")), "avg_dwell_seconds", "hourly_footfall")


def store_rollup(stores, cameras, sessions, billing, persons, day_start, day_end) -> DataFrame:
    """Per store: cameras, visitors and purchasers of the day."""
    of = F.broadcast(cameras.select("camera_id", "store_id"))
    count = lambda df, name: df.join(of, "camera_id").groupBy("store_id").agg(F.count_distinct("person_id").alias(name))
    out = stores.join(cameras.groupBy("store_id").agg(F.count("*").alias("cameras")), "store_id", "left")
    out = out.join(count(not_staff(within(sessions, "started_at", day_start, day_end), persons), "visitors"), "store_id", "left").join(count(purchasers(billing, persons, day_start, day_end), "purchasers"), "store_id", "left")
    return out.select("store_id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cameras", "visitors", "purchasers")))


def person_list(persons, sessions, billing, has_purchase: bool | None = None, staff: bool | None = None, start=None, end=None, offset: int = 330) -> DataFrame:
    """Persons with tracks, distinct local days and purchases; facts are aggregated before they are joined."""
    tracks = sessions.filter("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("tracks"), F.count_distinct(F.to_date(local(F.col("started_at"), offset))).alias("days"))
    bought = billing.filter("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("purchases"))
    if start is not None:
        persons = seen_in_window(persons, sessions, start, end)
    if staff is not None:
        persons = persons.filter(F.col("is_staff") == staff)
    out = persons.join(tracks, "person_id", "left").join(bought, "person_id", "left").select("person_id", "is_staff", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tracks", "days", "purchases")))
    return out if has_purchase is None else out.filter("purchases > 0" if has_purchase else "purchases = 0")


def session_browser(sessions, billing, persons, assigned: bool | None = None, start=None, end=None) -> DataFrame:
    rows = sessions if start is None else within(sessions, "started_at", start, end)
    if assigned is not None:
        rows = rows.filter("person_id IS NOT NULL" if assigned else "person_id IS NULL")
    bills = billing.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("billings"))
    people = persons.select("person_id", "is_staff", "has_face", "visit_count")
    return rows.join(bills, "session_id", "left").join(people, "person_id", "left").select("session_id", "camera_id", "person_id", "started_at", F.coalesce("billings", F.lit(0)).alias("billings"), F.coalesce("has_face", F.lit(False)).alias("has_face"), "is_staff", "visit_count")


def live_viewers(viewers: DataFrame, as_of, idle_minutes: int = 5) -> DataFrame:
    """Per camera: viewers with a heartbeat in the last minutes, their devices and the minutes watched so far."""
    live = viewers.filter((F.col("last_active_at") >= at(as_of) - F.expr(f"INTERVAL '{idle_minutes}' MINUTE")) & (F.col("login_at") <= at(as_of)) & F.col("ended_at").isNull())
    watched = F.round(scalars.seconds_between(F.col("login_at"), at(as_of)) / 60, 1)
    return live.groupBy("camera_id").agg(F.count("*").alias("viewers"), F.count_distinct("device").alias("devices"), F.round(F.sum(watched), 1).alias("minutes"))


def viewer_list(viewers: DataFrame, cameras: DataFrame, as_of) -> DataFrame:
    """camera_id, camera, active_viewers, device_hash, device_label, ip_address, viewing_since, minutes: who watches a feed now, a row for each view that has
    not ended, with the number of its camera's. A camera that is not known is called Unknown."""
    live = viewers.filter(F.col("ended_at").isNull())
    counts = live.groupBy("camera_id").agg(F.count("*").alias("active_viewers"))
    named = cameras.select("camera_id", F.col("name").alias("camera"))
    rows = live.join(counts, "camera_id", "left").join(F.broadcast(named), "camera_id", "left")
    agent = F.coalesce("user_agent", F.lit(""))
    return rows.select(
        "camera_id", F.coalesce("camera", F.lit("Unknown")).alias("camera"), "active_viewers", scalars.device_hash(agent, F.col("ip_address")).alias("device_hash"), scalars.device_label(agent).alias("device_label"),
        "ip_address", F.col("login_at").alias("viewing_since"), F.round(scalars.seconds_between(F.col("login_at"), at(as_of)) / 60, 1).alias("minutes"),
    )


def viewer_totals(devices: DataFrame, viewers: DataFrame, as_of, t: Thresholds = DEFAULTS) -> DataFrame:
    """connected, watching: active device sessions within the idle time, and views that have not ended; one row."""
    recent = F.col("last_active_at") >= at(as_of) - F.expr(f"INTERVAL '{t.device_idle_s}' SECOND")
    connected = devices.agg(F.count_if(F.col("is_active") & recent).alias("connected"))
    return connected.crossJoin(viewers.agg(F.count_if(F.col("ended_at").isNull()).alias("watching")))  # one row each


def last_known(sessions_events: DataFrame) -> DataFrame:
    """Per session: last non-null person and camera, largest dwell, first time."""
    dwell = dwell_seconds(F.col("metadata"))
    return sessions_events.groupBy("session_id").agg(
        F.max_by(F.col("person_id"), F.when(F.col("person_id").isNotNull(), F.struct("occurred_at", "event_id"))).alias("person_id"), F.max_by("camera_id", F.struct("occurred_at", "event_id")).alias("camera_id"), F.max(dwell).alias("max_dwell"), F.min("occurred_at").alias("first_at"),
    )


def null_billing_by_day(billing, sessions, offset: int = 330) -> DataFrame:
    """Per local day: billings, those without person, and those that their session could fill."""
    own = sessions.select("session_id", F.col("person_id").alias("session_person"))
    return billing.join(own, "session_id", "left").groupBy(F.to_date(local(F.col("entered_at"), offset)).alias("day")).agg(F.count("*").alias("billings"), F.count_if(F.col("person_id").isNull()).alias("without_person"), F.count_if(F.col("person_id").isNull() & F.col("session_person").isNotNull()).alias("fillable"))


def mixed_gender_persons(sessions: DataFrame) -> DataFrame:
    return sessions.filter("person_id IS NOT NULL AND gender IS NOT NULL").groupBy("person_id").agg(F.count_if(F.col("gender") == "M").alias("m"), F.count_if(F.col("gender") == "F").alias("f")).filter("m > 0 AND f > 0")


def multi_camera_persons(facts: DataFrame, least: int = 2) -> DataFrame:
    return facts.filter("person_id IS NOT NULL").groupBy("person_id").agg(F.count_distinct("camera_id").alias("cameras")).filter(F.col("cameras") >= least)


def dwell_sweep(billing, persons, thresholds=(5, 10, 15, 20, 30, 60, 120)) -> DataFrame:
    """threshold, purchasers: non-staff persons whose longest dwell reaches it; one aggregation per person, then one pass over persons."""
    longest = not_staff(billing, persons).groupBy("person_id").agg(F.max("dwell_seconds").alias("d"))
    counts = longest.agg(*(F.count_if(F.col("d") >= t).alias(str(t)) for t in thresholds))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"`{t}`").alias("purchasers")) for t in thresholds))))


def reconcile(computed: DataFrame, reported: DataFrame, measure: str) -> DataFrame:
    """day, computed, reported and the error in percent of the reported."""
    both = computed.select("day", F.col(measure).alias("computed")).join(reported.select("day", F.col(measure).alias("reported")), "day")
    return both.withColumn("error", scalars.percent_change(F.col("computed"), F.col("reported")))


def age_histogram(persons: DataFrame, width: int = 10) -> DataFrame:
    return persons.filter("estimated_age IS NOT NULL").groupBy((F.floor(F.col("estimated_age") / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def age_percentiles(persons: DataFrame) -> DataFrame:
    return persons.agg(*(F.round(F.percentile("estimated_age", F.lit(p / 100)), 4).alias(f"p{p}") for p in (10, 50, 90)), F.round(F.avg("estimated_age"), 4).alias("mean"))


def cameras_by_store(stores, cameras, store_id: int | None = None) -> DataFrame:
    """Each store's cameras, a list; stores without cameras only if asked for by id."""
    some = stores if store_id is None else stores.filter(F.col("store_id") == store_id)
    lists = cameras.groupBy("store_id").agg(F.sort_array(F.collect_list("name")).alias("cameras"), F.count("*").alias("n"))
    out = some.join(lists, "store_id", "inner" if store_id is None else "left")
    return out.select("store_id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.array_join("cameras", ", ").alias("cameras"))


def active_devices(devices: DataFrame, user_id: int, as_of) -> DataFrame:
    """A user's active, unexpired device sessions, newest first, labelled; n is their number."""
    mine = devices.filter((F.col("user_id") == user_id) & F.col("is_active") & (F.col("expires_at") > at(as_of)))
    n = mine.agg(F.count("*").alias("n"))
    labelled = mine.select("device", "ip_address", "last_active_at", scalars.device_label(F.col("user_agent")).alias("label"))
    return labelled.crossJoin(n).orderBy(F.desc("last_active_at"), "device")


def journey(sessions, cameras, person_id: int) -> DataFrame:
    """A person's sessions in order: duration and the gap since the one before."""
    w = Window.partitionBy("person_id").orderBy("started_at", "session_id")
    rows = sessions.filter(F.col("person_id") == person_id).join(F.broadcast(cameras.select("camera_id", "name")), "camera_id")
    before = F.lag(session_end()).over(w)
    return rows.select("session_id", "camera_id", "name", "started_at", session_seconds().alias("duration"), scalars.seconds_between(before, F.col("started_at")).alias("gap"))
