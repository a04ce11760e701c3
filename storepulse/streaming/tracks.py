"""Live tracks as keyed state: sessions, zones, milestones and rules from a stream of detections.

Zones are resolved before the state by a join with the static zone table, in Catalyst. A track's rows may arrive in any order within the watermark:
they wait in the track's list state and are taken in order of time once the watermark has passed them, by event-time timers, so that no row goes
back in time. A silent track is closed when the watermark is past its gap. The batch twins are in operators.windows and operators.detections.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storepulse.functions import geometry as G
from storepulse.operators.detections import zone_membership
from storepulse.thresholds import DEFAULTS, Thresholds

EVENTS = "camera_id int, local_track_id int, started_at timestamp, event_type string, zone_id int, rule_id int, occurred_at timestamp, dwell double, frames bigint, confidence double"
WAITING = "at bigint, x double, y double, confidence double, zones array<int>"


def _crosses(p: list[float], q: list[float], line: list[list[float]]) -> str | None:
    (ax, ay), (bx, by) = line[0], line[1]
    turn = lambda o, m, r: (m[0] - o[0]) * (r[1] - o[1]) - (m[1] - o[1]) * (r[0] - o[0])
    a, b = (ax, ay), (bx, by)
    if turn(a, b, p) * turn(a, b, q) > 0 or turn(p, q, a) * turn(p, q, b) > 0:
        return None
    way = (bx - ax) * (q[1] - p[1]) - (by - ay) * (q[0] - p[0])
    return "forward" if way > 0 else "backward" if way < 0 else None


class TrackProcessor(StatefulProcessor):
    """Keyed by camera and local track; times are microseconds. rules: (rule_id, rule_type, zone_id, camera_id, cooldown, threshold, line or None).

    State of a key: the rows that wait, and the open track with the time of the one timer that is set."""

    def __init__(self, rules: list[tuple], t: Thresholds = DEFAULTS):
        self.rules, self.t = rules, t
        self.gap = round(t.session_gap_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", "state string")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Rows only wait here: a timer of the same batch takes them if the watermark has passed them."""
        first = None
        for frames in rows:
            new = list(zip(frames["at"].tolist(), frames["x"].tolist(), frames["y"].tolist(), frames["confidence"].tolist(), [[int(z) for z in zones] for zones in frames["zones"]], strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(new)[0] if first is None else min(first, min(new)[0])
        now = self._load()
        if first is not None:
            self._wake(now, first)
        self._save(now)
        yield self._rows([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Takes the rows that the watermark has passed, and closes the track if it was silent for long enough."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        now, out = self._load(), []
        now["timer"] = None
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] <= passed]
        for at, x, y, confidence, zones in due:
            if now["track"] and at - now["track"]["last"] > self.gap:
                self._close(key, now, out)
            if not now["track"]:
                now["track"] = {"start": at, "last": at, "frames": 0, "sum": 0.0, "since": {}, "dwell": {}, "told": {}, "fired": {}, "at": None}
                out.append(self._event(key, now["track"], "person_entered_view", at))
            self._frame(key, now["track"], at, [x, y], zones, out)
            now["track"]["sum"] += confidence or 0.0
        later = waiting[len(due) :]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if now["track"] and now["track"]["last"] + self.gap <= passed:
            self._close(key, now, out)
        if later:
            self._wake(now, later[0][0])
        if now["track"]:
            self._wake(now, now["track"]["last"] + self.gap)
        self._save(now)
        yield self._rows(out)

    def _load(self) -> dict:
        return json.loads(self.track.get()[0]) if self.track.exists() else {"track": None, "timer": None}

    def _save(self, now: dict) -> None:
        self.track.update((json.dumps(now),)) if now["track"] or now["timer"] is not None else self.track.clear()

    def _wake(self, now: dict, at: int) -> None:
        """One timer a key, the earliest that was asked for: a millisecond that is not before `at`."""
        ms = -(-at // 1000)
        if now["timer"] is None or ms < now["timer"]:
            if now["timer"] is not None:
                self.handle.deleteTimer(now["timer"])
            self.handle.registerTimer(ms)
            now["timer"] = ms

    def _close(self, key: Any, now: dict, out: list) -> None:
        out.append(self._event(key, now["track"], "person_left_view", now["track"]["last"]))
        now["track"] = None

    def _frame(self, key: Any, now: dict, at: int, here: list[float], zones: list[int], out: list) -> None:
        inside = {int(z) for z in now["since"]}
        for z in sorted(set(zones) - inside):
            now["since"][str(z)], now["told"][str(z)] = at, []
            out.append(self._event(key, now, "zone_enter", at, zone=z))
        for z in sorted(inside - set(zones)):
            dwell = (now["last"] - now["since"].pop(str(z))) / 1e6
            out.append(self._event(key, now, "zone_exit", at, zone=z, dwell=dwell))
        for z, since in now["since"].items():
            now["dwell"][z] = (at - since) / 1e6
            due = [m for m in self.t.milestones if m <= now["dwell"][z] and m not in now["told"][z]]
            if due:
                now["told"][z].append(max(due))
                out.append(self._event(key, now, "zone_dwell", at, zone=int(z), dwell=float(max(due))))
        for rule, kind, zone, camera, cooldown, threshold, line in self.rules:
            if camera is not None and camera != key[0]:
                continue
            name, dwell = self._condition(now, kind, zone, threshold, line, here)
            last = now["fired"].get(str(rule))
            if name and (last is None or (at - last) / 1e6 >= cooldown):
                now["fired"][str(rule)] = at
                out.append(self._event(key, now, name, at, zone=zone, rule=rule, dwell=dwell))
        now["last"], now["frames"], now["at"] = at, now["frames"] + 1, here

    def _condition(self, now: dict, kind: str, zone, threshold, line, here: list[float]) -> tuple[str | None, float | None]:
        inside = zone is not None and str(zone) in now["since"]
        dwell = now["dwell"].get(str(zone)) if zone is not None else max(now["dwell"].values(), default=None)
        if kind == "line_crossing" and line and now["at"]:
            way = _crosses(now["at"], here, line)
            return (f"line_crossing_{way}" if way else None), None
        if kind == "zone_dwell" and dwell is not None and dwell >= (threshold or self.t.dwell_rule_s):
            return "zone_dwell_rule", dwell  # the last dwell counts even after leaving
        if kind == "billing_interaction" and inside and dwell >= (threshold or self.t.billing_rule_s):
            return kind, dwell
        if kind == "possible_purchase" and inside and dwell >= (threshold or self.t.purchase_rule_s):
            return kind, dwell
        if kind == "restricted_zone" and inside:
            return kind, dwell
        return None, None

    def _event(self, key, now: dict, name: str, at: int, zone=None, rule=None, dwell=None) -> tuple:
        return key[0], key[1], now["start"], name, zone, rule, at, dwell, now["frames"], now["sum"] / now["frames"] if now["frames"] else None

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
        for c in ("started_at", "occurred_at"):
            rows[c] = pd.to_datetime(rows[c], unit="us", utc=True)
        return rows

    def close(self) -> None:
        pass


def rule_list(rules: DataFrame, zones: DataFrame) -> list[tuple]:
    """The enabled rules, a small configuration table, with the ends of their line zones."""
    from storepulse.functions.json_fields import line_ends

    lines = zones.select("zone_id", line_ends(F.col("polygon"), F.col("shape")).alias("line"))
    rows = rules.filter("is_enabled").join(lines, "zone_id", "left").orderBy("rule_id").collect()
    return [(r.rule_id, r.rule_type, r.zone_id, r.camera_id, float(r.cooldown_seconds), r.dwell_threshold_seconds, [list(p) for p in r.line] if r.line else None) for r in rows]


def _micros(ts: str) -> Column:
    return F.unix_micros(ts)


def track_events(detections: DataFrame, zones: DataFrame, rules: list[tuple], t: Thresholds = DEFAULTS, scale: float = 100.0) -> DataFrame:
    """All events of the tracks of a watermarked stream of detections (append mode; the state store must be RocksDB).

    Rows may be out of order within the watermark; each is taken once the watermark has passed it, so events are told as late as the watermark is.
    Rows of one track and time are taken by place and confidence. Rows without time give nothing, null boxes lie in no zone and cross no line."""
    x, y = G.centre(F.col("bbox"))
    placed = zone_membership(detections, zones).select("camera_id", "local_track_id", "frame_ts", _micros("frame_ts").alias("at"), (x / F.col("frame_width") * scale).alias("x"), (y / F.col("frame_height") * scale).alias("y"), F.col("confidence"), "zones")
    return placed.groupBy("camera_id", "local_track_id").transformWithStateInPandas(TrackProcessor(rules, t), EVENTS, "Append", "EventTime")


def sessions_of(events: DataFrame) -> DataFrame:
    """Session rows from the events that close them."""
    left = events.filter(F.col("event_type") == "person_left_view")
    return left.select("camera_id", "local_track_id", "started_at", F.col("occurred_at").alias("ended_at"), F.col("frames").alias("total_frames"), F.round("confidence", 6).alias("avg_confidence"))


def one_per_session_and_zone(billing: DataFrame, ts: str, delay: str) -> DataFrame:
    """The first row of each session and zone within the watermark."""
    return billing.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["session_id", "zone_id"])


def live_tracks(detections: DataFrame) -> DataFrame:
    """Each track's last sight and frames so far (update mode)."""
    return detections.groupBy("camera_id", "local_track_id").agg(F.max("frame_ts").alias("last_seen_at"), F.count("*").alias("frames"))
