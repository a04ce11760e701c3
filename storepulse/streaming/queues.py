"""Queue rules on a live stream: an event-time count of the tracks in a zone, then a keyed state for the cooldown.

A rule of type queue_count names a zone, the number of tracks from which it fires, and a cooldown. None is enabled unless asked for."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storepulse.operators.detections import zone_membership

QUEUE_EVENTS = "camera_id int, zone_id int, rule_id int, event_type string, occurred_at timestamp, tracks int"


class CooldownProcessor(StatefulProcessor):
    """Keyed by camera, zone and rule: the counts of a key come in order of time, as the watermark ends their frames; the state is the last time fired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        counts = pd.concat(list(rows))
        last = self.fired.get()[0] if self.fired.exists() else None
        out = []
        for at, tracks, cooldown in sorted(zip(counts["at"].tolist(), counts["tracks"].tolist(), counts["cooldown"].tolist(), strict=True)):
            if last is None or at - last >= cooldown:
                out.append((*key, "queue_count", at, tracks))
                last = at
        if last is not None:
            self.fired.update((int(last),))
        told = pd.DataFrame(out, columns=[c.split()[0] for c in QUEUE_EVENTS.split(", ")])
        told["occurred_at"] = pd.to_datetime(told["occurred_at"], unit="us", utc=True)
        yield told

    def close(self) -> None:
        pass


def queue_events(detections: DataFrame, zones: DataFrame, rules: DataFrame, least: int = 3) -> DataFrame:
    """Rule rows of the enabled queue_count rules over a watermarked stream of detections (append mode; the state store must be RocksDB).

    A frame of a zone with count_threshold tracks or more (null: `least`) fires its rules, each again only after its cooldown. Rules of a camera
    or of all (null) are matched by the zone, which lies on one camera; rules without a zone never fire. Tracks seen twice in a frame count once."""
    on = rules.filter("is_enabled AND rule_type = 'queue_count'").select("rule_id", "zone_id", F.col("camera_id").alias("of"), (F.col("cooldown_seconds") * 1_000_000).cast("bigint").alias("cooldown"), F.coalesce("count_threshold", F.lit(least)).alias("least"))
    inside = zone_membership(detections, zones).select("camera_id", "frame_ts", "local_track_id", F.explode("zones").alias("zone_id"))
    counts = inside.groupBy("camera_id", "frame_ts", "zone_id").agg(F.size(F.collect_set("local_track_id")).alias("tracks"))
    due = counts.join(F.broadcast(on), "zone_id").filter("(of IS NULL OR of = camera_id) AND tracks >= least")
    timed = due.select("camera_id", "zone_id", "rule_id", "frame_ts", F.unix_micros("frame_ts").alias("at"), "tracks", "cooldown")
    return timed.groupBy("camera_id", "zone_id", "rule_id").transformWithStateInPandas(CooldownProcessor(), QUEUE_EVENTS, "Append", "EventTime")
