"""Detections frame by frame: zones, lines, occlusion, faces in bodies; and the closing of stale rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions import geometry as G
from storepulse.functions.json_fields import line_ends, points
from storepulse.operators.folds import select_in_order
from storepulse.operators.scopes import at
from storepulse.operators.windows import TRACK
from storepulse.thresholds import DEFAULTS, Thresholds


def _scaled(x, y, scale: float):
    return x / F.col("frame_width") * scale, y / F.col("frame_height") * scale


def zone_membership(detections: DataFrame, zones: DataFrame, scale: float = 100.0) -> DataFrame:
    """detections with zones: the sorted ids of the camera's active polygons that hold the feet or the centre. The zones are a small
    configuration table and are gathered per camera, so a frame stays one row."""
    polygons = zones.filter("is_active AND shape = 'polygon'").select("camera_id", "zone_id", points(F.col("polygon")).alias("pts")).filter("pts IS NOT NULL")
    by_camera = polygons.groupBy("camera_id").agg(F.sort_array(F.collect_list(F.struct("zone_id", "pts"))).alias("polygons"))
    (fx, fy), (cx, cy) = _scaled(*G.feet(F.col("bbox")), scale), _scaled(*G.centre(F.col("bbox")), scale)
    placed = detections.join(F.broadcast(by_camera), "camera_id", "left").withColumns({"_fx": fx, "_fy": fy, "_cx": cx, "_cy": cy})
    hits = F.filter("polygons", lambda z: G.in_polygon(F.col("_fx"), F.col("_fy"), z["pts"]) | G.in_polygon(F.col("_cx"), F.col("_cy"), z["pts"]))
    ids = F.coalesce(F.transform(hits, lambda z: z["zone_id"]), F.array().cast("array<int>"))
    return placed.withColumn("zones", ids).drop("polygons", "_fx", "_fy", "_cx", "_cy")


def line_crossings(detections: DataFrame, zones: DataFrame, scale: float = 100.0, keys: tuple[str, ...] = (*TRACK, "session")) -> DataFrame:
    """Steps of a track's centre over an active line of its camera, with their direction."""
    lines = zones.filter("is_active").select("camera_id", "zone_id", line_ends(F.col("polygon"), F.col("shape")).alias("line")).filter("line IS NOT NULL")
    x, y = _scaled(*G.centre(F.col("bbox")), scale)
    w = Window.partitionBy(*keys).orderBy("frame_ts")
    steps = detections.select(*keys, "frame_ts", x.alias("x"), y.alias("y")).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).filter("px IS NOT NULL")
    crossed = steps.join(F.broadcast(lines), "camera_id").withColumn("direction", G.crossing(*(F.col(c) for c in ("px", "py", "x", "y", "line"))))
    return crossed.filter("direction IS NOT NULL").select(*keys, "frame_ts", "zone_id", "direction")


def box_overlaps(detections: DataFrame) -> DataFrame:
    """camera_id, frame_ts, a < b (tracks), iou of the boxes of one frame."""
    one = detections.select("camera_id", "frame_ts", "local_track_id", "bbox")
    other = one.select("camera_id", "frame_ts", F.col("local_track_id").alias("b"), F.col("bbox").alias("box_b"))
    pairs = one.join(other, ["camera_id", "frame_ts"]).filter("local_track_id < b")
    return pairs.select("camera_id", "frame_ts", F.col("local_track_id").alias("a"), "b", G.iou(F.col("bbox"), F.col("box_b")).alias("iou"))


def occlusion(detections: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """detections with occluded: another box of the frame overlaps it enough."""
    near = box_overlaps(detections).filter(F.col("iou") >= t.occlusion_iou)
    hit = near.select("camera_id", "frame_ts", F.explode(F.array("a", "b")).alias("local_track_id")).distinct().withColumn("hit", F.lit(True))
    return detections.join(hit, ["camera_id", "frame_ts", "local_track_id"], "left").withColumn("occluded", F.coalesce("hit", F.lit(False))).drop("hit")


def probe_faces(detections: DataFrame) -> DataFrame:
    """A face at the top of every body, as a stand-in for a face detector."""
    b = F.col("bbox")
    box = F.struct((b["x1"] + 30).alias("x1"), (b["y1"] + 10).alias("y1"), (b["x1"] + 70).alias("x2"), (b["y1"] + 60).alias("y2"))
    return detections.select("camera_id", "frame_ts", F.col("local_track_id").alias("face"), box.alias("face_box"), F.col("confidence").alias("det_score"))


def face_candidates(faces: DataFrame, detections: DataFrame, t: Thresholds = DEFAULTS, least_score: float | None = None) -> DataFrame:
    """camera_id, frame_ts, face, track, score: faces whose centre lies in a body of the frame, in its upper part and mostly inside it.

    Size and centring weigh half each; the score is theirs times the detector's."""
    bodies = detections.select("camera_id", "frame_ts", F.col("local_track_id").alias("track"), "bbox")
    f, b = F.col("face_box"), F.col("bbox")
    x, y = G.centre(f)
    width, tall = b["x2"] - b["x1"], b["y2"] - b["y1"]
    inside = x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"]) & (width > 0) & (tall > 0)
    upper = ((y - b["y1"]) / F.when(tall > 0, tall) <= 0.70) & (G.share_inside(f, b) >= t.face_in_body)
    size = F.least(F.lit(1.0), G.area(f) / (F.greatest(width * tall, F.lit(1.0)) * 0.03))
    middle = F.greatest(F.lit(0.0), 1 - F.abs(x - G.centre(b)[0]) / F.greatest(width / 2, F.lit(1.0)))
    scored = faces.join(bodies, ["camera_id", "frame_ts"]).filter(inside & upper).withColumn("score", F.col("det_score") * (0.5 * size + 0.5 * middle))
    return scored.filter(F.col("score") >= (t.face_assign if least_score is None else least_score)).select("camera_id", "frame_ts", "face", "track", "score")


def assign_faces(candidates: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One track per face and one face per track of a frame: ambiguous faces go, then greedily by score (ties: smaller ids)."""
    w = Window.partitionBy("camera_id", "frame_ts", "face").orderBy(F.desc("score"), "track")
    clear = candidates.withColumn("second", F.lead("score").over(w)).withColumn("rank", F.row_number().over(w))
    good = clear.filter("rank = 1").filter(F.col("second").isNull() | (F.col("second") / F.col("score") < t.assign_ambiguity)).select("camera_id", "frame_ts", "face")
    rest = candidates.join(good, ["camera_id", "frame_ts", "face"], "left_semi")

    def greedy(rows: dict[str, list]) -> list[int]:
        faces, tracks, keep = set(), set(), []
        for i, (f, k) in enumerate(zip(rows["face"], rows["track"], strict=True)):
            if f not in faces and k not in tracks:
                faces.add(f), tracks.add(k), keep.append(i)
        return keep

    return select_in_order(rest, ["camera_id", "frame_ts"], [F.desc("score"), "face", "track"], greedy, ["face", "track"]).select(*candidates.columns)


def close_stale_sessions(sessions: DataFrame, as_of, t: Thresholds = DEFAULTS) -> DataFrame:
    """Active sessions not seen for some minutes end when they were last seen."""
    stale = F.col("is_active") & (F.col("last_seen_at") < at(as_of) - F.expr(f"INTERVAL '{t.stale_track_minutes}' MINUTE"))
    return sessions.withColumns({"ended_at": F.when(stale, F.col("last_seen_at")).otherwise(F.col("ended_at")), "is_active": F.col("is_active") & ~stale})


def close_stale_devices(devices: DataFrame, as_of, t: Thresholds = DEFAULTS) -> DataFrame:
    stale = (F.col("expires_at") <= at(as_of)) | (F.col("last_active_at") < at(as_of) - F.expr(f"INTERVAL '{t.device_idle_s}' SECOND"))
    return devices.withColumn("is_active", F.col("is_active") & ~stale)


def close_stale_viewers(viewers: DataFrame, as_of, t: Thresholds = DEFAULTS) -> DataFrame:
    stale = F.col("ended_at").isNull() & (F.col("last_active_at") < at(as_of) - F.expr(f"INTERVAL '{t.viewer_idle_s}' SECOND"))
    return viewers.withColumn("ended_at", F.when(stale, F.col("last_active_at")).otherwise(F.col("ended_at")))


def fold_devices(devices: DataFrame) -> DataFrame:
    """One row per user and device: first login, last activity, latest address."""
    return devices.groupBy("user_id", "device").agg(F.count("*").alias("logins"), F.min("login_at").alias("login_at"), F.max("last_active_at").alias("last_active_at"), F.max_by("ip_address", F.struct("last_active_at", "ip_address")).alias("ip_address"))


def queue_counts(frames: DataFrame, least: int) -> DataFrame:
    """camera_id, frame_ts, zone_id, tracks of frames with `least` tracks or more in a zone: the queue rule, an extension that is off unless asked for."""
    return frames.select("camera_id", "frame_ts", "local_track_id", F.explode("zones").alias("zone_id")).groupBy("camera_id", "frame_ts", "zone_id").agg(F.count_distinct("local_track_id").alias("tracks")).filter(F.col("tracks") >= least)
