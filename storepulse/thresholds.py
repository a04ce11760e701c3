"""Default thresholds, as data: every operator takes a Thresholds object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # faces
    face_match: float = 0.40
    face_recent: float = 0.35
    face_contradiction: float = 0.25
    face_body_exclusion: float = 0.30
    face_contamination: float = 0.35
    face_duplicate: float = 0.95
    cluster_median_strict: float = 0.35
    cluster_median_grey: float = 0.30
    cluster_pairs: int = 3
    # bodies
    body_match: float = 0.50
    body_recent: float = 0.55
    body_ambiguity: float = 0.03
    body_contamination: float = 0.50
    least_bodies: int = 2
    # galleries
    recent_minutes: int = 5
    most_faces: int = 5
    most_bodies: int = 10
    # creation
    create_face_score: float = 0.60
    create_detections: int = 2
    create_body_quality: float = 0.55
    create_body_nearest: float = 0.45
    create_body_staff: float = 0.48
    switch_quality: float = 0.80
    # overlap
    overlap_live_s: float = 1.0
    overlap_dedup_s: float = 10.0
    lookback_hours: int = 48
    # staff
    staff_streak_days: int = 5
    staff_days: int = 11
    staff_span_days: int = 15
    staff_body: float = 0.70
    staff_bodies: int = 2
    staff_face: float = 0.30
    staff_ambiguity: float = 0.03
    # repair of visits
    stitch_gap_s: float = 30.0
    visit_gap_s: float = 60.0
    visit_dwell_s: float = 20.0
    stitch_body: float = 0.80
    stitch_body_ambiguity: float = 0.05
    stitch_face_reject: float = 0.25
    stitch_face_accept: float = 0.40
    stitch_face_ambiguity: float = 0.03
    stitch_staff_veto: float = 0.70
    # frames
    occlusion_iou: float = 0.10
    face_in_body: float = 0.70
    face_assign: float = 0.45
    assign_ambiguity: float = 0.85
    session_gap_s: float = 5.0
    milestones: tuple[int, ...] = (30, 60, 120)
    cooldown_s: float = 30.0
    dwell_rule_s: float = 60.0
    billing_rule_s: float = 10.0
    purchase_rule_s: float = 15.0
    gender_margin: float = 0.5
    # sessions of devices, objects
    device_idle_s: int = 1800
    viewer_idle_s: int = 7200
    stale_track_minutes: int = 10
    retention_days: int = 30


DEFAULTS = Thresholds()
