"""Live identities: closed windows matched as they arrive, new persons made, galleries grown.

State is append-only tables under one folder, a part per batch number: decisions, faces, bodies, and the ids that left a gallery. A batch
sees the parts of earlier batches only and overwrites its own, so a batch done again after a failure gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.operators.identity import admit_bodies, admit_faces, body_candidates, creations, match_identities, recently_active
from storepulse.plans.lineage import cut, new_path
from storepulse.streaming.runs import each_batch
from storepulse.thresholds import DEFAULTS, Thresholds

FACES = "person_id bigint, face_id bigint, embedding array<double>, face_score double, face_crop_path string, captured_at timestamp_ntz"
BODIES = "person_id bigint, body_id bigint, embedding array<double>, crop_quality double, captured_at timestamp_ntz"
DECISIONS = "query bigint, camera_id int, start timestamp_ntz, end timestamp_ntz, person_id bigint, outcome string, reason string"


def live_identities(windows: DataFrame, persons: DataFrame, faces: DataFrame, bodies: DataFrame, sessions: DataFrame, t: Thresholds = DEFAULTS, root: str | None = None, progress: str | None = None) -> DataFrame:
    """Decisions (query, camera_id, start, end, person_id, outcome, reason), outcome being matched, created or left, one row per window of the stream
    (query, camera_id, start, end, embedding, body, face_score, face_crop_path, good_faces, quality) that is available now.

    A batch is decided against the galleries as the batches before left them: windows of one batch do not see each other. A window without
    candidate makes a person, whose id is a hash of the window's, if its face or its body passes the creation rule. The face and body of a
    matched or new window are offered to the person's gallery, which is folded anew by the rules of admission; what it drops is not seen by
    later batches. Null vectors are offered to no gallery. With the same root and progress folders a stopped run goes on."""
    spark = windows.sparkSession
    root = root or new_path(spark, "identities")

    def before(n: int, what: str, schema: str) -> DataFrame:
        rows = spark.read.schema(f"{schema}, batch int").parquet(f"{root}/{what}") if n else spark.createDataFrame([], f"{schema}, batch int")
        return rows.filter(F.col("batch") < n).drop("batch")

    def gallery(n: int, what: str, schema: str, given: DataFrame, key: str) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        return given.select(*columns).union(before(n, what, schema)).join(before(n, f"{what}_gone", f"{key} bigint"), key, "left_anti").select(*columns)

    def keep(rows: DataFrame, n: int, what: str) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/{what}/batch={n}")

    def grow(seen: DataFrame, new: DataFrame, admit, n: int, what: str, key: str) -> None:
        offered = new.filter("embedding IS NOT NULL")
        touched = seen.join(offered.select("person_id").distinct(), "person_id", "left_semi").select(*seen.columns)
        admitted = cut(admit(touched.union(offered.select(*seen.columns)), t).select(key), "admitted")
        keep(offered.join(admitted, key, "left_semi").select(*seen.columns), n, what)
        keep(touched.select(key).join(admitted, key, "left_anti"), n, f"{what}_gone")

    def decide(batch: DataFrame, n: int) -> None:
        batch = cut(batch, "windows")
        as_of = batch.agg(F.max("end").alias("end")).first().end
        if as_of is None:
            as_of = "1970-01-01 00:00:00"  # an empty batch keeps empty parts
        seen_faces, seen_bodies = gallery(n, "faces", FACES, faces, "face_id"), gallery(n, "bodies", BODIES, bodies, "body_id")
        decided = before(n, "decisions", DECISIONS)
        past = decided.filter("person_id IS NOT NULL").select(F.col("query").alias("session_id"), "person_id", "camera_id", F.col("start").alias("started_at"), F.col("end").alias("last_seen_at"), F.col("end").alias("ended_at"))
        known = sessions.select(*past.columns).union(past)
        found = cut(match_identities(batch, persons, seen_faces, seen_bodies, known, as_of, t), "found")
        open_ = batch.join(found.filter("reason = 'no_candidate'").select("query"), "query", "left_semi")
        near = body_candidates(open_, seen_bodies, seen_faces, t).join(recently_active(persons, known, seen_bodies, as_of, t).withColumn("recent", F.lit(True)), "person_id", "left").join(persons.select("person_id", "is_staff"), "person_id", "left")
        nearest = near.groupBy("query").agg(F.max(F.when(F.col("recent"), F.col("median"))).alias("nearest"), F.max(F.when(F.col("is_staff"), F.col("median"))).alias("nearest_staff"))
        made = creations(open_.join(nearest, "query", "left"), t).select("query", F.xxhash64(F.lit("person"), "query").alias("new"))
        out = batch.join(found.select("query", "person_id", "reason"), "query").join(made, "query", "left")
        outcome = F.when(F.col("person_id").isNotNull(), "matched").when(F.col("new").isNotNull(), "created").otherwise("left")
        out = cut(out.withColumn("outcome", outcome).withColumn("person_id", F.coalesce("person_id", "new")), "decided")
        sure = out.filter("person_id IS NOT NULL")
        grow(seen_faces, sure.select("person_id", F.col("query").alias("face_id"), "embedding", "face_score", "face_crop_path", F.col("start").alias("captured_at")), admit_faces, n, "faces", "face_id")
        grow(seen_bodies, sure.select("person_id", F.col("query").alias("body_id"), F.col("body").alias("embedding"), F.col("quality").alias("crop_quality"), F.col("start").alias("captured_at")), admit_bodies, n, "bodies", "body_id")
        keep(out.select(*(c.split()[0] for c in DECISIONS.split(", "))), n, "decisions")

    each_batch(windows, decide, progress=progress)
    return spark.read.schema(f"{DECISIONS}, batch int").parquet(f"{root}/decisions").drop("batch")
