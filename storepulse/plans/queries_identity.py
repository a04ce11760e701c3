"""Queries: vectors, nearest neighbours, matching, maintenance of identities, studies.

The given vectors do not cluster, so some queries take lower thresholds than the defaults; the operators are the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from storepulse.functions import vectors as V
from storepulse.operators import identity as I
from storepulse.operators import knn as K
from storepulse.operators import maintenance as M
from storepulse.operators import repair as B
from storepulse.operators import studies as E
from storepulse.operators.components import connected_components
from storepulse.plans.lineage import cut
from storepulse.plans.probes import AS_OF, END, START
from storepulse.plans.registry import query
from storepulse.thresholds import DEFAULTS

LOW = replace(DEFAULTS, face_match=0.36, face_recent=0.30, body_recent=0.10, body_match=0.02, body_ambiguity=0.002, face_body_exclusion=0.0, face_contradiction=-0.2, cluster_median_strict=-0.02, cluster_median_grey=-0.05, staff_body=-0.05, staff_face=-0.3, recent_minutes=2000)


def cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


@query("SELECT face_id, round(sqrt(list_dot_product(embedding, embedding)), 4) AS norm, round(embedding[1] * 3 / (3 * sqrt(list_dot_product(embedding, embedding))), 5) AS first, abs(sqrt(list_dot_product(embedding, embedding)) - 1) < 0.01 AS unit FROM faces")
def v1_normalise(p):
    three = F.transform(V.doubles(F.col("embedding")), lambda x: x * 3)
    return p.faces.select("face_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.round(V.normalise(three)[0], 5).alias("first"), (F.abs(V.norm(F.col("embedding")) - 1) < 0.01).alias("unit"))


@query(f"SELECT a.face_id AS a, b.face_id AS b, round({cos('a.embedding', 'b.embedding')}, 5) AS sim FROM faces a JOIN faces b ON b.face_id = a.face_id + 1")
def v2_cosine(p):
    b = p.faces.select((F.col("face_id") - 1).alias("face_id"), F.col("face_id").alias("b"), F.col("embedding").alias("other"))
    return p.faces.join(b, "face_id").select(F.col("face_id").alias("a"), "b", F.round(V.cosine(F.col("embedding"), F.col("other")), 5).alias("sim"))


def probe_pairs(p):
    return p.faces.select(F.col("face_id").alias("query"), ((F.col("face_id") * 7) % 100).alias("person_id"), "embedding")


@query(f"SELECT q.face_id AS query, g.person_id, round(median({cos('q.embedding', 'g.embedding')}), 5) AS median, round(max({cos('q.embedding', 'g.embedding')}), 5) AS best, count(*) AS n FROM faces q JOIN faces g ON g.person_id = (q.face_id * 7) % 100 GROUP BY 1, 2")
def v3_query_to_gallery(p):
    q = probe_pairs(p)
    return K.similarity_to_galleries(q, q, p.faces).select("query", "person_id", F.round("median", 5).alias("median"), F.round("best", 5).alias("best"), "n")


@query(f"SELECT x.person_id AS a, y.person_id AS b, round(median({cos('x.embedding', 'y.embedding')}), 5) AS median, round(max({cos('x.embedding', 'y.embedding')}), 5) AS best, count(*) AS n FROM faces x JOIN faces y ON y.person_id = x.person_id + 1 GROUP BY 1, 2")
def v4_gallery_to_gallery(p):
    people = p.faces.select("person_id").distinct()
    pairs = people.select(F.col("person_id").alias("a"), (F.col("person_id") + 1).alias("b"))
    return K.gallery_pairs(pairs, p.faces).select("a", "b", F.round("median", 5).alias("median"), F.round("best", 5).alias("best"), "n")


NEAR = f"""
nn AS (SELECT query, item, qp, person_id, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM (SELECT a.face_id AS query, b.face_id AS item, a.person_id AS qp, b.person_id, {cos('a.embedding', 'b.embedding')} AS sim FROM faces a JOIN faces b ON a.person_id <> b.person_id) WHERE sim >= 0.4),
dup AS (SELECT least(qp, person_id) AS a, greatest(qp, person_id) AS b, max(sim) AS sim FROM nn WHERE rank <= 5 GROUP BY 1, 2)"""


@query(f"WITH {NEAR} SELECT query, item, person_id, round(sim, 5) AS sim, CAST(rank AS INT) AS rank FROM nn WHERE rank <= 5")
def j9_nearest_other_persons(p):
    own = p.faces.select(F.col("face_id").alias("query"), "person_id", "embedding")
    return K.nearest(own, p.faces.select(F.col("face_id").alias("item"), "person_id", "embedding"), 5, 0.4, other_person=True, block=200).select("query", "item", "person_id", F.round("sim", 5).alias("sim"), "rank")


@query()
def j9_nearest_by_lsh(p):
    q = p.faces.filter("face_id % 100 = 0").select(F.col("face_id").alias("query"), "embedding")
    return K.nearest_lsh(q, p.faces.select(F.col("face_id").alias("item"), "person_id", "embedding"), 5, 0.3)


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS r FROM (SELECT a.face_id AS query, b.face_id AS item, b.person_id, {cos('a.embedding', 'b.embedding')} AS sim FROM faces a JOIN faces b ON a.face_id % 100 = 0)),
b AS (SELECT query, person_id, max(sim) AS sim FROM n WHERE r <= 100 GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, person_id) AS INT) AS rank FROM b)
SELECT query, person_id, round(sim, 5) AS sim, rank FROM k WHERE rank <= 3""")
def j10_best_persons(p):
    q = p.faces.filter("face_id % 100 = 0").select(F.col("face_id").alias("query"), "embedding")
    return K.best_persons(q, p.faces.select(F.col("face_id").alias("item"), "person_id", "embedding"), 3, 100).select("query", "person_id", F.round("sim", 5).alias("sim"), "rank")


def mixed(v):
    """A vector and its reverse, which has nothing to do with it: near to its own row, but not nearest to it by far."""
    one = V.doubles(v)
    return F.zip_with(one, F.reverse(one), lambda x, y: x * 0.35 + y)


def probes(p):
    """Every row as a new window, its vectors mixed; its person of a day before is the one it has now, or another."""
    end = F.col("captured_at") + F.expr("INTERVAL '30' SECOND")
    body = p.bodies.select(F.col("body_id").alias("face_id"), mixed(F.col("embedding")).alias("body"))
    rows = p.faces.join(body, "face_id").select(F.col("face_id").alias("query"), "camera_id", F.col("captured_at").alias("start"), end.alias("end"), mixed(F.col("embedding")).alias("embedding"), "body")
    return cut(rows, "probes")  # read by every step of a match


def galleries(p):
    return p.faces, p.bodies


GALLERY = "gf AS (SELECT * FROM faces), gb AS (SELECT * FROM bodies), pr AS (SELECT face_id AS query, person_id AS own, camera_id, captured_at AS s, captured_at + INTERVAL 30 SECOND AS e, list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: z[1] * 0.35::DOUBLE + z[2]) AS embedding FROM faces)"
RECENT = f"""
rec AS (
  SELECT person_id FROM sessions WHERE person_id IS NOT NULL AND coalesce(ended_at, last_seen_at) >= TIMESTAMP '{AS_OF}' - INTERVAL {LOW.recent_minutes} MINUTE AND started_at <= TIMESTAMP '{AS_OF}'
  UNION SELECT person_id FROM gb WHERE captured_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {LOW.recent_minutes} MINUTE AND TIMESTAMP '{AS_OF}'
  UNION SELECT person_id FROM persons WHERE last_seen_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {LOW.recent_minutes} MINUTE AND TIMESTAMP '{AS_OF}')"""
MATCH = f"""
{GALLERY}, {RECENT},
fn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS r FROM (SELECT query, face_id AS item, person_id, {cos('pr.embedding', 'gf.embedding')} AS sim FROM pr, gf)),
fp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY face DESC, person_id) AS k FROM (SELECT query, person_id, max(sim) AS face FROM fn WHERE r <= 100 GROUP BY ALL)),
fs AS (SELECT fn.query, fn.person_id, median(sim) AS med, max(sim) AS best, count(*) AS n FROM fn GROUP BY ALL),
known AS (SELECT fp.query, fp.person_id, face FROM fp JOIN fs USING (query, person_id) WHERE k <= 10 AND CASE WHEN face >= {LOW.face_match} AND n >= 2 THEN med >= {LOW.cluster_median_strict} WHEN face < {LOW.face_match} AND n >= 3 THEN med >= {LOW.cluster_median_grey} ELSE true END),
bn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS r FROM (SELECT query, body_id AS item, person_id, {cos('pr.embedding', 'gb.embedding')} AS sim FROM pr, gb)),
bp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY b DESC, person_id) AS k FROM (SELECT query, person_id, max(sim) AS b FROM bn WHERE r <= 25 GROUP BY ALL)),
bm AS (SELECT bn.query, bn.person_id, median(sim) AS med, count(*) AS n FROM bn GROUP BY ALL HAVING count(*) >= 2),
body AS (SELECT bp.query, bp.person_id, bm.med AS med, bm.n AS n, fs.best AS face FROM bp JOIN bm USING (query, person_id) LEFT JOIN fs USING (query, person_id) WHERE k <= 10)"""


def tier_sql(name: str, turn: int, where: str, least: float, exclusion: float, gap: float) -> str:
    return f"SELECT query, person_id, '{name}' AS tier, {turn} AS turn, med AS score, coalesce(med - second < {gap}, false) AS ambiguous FROM (SELECT *, row_number() OVER w AS r, lead(med) OVER w AS second FROM body WHERE med >= {least} AND coalesce(face >= {exclusion}, true) AND {where} WINDOW w AS (PARTITION BY query ORDER BY med DESC, person_id)) WHERE r = 1"


def match_sql(t, matched: str) -> str:
    """I1 over candidates `known` and `body` of `matched`, which follows MATCH and may narrow them."""
    return f"""
WITH {MATCH}{matched}, every AS (
  SELECT query, person_id, 'face' AS tier, 1 AS turn, face AS score, false AS ambiguous FROM known WHERE face >= {t.face_match}
  UNION ALL SELECT query, person_id, 'face_recent', 2, face, false FROM known WHERE face >= {t.face_recent} AND person_id IN (SELECT person_id FROM rec)
  UNION ALL {tier_sql('body_recent', 3, 'person_id IN (SELECT person_id FROM rec)', t.body_recent, t.face_contradiction, t.body_ambiguity)}
  UNION ALL {tier_sql('body', 4, 'true', t.body_match, t.face_body_exclusion, t.body_ambiguity)}
  UNION ALL {tier_sql('staff', 5, f"coalesce(face >= {t.staff_face}, false) AND n >= 2 AND person_id IN (SELECT person_id FROM persons WHERE is_staff)", t.staff_body, t.staff_face, t.staff_ambiguity)}),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY turn, score DESC, person_id) AS rk FROM every) WHERE rk = 1),
blocked AS (SELECT DISTINCT f.query FROM first f JOIN pr USING (query) JOIN sessions s ON s.person_id = f.person_id AND s.camera_id = pr.camera_id AND s.session_id <> f.query WHERE epoch(least(pr.e, coalesce(s.ended_at, s.last_seen_at)) - greatest(pr.s, s.started_at)) >= 1),
o AS (SELECT pr.query, f.person_id, f.tier, f.score, CASE WHEN f.tier IS NULL THEN 'no_candidate' WHEN f.ambiguous THEN 'ambiguous' WHEN b.query IS NOT NULL THEN 'overlap' ELSE 'matched' END AS reason FROM pr LEFT JOIN first f USING (query) LEFT JOIN blocked b ON b.query = pr.query)
SELECT query, CASE WHEN reason = 'matched' THEN person_id END AS person_id, tier, round(score, 5) AS score, reason = 'matched' AS accepted, reason FROM o"""


@query(match_sql(LOW, ""))
def i1_match_identities(p):
    f, b = galleries(p)
    return I.match_identities(probes(p), p.persons, f, b, p.sessions, AS_OF, LOW).withColumn("score", F.round("score", 5))


CONTRADICTED = replace(LOW, face_contradiction=0.34)


@query(match_sql(CONTRADICTED, f""" , bad AS (SELECT query, own FROM pr JOIN faces g ON g.person_id = pr.own WHERE pr.query % 3 <> 0 GROUP BY ALL HAVING max({cos('pr.embedding', 'g.embedding')}) < 0.34),
known2 AS (SELECT * FROM known WHERE (query, person_id) NOT IN (SELECT query, own FROM bad)), body2 AS (SELECT * FROM body WHERE (query, person_id) NOT IN (SELECT query, own FROM bad))""").replace("FROM known WHERE face", "FROM known2 WHERE face").replace("FROM body WHERE med", "FROM body2 WHERE med"))
def i4_never_the_contradicted_person(p):
    """I1 of windows of which two thirds have their own row's person now; where its faces contradict the window's it is not matched again."""
    f, b = galleries(p)
    now = p.faces.select(F.col("face_id").alias("query"), F.expr("CASE WHEN face_id % 3 <> 0 THEN person_id END").alias("current_person"))
    return I.match_identities(probes(p).join(now, "query"), p.persons, f, b, p.sessions, AS_OF, CONTRADICTED).withColumn("score", F.round("score", 5))


@query(f"WITH {MATCH} SELECT fp.query, fp.person_id, CASE WHEN face >= 0.2 AND n >= 2 THEN med >= 0.0 WHEN face < 0.2 AND n >= 3 THEN med >= -0.05 ELSE true END AS stands FROM fp JOIN fs USING (query, person_id) WHERE k <= 10")
def i2_cluster_guard(p):
    t = replace(LOW, face_match=0.2, cluster_median_strict=0.0)
    f, _ = galleries(p)
    rows = probes(p)
    near = cut(I.face_candidates(rows, f), "near")
    stats = K.similarity_to_galleries(near, rows.select("query", "embedding"), f)
    return near.join(stats, ["query", "person_id"]).select("query", "person_id", I.cluster_guard(F.col("face"), F.col("median"), F.col("n"), t).alias("stands"))


@query(f"WITH {GALLERY}, {RECENT} SELECT person_id FROM rec")
def i3_recently_active(p):
    return I.recently_active(p.persons, p.sessions, galleries(p)[1], AS_OF, LOW)


@query(f"SELECT q.face_id AS query, g.person_id, round(max({cos('q.embedding', 'g.embedding')}), 5) AS best, max({cos('q.embedding', 'g.embedding')}) < 0.25 AS contradicted FROM faces q JOIN faces g ON g.person_id = (q.face_id * 7) % 100 GROUP BY 1, 2")
def i4_contradictions(p):
    return I.contradictions(probe_pairs(p), p.faces).withColumn("best", F.round("best", 5))


@query(f"WITH {MATCH} SELECT query, person_id, round(med, 5) AS median, n, round(face, 5) AS face FROM body")
def i5_body_candidates(p):
    f, b = galleries(p)
    return I.body_candidates(probes(p), b, f, LOW).select("query", "person_id", F.round("median", 5).alias("median"), "n", F.round("face", 5).alias("face"))


# the staff of the probe tables have no row in the gallery, so here every fourth person is one
STAFF_LOW = replace(LOW, staff_body=-0.2, staff_face=-0.9, staff_ambiguity=0.0)


@query(f"WITH {MATCH} SELECT query, person_id, round(score, 5) AS score, ambiguous FROM ({tier_sql('staff', 5, f'coalesce(face >= {STAFF_LOW.staff_face}, false) AND person_id IN (SELECT person_id FROM persons WHERE person_id % 4 = 1)', STAFF_LOW.staff_body, STAFF_LOW.staff_face, STAFF_LOW.staff_ambiguity)})")
def i6_staff_reattach(p):
    f, b = galleries(p)
    t = STAFF_LOW
    staff = I.body_candidates(probes(p), b, f, LOW).join(p.persons.filter("person_id % 4 = 1").select("person_id"), "person_id", "left_semi").filter(F.coalesce(F.col("face") >= t.staff_face, F.lit(False)))
    return I.ranked_bodies(staff, t.staff_body, t.staff_face, t.staff_ambiguity).withColumn("score", F.round("score", 5))


@query(f"""
WITH m AS (SELECT session_id AS query, person_id, camera_id, started_at AS s, coalesce(ended_at, last_seen_at) AS e FROM sessions WHERE person_id IS NOT NULL)
SELECT DISTINCT m.query FROM m JOIN sessions t ON t.person_id = m.person_id AND t.camera_id = m.camera_id AND t.session_id <> m.query WHERE epoch(least(m.e, coalesce(t.ended_at, t.last_seen_at)) - greatest(m.s, t.started_at)) >= 1""")
def i7_overlap_gate(p):
    m = p.sessions.filter("person_id IS NOT NULL").select(F.col("session_id").alias("query"), "person_id", "camera_id", F.col("started_at").alias("start"), F.coalesce("ended_at", "last_seen_at").alias("end"))
    return I.overlap_gate(m, p.sessions)


@query("SELECT face_id, face_score >= CASE face_id % 6 WHEN 0 THEN 0.35 WHEN 1 THEN 0.4 WHEN 2 THEN 0.55 WHEN 3 THEN 0.5 WHEN 4 THEN 0.7 END AS accepted FROM faces")
def i8_accept_thresholds(p):
    tier = F.get(F.array(*(F.lit(x) for x in ("face_recent", "face", "body_recent", "body", "staff", None))), (F.col("face_id") % 6).cast("int"))
    return p.faces.select("face_id", (F.col("face_score") >= I.accept_threshold(tier)).alias("accepted"))


CREATE = "SELECT event_id AS query, k / 100.0 AS face_score, event_id % 4 AS good_faces, (event_id % 100) / 100.0 AS quality, CASE WHEN event_id % 6 <> 0 THEN (event_id * 7 % 100) / 100.0 END AS nearest, CASE WHEN event_id % 8 <> 0 THEN (event_id * 13 % 100) / 100.0 END AS nearest_staff FROM raw"


@query(f"""
SELECT query, how, sha256('person|' || query) AS person_id FROM (SELECT *, CASE WHEN face_score >= 0.6 AND good_faces >= 2 THEN 'face' WHEN quality >= 0.55 AND coalesce(nearest < 0.45, true) AND coalesce(nearest_staff < 0.48, true) THEN 'body' END AS how FROM ({CREATE})) WHERE how IS NOT NULL""")
def i9_creations(p):
    rows = p.raw.selectExpr("event_id AS query", "k / 100.0D AS face_score", "event_id % 4 AS good_faces", "(event_id % 100) / 100.0D AS quality", "CASE WHEN event_id % 6 <> 0 THEN (event_id * 7 % 100) / 100.0D END AS nearest", "CASE WHEN event_id % 8 <> 0 THEN (event_id * 13 % 100) / 100.0D END AS nearest_staff")
    return I.creations(rows)


@query("""
SELECT event_id, CASE WHEN cur IS NULL AND cand IS NOT NULL THEN 'assign' WHEN cur IS NULL THEN 'none' WHEN bad AND (cand IS NULL OR cand = cur) THEN 'detach' WHEN cand IS NULL OR cand = cur THEN 'keep' WHEN bad OR (by_face AND score > cs) THEN 'switch' WHEN NOT by_face AND quality >= 0.8 AND score > cs THEN 'switch' ELSE 'keep' END AS action
FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN k % 4 END AS cur, CASE WHEN event_id % 5 <> 0 THEN k % 3 END AS cand, event_id % 2 = 0 AS by_face, k / 100.0 AS score, coalesce(CASE WHEN event_id % 7 <> 0 THEN (event_id % 100) / 100.0 END, -1) AS cs, (event_id * 3 % 100) / 100.0 AS quality, event_id % 11 = 0 AS bad FROM raw)""")
def i10_refinement(p):
    x = p.raw.selectExpr("event_id", "CASE WHEN event_id % 3 <> 0 THEN k % 4 END AS cur", "CASE WHEN event_id % 5 <> 0 THEN k % 3 END AS cand", "CASE WHEN event_id % 2 = 0 THEN 'face' ELSE 'body' END AS tier", "k / 100.0D AS score", "CASE WHEN event_id % 7 <> 0 THEN (event_id % 100) / 100.0D END AS cs", "(event_id * 3 % 100) / 100.0D AS quality", "event_id % 11 = 0 AS bad")
    return x.select("event_id", I.refinement(*(F.col(c) for c in ("cur", "cand", "tier", "score", "cs", "quality", "bad"))).alias("action"))


NEXT_FACE = f"{{'ns': -o.face_score, 'face': o.face_id, 'crop': o.face_crop_path, 'v': o.embedding}}"


@query(f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY captured_at, face_id) AS i, count(*) OVER (PARTITION BY person_id) AS n FROM faces),
g AS (SELECT person_id, i, n, [{NEXT_FACE}] AS kept FROM o WHERE i = 1 UNION ALL
  SELECT o.person_id, o.i, o.n, CASE WHEN len(list_filter(kept, lambda k: k.crop = o.face_crop_path)) > 0
      THEN CASE WHEN o.face_score > -list_filter(kept, lambda k: k.crop = o.face_crop_path)[1].ns THEN list_sort(list_append(list_filter(kept, lambda k: k.crop <> o.face_crop_path), {NEXT_FACE})) ELSE kept END
    WHEN list_min(list_transform(kept, lambda k: {cos('k.v', 'o.embedding')})) >= -0.1 THEN list_slice(list_sort(list_append(kept, {NEXT_FACE})), 1, 5) ELSE kept END
  FROM g JOIN o ON o.person_id = g.person_id AND o.i = g.i + 1)
SELECT person_id, k.face AS face_id FROM (SELECT person_id, unnest(kept) AS k FROM g WHERE i = n)""")
def i11_admitted_faces(p):
    return I.admit_faces(p.faces, replace(DEFAULTS, face_contamination=-0.1))


@query(f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY captured_at, body_id) AS i, count(*) OVER (PARTITION BY person_id) AS n FROM bodies),
g AS (SELECT person_id, i, n, [embedding] AS latest, [{{'nq': -crop_quality, 'body': body_id}}] AS best FROM o WHERE i = 1 UNION ALL
  SELECT person_id, i, n, CASE WHEN fits THEN list_slice(list_append(latest, v), -10, -1) ELSE latest END, CASE WHEN fits THEN list_slice(list_sort(list_append(best, b)), 1, 10) ELSE best END
  FROM (SELECT o.person_id, o.i, o.n, latest, best, o.embedding AS v, {{'nq': -o.crop_quality, 'body': o.body_id}} AS b, len(latest) < 3 OR list_aggregate(list_transform(latest, lambda k: {cos('k', 'o.embedding')}), 'median') >= -0.02 AS fits FROM g JOIN o ON o.person_id = g.person_id AND o.i = g.i + 1))
SELECT person_id, k.body AS body_id FROM (SELECT person_id, unnest(best) AS k FROM g WHERE i = n)""")
def i11_admitted_bodies(p):
    return I.admit_bodies(p.bodies, replace(DEFAULTS, body_contamination=-0.02))


@query(f"""
WITH o AS (SELECT face_id % 40 AS track, face_id, embedding AS v, row_number() OVER (PARTITION BY face_id % 40 ORDER BY captured_at, face_id) AS i FROM faces),
g AS (SELECT track, face_id, i, [v] AS kept, true AS keep FROM o WHERE i = 1 UNION ALL
  SELECT track, face_id, i, CASE WHEN keep THEN list_append(kept, v) ELSE kept END, keep FROM (
    SELECT o.track, o.face_id, o.i, o.v, kept, list_max(list_transform(kept, lambda k: {cos('k', 'o.v')})) AS top, top <= 0.95 AND (len(kept) < 2 OR top >= 0.05) AS keep FROM g JOIN o ON o.track = g.track AND o.i = g.i + 1))
SELECT track, face_id FROM g WHERE keep""")
def i12_track_faces(p):
    return I.track_faces(p.faces.withColumn("track", F.col("face_id") % 40), replace(DEFAULTS, face_contamination=0.05))


@query("SELECT user_id AS track, CASE WHEN avg(value / 500) > 0.1 THEN 'M' ELSE 'F' END AS gender, CAST(round_even(median(k), 0) AS INT) AS age FROM raw GROUP BY user_id")
def i13_track_demographics(p):
    return I.track_demographics(p.raw.selectExpr("user_id AS track", "value / 500 AS margin", "k AS age"), replace(DEFAULTS, gender_margin=0.1))


@query("SELECT person_id, arg_max(face_id, {'s': face_score, 't': captured_at, 'i': face_id}) AS face_id, max(face_score) AS score FROM faces GROUP BY person_id")
def i14_person_demographics(p):
    return I.person_demographics(p.faces)


@query(f"""
WITH st AS (SELECT session_id, max(m) AS staff FROM (SELECT b.body_id AS session_id, g.person_id, median({cos('b.embedding', 'g.embedding')}) AS m FROM bodies b JOIN bodies g ON g.person_id IN (SELECT person_id FROM persons WHERE is_staff) GROUP BY ALL) GROUP BY 1),
o AS (SELECT session_id, t, t + INTERVAL 45 SECOND AS e, q, v, staff, row_number() OVER (ORDER BY t, session_id) AS i FROM (SELECT body_id AS session_id, captured_at + to_minutes(CAST((body_id // 40) * 30 AS INT)) AS t, crop_quality AS q, embedding AS v FROM bodies) LEFT JOIN st USING (session_id)),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS session_id, NULL::VARCHAR AS person, NULL::VARCHAR AS outcome, []::STRUCT(p VARCHAR, seen TIMESTAMP, vs DOUBLE[][])[] AS people UNION ALL
  SELECT i, session_id, person, outcome, CASE outcome WHEN 'left' THEN live WHEN 'attached' THEN list_transform(live, lambda k: CASE WHEN k.p = person THEN {{'p': k.p, 'seen': greatest(k.seen, e), 'vs': list_slice(list_append(k.vs, v), -10, -1)}} ELSE k END) ELSE list_append(live, {{'p': person, 'seen': e, 'vs': [v]}}) END FROM (
    SELECT *, CASE outcome WHEN 'attached' THEN sc[1].p WHEN 'created' THEN concat('new-', session_id) END AS person FROM (
      SELECT *, CASE WHEN near >= 0.25 AND (len(sc) < 2 OR sc[2].ns - sc[1].ns >= 0.03) THEN 'attached' WHEN q >= 0.55 AND near < 0.6 AND coalesce(staff, -1) < 0.9 THEN 'created' ELSE 'left' END AS outcome FROM (
        SELECT *, coalesce(-sc[1].ns, -1) AS near FROM (
          SELECT *, list_sort(list_transform(live, lambda k: {{'ns': -list_aggregate(list_transform(k.vs, lambda x: {cos('x', 'v')}), 'median'), 'p': k.p}})) AS sc FROM (
            SELECT o.*, list_filter(people, lambda k: epoch(o.t - k.seen) <= 300) AS live FROM g JOIN o ON o.i = g.i + 1))))))
SELECT session_id, person, outcome FROM g WHERE i > 0""")
def i16_replay(p):
    rows = p.bodies.select(F.col("body_id").alias("session_id"), (F.col("captured_at") + F.expr("make_dt_interval(0, 0, CAST((body_id DIV 40) * 30 AS INT), 0)")).alias("start"), "crop_quality", "embedding")
    rows = rows.select("session_id", "start", (F.col("start") + F.expr("INTERVAL '45' SECOND")).alias("end"), F.col("crop_quality").alias("quality"), "embedding")
    staff = p.bodies.join(p.persons.filter("is_staff").select("person_id"), "person_id", "left_semi")
    return I.replay(rows, staff, replace(DEFAULTS, body_recent=0.25, create_body_nearest=0.6, create_body_staff=0.9))


@query(f"WITH {NEAR} SELECT a, b, round(sim, 5) AS sim FROM dup")
def m1_duplicate_pairs(p):
    return M.duplicate_pairs(p.faces).withColumn("sim", F.round("sim", 5))


VETO = """
veto AS (SELECT DISTINCT least(s.person_id, t.person_id) AS a, greatest(s.person_id, t.person_id) AS b FROM sessions s JOIN sessions t ON s.camera_id = t.camera_id AND s.session_id < t.session_id AND s.person_id <> t.person_id WHERE epoch(least(coalesce(s.ended_at, s.last_seen_at), coalesce(t.ended_at, t.last_seen_at)) - greatest(s.started_at, t.started_at)) >= 10),
kept AS (SELECT a, b, sim FROM dup ANTI JOIN veto USING (a, b))"""


@query(f"WITH {NEAR}, {VETO} SELECT a, b FROM kept")
def m2_overlap_veto(p):
    return M.overlap_veto(M.duplicate_pairs(p.faces), p.sessions).select("a", "b")


CC = """
both_ways AS (SELECT a AS x, b AS y FROM dup UNION SELECT b, a FROM dup UNION SELECT a, a FROM dup UNION SELECT b, b FROM dup),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, w.y FROM reach r JOIN both_ways w ON r.y = w.x),
comp AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x),
win AS (SELECT component, arg_max(person_id, {'s': coalesce(best_face_score, -1), 't': -epoch(first_seen_at), 'i': -person_id}) AS winner FROM comp JOIN persons ON person_id = node GROUP BY component),
mm AS (SELECT node AS person_id, winner FROM comp JOIN win USING (component) WHERE node IN (SELECT person_id FROM persons))"""


@query(f"WITH {NEAR}, {CC} SELECT node, component FROM comp")
def m3_connected_components(p):
    return connected_components(M.duplicate_pairs(p.faces))


def merges(p):
    return M.merge_map(M.duplicate_pairs(p.faces), p.persons)


@query(f"WITH {NEAR}, {CC} SELECT person_id, winner FROM mm")
def m4_winners(p):
    return merges(p)


@query(f"WITH {NEAR}, {CC} SELECT session_id, coalesce(winner, person_id) AS person_id FROM sessions LEFT JOIN mm USING (person_id)")
def m5_remapped_facts(p):
    return M.remap(p.sessions, merges(p)).select("session_id", "person_id")


@query(f"WITH {NEAR}, {CC} SELECT winner, CAST(sum(visit_count) AS BIGINT) AS visit_count, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, count(*) AS members FROM mm JOIN persons USING (person_id) GROUP BY winner")
def m6_merged_persons(p):
    return M.merged_persons(p.persons, merges(p))


def absorbed_sql(table: str, key: str, score: str, most: int, least: float, duplicate: float | None) -> str:
    """Loser by loser, best scored rows first; the cluster is cut to its best rows when the next loser's turn comes, and at the end."""
    row = f"{{'ns': -o.{score}, 'k': o.{key}, 'v': o.embedding}}"
    fits = "len(held) = 0 OR (list_aggregate(sims, 'median') >= {least}{dup})".format(least=least, dup="" if duplicate is None else f" AND list_max(sims) <= {duplicate}")
    return f"""
WITH {NEAR}, {CC}, o AS (SELECT t.*, winner, t.person_id <> winner AS other, row_number() OVER (PARTITION BY winner ORDER BY t.person_id <> winner, t.person_id, {score} DESC, {key}) AS i, count(*) OVER (PARTITION BY winner) AS n FROM {table} t JOIN mm USING (person_id)),
g AS (SELECT winner, i, n, [{row}] AS kept, CASE WHEN other THEN person_id END AS hand, other AS moved FROM o WHERE i = 1 UNION ALL
  SELECT winner, i, n, CASE WHEN takes THEN list_append(held, r) ELSE held END, CASE WHEN other THEN person_id ELSE hand END, (moved AND NOT turn) OR (takes AND other) FROM (
    SELECT *, CASE WHEN NOT other THEN true ELSE {fits} END AS takes FROM (
      SELECT *, list_transform(held, lambda k: {cos('k.v', 'v')}) AS sims FROM (
        SELECT o.winner, o.i, o.n, o.other, o.person_id, hand, moved, o.embedding AS v, {row} AS r, o.other AND o.person_id IS DISTINCT FROM hand AS turn, CASE WHEN o.other AND o.person_id IS DISTINCT FROM hand AND moved THEN list_slice(list_sort(kept), 1, {most}) ELSE kept END AS held
        FROM g JOIN o ON o.winner = g.winner AND o.i = g.i + 1))))
SELECT winner, k.k AS {key} FROM (SELECT winner, unnest(list_slice(list_sort(kept), 1, {most})) AS k FROM g WHERE i = n)"""


@query(absorbed_sql("faces", "face_id", "face_score", DEFAULTS.most_faces, -0.05, DEFAULTS.face_duplicate))
def m7_absorbed_faces(p):
    return M.absorbed(p.faces, merges(p), "face_id", "face_score", DEFAULTS.most_faces, -0.05, DEFAULTS.face_duplicate)


@query(absorbed_sql("bodies", "body_id", "crop_quality", DEFAULTS.most_bodies, -0.05, None))
def m7_absorbed_bodies(p):
    return M.absorbed(p.bodies, merges(p), "body_id", "crop_quality", DEFAULTS.most_bodies, -0.05)


@query(f"""
WITH {NEAR}, {CC}, v AS (SELECT winner, count(*) FILTER (WHERE s.gender = 'M') AS m, count(*) FILTER (WHERE s.gender = 'F') AS f FROM mm JOIN sessions s USING (person_id) GROUP BY winner)
SELECT w.winner, CASE WHEN m > f THEN 'M' WHEN f > m THEN 'F' ELSE p.gender END AS gender FROM (SELECT DISTINCT winner FROM mm) w LEFT JOIN v USING (winner) LEFT JOIN persons p ON p.person_id = w.winner""")
def m8_gender_vote(p):
    return M.gender_vote(p.sessions, merges(p), p.persons)


@query(f"WITH {NEAR}, {CC} SELECT 'merge' AS kind, winner, person_id AS loser, round(max(sim), 5) AS sim FROM mm JOIN dup ON person_id IN (a, b) WHERE person_id <> winner GROUP BY winner, person_id")
def m9_merge_audit(p):
    return M.merge_audit(merges(p), M.duplicate_pairs(p.faces)).withColumn("sim", F.round("sim", 5))


def contaminated_sql(table: str, key: str, score: str, least: float, stop: int) -> str:
    """A person's similarities as a matrix, and who is left as numbers of its rows; a step takes one out."""
    return f"""
WITH g AS (SELECT person_id, list({key} ORDER BY {score} DESC, {key}) AS ks, list(embedding ORDER BY {score} DESC, {key}) AS vs FROM {table} GROUP BY person_id),
m AS (SELECT person_id, ks, list_transform(vs, lambda a: list_transform(vs, lambda b: {cos('a', 'b')})) AS sim FROM g),
r AS (SELECT person_id, ks, sim, range(1, len(ks) + 1) AS rest, NULL::BIGINT AS gone FROM m UNION ALL
  SELECT person_id, ks, sim, list_filter(rest, lambda x: x <> rest[w]), ks[rest[w]] FROM (
    SELECT *, list_position(med, list_min(med)) AS w FROM (
      SELECT person_id, ks, sim, rest, list_transform(rest, lambda x: round(list_aggregate(list_transform(list_filter(rest, lambda y: y <> x), lambda y: sim[x][y]), 'median'), 9)) AS med FROM r WHERE len(rest) >= {stop}))
  WHERE list_min(med) < {least})
SELECT person_id, gone AS {key} FROM r WHERE gone IS NOT NULL"""


@query(contaminated_sql("faces", "face_id", "face_score", 0.0, 2))
def m10_contaminated_faces(p):
    return M.contaminated(p.faces, "face_id", "face_score", 0.0, 2)


@query(contaminated_sql("bodies", "body_id", "crop_quality", -0.02, 3))
def m10_contaminated_bodies(p):
    return M.contaminated(p.bodies, "body_id", "crop_quality", -0.02, 3)


def losers_sql(persons: int) -> str:
    """lost: of one person's sessions on a camera, longest first, those that overlap one that stays by a second."""
    return f"""
ms AS (SELECT session_id, camera_id, person_id % {persons} AS person_id, started_at AS s, coalesce(ended_at, last_seen_at) AS e FROM sessions WHERE person_id IS NOT NULL),
mo AS (SELECT *, row_number() OVER (PARTITION BY camera_id, person_id ORDER BY e - s DESC, s, session_id) AS i FROM ms),
mf AS (SELECT session_id, camera_id, person_id, i, [{{'s': s, 'e': e}}] AS kept, true AS keep FROM mo WHERE i = 1 UNION ALL
  SELECT session_id, camera_id, person_id, i, CASE WHEN free THEN list_append(kept, {{'s': s, 'e': e}}) ELSE kept END, free FROM (
    SELECT o.*, kept, len(list_filter(kept, lambda k: epoch(least(k.e, o.e) - greatest(k.s, o.s)) >= 1)) = 0 AS free FROM mf JOIN mo o ON o.camera_id = mf.camera_id AND o.person_id = mf.person_id AND o.i = mf.i + 1)),
lost AS (SELECT session_id FROM mf WHERE NOT keep)"""


@query(f"WITH {losers_sql(10)} SELECT session_id FROM lost")
def m11_overlap_losers(p):
    return M.overlap_losers(p.sessions.withColumn("person_id", F.col("person_id") % 10))


@query("""
WITH s AS (SELECT * FROM sessions WHERE session_id % 3 <> 0 AND person_id IS NOT NULL), c AS (SELECT person_id, min(started_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, count(*) AS visits, count(*) FILTER (WHERE gender = 'M') AS m, count(*) FILTER (WHERE gender = 'F') AS f FROM s GROUP BY 1)
SELECT person_id, first_seen_at, last_seen_at, visits, CASE WHEN m > f THEN 'M' WHEN f > m THEN 'F' END AS gender FROM c""")
def m12_person_stats(p):
    gone = p.sessions.filter("session_id % 3 = 0").select("session_id")
    return M.person_stats(M.orphaned(p.sessions, gone))


def session_vectors(p):
    return p.faces.select("session_id", "embedding")


@query(f"""
WITH {losers_sql(60)}, rest AS (SELECT *, CASE WHEN session_id % 3 = 0 THEN 'M' ELSE 'F' END AS gender FROM ms WHERE session_id NOT IN (FROM lost)),
t AS (SELECT person_id, sum(CASE WHEN gender = 'M' THEN epoch(e - s) ELSE 0 END) AS m, sum(CASE WHEN gender = 'F' THEN epoch(e - s) ELSE 0 END) AS f FROM rest GROUP BY 1),
other AS (SELECT session_id FROM rest JOIN t USING (person_id) WHERE gender <> CASE WHEN m > f THEN 'M' WHEN f > m THEN 'F' END),
bad AS (SELECT r.session_id FROM rest r JOIN faces v ON v.session_id = r.session_id JOIN faces g ON g.person_id = r.person_id WHERE r.session_id NOT IN (FROM other) GROUP BY r.session_id, r.person_id HAVING median({cos('v.embedding', 'g.embedding')}) < 0.0)
SELECT session_id, 'overlap' AS reason FROM lost UNION ALL SELECT session_id, 'gender' FROM other UNION ALL SELECT session_id, 'face' FROM bad""")
def m13_mixed_tracks(p):
    mixed = p.sessions.withColumn("person_id", F.col("person_id") % 60).withColumn("gender", F.when(F.col("session_id") % 3 == 0, "M").otherwise("F"))
    return M.mixed_tracks(mixed, session_vectors(p), p.faces, replace(DEFAULTS, face_contamination=0.0))


MERGE_LOW = replace(DEFAULTS, face_recent=0.38, body_recent=0.12, cluster_median_grey=-0.02, recent_minutes=1)
NEIGHBOURS = """
sp AS (SELECT session_id, camera_id, person_id, started_at AS s, coalesce(ended_at, last_seen_at) AS e FROM sessions WHERE person_id IS NOT NULL),
rn AS (SELECT DISTINCT a.person_id AS a, b.person_id AS b FROM sp a JOIN sp b ON a.person_id < b.person_id AND a.s - INTERVAL 1 MINUTE <= b.e AND b.s <= a.e + INTERVAL 1 MINUTE)"""


@query(f"""
WITH {NEIGHBOURS}, veto AS (SELECT DISTINCT least(x.person_id, y.person_id) AS a, greatest(x.person_id, y.person_id) AS b FROM sp x JOIN sp y ON x.camera_id = y.camera_id AND x.session_id < y.session_id AND x.person_id <> y.person_id AND epoch(least(x.e, y.e) - greatest(x.s, y.s)) >= 0),
pairs AS (SELECT a, b FROM rn ANTI JOIN veto USING (a, b)),
f AS (SELECT a, b, max({cos('x.embedding', 'y.embedding')}) AS face, median({cos('x.embedding', 'y.embedding')}) AS fm, count(*) AS n FROM pairs JOIN faces x ON x.person_id = a JOIN faces y ON y.person_id = b GROUP BY a, b),
bo AS (SELECT a, b, median({cos('x.embedding', 'y.embedding')}) AS body FROM pairs JOIN bodies x ON x.person_id = a JOIN bodies y ON y.person_id = b GROUP BY a, b),
nb AS (SELECT person_id FROM bodies GROUP BY 1 HAVING count(*) >= 2)
SELECT * FROM (SELECT a, b, CASE WHEN face >= 0.38 AND (n < 3 OR fm >= -0.02) THEN 'face' WHEN a IN (FROM nb) AND b IN (FROM nb) AND body >= 0.12 AND coalesce(face >= 0.25, true) THEN 'body' END AS how FROM pairs LEFT JOIN f USING (a, b) LEFT JOIN bo USING (a, b)) WHERE how IS NOT NULL""")
def m14_recent_merges(p):
    return M.recent_merges(p.sessions, p.faces, p.bodies, MERGE_LOW)


@query(f"""
WITH {NEIGHBOURS}, pairs AS (SELECT CASE WHEN x.is_staff THEN b ELSE a END AS fragment, CASE WHEN x.is_staff THEN a ELSE b END AS staff FROM rn JOIN persons x ON x.person_id = a JOIN persons y ON y.person_id = b WHERE x.is_staff <> y.is_staff),
bo AS (SELECT fragment, staff, median({cos('x.embedding', 'y.embedding')}) AS body FROM pairs JOIN bodies x ON x.person_id = fragment JOIN bodies y ON y.person_id = staff GROUP BY ALL),
f AS (SELECT fragment, staff, max({cos('x.embedding', 'y.embedding')}) AS face FROM pairs JOIN faces x ON x.person_id = fragment JOIN faces y ON y.person_id = staff GROUP BY ALL),
k AS (SELECT fragment, staff, body, row_number() OVER w AS r, lead(body) OVER w AS second FROM bo JOIN f USING (fragment, staff) WHERE body >= 0.01 AND face >= 0.05 WINDOW w AS (PARTITION BY fragment ORDER BY body DESC, staff))
SELECT fragment, staff FROM k WHERE r = 1 AND (second IS NULL OR body - second >= 0.002)""")
def m15_staff_fragments(p):
    return M.staff_fragments(p.sessions, p.persons, p.faces, p.bodies, replace(DEFAULTS, staff_body=0.01, staff_face=0.05, staff_ambiguity=0.002, recent_minutes=1))


@query("SELECT session_id, CASE WHEN person_id IN (2, 3) THEN 1 WHEN person_id = 9 THEN 8 ELSE person_id END AS person_id FROM sessions")
def m16_forced_merge(p):
    forced = p.persons.filter("person_id IN (2, 3, 9)").select("person_id", F.when(F.col("person_id") == 9, 8).otherwise(1).cast("bigint").alias("winner"))
    return M.remap(p.sessions, forced).select("session_id", "person_id")


@query("SELECT 'session' AS kind, session_id AS id, CASE WHEN person_id % 7 <> 0 THEN person_id END AS person_id FROM sessions UNION ALL SELECT 'face', face_id, person_id FROM faces WHERE person_id NOT IN (SELECT person_id FROM persons WHERE person_id % 7 = 0)")
def m17_deleted_persons(p):
    gone = p.persons.filter("person_id % 7 = 0").select("person_id")
    nulled = M.without_persons(p.sessions, gone, False).select(F.lit("session").alias("kind"), F.col("session_id").alias("id"), "person_id")
    return nulled.union(M.without_persons(p.faces, gone, True).select(F.lit("face"), "face_id", "person_id"))


@query("SELECT person_id, (SELECT arg_max(best_crop_path, {'t': started_at, 'i': session_id}) FROM sessions s WHERE s.person_id = p.person_id AND best_crop_path IS NOT NULL) AS crop FROM persons p WHERE person_id NOT IN (SELECT person_id FROM faces WHERE person_id % 2 = 0)")
def m18_faceless(p):
    return M.faceless(p.persons, p.faces.filter("person_id % 2 = 0"), p.sessions)


@query(f"""
WITH d AS (SELECT DISTINCT person_id, CAST(started_at + INTERVAL 330 MINUTE AS DATE) - DATE '2000-01-01' AS n FROM sessions WHERE person_id IS NOT NULL), i AS (SELECT person_id, n - row_number() OVER (PARTITION BY person_id ORDER BY n) AS g FROM d),
c AS (SELECT person_id, count(*) OVER (PARTITION BY person_id ORDER BY n RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS c FROM d), ok AS (SELECT person_id FROM i GROUP BY person_id, g HAVING count(*) >= 5 UNION SELECT person_id FROM c WHERE c >= 11),
r AS (SELECT person_id, has_face AND person_id IN (FROM ok) AS rule, has_face FROM persons WHERE is_staff AND person_id IN (SELECT person_id FROM sessions WHERE started_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'))
SELECT person_id, CASE WHEN rule THEN 'keep' ELSE 'demote' END AS verdict, CASE WHEN rule THEN 'rule' WHEN NOT has_face THEN 'no_face' ELSE 'too_few_days' END AS reason FROM r""")
def m19_revalidated_staff(p):
    return M.revalidated_staff(p.persons, p.sessions, START, END)


@query(f"""
WITH r AS (SELECT session_id AS sid, person_id, f.embedding FROM (SELECT session_id, person_id FROM sessions WHERE person_id IS NOT NULL AND total_frames >= 5) JOIN (SELECT session_id, embedding FROM faces) f USING (session_id)),
a AS (SELECT sid AS session_id FROM r JOIN faces g USING (person_id) GROUP BY sid, person_id HAVING count(*) >= 2 AND max({cos('r.embedding', 'g.embedding')}) < 0.25),
b AS (SELECT sid AS session_id FROM r JOIN bodies g USING (person_id) GROUP BY sid, person_id HAVING count(*) >= 3 AND max({cos('r.embedding', 'g.embedding')}) < 0.5)
SELECT session_id, CASE WHEN session_id IN (FROM a) THEN 'face' ELSE 'body' END AS reason FROM (FROM a UNION FROM b)""")
def m20_detached_tracks(p):
    v = session_vectors(p)
    return M.detached_tracks(p.sessions, v, v, p.faces, p.bodies)


@query(f"SELECT a.face_id, round({cos('a.embedding', 'b.embedding')}, 5) AS sim, {cos('a.embedding', 'b.embedding')} < 0.2 AS low FROM faces a JOIN (SELECT face_id, lead(embedding, 1, embedding) OVER (ORDER BY face_id) AS next, CASE WHEN face_id % 4 = 0 THEN lead(embedding, 1, embedding) OVER (ORDER BY face_id) ELSE embedding END AS embedding FROM faces) b USING (face_id)")
def m21_stored_against_recomputed(p):
    """Every row against the vector computed again, here the row's own, but for every fourth row the next row's."""
    following = p.faces.select((F.col("face_id") - 1).alias("face_id"), F.col("embedding").alias("following"))
    again = p.faces.join(following, "face_id", "left").select("face_id", F.when(F.col("face_id") % 4 == 0, F.coalesce("following", "embedding")).otherwise(F.col("embedding")).alias("embedding"))
    return M.recomputed(p.faces, again, "face_id", 0.2).withColumn("sim", F.round("sim", 5))


@query(f"""
WITH {NEAR}, f AS (SELECT person_id, count(*) AS n FROM faces GROUP BY 1), s AS (SELECT person_id, count(*) AS n FROM sessions WHERE person_id IS NOT NULL GROUP BY 1)
SELECT a, b, round(sim, 5) AS sim, fa.n AS faces_a, fb.n AS faces_b, coalesce(sa.n, 0) AS sessions_a, coalesce(sb.n, 0) AS sessions_b FROM dup JOIN f fa ON fa.person_id = a JOIN f fb ON fb.person_id = b LEFT JOIN s sa ON sa.person_id = a LEFT JOIN s sb ON sb.person_id = b""")
def a30_duplicate_report(p):
    return M.duplicate_report(M.duplicate_pairs(p.faces), p.faces, p.sessions).withColumn("sim", F.round("sim", 5))


@query(f"""
SELECT person_id, count(*) AS n, round(avg(s), 5) AS mean, round(median(s), 5) AS median, round(stddev_pop(s), 5) AS std, count(*) FILTER (WHERE s < 0.1) AS low_pairs FROM (SELECT a.person_id, {cos('a.embedding', 'b.embedding')} AS s FROM faces a JOIN faces b ON a.person_id = b.person_id AND a.face_id < b.face_id) GROUP BY 1""")
def a31_gallery_diagnostics(p):
    return K.gallery_spread(p.faces, "face_id", 0.1).select("person_id", "n", *(F.round(c, 5).alias(c) for c in ("mean", "median", "std")), "low_pairs")


STITCH_LOW = replace(DEFAULTS, stitch_gap_s=3600.0, stitch_face_reject=0.0, stitch_face_accept=0.2, stitch_body=0.0, stitch_body_ambiguity=0.01, stitch_staff_veto=0.02)
STITCH = f"""
ps AS (SELECT session_id, camera_id, person_id % 50 AS person_id, started_at AS s, coalesce(ended_at, last_seen_at) AS e FROM sessions),
cand AS (SELECT DISTINCT o.session_id AS orphan, k.person_id FROM ps o JOIN ps k ON o.camera_id = k.camera_id WHERE o.person_id IS NULL AND k.person_id IS NOT NULL AND k.person_id NOT IN (SELECT person_id FROM persons WHERE is_staff) AND greatest(epoch(k.s - o.e), epoch(o.s - k.e)) BETWEEN 0 AND 3600),
fo AS (SELECT session_id AS orphan, embedding FROM faces WHERE session_id % 3 <> 0), bo AS (SELECT body_id AS orphan, embedding FROM bodies WHERE body_id % 5 <> 0),
fc AS (SELECT orphan, c.person_id, max({cos('fo.embedding', 'g.embedding')}) AS face FROM cand c JOIN fo USING (orphan) JOIN faces g ON g.person_id = c.person_id GROUP BY ALL),
bc AS (SELECT orphan, c.person_id, median({cos('bo.embedding', 'g.embedding')}) AS body FROM cand c JOIN bo USING (orphan) JOIN bodies g ON g.person_id = c.person_id GROUP BY ALL HAVING count(*) >= 2),
sv AS (SELECT orphan, median({cos('bo.embedding', 'g.embedding')}) AS staff_body FROM (SELECT DISTINCT orphan FROM cand) JOIN bo USING (orphan) JOIN bodies g ON g.person_id IN (SELECT person_id FROM persons WHERE is_staff) GROUP BY orphan),
sc AS (SELECT cand.orphan, cand.person_id, cand.orphan IN (SELECT orphan FROM fo) AS has_face, face, body, staff_body FROM cand LEFT JOIN fc USING (orphan, person_id) LEFT JOIN bc USING (orphan, person_id) LEFT JOIN sv USING (orphan))"""


def stitch_scores(p):
    """Sessions of 50 persons; a third of those without person have no face, a fifth no body."""
    sessions = p.sessions.withColumn("person_id", F.col("person_id") % 50)
    staff = p.persons.filter("is_staff").select("person_id")
    found = B.stitch_persons(sessions, staff, STITCH_LOW.stitch_gap_s)
    faces_of = p.faces.filter("session_id % 3 <> 0").select("session_id", "embedding")
    bodies_of = p.bodies.filter("body_id % 5 <> 0").select(F.col("body_id").alias("session_id"), "embedding")
    return B.stitch_scores(found, faces_of, bodies_of, p.faces, p.bodies, p.bodies.join(staff, "person_id", "left_semi"), STITCH_LOW)


@query(f"WITH {STITCH} SELECT orphan, person_id, has_face, round(face, 5) AS face, round(body, 5) AS body, round(staff_body, 5) AS staff_body FROM sc")
def b4_stitch_vectors(p):
    return stitch_scores(p).withColumns({c: F.round(c, 5) for c in ("face", "body", "staff_body")})


@query(f"""
WITH {STITCH}, h AS (SELECT *, coalesce(face, -1) AS f, coalesce(body, 0) AS b, CASE WHEN face >= 0.2 THEN 'face' WHEN NOT has_face AND body >= 0.0 THEN 'body' WHEN face >= 0.0 AND body >= 0.0 THEN 'body_face_ok' END AS how FROM sc),
r AS (SELECT *, row_number() OVER w AS rk, lead(f) OVER w AS f2, lead(b) OVER w AS b2 FROM h WHERE how IS NOT NULL WINDOW w AS (PARTITION BY orphan ORDER BY f DESC, b DESC, person_id)),
o AS (SELECT orphan, person_id, how, coalesce((abs(b - b2) < 0.01 AND f < 0.2) OR (f >= 0.2 AND f2 >= 0.2 AND abs(f - f2) < 0.03), false) AS near FROM r WHERE rk = 1),
v AS (SELECT orphan, coalesce(max(staff_body) >= 0.02, false) AS vetoed FROM sc GROUP BY orphan)
SELECT orphan, CASE WHEN NOT vetoed THEN person_id END AS person_id, CASE WHEN NOT vetoed THEN how END AS how, CASE WHEN vetoed THEN 'staff' WHEN how IS NULL THEN 'no_match' WHEN near THEN 'ambiguous' ELSE 'stitched' END AS reason FROM v LEFT JOIN o USING (orphan)""")
def b4_stitch_scoring(p):
    return B.stitch(stitch_scores(p), STITCH_LOW)


STUDY = f"st AS (SELECT CASE WHEN a.person_id = b.person_id THEN 'same' ELSE 'different' END AS kind, round({cos('a.embedding', 'b.embedding')}, 4) AS sim FROM faces a JOIN faces b ON a.face_id < b.face_id AND a.person_id // 10 = b.person_id // 10)"


def study(p):
    return K.similarity_counts(p.faces.select((F.col("person_id") / 10).cast("int").alias("group"), F.col("face_id").alias("id"), F.col("person_id").alias("person"), "embedding"))


@query(f"WITH {STUDY}, r AS (SELECT kind, sim, row_number() OVER (PARTITION BY kind ORDER BY sim) AS i, count(*) OVER (PARTITION BY kind) AS n FROM st) SELECT kind, max(n) AS n, max(sim) FILTER (WHERE i = n * 10 // 100 + 1) AS p10, max(sim) FILTER (WHERE i = n * 50 // 100 + 1) AS p50, max(sim) FILTER (WHERE i = n * 90 // 100 + 1) AS p90 FROM r GROUP BY kind")
def e1_similarity_quantiles(p):
    return E.quantile_picks(study(p))


SWEEP = f"""
{STUDY}, sw AS (SELECT t, (SELECT count(*) FROM st WHERE kind = 'same' AND floor(round(sim * 100, 6)) >= t) AS tp, (SELECT count(*) FROM st WHERE kind = 'different' AND floor(round(sim * 100, 6)) >= t) AS fp, (SELECT count(*) FROM st WHERE kind = 'same') AS pos FROM range(0, 101) r(t)),
f1 AS (SELECT t / 100.0::DOUBLE AS threshold, tp, fp, pos - tp AS fn, round(CASE WHEN 2 * tp + fp + pos - tp > 0 THEN 2 * tp / (2 * tp + fp + pos - tp)::DOUBLE ELSE 0.0::DOUBLE END, 6) AS f1 FROM sw)"""


@query(f"WITH {SWEEP} SELECT * FROM f1")
def e2_f1_sweep(p):
    return E.f1_sweep(study(p))


@query(f"WITH {SWEEP} SELECT threshold, f1 FROM f1 ORDER BY f1 DESC, threshold LIMIT 1")
def e2_best_threshold(p):
    return E.best_threshold(E.f1_sweep(study(p)))


@query(f"WITH {STUDY}, r AS (SELECT kind, sim, row_number() OVER (PARTITION BY kind ORDER BY sim) AS i, count(*) OVER (PARTITION BY kind) AS n FROM st) SELECT round((max(sim) FILTER (WHERE kind = 'same' AND i = n * 10 // 100 + 1) + max(sim) FILTER (WHERE kind = 'different' AND i = n * 90 // 100 + 1)) / 2, 6) AS midpoint FROM r")
def e2_midpoint(p):
    return E.midpoint(E.quantile_picks(study(p)))


@query(f"WITH {STUDY} SELECT kind, CAST(trunc(sim * 20) AS INT) / 20.0::DOUBLE AS bin, count(*) AS n FROM st GROUP BY 1, 2")
def e3_similarity_histogram(p):
    return E.similarity_histogram(study(p))


@query("""
WITH x AS (SELECT CASE user_id % 2 WHEN 0 THEN 'M' ELSE 'F' END AS truth, CASE WHEN k < 60 THEN 'M' WHEN k < 90 THEN 'F' END AS one, CASE WHEN value > 20 THEN 'F' ELSE 'M' END AS two, event_type = 'click' AS clicks, k > 50 AS high FROM raw),
l AS (SELECT *, unnest(list_filter(['all', CASE WHEN clicks THEN 'clicks' END, CASE WHEN high THEN 'high' END], lambda s: s IS NOT NULL)) AS subset FROM x), m AS (SELECT truth, subset, 'one' AS method, one AS said FROM l UNION ALL SELECT truth, subset, 'two', two FROM l)
SELECT method, subset, count(*) AS n, count(*) FILTER (WHERE said = truth) AS correct, count(*) FILTER (WHERE said <> truth) AS wrong, count(*) FILTER (WHERE said IS NULL) AS abstained, count(*) FILTER (WHERE truth = 'F' AND said = 'M') AS f_to_m, count(*) FILTER (WHERE truth = 'M' AND said = 'F') AS m_to_f FROM m GROUP BY 1, 2""")
def e4_classifier_comparison(p):
    rows = p.raw.selectExpr("CASE user_id % 2 WHEN 0 THEN 'M' ELSE 'F' END AS truth", "CASE WHEN k < 60 THEN 'M' WHEN k < 90 THEN 'F' END AS one", "CASE WHEN value > 20 THEN 'F' ELSE 'M' END AS two", "event_type = 'click' AS clicks", "k > 50 AS high")
    return E.classifier_comparison(rows, ["one", "two"], ["clicks", "high"])


@query("""
WITH s AS (SELECT user_id AS person_id, CASE user_id % 2 WHEN 0 THEN 'M' ELSE 'F' END AS truth, k / 100.0::DOUBLE AS margin FROM raw), d AS (SELECT unnest([0.4, 0.45, 0.5, 0.55])::DOUBLE AS delta),
g AS (SELECT person_id, any_value(truth) AS truth, delta, avg(margin) > delta AS mean, median(margin) > delta AS median, avg(CASE WHEN margin > delta THEN 1.0 ELSE 0.0 END) > 0.5 AS majority FROM s, d GROUP BY person_id, delta),
l AS (SELECT truth, delta, 'mean' AS how, mean AS male FROM g UNION ALL SELECT truth, delta, 'median', median FROM g UNION ALL SELECT truth, delta, 'majority', majority FROM g),
o AS (SELECT how, delta, count(*) FILTER (WHERE (truth = 'M') <> male) AS errors, count(*) FILTER (WHERE truth = 'M' AND NOT male) AS m_to_f, count(*) FILTER (WHERE truth = 'F' AND male) AS f_to_m FROM l GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY errors, m_to_f, f_to_m, delta, how) = 1 AS best FROM o""")
def e5_margin_sweep(p):
    rows = p.raw.selectExpr("user_id AS person_id", "CASE user_id % 2 WHEN 0 THEN 'M' ELSE 'F' END AS truth", "k / 100.0D AS margin")
    return E.margin_sweep(rows, [0.4, 0.45, 0.5, 0.55])
