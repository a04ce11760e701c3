"""Column expressions: bins, normalisers, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The keys and inclusive bounds of the two report groupings.
AGE_BINS = (("under_18", 0, 17), ("age_18_24", 18, 24), ("age_25_34", 25, 34), ("age_35_44", 35, 44), ("age_45_60", 45, 60), ("age_60_plus", 61, 999))
AGE_GROUPS = (("child", 0, 10), ("teenager", 11, 17), ("young_adult", 18, 35), ("middle_adult", 36, 55), ("senior", 55, 999))


def binned(age: Column, bins=AGE_BINS) -> Column:
    """The first bin that has the age, else unidentified."""
    out = F
    for key, low, high in bins:
        out = out.when(age.between(low, high), key)
    return out.otherwise("unidentified")


def coarse_age(age: Column) -> Column:
    return F.when(age < 12, "child").when(age < 25, "young_adult").when(age < 60, "adult").when(age.isNotNull(), "senior")


def gender_strict(g: Column) -> Column:
    """male for M, female for F, else unidentified."""
    g = F.upper(F.trim(g))
    return F.when(g == "M", "male").when(g == "F", "female").otherwise("unidentified")


def gender_loose(g: Column) -> Column:
    g = F.upper(F.trim(g))
    return F.when(g.isin("M", "MALE"), "male").when(g.isin("F", "FEMALE"), "female").otherwise("unidentified")


def percent_change(now: Column, before: Column) -> Column:
    """To one place; null where there was nothing before."""
    return F.when(before != 0, F.round((now - before) * 100.0 / F.when(before != 0, before), 1))


def conversion(purchasers: Column, visitors: Column) -> Column:
    return F.round(purchasers * 100.0 / F.greatest(visitors, F.lit(1)), 1)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end of two timestamps without zone, fractions included."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000.0)


def decay(ts: Column, as_of: Column, hours: float = 24.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - seconds_between(ts, as_of) / (hours * 3600))


def duration_text(s: Column) -> Column:
    """45s, 3.2m or 1.5h."""
    return F.when(s < 60, F.concat(F.bround(s, 0).cast("long").cast("string"), F.lit("s"))).when(s < 3600, F.format_string("%.1fm", s / 60)).otherwise(F.format_string("%.1fh", s / 3600))


def object_key(path: Column, bucket: str = "media") -> Column:
    return F.when(F.startswith(path, F.lit(f"{bucket}/")), F.substring(path, len(bucket) + 2, 1 << 20)).otherwise(path)


def _first_match(text: Column, tests: list[tuple[tuple[str, ...], str]], other) -> Column:
    out = F
    for parts, name in tests:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(text, F.lit(p))
        out = out.when(hit, name)
    return out.otherwise(other)


def device_label(agent: Column) -> Column:
    """Browser on system; the browser alone if no system is known. Tests are in a fixed order: chrome before opera, linux before android."""
    a = F.lower(F.coalesce(agent, F.lit("")))
    browser = _first_match(a, [(("edg/",), "Edge"), (("chrome/",), "Chrome"), (("firefox/",), "Firefox"), (("safari/",), "Safari"), (("opr/", "opera/"), "Opera")], F.lit("Unknown"))
    system = _first_match(a, [(("mac os", "macintosh"), "macOS"), (("windows nt",), "Windows"), (("linux", "x11"), "Linux"), (("android",), "Android"), (("iphone", "ipad"), "iOS")], F.lit(None).cast("string"))
    return F.when(system.isNull(), browser).otherwise(F.concat(browser, F.lit(" on "), system))


def device_hash(agent: Column, ip: Column) -> Column:
    """SHA-256 of the agent and the address's /24 (of a v6 address the first three groups)."""
    four, six = F.split(ip, r"\."), F.split(ip, ":")
    net = F.when(F.size(four) == 4, F.array_join(F.slice(four, 1, 3), ".")).when(F.size(six) >= 3, F.array_join(F.slice(six, 1, 3), ":")).otherwise(ip)
    return F.sha2(F.concat(agent, F.lit("|"), net), 256)


def crop_quality(torso: Column, confidence: Column, sharpness: Column, height: Column, width: Column, brightness: Column) -> Column:
    """Torso .35, confidence .25, sharpness .15, size .10, aspect .10, brightness .05, to three places. The weight of a null torso goes
    to the confidence, then that of a null confidence to the torso. Missing or under 50 x 25 px: 0."""
    none = F.lit(0.0)
    torso_weight = F.when(torso.isNull(), 0.0).otherwise(0.35) + F.when(confidence.isNull(), F.when(torso.isNull(), 0.60).otherwise(0.25)).otherwise(0.0)
    sure_weight = F.when(confidence.isNull(), 0.0).when(torso.isNull(), 0.60).otherwise(0.25)
    aspect = height / F.when(width > 0, width)
    aspect_score = F.when(aspect.between(1.5, 3.5), 1.0).when(aspect.between(1.0, 4.5), 0.7).otherwise(0.4)
    light = F.when((brightness < 30) | (brightness > 240), 0.3).when((brightness < 60) | (brightness > 200), 0.6).otherwise(1.0)
    total = (
        torso_weight * F.coalesce(torso, none) + sure_weight * F.coalesce(confidence, none) + 0.15 * F.least(F.lit(1.0), sharpness / 500.0)
        + 0.10 * F.least(F.lit(1.0), height * width / float(128 * 256)) + 0.10 * aspect_score + 0.05 * light
    )
    usable = F.coalesce((height >= 50) & (width >= 25), F.lit(False))
    return F.when(usable, F.round(F.greatest(none, F.least(F.lit(1.0), total)), 3)).otherwise(none)


def torso_visibility(keypoint_confidence: Column, least: float = 0.5) -> Column:
    """Share of both shoulders and both hips (keypoints 5, 6, 11, 12) that are visible."""
    return F.size(F.filter(F.transform(F.array(*(F.lit(i) for i in (5, 6, 11, 12))), lambda i: F.get(keypoint_confidence, i)), lambda c: c >= least)) / F.lit(4.0)


def face_quality(det: Column, box: Column, points: Column, weight: float = 0.35) -> Column:
    """Detection score and frontality, to three places. points: [x, y] of left eye, right eye and nose at least; the two eyes
    alone give the spread only, no points give .5."""
    zero, one = F.lit(0.0), F.lit(1.0)
    wide, tall = F.greatest(box["x2"] - box["x1"], one), F.greatest(box["y2"] - box["y1"], one)
    at = lambda i, j: F.get(F.get(points, i), j)
    spread = F.least(one, F.abs(at(1, 0) - at(0, 0)) / wide / 0.35)
    nose = F.greatest(zero, 1 - F.abs(at(2, 0) - (box["x1"] + box["x2"]) / 2) / (wide / 2))
    level = F.greatest(zero, 1 - F.abs(at(1, 1) - at(0, 1)) / tall * 4)
    frontality = F.when(F.size(points) >= 5, 0.55 * spread + 0.30 * nose + 0.15 * level).when(F.size(points) >= 2, spread).otherwise(F.lit(0.5))
    return F.round(F.greatest(zero, F.least(one, (1 - weight) * det + weight * frontality)), 3)


def face_fault(det: Column, width: Column, spread: Column) -> Column:
    """Why a face is not used; null if it is."""
    return F.when(det < 0.5, "low_score").when(width < 30, "too_small").when(spread < 0.25, "not_frontal")
