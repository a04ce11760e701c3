"""Boxes, polygons and lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def feet(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, b["y2"]


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / F.when(union > 0, union)).otherwise(F.lit(0.0))


def share_inside(inner: Column, outer: Column) -> Column:
    own = area(inner)
    return F.when(own > 0, intersection(inner, outer) / F.when(own > 0, own)).otherwise(F.lit(0.0))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Strictly inside; the boundary is outside, and so is everything for a null polygon. polygon: array of [x, y]."""
    n = F.size(polygon)
    edges = F.transform(polygon, lambda p, i: F.struct(p[0].alias("ax"), p[1].alias("ay"), F.element_at(polygon, (i + 1) % n + 1)[0].alias("bx"), F.element_at(polygon, (i + 1) % n + 1)[1].alias("by")))

    def on_edge(e):
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return (cross == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crossed(e):
        # multiplied out, so that no edge divides by zero
        side = (x - e["ax"]) * (e["by"] - e["ay"]) - (y - e["ay"]) * (e["bx"] - e["ax"])
        return ((e["ay"] > y) != (e["by"] > y)) & F.when(e["by"] > e["ay"], side < 0).otherwise(side > 0)

    odd = F.size(F.filter(edges, crossed)) % 2 == 1
    return F.coalesce((n >= 3) & odd & ~F.exists(edges, on_edge), F.lit(False))


def crossing(px: Column, py: Column, x: Column, y: Column, line: Column) -> Column:
    """forward, backward or null for the step from (px, py) to (x, y) over a line [[x, y], [x, y]]; a touch counts, a step along it does not."""
    ax, ay, bx, by = line[0][0], line[0][1], line[1][0], line[1][1]
    turn = lambda ox, oy, mx, my, qx, qy: F.signum((mx - ox) * (qy - oy) - (my - oy) * (qx - ox))
    meet = (turn(ax, ay, bx, by, px, py) * turn(ax, ay, bx, by, x, y) <= 0) & (turn(px, py, x, y, ax, ay) * turn(px, py, x, y, bx, by) <= 0)
    direction = (bx - ax) * (y - py) - (by - ay) * (x - px)
    return F.when(meet & (direction > 0), "forward").when(meet & (direction < 0), "backward")
