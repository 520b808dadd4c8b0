"""Boxes, points, and time intervals, as Column expressions. A box is a struct or array-like (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .similarity import ratio


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def box_from_size(x, y, w, h) -> Column:
    return box(x, y, x + w, y + h)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes without a union."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def center_inside(a: Column, b: Column) -> Column:
    """Is the middle of a inside b?"""
    return point_inside((a["x1"] + a["x2"]) / 2, (a["y1"] + a["y2"]) / 2, b)


def point_inside(x: Column, y: Column, b: Column) -> Column:
    return (x >= b["x1"]) & (x <= b["x2"]) & (y >= b["y1"]) & (y <= b["y2"])


def point_distance(x: Column, y: Column, b: Column) -> Column:
    """From a point to the nearest place of a box."""
    dx = F.greatest(b["x1"] - x, F.lit(0.0), x - b["x2"])
    dy = F.greatest(b["y1"] - y, F.lit(0.0), y - b["y2"])
    return F.sqrt(dx * dx + dy * dy)


def parse_box(text: Column, width: Column, height: Column) -> Column:
    """The first four numbers of a text as a box in pixels: values to 1.5 are shares, to 1000 thousandths, else pixels; corners are ordered and clipped."""
    v = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), 0), 1, 4), lambda x: x.try_cast("double"))
    most = F.array_max(v)
    scale = lambda size: F.when(most <= 1.5, size).when(most <= 1000, size / 1000).otherwise(1.0)
    clip = lambda c, size: F.greatest(F.lit(0.0), F.least(c, size.cast("double")))
    x1, y1, x2, y2 = (clip(F.get(v, k) * scale(width if k % 2 == 0 else height), width if k % 2 == 0 else height) for k in range(4))
    return F.when(F.size(v) == 4, box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)))


def best_iou(targets: Column, preds: Column) -> Column:
    """For each target box, the largest IoU with a predicted one; 0 without any."""
    return F.transform(targets, lambda t: F.coalesce(F.array_max(F.transform(preds, lambda p: iou(t, p))), F.lit(0.0)))


def time_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two intervals over their hull; 0 for a hull without length."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return ratio(F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)), F.when(hull > 0, hull))


def merge_intervals(c: Column) -> Column:
    """Union of an array of struct(start, end) as disjoint intervals in order; touching ones merge."""
    kind = "array<struct<start:double,end:double>>"
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
        F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(c.cast(kind)), F.array().cast(kind), step)


def total_length(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + (x["end"] - x["start"]))


def interval_sets_iou(a: Column, b: Column) -> Column:
    """Length of the intersection of two unions of intervals over that of their union."""
    a, b = merge_intervals(a), merge_intervals(b)
    common = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.aggregate(b, F.lit(0.0), lambda u, y: u + F.greatest(F.lit(0.0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))))
    return ratio(common, F.when(total_length(a) + total_length(b) - common > 0, total_length(a) + total_length(b) - common))


# Polygons: arrays of struct<x double, y double>, corners in either direction


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The polygon of a box."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2))


def _let(value: Column, f) -> Column:
    """f of value, which is worked out once: inside a lambda an expression is worked out anew wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def upright(p: Column) -> Column:
    """Is the polygon a box whose sides run along x and y?"""
    at = lambda c, i, j: F.get(p, F.lit(i))[c] == F.get(p, F.lit(j))[c]
    turned = [at(c, 0, 1) & at(c, 2, 3) & at(d, 1, 2) & at(d, 3, 0) for c, d in ("xy", "yx")]
    return F.coalesce((F.size(p) == 4) & (turned[0] | turned[1]), F.lit(False))


def signed_area(p: Column) -> Column:
    """Above 0 if the corners go from x to y; 0 for fewer than three."""

    def turns(own: Column) -> Column:
        after = lambda i: F.get(own, (i + 1) % F.size(own))
        each = F.transform(own, lambda a, i: a["x"] * after(i)["y"] - after(i)["x"] * a["y"])
        return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / 2

    return _let(p, turns)


def polygon_area(p: Column) -> Column:
    """Area of any simple polygon; a box's without a walk along its corners."""
    across = lambda c: F.abs(F.get(p, F.lit(2))[c] - F.get(p, F.lit(0))[c])
    return F.when(upright(p), across("x") * across("y")).otherwise(F.abs(signed_area(p)))


def clip(subject: Column, window: Column) -> Column:
    """The part of subject inside a convex window, edge by edge of the window; its area is right for any simple subject.

    An edge is a half plane a x + b y + c >= 0; a corner inside stays, and where two corners lie on both sides of the edge
    the place between them comes in.
    """
    sign = F.when(signed_area(window) < 0, -1.0).otherwise(1.0)

    def edge(p: Column, q: Column) -> Column:
        a, b = p["y"] - q["y"], q["x"] - p["x"]
        return F.struct(a.alias("a"), b.alias("b"), (-(a * p["x"] + b * p["y"])).alias("c"))

    edges = F.transform(window, lambda p, i: edge(p, F.get(window, (i + 1) % F.size(window))))
    edges = _let(sign, lambda s: F.transform(edges, lambda e: F.struct((e["a"] * s).alias("a"), (e["b"] * s).alias("b"), (e["c"] * s).alias("c"))))
    none = F.array().cast("array<struct<x:double,y:double>>")

    def inside(held: Column, e: Column) -> Column:
        sided = F.transform(held, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (e["a"] * p["x"] + e["b"] * p["y"] + e["c"]).alias("s")))

        def corners(own: Column) -> Column:
            def corner(p: Column, q: Column) -> Column:
                share = p["s"] / F.nullif(p["s"] - q["s"], F.lit(0.0))
                cross = F.struct((p["x"] + (q["x"] - p["x"]) * share).alias("x"), (p["y"] + (q["y"] - p["y"]) * share).alias("y"))
                end = F.struct(q["x"].alias("x"), q["y"].alias("y"))
                return F.when((p["s"] >= 0) & (q["s"] >= 0), F.array(end)).when(p["s"] >= 0, F.array(cross)).when(q["s"] >= 0, F.array(cross, end)).otherwise(none)

            return F.flatten(F.transform(own, lambda p, i: corner(p, F.get(own, (i + 1) % F.size(own)))))

        return _let(sided, corners)

    return F.aggregate(edges, subject, inside)


def shared_area(a: Column, b: Column) -> Column:
    """Area that a polygon and a convex one have in common; of two boxes that of a box, anything else is clipped."""
    ends = lambda p, c: [F.get(p, F.lit(i))[c] for i in (0, 2)]
    side = lambda c: F.greatest(F.least(F.greatest(*ends(a, c)), F.greatest(*ends(b, c))) - F.greatest(F.least(*ends(a, c)), F.least(*ends(b, c))), F.lit(0.0))
    return F.when(upright(a) & upright(b), side("x") * side("y")).otherwise(F.abs(signed_area(clip(a, b))))


def bounds(p: Column) -> Column:
    """struct x1, y1, x2, y2: the least box around a polygon."""
    xs, ys = p["x"], p["y"]
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
