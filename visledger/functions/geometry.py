"""Box and polygon arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    return box["w"] * box["h"]


def intersection(a: Column, b: Column, bias: float = 0.0) -> Column:
    """Area that two ``xywh`` boxes share; ``bias`` is added to each side."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]) + F.lit(bias)
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]) + F.lit(bias)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column, bias: float = 0.0) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    both = intersection(a, b, bias)
    each = (a["w"] + F.lit(bias)) * (a["h"] + F.lit(bias)) + (b["w"] + F.lit(bias)) * (b["h"] + F.lit(bias))
    return F.coalesce(F.try_divide(both, each - both), F.lit(0.0))


def to_corners(box: Column) -> Column:
    return F.struct(box["x"].alias("left"), box["y"].alias("top"), (box["x"] + box["w"]).alias("right"), (box["y"] + box["h"]).alias("bottom"))


def to_center(box: Column) -> Column:
    return F.struct((box["x"] + box["w"] / 2).alias("cx"), (box["y"] + box["h"] / 2).alias("cy"), box["w"].alias("w"), box["h"].alias("h"))


def box_polygon(box: Column) -> Column:
    """The four corners of a box, as an array of points."""
    right, bottom = box["x"] + box["w"], box["y"] + box["h"]
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(box["x"], box["y"]), point(right, box["y"]), point(right, bottom), point(box["x"], bottom))


def polygon_area(points: Column) -> Column:
    """Area of a simple polygon by the shoelace rule; 0 for fewer than three points."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(total) / 2)


def affine_apply(t: Column, x: Column, y: Column) -> Column:
    """A point under a 2 x 3 transform ``a, b, tx, c, d, ty``."""
    return F.struct((t["a"] * x + t["b"] * y + t["tx"]).alias("x"), (t["c"] * x + t["d"] * y + t["ty"]).alias("y"))


def affine_inverse(t: Column) -> Column:
    det = t["a"] * t["d"] - t["b"] * t["c"]
    a, b, c, d = t["d"] / det, -t["b"] / det, -t["c"] / det, t["a"] / det
    return F.struct(
        a.alias("a"), b.alias("b"), (-(a * t["tx"] + b * t["ty"])).alias("tx"), c.alias("c"), d.alias("d"), (-(c * t["tx"] + d * t["ty"])).alias("ty")
    )
