"""Crowded images: pairs by grid cells and assignment in rounds give what the plain ways give; shapes of polygons."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from visledger.functions import polygons as P
from visledger.manifest import from_rows
from visledger.operators import match, shapes

DET = "gid bigint, id bigint, cls bigint, bbox struct<x:double,y:double,w:double,h:double>, score double, weight double"


def boxes(rng, n, start, images=3):
    def one(k):
        size = rng.choice([1, 5, 40, 300, 5000])
        at = lambda: rng.choice([rng.uniform(-500, 2000), float(rng.randint(0, 20) * 64)])
        return (rng.randint(1, images), start + k, rng.randint(1, 3), (at(), at(), rng.choice([0.0, rng.uniform(0, size), float(size)]), rng.uniform(0, size)), rng.choice([0.1, 0.5, 0.9, rng.random()]), 1.0)

    return [one(k) for k in range(n)]


@pytest.mark.parametrize("compat", ["mutex", "all", "ancestors"])
@pytest.mark.parametrize("bias", [0.0, 1.0])
def test_pairs_by_cell_equal_the_plain_join(spark, compat, bias):
    rng = random.Random(5)
    true, pred = spark.createDataFrame(boxes(rng, 150, 0), DET), spark.createDataFrame(boxes(rng, 150, 1000), DET)
    tree = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 0), (1, 2, 1), (1, 3, 2)], "ancestor bigint, descendant bigint, dist bigint")
    plain, cells = (sorted(map(tuple, match.candidates(true, pred, compat, bias, tree, crowded=k).collect())) for k in (None, 10))
    assert plain == cells and len(plain) > 50 and len({r[:3] for r in cells}) == len(cells)


@pytest.mark.parametrize("prioritize", ["iou", "class"])
def test_rounds_equal_the_fold(spark, prioritize):
    rng = random.Random(6)

    def side(n, start):
        return [(rng.randint(1, 4), start + k, rng.randint(1, 2), (float(rng.randint(0, 30)), float(rng.randint(0, 30)), 12.0, 12.0), rng.choice([0.2, 0.5, 0.7, rng.random()]), 1.0) for k in range(n)]

    true, pred = spark.createDataFrame(side(200, 0), DET), spark.createDataFrame(side(260, 1000), DET)
    pairs = match.candidates(true, pred, "all")
    ways = [sorted(map(tuple, match.match(true, pred, pairs, (0.1, 0.5), prioritize=prioritize, long_fold=k).collect())) for k in (None, 0, 55)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 200
    assert sorted(map(tuple, match.match(true, pred, pairs, (0.1,), max_dets=20, long_fold=0).collect())) == sorted(map(tuple, match.match(true, pred, pairs, (0.1,), max_dets=20, long_fold=None).collect()))


def test_an_image_of_very_many_boxes(spark):
    n = 100_000
    k = F.col("id")
    at = F.struct((k % 317 * 20.0).alias("x"), (F.floor(k / 317) * 20.0).alias("y"), F.lit(24.0).alias("w"), F.lit(24.0).alias("h"))
    true = spark.range(n).select(F.lit(1).cast("long").alias("gid"), "id", F.lit(1).cast("long").alias("cls"), at.alias("bbox"), F.lit(1.0).alias("score"), F.lit(1.0).alias("weight"))
    pred = true.withColumns({"id": k + n, "score": k % 1000 / 1000.0})
    began = time.time()
    found = match.match(true, pred, match.candidates(true, pred), (0.5,))
    assert found.where("px = tx + 100000").count() == found.count() == n
    assert time.time() - began < 300


def test_hull_and_smallest_box():
    rng = random.Random(2)
    for _ in range(300):
        points = [(rng.choice([rng.uniform(0, 9), float(rng.randint(0, 4))]), float(rng.randint(0, 6))) for _ in range(rng.randint(1, 25))]
        corners = P.hull(points)
        assert set(corners) <= set(points)
        if len(corners) < 3:
            continue
        ring = [*corners[1:], corners[0]]
        assert all(P._turn(a, b, p) >= -1e-9 for a, b in zip(corners, ring) for p in points)
        best = math.inf
        for (ax, ay), (bx, by) in zip(corners, ring):
            size = math.hypot(bx - ax, by - ay)
            ux, uy = (bx - ax) / size, (by - ay) / size
            u, v = [x * ux + y * uy for x, y in points], [y * ux - x * uy for x, y in points]
            best = min(best, (max(u) - min(u)) * (max(v) - min(v)))
        major, minor = P.smallest_box(corners)
        assert math.isclose(major * minor, best, rel_tol=1e-9, abs_tol=1e-9) and major >= minor


def test_shapes_of_awkward_polygons(spark):
    hole = {"exterior": [[0, 0], [4, 0], [4, 4], [0, 4]], "interiors": [[[1, 1], [2, 1], [2, 2], [1, 2]]]}
    rows = [hole, [[0, 0, 3, 0, 3, 1, 0, 1], [5, 5, 6, 5, 6, 6]], [[2, 2, 2, 2, 2, 2]], [[0, 0, 3, 4]], {"size": [2, 2], "counts": [4]}, []]
    m = from_rows(spark, {"images": [{"id": 1}], "annotations": [{"id": i, "image_id": 1, "segmentation": s} for i, s in enumerate(rows)] + [{"id": 9, "image_id": 1}]})
    got = {r["id"]: r for r in shapes.polygon_shapes(m).collect()}
    assert got.keys() == set(range(6)) and got[0]["area"] == 15 and got[0]["n_vertices"] == 8 and got[0]["obox_ratio"] == 1
    assert got[1]["area"] == 3.5 and got[1]["n_shapes"] == 2 and got[2]["obox_major"] == 0 and got[2]["obox_ratio"] is None
    assert got[3]["obox_major"] == 5 and got[3]["obox_minor"] == 0 and got[4]["area"] is None and got[5]["n_shapes"] is None
