"""Matching and scores on small fixtures."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from visledger.operators import curves as E
from visledger.operators import match as X
from visledger.operators import stats as A
from visledger.operators import tree as C

DET = "gid bigint, id bigint, cls bigint, bbox struct<x:double,y:double,w:double,h:double>, score double, weight double"


def dets(spark, *rows):
    """Rows gid, id, cls, (cx, cy, w, h), score, weight."""
    return spark.createDataFrame([(g, i, c, (b[0] - b[2] / 2, b[1] - b[3] / 2, b[2], b[3]), s, w) for g, i, c, b, s, w in rows], DET)


BOX = (50.0, 50.0, 23.0, 31.0)


def ap(spark, true, pred, compat="mutex"):
    v = X.confusion_vectors(true, pred, (0.5,), compat)
    return E.average_precision(E.metrics(E.curve(E.classless(v)))).first()["ap"]


def test_reuse_policies(spark):
    true = dets(spark, (1, 1, 0, BOX, 1.0, 1.0), (1, 2, 0, (51.0, 51.0, 23.0, 31.0), 1.0, 1.0))
    pred = dets(spark, *[(1, i, 0, BOX, 0.5, 1.0) for i in range(4)], (1, 9, 0, (500.0, 500.0, 23.0, 31.0), 0.5, 1.0))
    pairs = X.candidates(true, pred, "all")
    never = [r["tx"] for r in X.match(true, pred, pairs, (0.1,)).collect()]
    assert sorted(never) == [1, 2]
    again = [r["tx"] for r in X.match(true, pred, pairs, (0.1,), reuse=True).collect()]
    assert sorted(again) == [1, 1, 2, 2]


def test_compatibility(spark):
    true, pred = dets(spark, (1, 1, 1, BOX, 1.0, 1.0)), dets(spark, (1, 1, 2, BOX, 0.9, 1.0))
    assert ap(spark, true, pred, "all") == pytest.approx(1.0)
    assert ap(spark, true, pred, "mutex") < 0.2


def test_weights_and_misses(spark):
    boxes = [(20.0 * i, 20.0, 10.0, 10.0) for i in range(10)]
    true = dets(spark, *[(1, i, 0, b, 1.0, 1.0) for i, b in enumerate(boxes)])
    pred = dets(spark, *[(1, i, 0, b, 0.9 - i / 100, 1.0) for i, b in enumerate(boxes)])
    assert ap(spark, true, pred) == pytest.approx(1.0)
    assert ap(spark, true, pred.where("id <> 3")) < 0.95
    assert ap(spark, true.withColumn("weight", F.when(F.col("id") == 3, 0.0).otherwise(1.0)), pred.where("id <> 3")) == pytest.approx(1.0)


def test_empty_sides(spark):
    one = dets(spark, (1, 1, 0, BOX, 0.5, 1.0))
    assert X.confusion_vectors(one.limit(0), one).collect()[0]["true"] == -1
    missed = X.confusion_vectors(one, one.limit(0)).collect()[0]
    assert missed["pred"] == -1 and missed["score"] == -math.inf
    assert X.confusion_vectors(one.limit(0), one.limit(0)).count() == 0


def test_auc_without_negatives(spark):
    rows = [(0.9, 0.0, 0.0, 3.0, 0.0), (0.7, 1.0, 0.0, 2.0, 0.0), (0.5, 2.0, 0.0, 1.0, 0.0), (-math.inf, 3.0, 0.0, 0.0, 0.0)]
    c = spark.createDataFrame(rows, "thresh double, tp double, fp double, fn double, tn double")
    assert E.auc(E.metrics(c)).first()["auc"] == 2 / 3  # what was never predicted is below all finite thresholds


def test_max_dets_and_thresholds(spark):
    true = dets(spark, *[(1, i, 0, (20.0 * i, 0.0, 10.0, 10.0), 1.0, 1.0) for i in range(5)])
    pred = dets(spark, *[(1, i, 0, (20.0 * i + 1, 0.0, 10.0, 10.0), 0.1 * (i + 1), 1.0) for i in range(5)])
    pairs = X.candidates(true, pred)
    assert sorted(r["px"] for r in X.match(true, pred, pairs, (0.5,), max_dets=2).collect()) == [3, 4]
    many = X.match(true, pred, pairs, (0.5, 0.9)).groupBy("iou_thresh").count().collect()
    assert {(r["iou_thresh"], r["count"]) for r in many} == {(0.5, 5)}
    assert X.confusion_vectors(true, pred, (0.5, 0.9)).count() == 5 + 10


def test_ignore_and_voc(spark):
    pred = dets(spark, (1, 1, 0, (5.0, 5.0, 10.0, 10.0), 0.9, 1.0), (1, 2, 0, (5.0, 5.0, 10.0, 10.0), 0.8, 1.0), (1, 3, 0, (100.0, 5.0, 10.0, 10.0), 0.7, 1.0))
    region = dets(spark, (1, 1, 9, (5.0, 5.0, 10.0, 12.0), 1.0, 1.0))
    assert sorted(r["px"] for r in X.ignored(pred, region).collect()) == [1, 2]
    true = dets(spark, (1, 1, 0, (5.0, 5.0, 10.0, 10.0), 1.0, 1.0))
    assert {r["px"]: r["hit"] for r in X.voc_match(true, pred).collect()} == {1: True, 2: False, 3: False}


def test_association(spark):
    ddl = "id bigint, name string, video string"
    a = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "f", "v"), (4, "f", "only1")], ddl)
    b = spark.createDataFrame([(11, "a", None), (12, "c", None), (13, "f", "v"), (14, "g", "v")], ddl)
    assert {(r["video"], r["gid1"], r["gid2"]) for r in X.associate(a, b).collect()} == {(None, 1, 11), ("v", 3, 13)}
    assert X.associate(a, b, valid_ids=[3]).count() == 1
    unnamed = spark.createDataFrame([(5, None, None)], ddl)
    assert X.associate(unnamed, unnamed).count() == 1
    with pytest.raises(ValueError):
        X.associate(unnamed, b, fallback=None)


def test_combined_curves_equal_the_whole(spark):
    rows = [(i % 3, (i * 7) % 5 > 1, (i * 13) % 11 / 10) for i in range(60)]
    b = spark.createDataFrame([(p, int(t), s, 1.0) for p, t, s in rows], "part int, is_true bigint, pred_score double, weight double")
    whole = {tuple(r) for r in E.curve(b).collect()}
    assert {tuple(r) for r in E.combine(E.curve(b, ["part"])).collect()} == whole


def test_report_and_confusion(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 2.0), (2, 0, 1.0)], "true bigint, pred bigint, weight double")
    m = A.confusion(rows)
    r = {x["cls"]: x for x in E.report(m).collect()}
    assert (r[0]["precision"], r[0]["recall"], r[1]["precision"]) == (0.5, 0.5, pytest.approx(2 / 3)) and r[2]["f1"] == 0
    assert A.accuracy(m).first()["global_accuracy"] == pytest.approx(0.6)


def test_hierarchy(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("f", "e")], "child string, parent string")
    c = C.closure(e)
    assert {r["node"]: r["ancestors"] for r in C.ancestors(c).collect()}["c"] == ["a", "b", "c"]
    assert {(r["a"], r["b"]): r["dist"] for r in C.signed_distance(c).collect()}[("c", "a")] == -2
    kept = C.subgraph(e, spark.createDataFrame([("a",), ("c",), ("d",), ("f",)], "node string"), through=True)
    assert {tuple(r) for r in kept.collect()} == {("c", "a"), ("d", "a")}
    assert not C.is_mutex(e) and C.is_mutex(e.limit(0))
    assert C.render([("b", "a"), ("c", "b")]) == "a\n  b\n    c"


def test_set_cover(spark):
    sets = spark.createDataFrame([(1, [1, 2]), (2, [2, 3, 4]), (3, [5]), (4, [1])], "id bigint, members array<bigint>")
    assert A.set_cover(sets) == [2, 1, 3]


def test_three_covers(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.sample(range(40), rng.randint(1, 6)), rng.randint(1, 12)) for i in range(60)]
    want, left = [], {i: (set(s), n) for i, s, n in rows}
    for k, cost in enumerate((lambda n: 1, lambda n: n, lambda n: 1 / (n + 1))):
        covered, picked = set(), []
        while any(s - covered for s, _ in left.values()):
            i = min(left, key=lambda i: (-len(left[i][0] - covered) / cost(left[i][1]), i))
            picked.append(i)
            covered |= left[i][0]
        want += [(k, nth, i) for nth, i in enumerate(picked)]
        left = {i: x for i, x in left.items() if i not in picked}
    sets = spark.createDataFrame(rows, "id bigint, members array<bigint>, n bigint")
    assert sorted(tuple(r) for r in A.representative(sets).collect()) == want


def test_sizes_come_with_the_vectors(spark):
    """The area of the true (else the predicted) box, and weights by ranges of it, as the joins by id give them."""
    rows = [(g, 10 * g + i, i % 2, (5.0 * i, 0.0, 4.0 + i, 4.0), 0.1 * i, 1.0 + g) for g in range(3) for i in range(6)]
    true = spark.createDataFrame(rows, DET)
    pred = spark.createDataFrame([(g, 100 + i, c, (x + 1, y, w + 2, h), s, 1.0) for g, i, c, (x, y, w, h), s, _ in rows if i % 4], DET)
    v = X.confusion_vectors(true, pred, (0.3, 0.7), sized=True)
    assert sorted(v.drop("size").collect()) == sorted(X.confusion_vectors(true, pred, (0.3, 0.7)).collect())
    area = (F.col("bbox.w") * F.col("bbox.h")).alias("area")
    areas = true.select("id", area, F.lit("t").alias("kind")).unionByName(pred.select("id", area, F.lit("p").alias("kind")))
    for name, low, high in (("a", 0, 25), ("b", 20, 100), ("c", 500, 900)):
        plain = E.area_weights(v.drop("size"), areas, low, high)
        want = plain.agg(F.sum("weight"), F.count("*")).first()
        assert tuple(want) == tuple(E.weights_in_ranges(v, ((name, low, high),)).select("weight", "n").first())
    plan = E.weights_in_ranges(v, (("a", 0, 25), ("b", 20, 100)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # vectors are joined once for all ranges
