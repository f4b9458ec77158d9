"""Operators that SQL expresses badly, against plain Python on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from visledger.operators import edit, setops, stats
from visledger.operators import match as X
from visledger.sources import star

UP = {"animal": None, "dog": "animal", "pug": "dog", "cat": "animal"}
CLS = {name: i for i, name in enumerate(UP)}
DETS = "gid bigint, id bigint, cls bigint, bbox struct<x:double,y:double,w:double,h:double>, score double, weight double"


def above(name: str | None) -> list[str]:
    return [] if name is None else [name, *above(UP[name])]


def overlap(a, b) -> float:
    i = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return i / (a[2] * a[3] + b[2] * b[3] - i)


def boxes(rng: random.Random, n: int, first: int):
    return [(rng.randint(1, 4), first + i, rng.randrange(4), tuple(float(rng.randint(lo, hi)) for lo, hi in ((0, 12), (0, 12), (4, 12), (4, 12))), rng.randint(1, 9) / 10) for i in range(n)]


def brute_reuse(true, pred, least):
    out = set()
    for gid in {p[0] for p in pred}:
        used: dict = {}
        for _, px, cls, box, score in sorted((p for p in pred if p[0] == gid), key=lambda p: (-p[4], -p[1])):
            cands = sorted((-overlap(t[3], box), t[1]) for t in true if t[0] == gid and t[2] == cls and overlap(t[3], box) > least)
            if cands:
                _, _, tx = min((used.get(tx, 0), n, tx) for n, (_, tx) in enumerate(cands))
                used[tx] = used.get(tx, 0) + 1
                out.add((gid, px, tx))
    return out


def test_reusing_match_and_candidates_by_ancestors(spark):
    rng = random.Random(6)
    true, pred = boxes(rng, 40, 100), boxes(rng, 90, 1000)
    frame = lambda rows: spark.createDataFrame([(g, i, c, b, s, 1.0) for g, i, c, b, s in rows], DETS)
    t, p = frame(true), frame(pred)
    got = X.match(t, p, X.candidates(t, p), (0.2,), reuse=True).select("gid", "px", "tx").collect()
    assert {tuple(r) for r in got} == brute_reuse(true, pred, 0.2) and len(got) == len({r["px"] for r in got})
    closure = spark.createDataFrame([(CLS[a], CLS[d], n) for d in UP for n, a in enumerate(above(d))], "ancestor bigint, descendant bigint, dist int")
    found = {(r["px"], r["tx"], r["apart"]) for r in X.candidates(t, p, "ancestors", closure=closure).collect()}
    names = list(UP)
    want = {(q[1], u[1], above(names[q[2]]).index(names[u[2]])) for q in pred for u in true if q[0] == u[0] and overlap(u[3], q[3]) > 0 and names[u[2]] in above(names[q[2]])}
    assert found == want


def test_digest_of_a_table(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("k"))
    digest = lambda x: stats.content_hash(x).first()["digest"]
    assert digest(df) == digest(df.orderBy(F.desc("id")).repartition(5)) == digest(df.select("k", "id"))
    assert len({digest(df), digest(df.withColumn("k", F.when(F.col("id") == 3, 9).otherwise(F.col("k")))), digest(df.union(df.limit(1))), digest(df.limit(0))}) == 4


def test_perturbed_copies_agree_and_stay_near(spark):
    an = star.manifest(spark, "/root/testdata/sf0.001").annotations
    a, b = (edit.perturb(an, seed=3, n_categories=25).select("id", "bbox", "category_id", "score").collect() for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b))
    old = {r["id"]: r for r in an.collect()}
    assert abs(len(a) / len(old) - 0.9) < 0.03
    assert all(r["bbox"] is None or (abs(r["bbox"]["x"] - old[r["id"]]["bbox"]["x"]) <= 5 and r["bbox"]["w"] == old[r["id"]]["bbox"]["w"]) for r in a)
    assert 0.02 < sum(r["category_id"] != old[r["id"]]["category_id"] for r in a) / len(a) <= 0.12


def test_anchors_are_the_centres_of_sizes(spark):
    from visledger.manifest import from_rows

    rng = random.Random(1)
    anns = [{"id": i, "image_id": 1, "bbox": [0, 0, c + rng.random(), 2 * c + rng.random()]} for i, c in enumerate([10, 50, 200] * 30)]
    got = sorted((r["w"], r["h"]) for r in stats.anchors(from_rows(spark, {"images": [{"id": 1}], "annotations": anns}), k=3).collect())
    for (w, h), c in zip(got, (10, 50, 200)):
        group = [a["bbox"] for a in anns if c <= a["bbox"][2] <= c + 1]
        assert abs(w - sum(b[2] for b in group) / 30) < 1e-6 and abs(h - sum(b[3] for b in group) / 30) < 1e-6


def test_folds_spread_every_class(spark):
    """Like the rule that places each group where its classes are scarcest: no fold misses a common class."""
    m = star.manifest(spark, "/root/testdata/sf0.001")
    folds = {r["group_id"]: r["fold"] for r in setops.group_folds(m, 4).collect()}
    group = {r["id"]: f"v{r['video_id']}" if r["video_id"] is not None else f"i{r['id']}" for r in m.images.select("id", "video_id").collect()}
    rows = [(folds[group[r["image_id"]]], (r["category_id"] or 0) % 3) for r in m.annotations.select("image_id", "category_id").collect()]
    for k in range(3):
        sizes = [sum(1 for f, c in rows if f == fold and c == k) for fold in range(4)]
        assert min(sizes) > 0.6 * max(sizes), sizes
