"""Run-length masks and scores of masks, against pixels drawn one by one."""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from visledger.functions import runs as R
from visledger.manifest import from_rows
from visledger.operators import curves, masks, segmentation


def drawn(rings, w, h) -> np.ndarray:
    """Pixel by pixel: the centre is inside if a ray to the right crosses the edges of all rings an odd number of times."""
    out = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            cx, cy, odd = x + 0.5, y + 0.5, False
            for ring in rings:
                for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
                    if (ax > cx) != (bx > cx) and cy < ay + (cx - ax) * (by - ay) / (bx - ax):
                        odd = not odd
            out[y, x] = odd
    return out


def raster(runs, w, h) -> np.ndarray:
    out = np.zeros((h, w), bool)
    for line, a, b in zip(*(c.tolist() for c in runs)):
        assert 0 <= a < b <= h and 0 <= line < w and not out[a:b, line].any()
        out[a:b, line] = True
    return out


def rings_of(rng, w, h):
    return [[(rng.choice([rng.uniform(-5, w + 5), rng.randint(0, w)]), rng.choice([rng.uniform(-5, h + 5), rng.randint(0, h)])) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 3))]


def test_fill_union_and_overlap_equal_pixels():
    rng = random.Random(4)
    for _ in range(150):
        w, h = rng.randint(1, 30), rng.randint(1, 30)
        a, b = rings_of(rng, w, h), rings_of(rng, w, h)
        x, y = (R.fill([np.array(r, float) for r in rings], w, h) for rings in (a, b))
        ra, rb = drawn(a, w, h), drawn(b, w, h)
        assert (raster(x, w, h) == ra).all() and R.area(x) == ra.sum()
        assert R.intersection_area(x, y) == (ra & rb).sum()
        both = R.union(*(np.concatenate(p) for p in zip(x, y)))
        assert (raster(both, w, h) == (ra | rb)).all()


def slow_text(counts) -> str:
    out = ""
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            low, x = x & 31, x >> 5
            more = x != -1 if low & 16 else x != 0
            out += chr((low | 32 * more) + 48)
            if not more:
                break
    return out


def test_run_lengths_both_ways():
    rng = random.Random(9)
    for _ in range(200):
        w, h = rng.randint(1, 12), rng.randint(1, 12)
        mask = np.array([[rng.random() < rng.choice([0.1, 0.5, 0.9, 1]) for _ in range(w)] for _ in range(h)])
        flat = mask.T.ravel()
        want, last = [0], False
        for v in flat.tolist():
            if v != last:
                want.append(0)
                last = v
            want[-1] += 1
        runs = R.from_counts(np.array(want), h)
        assert (raster(runs, w, h) == mask).all()
        assert R.to_counts(R.union(*runs), w, h).tolist() == want
        assert R.to_text(np.array(want)) == slow_text(want) and R.from_text(slow_text(want)).tolist() == want
    big = [rng.randint(0, 1 << rng.randint(1, 40)) for _ in range(2000)]
    assert R.to_text(np.array(big)) == slow_text(big) and R.from_text(slow_text(big)).tolist() == big
    assert R.to_text(np.array([6, 1, 40, 4, 5, 4, 5, 4, 21])) == "61X13mN000`0"  # a code that is published as an example
    assert R.from_text("").tolist() == [] and R.to_text(np.zeros(0, np.int64)) == ""


def manifest(spark, rows, w=20, h=16):
    return from_rows(spark, {
        "images": [{"id": g, "width": w, "height": h} for g in sorted({r["image_id"] for r in rows})], "annotations": rows,
    })


def test_segmentations_of_all_kinds(spark):
    square = [2, 2, 8, 2, 8, 7, 2, 7]
    hole = {"exterior": [[0, 0], [10, 0], [10, 10], [0, 10]], "interiors": [[[2, 2], [5, 2], [5, 5], [2, 5]]]}
    counts = R.to_counts(R.fill([np.array([[1, 1], [4, 1], [4, 9], [1, 9]], float)], 20, 16), 20, 16)
    kinds = [
        [square], square, hole, [hole, {"exterior": [[3, 3], [4, 3], [4, 4], [3, 4]]}], {"size": [16, 20], "counts": counts.tolist()},
        {"size": [16, 20], "counts": R.to_text(counts)}, [square, [100, 100, 120, 100, 120, 120]], [], [[1, 1, 2, 2]],
    ]
    m = manifest(spark, [{"id": i, "image_id": 1, "segmentation": k} for i, k in enumerate(kinds)] + [{"id": 99, "image_id": 1}])
    got = {r["id"]: r["area"] for r in masks.areas(masks.runs(m), ("id",)).collect()}
    want = {0: 30, 1: 30, 2: 91, 3: 92, 4: 24, 5: 24, 6: 30}
    assert got == want
    coded = {r["id"]: (r["area"], r["counts"]) for r in masks.encoded(m).collect()}
    assert {i: a for i, (a, _) in coded.items() if a} == want and coded[4][1] == coded[5][1] == R.to_text(counts)
    again = {r["id"]: r["area"] for r in masks.areas(masks.runs(masks.with_encoded(m)), ("id",)).collect()}
    assert again == want
    back = {r["id"]: r["counts"] for r in masks.counts(masks.encoded(m)).collect()}
    assert back[4] == counts.tolist() and back[7] == [320]


def scene(rng, n, start, w, h, names):
    rows = []
    for k in range(n):
        ring = rings_of(rng, w, h)[0]
        rows.append({"id": start + k, "image_id": rng.randint(1, 3), "segmentation": [[c for p in ring for c in p]], "name": rng.choice(names), "weight": rng.choice([1.0, 1.0, 0.5, 2.0]), "score": rng.choice([0.2, 0.5, 0.9])})
    return rows


def tables(spark, true, pred):
    m, p = manifest(spark, true), manifest(spark, pred)
    info = lambda rows: spark.createDataFrame([(r["id"], r["name"], r["weight"], r["score"]) for r in rows], "id bigint, name string, weight double, score double")
    t = masks.runs(m).join(info(true).drop("score"), "id")
    t = t.join(segmentation.behaviors(t.select("name").distinct()), "name")
    return t, masks.runs(p).join(info(pred).drop("weight"), "id"), m.images


def brute_pixels(true, pred, gids, w, h, balance):
    """``(gid, cls, is_true, score) -> weight`` by drawing every pixel."""
    out: dict = {}
    shape = lambda r: drawn([[(r["segmentation"][0][i], r["segmentation"][0][i + 1]) for i in range(0, len(r["segmentation"][0]), 2)]], w, h)
    scored = {p["name"] for p in pred if segmentation.BEHAVIORS.get(p["name"], "foreground") == "foreground" and shape(p).any()}
    for g in gids:
        ts = sorted((r for r in true if r["image_id"] == g), key=lambda r: r["id"])
        ts = [(r, shape(r), segmentation.BEHAVIORS.get(r["name"], "foreground")) for r in ts]
        ps = [(r, shape(r)) for r in pred if r["image_id"] == g]
        for way, objects, void in (("all", {"foreground", "negative", "undistinguished"}, {"ignore"}), ("each", {"foreground", "negative"}, {"ignore", "undistinguished"})):
            weight = np.ones((h, w))
            for _, s, b in ts:
                if b in void:
                    weight[s] = 0
            some = [(r, s) for r, s, b in ts if b in objects and s.any()]
            whole = np.any([s for _, s in some], axis=0).sum() if some else 0
            for r, s in some:
                own = r["weight"] * (whole / len(some) / s.sum() if balance else 1)
                if balance or own != 1:
                    weight[s] = own
            for cls in ([""] if way == "all" else sorted(scored)):
                truth, score = np.zeros((h, w), int), np.zeros((h, w))
                for r, s in some:
                    if way == "all" or r["name"] == cls:
                        truth[s] = 1
                for r, s in ps:
                    if way == "all" or r["name"] == cls:
                        score[s] = np.maximum(score[s], r["score"])
                for y, v, x in zip(truth.ravel().tolist(), score.ravel().tolist(), weight.ravel().tolist()):
                    out[g, cls, y, v] = out.get((g, cls, y, v), 0) + x
    return {k: v for k, v in out.items() if v}


def test_pixels_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(segmentation, "TILE", 7)
    true = scene(rng, 14, 0, 20, 16, ["cat", "dog", "ignore", "positive", "background", "negative"])
    pred = scene(rng, 12, 100, 20, 16, ["cat", "dog", "bird", "negative"])
    for balance in (False, True):
        t, p, images = tables(spark, true, pred)
        want = brute_pixels(true, pred, {r["image_id"] for r in true}, 20, 16, balance)
        got = {(r["gid"], r["cls"], r["is_true"], r["pred_score"]): r["weight"] for r in segmentation.pixels(t, p, images, balance, by_image=True).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
        whole: dict = {}
        for (_, *k), v in want.items():
            whole[tuple(k)] = whole.get(tuple(k), 0) + v
        got = {(r["cls"], r["is_true"], r["pred_score"]): r["weight"] for r in segmentation.pixels(t, p, images, balance).collect()}
        assert got.keys() == whole.keys() and all(math.isclose(got[k], whole[k], rel_tol=1e-9) for k in whole)


def test_scores_of_masks(spark):
    rng = random.Random(3)
    true = scene(rng, 10, 0, 20, 16, ["cat", "dog"])
    same = [r | {"id": r["id"] + 100} for r in true]
    t, p, images = tables(spark, true, same)
    scores = {r["cls"]: r for r in segmentation.evaluate(t, p, images).collect()}
    assert set(scores) == {"", "cat", "dog"} and scores[""]["positives"] > 0
    assert {r["cls"] for r in segmentation.evaluate(t, p, images, classes=spark.createDataFrame([("cat",)], "name string")).collect()} == {"", "cat"}
    mean = segmentation.mean_scores(segmentation.evaluate(t, p, images)).first()
    assert mean["classes"] == 2 and math.isclose(mean["map"], (scores["cat"]["ap"] + scores["dog"]["ap"]) / 2)
    binned = segmentation.pixels(t, p, images, bins=5).select("pred_score").distinct().collect()
    assert {r[0] for r in binned} <= {0.0, 0.25, 0.5, 0.75, 1.0}
    assert curves.curve(segmentation.pixels(t, p.where("false"), images), ["cls"]).select("cls").distinct().count() == 1


def test_overlap_of_masks(spark):
    rng = random.Random(8)
    true, pred = scene(rng, 8, 0, 20, 16, ["a"]), scene(rng, 8, 100, 20, 16, ["a"])
    t, p = masks.runs(manifest(spark, true)), masks.runs(manifest(spark, pred))
    pairs = spark.createDataFrame([(a["image_id"], a["id"], b["id"]) for a in true for b in pred if a["image_id"] == b["image_id"]], "gid bigint, tx bigint, px bigint")
    got = {(r["tx"], r["px"]): (r["shared"], r["iou"]) for r in masks.overlaps(t, p, pairs).collect()}
    shape = lambda r: drawn([[(r["segmentation"][0][i], r["segmentation"][0][i + 1]) for i in range(0, len(r["segmentation"][0]), 2)]], 20, 16)
    want = {}
    for a in true:
        for b in pred:
            x, y = shape(a), shape(b)
            if a["image_id"] == b["image_id"] and (x & y).any():
                want[a["id"], b["id"]] = ((x & y).sum(), (x & y).sum() / (x | y).sum())
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)
    united = {(r["gid"], r["line"], r["start"], r["stop"]) for r in masks.union(t).collect()}
    for g in {a["image_id"] for a in true}:
        whole = np.any([shape(a) for a in true if a["image_id"] == g], axis=0)
        mine = [u for u in united if u[0] == g]
        assert (raster(tuple(np.array(c) for c in zip(*[u[1:] for u in mine])), 20, 16) == whole).all()
        assert not any(u[1] == v[1] and u[3] == v[2] for u in mine for v in mine)
    assert json.loads(spark.range(1).select(masks.polygon(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))))).first()[0]) == [[1.0, 2.0]]


def some_segmentations(rng, n):
    """Segmentations of every kind with the sizes of their images."""
    out = []
    for _ in range(n):
        w, h = rng.randint(1, 30), rng.randint(1, 30)
        ring = lambda: [c for p in rings_of(rng, w, h)[0] for c in p]  # noqa: B023, E731
        counts = [rng.randint(0, 9) for _ in range(8)]
        kinds = (None, [], ring(), [ring(), ring()], [{"exterior": ring(), "interiors": [ring(), [[1, 2], [3, 4], [5, 0]]]}], [[1, 2, 3, 4]], {"counts": counts, "size": [h, w]})
        value = rng.choice(kinds)
        out.append((None if value is None else json.dumps(value), w, h))
    return [list(c) for c in zip(*out)]


def test_many_masks_at_once_equal_each_alone(monkeypatch):
    texts, ws, hs = some_segmentations(random.Random(8), 400)
    alone = [R.of_segmentation(*r) for r in zip(texts, ws, hs)]
    for held in (1 << 18, 40):
        monkeypatch.setattr(R, "HELD", held)
        got = {}
        for row, *runs in R.of_segmentations(texts, ws, hs):
            for i in np.unique(row).tolist():
                assert i not in got
                got[i] = [c[row == i].tolist() for c in runs]
        assert got == {i: [c.tolist() for c in runs] for i, runs in enumerate(alone) if len(runs[0])}
    row = np.repeat(np.arange(len(alone)), [len(r[0]) for r in alone])
    coded = R.to_texts(row, tuple(np.concatenate(c) for c in zip(*alone)), np.array(ws), np.array(hs))
    assert coded == [R.to_text(R.to_counts(r, w, h)) for r, w, h in zip(alone, ws, hs)]
    counts, at = R.from_texts([*coded, ""])
    assert [counts[a:b].tolist() for a, b in zip(at, at[1:])] == [R.from_text(t).tolist() for t in [*coded, ""]]


def test_masks_of_a_batch_take_no_longer_than_a_few_alone():
    import time

    rng = random.Random(9)
    boxes = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(4000)]
    texts = [json.dumps([[x, y, x + 30, y, x + 30, y + 25, x, y + 25]]) for x, y in boxes]
    took = []
    for make in (lambda: [R.of_segmentation(t, 800, 480) for t in texts[:1000]], lambda: list(R.of_segmentations(texts, [800] * 4000, [480] * 4000))):
        began = time.process_time()
        make()
        took.append(time.process_time() - began)
    assert took[1] < took[0]


def test_strips_measures_and_pairs_equal_runs(spark):
    texts, ws, hs = some_segmentations(random.Random(10), 60)
    images = [{"id": i, "width": w, "height": h} for i, (w, h) in enumerate(zip(ws, hs))]
    annotations = [{"id": 100 + i, "image_id": i // 2 * 2, "category_id": 1, "bbox": [0, 0, 30, 30], "segmentation": None if t is None else json.loads(t)} for i, t in enumerate(texts)]
    m = from_rows(spark, {"images": images, "annotations": annotations})
    runs = masks.runs(m).cache()
    told = runs.groupBy("gid", "id").agg(F.sum(F.col("stop") - F.col("start")).alias("area"), F.count("*").alias("n_runs"))
    assert sorted(masks.measured(m).collect()) == sorted(told.collect())
    strips = masks.strips(m, 4, ("category_id",))
    flat = strips.select("gid", "id", "category_id", "tile", F.explode(F.arrays_zip("line", "start", "stop")).alias("r")).select("gid", "id", "category_id", "tile", "r.*")
    assert sorted(flat.select("gid", "id", "line", "start", "stop").collect()) == sorted(runs.collect())
    assert flat.where("tile <> line div 4 or category_id <> 1").isEmpty()
    d = masks.detections(m)
    pairs = [d.where(f"id % 2 = {k}") for k in (0, 1)]
    from visledger.operators import match

    found = masks.shared(match.candidates(*pairs, carry=("segmentation", "w", "h")))
    plain = masks.overlaps(runs, runs, match.candidates(*pairs))
    assert found.count() > 5 and sorted(found.collect()) == sorted(plain.select(*found.columns).collect())


def test_sweep_in_small_parts(spark, monkeypatch):
    """What is summed doesn't depend on how many coverings are held at a time."""
    rng = random.Random(11)
    runs = [(g, i, line, a, a + rng.randint(1, 9)) for g in range(3) for i in range(12) for line in range(3) if (a := rng.randint(0, 9)) >= 0]
    t = spark.createDataFrame([(*r, "cat", "foreground", 1.0 + r[1] % 3) for r in runs if r[1] % 2], "gid long, id long, line long, start long, stop long, name string, behavior string, weight double")
    p = spark.createDataFrame([(*r, "cat", r[1] / 20) for r in runs if not r[1] % 2], "gid long, id long, line long, start long, stop long, name string, score double")
    table = segmentation.strokes(t, p).orderBy("gid", "tile", "nth").toArrow()
    sums = []
    for held in (1 << 18, 5):
        monkeypatch.setattr(R, "HELD", held)
        total = {}
        for b in segmentation._sweep(table, True):
            for gid, cls, y, s, w, n, _ in zip(*(c.to_pylist() for c in b.columns)):
                old = total.get((gid, cls, y, s), (0, 0))
                total[gid, cls, y, s] = (old[0] + w, old[1] + n)
        sums.append(total)
    assert sums[0] == sums[1] and len(sums[0]) > 20
