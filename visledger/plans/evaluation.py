"""Matching and scores (M of the inventory)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import curves as E
from ..operators import evaluate
from ..operators import match as X
from ..operators import stats as A
from ..operators import tree as C
from ..sources import star
from ..storage import materialize
from ._register import registrar

QUERIES, SQL, query = registrar()


def whole(col, digits: int):
    """A sum of doubles as a whole number of units, so that its last bits don't show."""
    return F.floor(col * 10**digits + 1e-6).cast("long")


def sides(spark, sf):
    """True and predicted detections of the star tables, off one table written for all that reads them; rows without a category are left out."""
    cats = star.categories(spark, sf)
    a = star.annotations(spark, sf, cats).where("bbox is not null and category_id is not null")
    a = materialize(a.select("id", "image_id", "category_id", "bbox", "score", "weight", "pk", "sk"), "detections")
    cols = [F.col("image_id").alias("gid"), "id", F.col("category_id").alias("cls"), "bbox", "score", "weight"]
    return a.select(*cols), star.predictions(a, cats.count()).select(*cols)


_SIDES = """, truth AS (SELECT image_id AS gid, id, category_id AS cls, x, y, w, h, weight FROM annotations WHERE x IS NOT NULL AND category_id IS NOT NULL),
pred AS (SELECT image_id AS gid, id, category_id AS cls, x, y, w, h, score FROM predictions WHERE category_id IS NOT NULL),
overlap AS (SELECT t.gid, t.id AS tx, p.id AS px, t.cls AS tcls, p.cls AS pcls,
  greatest(least(t.x + t.w, p.x + p.w) - greatest(t.x, p.x), 0) * greatest(least(t.y + t.h, p.y + p.h) - greatest(t.y, p.y), 0) AS i,
  t.w * t.h + p.w * p.h AS s FROM truth t JOIN pred p ON p.gid = t.gid),
pairs AS (SELECT gid, tx, px, tcls, pcls, i / (s - i) AS iou FROM overlap WHERE i > 0)"""


def _matched(where: str) -> str:
    """The greedy assignment as a recursion over each image's predictions by rank."""
    return f"""{_SIDES},
lists AS (SELECT gid, px, list({{'n': -iou, 'tx': tx}} ORDER BY -iou, tx) AS c FROM pairs WHERE iou > 0.5 AND {where} GROUP BY gid, px),
ranked AS (SELECT l.gid, l.px, c, row_number() OVER (PARTITION BY l.gid ORDER BY score DESC, l.px DESC) AS r FROM lists l JOIN pred p ON p.id = l.px),
fold AS (
  SELECT gid, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS px, CAST(NULL AS BIGINT) AS tx, CAST(NULL AS DOUBLE) AS iou FROM (SELECT DISTINCT gid FROM ranked)
  UNION ALL
  SELECT k.gid, k.r, CASE WHEN f.b IS NULL THEN f.used ELSE list_append(f.used, f.b.tx) END, k.px, f.b.tx, -f.b.n FROM (
    SELECT o.gid, o.used, q.r, q.px, list_filter(q.c, lambda z: NOT list_contains(o.used, z.tx))[1] AS b FROM fold o JOIN ranked q ON q.gid = o.gid AND q.r = o.r + 1) f
    JOIN ranked k ON k.gid = f.gid AND k.r = f.r),
matched AS (SELECT gid, px, tx, iou FROM fold WHERE tx IS NOT NULL),
cfsn AS (
  SELECT p.gid, CASE WHEN m.tx IS NULL THEN -1 ELSE t.cls END AS t, p.cls AS p, p.score AS score, CASE WHEN m.tx IS NULL THEN 1 ELSE t.weight END AS weight,
    coalesce(m.iou, -1) AS iou, coalesce(m.tx, -1) AS txs, p.id AS pxs FROM pred p LEFT JOIN matched m ON m.px = p.id LEFT JOIN truth t ON t.id = m.tx
  UNION ALL
  SELECT gid, cls, -1, CAST('-inf' AS DOUBLE), weight, -1, id, -1 FROM truth WHERE id NOT IN (SELECT tx FROM matched))"""


_MUTEX, _ALL = _matched("tcls = pcls"), _matched("true")


def vectors(spark, sf, compat="mutex", thresholds=(0.5,)):
    """Confusion vectors of the star tables, written once."""
    true, pred = sides(spark, sf)
    return materialize(X.confusion_vectors(true, pred, thresholds, compat), "vectors")


@query("""SELECT a.name AS video, a.id AS gid1, b.id AS gid2 FROM (SELECT i.id, i.name AS iname, v.name FROM images i JOIN videos v ON v.id = video_id) a
JOIN (SELECT i.id + 1000000 AS id, i.id AS old, i.name AS iname, v.name FROM images i JOIN videos v ON v.id = video_id WHERE i.id % 2 = 0) b ON a.iname = b.iname AND a.name = b.name""")
def m1_associate_images(spark, sf):
    m = star.manifest(spark, sf)
    v = m.videos.select(F.col("id").alias("video_id"), F.col("name").alias("video"))
    im = m.images.join(v, "video_id").select("id", "name", "video")
    return X.associate(im, im.where("id % 2 = 0").withColumn("id", F.col("id") + 1000000))


@query(f"{_MUTEX} SELECT gid, px, tx, round(iou, 6) AS iou FROM matched")
def m2_greedy_match(spark, sf):
    true, pred = sides(spark, sf)
    m = X.match(true, pred, X.candidates(true, pred, "mutex"))
    return m.select("gid", "px", "tx", F.round("iou", 6).alias("iou"))


@query(f"{_ALL} SELECT gid, px, tx, round(iou, 6) AS iou FROM matched")
def m2_greedy_match_any_class(spark, sf):
    true, pred = sides(spark, sf)
    m = X.match(true, pred, X.candidates(true, pred, "all"))
    return m.select("gid", "px", "tx", F.round("iou", 6).alias("iou"))


@query()
def m2_reusing_match(spark, sf):
    true, pred = sides(spark, sf)
    return X.match(true, pred, X.candidates(true, pred, "mutex"), reuse=True).select("gid", "px", "tx")


_NEAREST_CLASS = _ALL.replace("{'n': -iou, 'tx': tx} ORDER BY -iou, tx", "{'n': -iou, 'tx': tx} ORDER BY CAST(tcls <> pcls AS INT), -iou, tx")


@query(f"{_NEAREST_CLASS} SELECT gid, px, tx FROM matched")
def m5_class_priority(spark, sf):
    true, pred = sides(spark, sf)
    return X.match(true, pred, X.candidates(true, pred, "all"), prioritize="class").select("gid", "px", "tx")


@query(f"""{_SIDES}, covered AS (SELECT p.gid, p.id AS px, sum(least(1, greatest(least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x), 0) * greatest(least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y), 0) / (p.w * p.h))) AS c
FROM pred p JOIN truth t ON t.gid = p.gid WHERE t.weight = 0 GROUP BY 1, 2) SELECT gid, px, CAST(floor(c * 10000 + 1e-6) AS BIGINT) AS covered FROM covered WHERE round(c, 9) > 0.5""")
def m3_ignore_regions(spark, sf):
    true, pred = sides(spark, sf)
    c = X.ignored(pred, true.where("weight = 0"), 0.0).where(F.round("covered", 9) > 0.5)
    return c.select("gid", "px", whole(F.col("covered"), 4).alias("covered"))


@query(f"{_SIDES} SELECT gid, px, tx, round(iou, 6) AS iou FROM pairs WHERE tcls = pcls")
def m4_candidates(spark, sf):
    true, pred = sides(spark, sf)
    return X.candidates(true, pred).select("gid", "px", "tx", F.round("iou", 6).alias("iou"))


@query(f"{_MUTEX} SELECT gid, t AS \"true\", p AS pred, CASE WHEN pxs < 0 THEN -1 ELSE score END AS score, CAST(weight AS DOUBLE) AS weight, round(iou, 6) AS iou, txs, pxs FROM cfsn")
def m6_confusion_vectors(spark, sf):
    v = vectors(spark, sf)
    return v.select("gid", "true", "pred", F.when(F.col("pxs") < 0, -1.0).otherwise(F.col("score")).alias("score"), "weight", F.round("iou", 6).alias("iou"), "txs", "pxs")


@query(f"{_MUTEX} SELECT CAST(t >= 0 AS BIGINT) AS is_true, count(*) AS n, CAST(sum(weight) AS DOUBLE) AS weight FROM cfsn GROUP BY 1")
def m11_classless(spark, sf):
    b = E.classless(vectors(spark, sf))
    return b.groupBy("is_true").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


_OVR = """, ovr AS (SELECT c.id AS cls, CAST(coalesce(t = c.id, false) AS BIGINT) AS is_true, CASE WHEN p = c.id THEN score ELSE CAST('-inf' AS DOUBLE) END AS score, weight
  FROM cfsn CROSS JOIN categories c WHERE c.name NOT IN ('background', 'ignore'))"""


def _curves(keys: str) -> str:
    """Curves of the rows of ``ovr`` in SQL: counts, precision with its envelope, recall and the rest."""
    return f""", steps AS (SELECT {keys}, score AS thresh, sum(weight * is_true) AS t, sum(weight * (1 - is_true)) AS f FROM ovr GROUP BY {keys}, score),
curve AS (SELECT {keys}, thresh, sum(t) OVER w AS tp, CASE WHEN isfinite(thresh) THEN sum(f) OVER w ELSE CAST('inf' AS DOUBLE) END AS fp, sum(t) OVER k AS pos, sum(f) OVER k AS neg
  FROM steps WINDOW w AS (PARTITION BY {keys} ORDER BY thresh DESC), k AS (PARTITION BY {keys})),
m AS (SELECT *, CASE WHEN isfinite(thresh) THEN coalesce(tp / nullif(tp + fp, 0), 0) ELSE 0 END AS raw, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS tpr,
  CASE WHEN isfinite(thresh) THEN fp / coalesce(nullif(max(CASE WHEN isfinite(thresh) THEN fp END) OVER (PARTITION BY {keys}), 0), 1) END AS fpr,
  CASE WHEN isfinite(thresh) THEN coalesce((neg - fp) / nullif(neg, 0), 0) END AS tnr,
  CASE WHEN isfinite(thresh) THEN coalesce((neg - fp) / nullif(neg - fp + pos - tp, 0), 0) END AS npv,
  CASE WHEN isfinite(thresh) THEN coalesce((tp + (neg - fp)) / nullif(tp + (neg - fp) + fp + (pos - tp), 0), 0) END AS acc FROM curve),
e AS (SELECT *, max(raw) OVER (PARTITION BY {keys} ORDER BY thresh DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ppv FROM m),
d AS (SELECT {keys}, tpr, fpr, tp, pos, thresh, lag(tpr) OVER w AS pt, lag(fpr) OVER w AS pf, ppv FROM e WINDOW w AS (PARTITION BY {keys} ORDER BY thresh DESC)),
areas AS (SELECT {keys}, CASE WHEN max(pos) > 0 THEN CASE WHEN max(fpr) = min(fpr) THEN max(tpr - fpr) ELSE sum((fpr - pf) * (tpr + pt) / 2) END END AS auc FROM d WHERE isfinite(thresh) GROUP BY {keys}),
levels AS (SELECT {keys}, i, max(ppv) AS p FROM e, range(101) r(i) WHERE tp * 100 >= i * pos AND pos > 0 GROUP BY {keys}, i),
means AS (SELECT {keys}, sum(p) / 101 AS ap FROM levels GROUP BY {keys}),
scores AS (SELECT {', '.join('k.' + x.strip() for x in keys.split(','))}, CASE WHEN seen THEN coalesce(ap, 0) END AS ap, auc, sklish
  FROM (SELECT {keys}, bool_or(isfinite(thresh)) AS seen, sum((tpr - coalesce(pt, 0)) * ppv) AS sklish FROM d GROUP BY {keys}) k LEFT JOIN means USING ({keys}) LEFT JOIN areas USING ({keys}))"""


_CURVE = _curves("cls")


def _units(col: str) -> str:
    return f"coalesce(CAST(floor({col} * 1e5 + 1e-6) AS BIGINT), -1)"


def units(col):
    """A score in whole units of a hundred thousandth; -1 where it is undefined."""
    return F.coalesce(whole(F.col(col), 5), F.lit(-1).cast("long"))


def _ovr(spark, sf):
    return E.one_vs_rest(vectors(spark, sf), E.rest_classes(star.categories(spark, sf)))


def _measured(spark, sf):
    """The curves of all classes with their metrics, made once for all that is read off them."""
    return materialize(E.metrics(E.curve(_ovr(spark, sf), ["cls"]), ["cls"]), "curves")


def _finite(col: str):
    return F.when(F.col("thresh") == E.NEVER_SEEN, -1.0).otherwise(F.col(col)).alias(col)


@query(f"{_MUTEX}{_OVR} SELECT cls, is_true, count(*) AS n, CAST(sum(weight) AS DOUBLE) AS weight FROM ovr GROUP BY 1, 2")
def m12_one_vs_rest(spark, sf):
    return _ovr(spark, sf).groupBy("cls", "is_true").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


@query(f"""{_MUTEX}, ovr AS (SELECT c.id AS cls, CAST(coalesce(t = c.id, false) AS BIGINT) AS is_true, weight,
  CASE WHEN p = c.id THEN score WHEN p = -1 THEN -1 ELSE (1 - score) / (SELECT count(*) - 1 FROM categories) END AS score FROM cfsn CROSS JOIN categories c)
SELECT cls, is_true, count(*) AS n, CAST(sum(weight) AS DOUBLE) AS weight, CAST(floor(sum(score) * 1000 + 1e-4) AS BIGINT) AS scores FROM ovr GROUP BY 1, 2""")
def m12_one_vs_rest_approximate(spark, sf):
    b = E.one_vs_rest(vectors(spark, sf), E.rest_classes(star.categories(spark, sf)), approx=True)
    score = F.when(F.col("pred_score") == E.NEVER_SEEN, -1.0).otherwise(F.col("pred_score"))
    return b.groupBy("cls", "is_true").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.floor(F.sum(score) * 1000 + 1e-4).cast("long").alias("scores"))


@query(f"""{_MUTEX}{_OVR}{_CURVE} SELECT cls, CASE WHEN isfinite(thresh) THEN thresh ELSE -1 END AS thresh, CAST(tp AS DOUBLE) AS tp,
  CAST(CASE WHEN isfinite(thresh) THEN fp ELSE -1 END AS DOUBLE) AS fp, CAST(pos - tp AS DOUBLE) AS fn, CAST(CASE WHEN isfinite(thresh) THEN neg - fp ELSE -1 END AS DOUBLE) AS tn FROM curve""")
def m13_curves(spark, sf):
    c = E.curve(_ovr(spark, sf), ["cls"])
    return c.select("cls", _finite("thresh"), "tp", _finite("fp"), "fn", _finite("tn"))


@query(f"""{_MUTEX}{_OVR}{_CURVE} SELECT cls, CASE WHEN isfinite(thresh) THEN thresh ELSE -1 END AS thresh, round(ppv, 6) AS ppv, round(tpr, 6) AS tpr, round(coalesce(fpr, -1), 6) AS fpr,
  round(coalesce(2 * ppv * tpr / nullif(ppv + tpr, 0), 0), 6) AS f1, round(sqrt(ppv * tpr), 6) AS g1, round(coalesce(tnr, -1), 6) AS tnr, round(coalesce(npv, -1), 6) AS npv,
  round(coalesce(acc, -1), 6) AS acc, round(CASE WHEN isfinite(thresh) THEN tpr + tnr - 1 ELSE -1 END, 5) + 0 AS bm, round(CASE WHEN isfinite(thresh) THEN ppv + npv - 1 ELSE -1 END, 5) + 0 AS mk FROM e""")
def m14_metrics(spark, sf):
    m = E.metrics(E.curve(_ovr(spark, sf), ["cls"]), ["cls"])
    m = m.select("cls", "ppv", "tpr", "f1", "g1", *[_finite(c) for c in ("fpr", "tnr", "npv", "acc", "bm", "mk", "thresh")])
    six = [F.round(c, 6).alias(c) for c in ("ppv", "tpr", "fpr", "f1", "g1", "tnr", "npv", "acc")]
    return m.select("cls", "thresh", *six, *[(F.round(c, 5) + 0.0).alias(c) for c in ("bm", "mk")])


@query(f"""{_MUTEX}{_OVR}{_CURVE} SELECT cls, max(CAST(floor((sqrt(ppv * tpr * tnr * npv) - sqrt((1 - ppv) * CASE WHEN pos > 0 THEN (pos - tp) / pos ELSE 0 END * fpr * (1 - npv))) * 1e4 + 1e-3) AS BIGINT)) AS mcc
FROM e WHERE isfinite(thresh) GROUP BY cls""")
def m14_best_correlation(spark, sf):
    m = _measured(spark, sf)
    best = E.best_thresholds(m, ["cls"], ("mcc",))
    return best.select("cls", F.floor(F.col("value") * 1e4 + 1e-3).cast("long").alias("mcc"))


@query(f"{_MUTEX}{_OVR}{_CURVE} SELECT cls, {_units('ap')} AS ap FROM scores")
def m14_average_precision(spark, sf):
    m = _measured(spark, sf)
    return E.average_precision(m, ["cls"]).withColumn("ap", units("ap"))


@query(f"{_MUTEX}{_OVR}{_CURVE} SELECT cls, {_units('auc')} AS auc, {_units('sklish')} AS ap FROM scores")
def m14_auc_and_sklish(spark, sf):
    m = _measured(spark, sf)
    out = E.auc(m, ["cls"]).join(E.sklish_precision(m, ["cls"]), "cls")
    return out.select("cls", units("auc").alias("auc"), units("ap").alias("ap"))


@query(f"""{_MUTEX}{_OVR}{_CURVE}, cut AS (SELECT cls, thresh, tp, fp, pos FROM curve WHERE isfinite(thresh) AND fp <= 20
  UNION ALL SELECT cls, CAST('-inf' AS DOUBLE), coalesce(max(CASE WHEN isfinite(thresh) AND fp <= 20 THEN tp END), 0), 20, max(pos) FROM curve GROUP BY cls),
r AS (SELECT cls, fp / 20 AS x, tp / nullif(pos, 0) AS y, lag(fp / 20) OVER w AS px, lag(tp / nullif(pos, 0)) OVER w AS py FROM cut WINDOW w AS (PARTITION BY cls ORDER BY thresh DESC)),
a AS (SELECT cls, CASE WHEN max(x) = min(x) THEN max(y - x) ELSE sum((x - px) * (y + py) / 2) END AS auc FROM r GROUP BY cls) SELECT cls, {_units('auc')} AS auc FROM a""")
def w5_truncated_auc(spark, sf):
    c = E.curve(_ovr(spark, sf), ["cls"])
    return E.auc(c, ["cls"], cutoff=20.0).select("cls", units("auc").alias("auc"))


@query(f"""{_MUTEX}{_OVR}{_CURVE}, voc AS (SELECT cls, i, max(ppv) AS p FROM e, range(11) r(i) WHERE tp * 10 >= i * pos AND pos > 0 GROUP BY cls, i), v AS (SELECT cls, sum(p) / 11 AS voc FROM voc GROUP BY cls),
z AS (SELECT cls, sum((tpr - coalesce(pt, 0)) * (ppv + coalesce(pp, 1)) / 2) AS z FROM (SELECT cls, thresh, tpr, ppv, lag(tpr) OVER w AS pt, lag(ppv) OVER w AS pp FROM e WINDOW w AS (PARTITION BY cls ORDER BY thresh DESC)) WHERE isfinite(thresh) GROUP BY cls)
SELECT cls, CASE WHEN ap IS NULL THEN -1 ELSE {_units('coalesce(voc, 0)')} END AS voc2007, {_units('sklish')} AS voc2012, {_units('z')} AS trapezoid FROM scores LEFT JOIN v USING (cls) LEFT JOIN z USING (cls)""")
def m36_average_precisions(spark, sf):
    m, keys = _measured(spark, sf), ["cls"]
    parts = [E.average_precision(m, keys, 11), E.sklish_precision(m, keys), E.trapezoid_precision(m, keys)]
    out = parts[0].withColumn("voc2007", units("ap")).drop("ap")
    for name, part in zip(("voc2012", "trapezoid"), parts[1:]):
        out = out.join(part.withColumn(name, units("ap")).drop("ap"), keys)
    return out


@query(f"""{_MUTEX}{_OVR}{_CURVE}, f AS (SELECT cls, thresh, coalesce(2 * ppv * tpr / nullif(ppv + tpr, 0), 0) AS v FROM e WHERE isfinite(thresh))
SELECT cls, 'f1' AS metric, round(max(v), 6) AS value FROM f GROUP BY cls""")
def r5_best_thresholds(spark, sf):
    m = _measured(spark, sf)
    return E.best_thresholds(m, ["cls"], ("f1",)).select("cls", "metric", F.round("value", 6).alias("value"))


@query(f"""{_MUTEX}{_OVR}{_CURVE}, f AS (SELECT cls, round(max(coalesce(2 * ppv * tpr / nullif(ppv + tpr, 0), 0)), 6) AS f FROM e WHERE isfinite(thresh) GROUP BY cls), n AS (SELECT cls, max(pos) AS pos, max(neg + pos) AS support FROM curve GROUP BY cls)
SELECT cls, {_units('ap')} AS ap, {_units('auc')} AS auc, coalesce(f, -1) AS max_f1, CAST(pos AS DOUBLE) AS positives, CAST(support AS DOUBLE) AS support FROM scores JOIN n USING (cls) LEFT JOIN f USING (cls)""")
def r4_summary(spark, sf):
    s = E.summary(materialize(E.curve(_ovr(spark, sf), ["cls"]), "curves"), ["cls"])
    return s.select("cls", units("ap").alias("ap"), units("auc").alias("auc"), F.coalesce(F.round("max_f1", 6), F.lit(-1.0)).alias("max_f1"), "positives", "support")


@query(f"{_ALL} SELECT t AS \"true\", p AS pred, CAST(sum(weight) AS DOUBLE) AS total FROM cfsn GROUP BY 1, 2")
def m17_confusion_matrix(spark, sf):
    return A.confusion(vectors(spark, sf, "all"))


@query(f"""{_ALL}, up AS (SELECT id AS cls, supercategory AS top FROM categories)
SELECT coalesce(a.top, 'none') AS "true", coalesce(b.top, 'none') AS pred, CAST(sum(weight) AS DOUBLE) AS total FROM cfsn LEFT JOIN up a ON a.cls = t LEFT JOIN up b ON b.cls = p GROUP BY 1, 2""")
def m18_coarsened_matrix(spark, sf):
    above = star.categories(spark, sf).select(F.col("id").alias("cls"), F.col("supercategory").alias("top"))
    return A.coarsened(vectors(spark, sf, "all"), above)


@query(f"{_MUTEX}, ovr AS (SELECT 0 AS cls, CAST(t >= 0 AS BIGINT) AS is_true, score, weight FROM cfsn){_CURVE} SELECT CASE WHEN isfinite(thresh) THEN thresh ELSE -1 END AS thresh, CAST(tp AS DOUBLE) AS tp, CAST(CASE WHEN isfinite(thresh) THEN fp ELSE -1 END AS DOUBLE) AS fp, CAST(pos - tp AS DOUBLE) AS fn, CAST(CASE WHEN isfinite(thresh) THEN neg - fp ELSE -1 END AS DOUBLE) AS tn FROM curve")
def m19_combined_curves(spark, sf):
    v = vectors(spark, sf).withColumn("part", F.pmod("gid", F.lit(3)))
    parts = E.curve(v.select("part", (F.col("true") >= 0).cast("long").alias("is_true"), F.col("score").alias("pred_score"), "weight"), ["part"])
    c = E.combine(parts)
    return c.select(_finite("thresh"), "tp", _finite("fp"), "fn", _finite("tn"))


@query(f"""{_ALL}, k AS (SELECT t, p, CAST(sum(weight) AS DOUBLE) AS n FROM cfsn GROUP BY 1, 2), c AS (
  SELECT coalesce(a.cls, b.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(named, 0) AS named FROM
  (SELECT t AS cls, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS tp FROM k GROUP BY 1) a FULL JOIN (SELECT p AS cls, sum(n) AS named FROM k GROUP BY 1) b ON a.cls = b.cls)
SELECT cls, round(coalesce(tp / nullif(named, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, support FROM c""")
def m22_classification_report(spark, sf):
    r = E.report(A.confusion(vectors(spark, sf, "all")))
    return r.select("cls", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


@query("SELECT name, dense_rank() OVER (ORDER BY lower(replace(name, ' ', '_'))) - 1 AS cls FROM categories")
def m25_unify_classes(spark, sf):
    c = star.categories(spark, sf).select("name")
    return X.unify_classes(c, c)


@query(f"""{_MUTEX}, areas AS (SELECT c.*, coalesce(t.w * t.h, p.w * p.h) AS a FROM cfsn c LEFT JOIN truth t ON t.id = txs LEFT JOIN pred p ON p.id = pxs)
SELECT 'small' AS area, CAST(sum(CASE WHEN a <= 700 THEN weight ELSE 0 END) AS DOUBLE) AS weight, count(*) AS n FROM areas
UNION ALL SELECT 'large', CAST(sum(CASE WHEN a BETWEEN 700 AND 1e9 THEN weight ELSE 0 END) AS DOUBLE), count(*) FROM areas""")
def m28_area_ranges(spark, sf):
    true, pred = sides(spark, sf)
    return E.weights_in_ranges(X.confusion_vectors(true, pred, sized=True), (("small", 0, 700), ("large", 700, 1e9)))


@query(f"""{_SIDES}, best AS (SELECT o.gid, o.px, arg_min(o.tx, (-o.v, o.tx)) AS tx, max(o.v) AS v FROM (
  SELECT t.gid, t.id AS tx, p.id AS px, greatest(least(t.x + t.w, p.x + p.w) - greatest(t.x, p.x) + 1, 0) * greatest(least(t.y + t.h, p.y + p.h) - greatest(t.y, p.y) + 1, 0) AS i,
    (t.w + 1) * (t.h + 1) + (p.w + 1) * (p.h + 1) AS s, i / (s - i) AS v FROM truth t JOIN pred p ON p.gid = t.gid AND p.cls = t.cls) o WHERE v > 0 GROUP BY 1, 2)
SELECT p.gid, p.id AS px, coalesce(v >= 0.5, false) AND row_number() OVER (PARTITION BY p.gid, b.tx, coalesce(v >= 0.5, false) ORDER BY score DESC, p.id DESC) = 1 AS hit FROM pred p LEFT JOIN best b ON b.px = p.id""")
def m10_voc_match(spark, sf):
    true, pred = sides(spark, sf)
    return X.voc_match(true, pred)


@query("SELECT vec_id AS id, CAST(list_position(CAST(embedding AS DOUBLE[]), list_max(CAST(embedding AS DOUBLE[]))) - 1 AS BIGINT) AS cls FROM embeddings", tables=False)
def r1_top_class(spark, sf):
    e = star.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("prob"))
    return E.top_class(e)


_RANGES = (("all", 0.0, 1e10), ("small", 0.0, 1024.0), ("large", 1024.0, 1e10))
_AT_75 = re.sub(r"\b(lists|ranked|fold|matched|cfsn)\b", r"\1_75", _MUTEX.removeprefix(_SIDES).replace("iou > 0.5", "iou > 0.75"))
_EVALUATED = f"""{_MUTEX}{_AT_75}, every AS (SELECT CAST(0.5 AS DOUBLE) AS iou_thresh, * FROM cfsn UNION ALL SELECT 0.75, * FROM cfsn_75),
ranged AS (SELECT iou_thresh, area, v.t, v.p, v.score, CASE WHEN coalesce(t.w * t.h, p.w * p.h) BETWEEN lo AND hi THEN v.weight ELSE 0 END AS weight
  FROM every v LEFT JOIN truth t ON t.id = txs LEFT JOIN pred p ON p.id = pxs CROSS JOIN (VALUES {', '.join(f"('{n}', {lo}, {hi})" for n, lo, hi in _RANGES)}) r(area, lo, hi)),
ovr AS (SELECT iou_thresh, area, c.id AS cls, CAST(coalesce(t = c.id, false) AS BIGINT) AS is_true, CASE WHEN p = c.id THEN score ELSE CAST('-inf' AS DOUBLE) END AS score, weight FROM ranged CROSS JOIN categories c
  UNION ALL SELECT iou_thresh, area, -1, CAST(coalesce(t, -2) <> -1 AS BIGINT), score, weight FROM ranged){_curves('iou_thresh, area, cls')}"""


@query(f"{_EVALUATED} SELECT iou_thresh, area, cls, {_units('ap')} AS ap, {_units('auc')} AS auc FROM scores")
def m27_evaluate(spark, sf):
    """All IoU thresholds and area ranges at once: scores of each class, and without classes (-1)."""
    true, pred = sides(spark, sf)
    s = evaluate.evaluate(true, pred, E.rest_classes(star.categories(spark, sf)), (0.5, 0.75), _RANGES)
    return s.select("iou_thresh", "area", F.coalesce("cls", F.lit(-1).cast("long")).alias("cls"), units("ap").alias("ap"), units("auc").alias("auc"))


@query(f"{_SIDES}, kin AS (SELECT a.id AS up, b.id AS down FROM categories a JOIN categories b ON a.id = b.id OR a.name = b.supercategory) SELECT gid, px, tx FROM pairs JOIN kin ON up = tcls AND down = pcls")
def m4_ancestor_candidates(spark, sf):
    """Truth of a coarser class serves predictions of the classes below it."""
    cats = star.categories(spark, sf)
    ids = cats.select("id", "name")
    c = C.closure(C.edges(cats))
    c = c.join(ids.toDF("a", "ancestor"), "ancestor").join(ids.toDF("d", "descendant"), "descendant").select(F.col("a").alias("ancestor"), F.col("d").alias("descendant"))
    true, pred = sides(spark, sf)
    return X.candidates(true, pred, "ancestors", closure=c).select("gid", "px", "tx")
