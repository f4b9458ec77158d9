"""Masks, their scores and the shapes of polygons (R13, M33, M34, R40, A19 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..manifest import empty
from ..operators import masks, segmentation, shapes
from ..operators import match as X
from ..sources import star
from ._register import registrar
from .evaluation import _curves, _units, sides, units

QUERIES, SQL, query = registrar()


def _with_polygons(spark, sf, dets):
    """A manifest of the star tables' images in which detections are polygons."""
    a = dets.select("id", F.col("gid").alias("image_id"), F.col("cls").alias("category_id"), "bbox", "score", "weight", masks.polygon(geometry.box_polygon(F.col("bbox"))).alias("segmentation"))
    return empty(spark).with_tables(images=star.images(spark, sf), annotations=a)


def _clipped(table: str) -> str:
    """Boxes of a side, cut to their images, in whole pixels."""
    return f"""SELECT b.*, CAST(greatest(x, 0) AS BIGINT) AS x0, CAST(least(x + w, i.width) AS BIGINT) AS x1, CAST(greatest(y, 0) AS BIGINT) AS y0, CAST(least(y + h, i.height) AS BIGINT) AS y1
  FROM {table} b JOIN images i ON i.id = b.gid WHERE x < i.width AND y < i.height AND x + w > 0 AND y + h > 0"""


_BOXES = f""", truth AS (SELECT image_id AS gid, id, category_id AS cls, x, y, w, h, weight FROM annotations WHERE x IS NOT NULL AND category_id IS NOT NULL),
pred AS (SELECT image_id AS gid, id, category_id AS cls, x, y, w, h, score FROM predictions WHERE category_id IS NOT NULL),
t AS ({_clipped('truth')}), p AS ({_clipped('pred')})"""


@query(f"{_BOXES} SELECT id, (x1 - x0) * (y1 - y0) AS area, x1 - x0 AS n_runs FROM p")
def r13_mask_areas(spark, sf):
    return masks.measured(_with_polygons(spark, sf, sides(spark, sf)[1])).select("id", "area", "n_runs")


@query(f"""{_BOXES} SELECT t.id, array_to_string(list_concat([x0 * i.height + y0, y1 - y0], flatten(list_transform(range(x1 - x0 - 1), lambda k: [i.height - y1 + y0, y1 - y0])),
  [i.width * i.height - (x1 - 1) * i.height - y1]), ' ') AS counts FROM t JOIN images i ON i.id = t.gid""")
def r13_mask_codes(spark, sf):
    """Run-length texts of all masks, read back."""
    coded = masks.encoded(_with_polygons(spark, sf, sides(spark, sf)[0])).select("id", "counts")
    return masks.counts(coded).select("id", F.array_join(F.col("counts").cast("array<string>"), " ").alias("counts"))


@query(f"""{_BOXES}, o AS (SELECT t.gid, t.id AS tx, p.id AS px, (least(t.x1, p.x1) - greatest(t.x0, p.x0)) * (least(t.y1, p.y1) - greatest(t.y0, p.y0)) AS shared,
  (t.x1 - t.x0) * (t.y1 - t.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS total FROM t JOIN p ON p.gid = t.gid AND p.cls = t.cls AND t.x0 < p.x1 AND p.x0 < t.x1 AND t.y0 < p.y1 AND p.y0 < t.y1)
SELECT gid, tx, px, shared, round(shared / CAST(total - shared AS DOUBLE), 6) AS iou FROM o""")
def r13_mask_overlaps(spark, sf):
    true, pred = sides(spark, sf)
    t, p = (masks.detections(_with_polygons(spark, sf, d)) for d in (true, pred))
    found = masks.shared(X.candidates(t, p, carry=("segmentation", "w", "h")))
    return found.select("gid", "tx", "px", "shared", F.round("iou", 6).alias("iou"))


def _class_name(cls: str = "cls") -> str:
    return f"CASE {cls} % 11 WHEN 1 THEN 'ignore' WHEN 2 THEN 'background' WHEN 3 THEN 'positive' WHEN 4 THEN 'negative' ELSE concat('class_', CAST({cls} % 4 AS STRING)) END"


def _named(spark, sf):
    """Strips of both sides with class names, of which some are special, and the images."""
    true, pred = sides(spark, sf)
    name = F.expr(_class_name("category_id"))
    t = masks.strips(_with_polygons(spark, sf, true), segmentation.TILE, ("category_id", "weight")).withColumn("name", name)
    kinds = segmentation.behaviors(true.select(F.expr(_class_name()).alias("name")).distinct())
    p = masks.strips(_with_polygons(spark, sf, pred), segmentation.TILE, ("category_id", "score")).withColumn("name", name)
    return t.join(F.broadcast(kinds), "name"), p, star.images(spark, sf)  # a row for each class


def _behavior(name: str) -> str:
    return f"CASE {name} WHEN 'ignore' THEN 'ignore' WHEN 'background' THEN 'background' WHEN 'positive' THEN 'undistinguished' WHEN 'negative' THEN 'negative' ELSE 'foreground' END"


#: Cells between all edges of an image's boxes, what covers each, and its pixels for all objects and for each class.
_PIXELS = f"""{_BOXES}, strokes AS (SELECT gid, id, {_class_name().replace('STRING', 'VARCHAR')} AS name, x0, x1, y0, y1, weight, CAST(0 AS DOUBLE) AS score, 0 AS side FROM t
  UNION ALL SELECT gid, id, {_class_name().replace('STRING', 'VARCHAR')}, x0, x1, y0, y1, 1, score, 1 FROM p),
kinds AS (SELECT *, CASE WHEN side = 1 THEN 'found' ELSE {_behavior('name')} END AS b FROM strokes),
xs AS (SELECT gid, v AS a, lead(v) OVER (PARTITION BY gid ORDER BY v) AS b FROM (SELECT DISTINCT gid, unnest([x0, x1]) AS v FROM strokes)),
ys AS (SELECT gid, v AS a, lead(v) OVER (PARTITION BY gid ORDER BY v) AS b FROM (SELECT DISTINCT gid, unnest([y0, y1]) AS v FROM strokes)),
cells AS (SELECT xs.gid, xs.a AS xa, ys.a AS ya, (xs.b - xs.a) * (ys.b - ys.a) AS n, k.* EXCLUDE (gid, b), k.b AS kind FROM xs JOIN ys ON ys.gid = xs.gid JOIN kinds k ON k.gid = xs.gid AND k.x0 <= xs.a AND k.x1 >= xs.b AND k.y0 <= ys.a AND k.y1 >= ys.b
  WHERE xs.b IS NOT NULL AND ys.b IS NOT NULL AND k.b <> 'background'),
laid AS (SELECT gid, xa, ya, any_value(n) AS n,
  coalesce(arg_max(weight, id) FILTER (WHERE kind IN ('foreground', 'negative', 'undistinguished') AND weight <> 1), CASE WHEN bool_or(kind = 'ignore') THEN 0 ELSE 1 END) AS w_all,
  coalesce(arg_max(weight, id) FILTER (WHERE kind IN ('foreground', 'negative') AND weight <> 1), CASE WHEN bool_or(kind IN ('ignore', 'undistinguished')) THEN 0 ELSE 1 END) AS w_each,
  CAST(bool_or(kind IN ('foreground', 'negative', 'undistinguished')) AS BIGINT) AS y, max(score) AS s FROM cells GROUP BY gid, xa, ya),
names AS (SELECT DISTINCT name AS cls FROM kinds WHERE b = 'found' AND {_behavior('name')} = 'foreground'),
of AS (SELECT c.gid, c.xa, c.ya, c.name AS cls, any_value(c.n) AS n, any_value(l.w_each) AS w, CAST(bool_or(side = 0) AS BIGINT) AS y, max(c.score) AS s FROM cells c JOIN laid l ON l.gid = c.gid AND l.xa = c.xa AND l.ya = c.ya
  WHERE c.name IN (SELECT cls FROM names) GROUP BY 1, 2, 3, 4),
whole AS (SELECT sum(width * height) - (SELECT sum(n) FROM laid) AS bare, (SELECT sum(n * w_each) FROM laid) AS w FROM images),
every AS (SELECT '' AS cls, y AS is_true, s AS score, n * w_all AS weight FROM laid UNION ALL SELECT '', 0, 0, bare FROM whole
  UNION ALL SELECT cls, y, s, n * w FROM of UNION ALL SELECT cls, 0, 0, bare + w - coalesce((SELECT sum(n * of.w) FROM of WHERE of.cls = names.cls), 0) FROM names, whole),
ovr AS (SELECT cls, CAST(is_true AS BIGINT) AS is_true, CAST(score AS DOUBLE) AS score, CAST(sum(weight) AS DOUBLE) AS weight FROM every GROUP BY 1, 2, 3 HAVING sum(weight) <> 0)"""


@query(f"{_PIXELS} SELECT cls, is_true, round(score, 4) AS score, weight FROM ovr")
def m33_pixel_confusion(spark, sf):
    t, p, im = _named(spark, sf)
    return segmentation.pixels(t, p, im).select("cls", "is_true", F.round("pred_score", 4).alias("score"), "weight")


@query(f"{_PIXELS}{_curves('cls')}, n AS (SELECT cls, max(pos) AS positives FROM curve GROUP BY cls) SELECT cls, {_units('ap')} AS ap, {_units('auc')} AS auc, CAST(positives AS DOUBLE) AS positives FROM scores JOIN n USING (cls)")
def m34_segmentation_scores(spark, sf):
    t, p, im = _named(spark, sf)
    s = segmentation.evaluate(t, p, im)
    return s.select("cls", units("ap").alias("ap"), units("auc").alias("auc"), "positives")


def _shaped(spark, sf):
    """Detections as rhombs (even ids) and as angles, boxes without a quarter (odd ids)."""
    true, _ = sides(spark, sf)
    b = F.col("bbox")
    x, y, w, h = (b[c] for c in "xywh")
    rhomb = F.array(x + w / 2, y, x + w, y + h / 2, x + w / 2, y + h, x, y + h / 2)
    angle = F.array(x, y, x + w, y, x + w, y + h / 2, x + w / 2, y + h / 2, x + w / 2, y + h, x, y + h)
    a = true.select("id", F.col("gid").alias("image_id"), F.to_json(F.array(F.when(F.col("id") % 2 == 0, rhomb).otherwise(angle))).alias("segmentation"))
    return empty(spark).with_tables(images=star.images(spark, sf), annotations=a)


@query(""", s AS (SELECT id, id % 2 = 0 AS rhomb, w, h, sqrt(w * w + h * h) AS d FROM annotations WHERE x IS NOT NULL AND category_id IS NOT NULL)
SELECT id, CAST(CASE WHEN rhomb THEN 4 ELSE 6 END AS BIGINT) AS n_vertices, CASE WHEN rhomb THEN w * h / 2 ELSE w * h * 3 / 4 END AS area,
  round(sqrt(CASE WHEN rhomb THEN w * h / 2 ELSE w * h * 7 / 8 END), 6) AS hull_rt_area,
  round(CASE WHEN rhomb THEN greatest(w, h) * greatest(w, h) / d ELSE greatest(w, h) END, 6) AS obox_major, round(CASE WHEN rhomb THEN w * h / d ELSE least(w, h) END, 6) AS obox_minor FROM s""")
def a19_polygon_shapes(spark, sf):
    s = shapes.polygon_shapes(_shaped(spark, sf))
    return s.select("id", "n_vertices", "area", *[F.round(c, 6).alias(c) for c in ("hull_rt_area", "obox_major", "obox_minor")])
