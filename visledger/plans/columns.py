"""Projections, lookups and filters (P, F, J, R of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import select as S
from ..sources import star
from ._register import registrar

QUERIES, SQL, query = registrar()
M = star.manifest


@query("SELECT id, name, width FROM images")
def p1_lookup(spark, sf):
    return S.lookup(M(spark, sf).images, ["name", "width"])


@query("SELECT id, CASE WHEN flag = 'R' THEN 'R' ELSE flag END AS flag, coalesce(CAST(NULL AS VARCHAR), 'none') AS other FROM annotations")
def p2_get_overflow(spark, sf):
    a = M(spark, sf).annotations
    return a.select("id", S.value(a, "flag").alias("flag"), S.value(a, "absent", "none").alias("other"))


@query("SELECT id, CAST(qty AS BIGINT) AS qty FROM annotations WHERE qty > 25")
def p3_get_iter_numeric(spark, sf):
    a = M(spark, sf).annotations
    return a.select("id", S.value(a, "qty", as_type="bigint").alias("qty")).where("qty > 25")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'even' END AS caption FROM images")
def p4_set_column(spark, sf):
    im = M(spark, sf).images
    new = im.where("id % 2 = 0").select("id", F.lit("even").alias("value"))
    return S.assign(im, "caption", new).select("id", "caption")


@query(""", wanted AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 1)) t(pos, id))
SELECT CAST(pos AS BIGINT) AS pos, i.id AS id, name FROM wanted w JOIN images i ON i.id = w.id""")
def p5_column_lookup_by_ids(spark, sf):
    return S.view(M(spark, sf).images, [7, 3, 7, 1]).select(F.col("pos").cast("long").alias("pos"), "id", "name")


@query("SELECT id, image_id, category_id FROM annotations ORDER BY id")
def p6_all_rows_lookup(spark, sf):
    return M(spark, sf).annotations.select("id", "image_id", "category_id").orderBy("id")


@query("""SELECT a.id, image_id, category_id, x + w / 2 AS center_x, y + h / 2 AS center_y, w AS width, h AS height,
  i.width AS img_width, i.height AS img_height FROM annotations a JOIN images i ON i.id = image_id WHERE x IS NOT NULL""")
def p7_tabular_targets(spark, sf):
    return S.tabular_targets(M(spark, sf))


@query("SELECT CAST(id AS BIGINT) AS id, CAST(pos AS BIGINT) AS pos FROM (VALUES (7, 0), (3, 1), (1, 3)) t(id, pos) WHERE id IN (SELECT id FROM images)")
def p8_unique(spark, sf):
    return S.unique(S.view(M(spark, sf).images, [7, 3, 7, 1])).select("id", F.col("pos").cast("long").alias("pos"))


@query("SELECT id, name FROM images WHERE id IN (1, 7)")
def p9_take(spark, sf):
    return S.take(S.view(M(spark, sf).images, [7, 3, 5, 1]), [0, 3]).select("id", "name")


@query("SELECT id, name FROM videos WHERE caption = 'BUILDING'")
def p10_compress(spark, sf):
    return S.compress(M(spark, sf).videos, F.col("caption") == "BUILDING").select("id", "name")


@query("SELECT id, name FROM categories ORDER BY id LIMIT 1")
def p11_peek(spark, sf):
    return S.slice_rows(M(spark, sf).categories, 0, 1).select("id", "name")


@query("SELECT id, name FROM categories ORDER BY id LIMIT 5 OFFSET 10")
def p13_slice(spark, sf):
    return S.slice_rows(M(spark, sf).categories, 10, 15).select("id", "name")


@query("""SELECT attribute, n FROM (SELECT count(id) AS id, count(category_id) AS category_id, count(x) AS bbox,
  count(CASE WHEN has_kp THEN 1 END) AS keypoints, count(track_id) AS track_id FROM annotations)
UNPIVOT (n FOR attribute IN (id, category_id, bbox, keypoints, track_id))""")
def p14_attribute_frequency(spark, sf):
    return S.attribute_frequency(M(spark, sf).annotations.select("id", "category_id", "bbox", "keypoints", "track_id"))


@query("""SELECT video_id, string_agg(CAST(width AS VARCHAR), ',' ORDER BY frame_index, id) AS widths FROM images GROUP BY video_id""")
def p16_lookup_per_group(spark, sf):
    im = M(spark, sf).images
    ws = F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "id", "width"))), lambda s: s["width"].cast("string"))
    return im.groupBy("video_id").agg(F.array_join(ws, ",").alias("widths"))


@query("SELECT id, width, height, width * height AS area FROM images")
def p17_sizes(spark, sf):
    return M(spark, sf).images.select("id", "width", "height", (F.col("width") * F.col("height")).alias("area"))


@query("SELECT i.id AS image_id, count(a.id) AS n FROM images i LEFT JOIN annotations a ON a.image_id = i.id GROUP BY i.id")
def p18_annotations_per_image(spark, sf):
    return S.annotations_per_image(M(spark, sf))


@query("""SELECT i.id AS image_id, coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id), '') AS annotation_ids
FROM images i LEFT JOIN annotations a ON a.image_id = i.id GROUP BY i.id""")
def p19_annotation_groups(spark, sf):
    return S.annotation_groups(M(spark, sf)).select("image_id", F.array_join(F.col("annotation_ids").cast("array<string>"), ",").alias("annotation_ids"))


@query("""SELECT v.id AS video_id, coalesce(string_agg(CAST(i.id AS VARCHAR), ',' ORDER BY frame_index, i.id), '') AS image_ids
FROM videos v LEFT JOIN images i ON i.video_id = v.id GROUP BY v.id""")
def p20_images_of_video(spark, sf):
    return S.frames(M(spark, sf)).select("video_id", F.array_join(F.col("image_ids").cast("array<string>"), ",").alias("image_ids"))


@query("SELECT a.id, image_id, i.name AS image_name, file_name FROM annotations a JOIN images i ON i.id = image_id")
def p21_images_of_annotations(spark, sf):
    m = M(spark, sf)
    return S.images_of(m, m.annotations).select("id", "image_id", "image_name", "file_name")


@query("SELECT a.id, c.name AS category FROM annotations a LEFT JOIN categories c ON c.id = category_id")
def p22_category_names(spark, sf):
    m = M(spark, sf)
    return S.category_names(m, m.annotations)


@query("""SELECT a.id, CASE WHEN a.id % 5 = 0 THEN (SELECT min(id) FROM categories) ELSE category_id END AS category_id FROM annotations a""")
def p22_set_category_names(spark, sf):
    m = M(spark, sf)
    first = m.categories.orderBy("id").limit(1).select(F.upper("name").alias("category"))
    return S.set_category_names(m, m.annotations.where("id % 5 = 0").select("id").crossJoin(F.broadcast(first))).select("id", "category_id")


@query("SELECT id, x, y, w, h FROM annotations WHERE x IS NOT NULL")
def p23_boxes(spark, sf):
    return S.boxes(M(spark, sf).annotations)


@query("SELECT image_id AS gid, id, category_id AS cls, x, y, w, h, score, weight FROM annotations WHERE x IS NOT NULL")
def p24_detections(spark, sf):
    from ..operators.match import detections

    return detections(M(spark, sf)).select("gid", "id", "cls", "bbox.*", "score", "weight")


@query("""SELECT track_id, string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY frame_index, image_id, a.id) AS annotation_ids
FROM annotations a LEFT JOIN images i ON i.id = image_id GROUP BY track_id""")
def p25_track_annotations(spark, sf):
    return S.track_annotations(M(spark, sf)).select("track_id", F.array_join(F.col("annotation_ids").cast("array<string>"), ",").alias("annotation_ids"))


@query("SELECT id, '/data/bundle/' || file_name AS path FROM images")
def p26_paths(spark, sf):
    return S.paths(M(spark, sf).images, "/data/bundle")


@query("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS prob_0, CAST(embedding[2] AS DOUBLE) AS prob_1, CAST(embedding[3] AS DOUBLE) AS prob_2 FROM embeddings", tables=False)
def p27_prob_columns(spark, sf):
    e = star.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"prob_{i}") for i in range(3)])


@query("SELECT a.id, image_id FROM annotations a JOIN images i ON i.id = image_id WHERE video_id = 5")
def f1_annotations_of_video(spark, sf):
    return S.select_annotations(M(spark, sf), image_id=1, video_id=5).select("id", "image_id")  # the later filter overrides


@query("SELECT id, image_id FROM annotations WHERE track_id = (SELECT id FROM tracks WHERE name = 'Supplier#000000003')")
def f1_annotations_of_track(spark, sf):
    m = M(spark, sf)
    name = "Supplier#000000003"
    return S.select_annotations(m, track_name=name).select("id", "image_id")


@query("SELECT CAST(pos AS BIGINT) AS pos, i.id AS id FROM (VALUES (0, 'order_9'), (1, 'order_2')) t(pos, n) JOIN images i ON i.name = n")
def f2_images_by_name(spark, sf):
    return S.select_images(M(spark, sf), names=["order_9", "order_2"]).select(F.col("pos").cast("long").alias("pos"), "id")


@query("SELECT id, frame_index FROM images WHERE video_id IN (SELECT id FROM videos WHERE name = 'Customer#000000004')")
def f2_images_of_video(spark, sf):
    return S.select_images(M(spark, sf), video_name="Customer#000000004").select("id", "frame_index")


@query("SELECT id, name FROM categories WHERE id IN (2, 4)")
def f3_categories_by_id(spark, sf):
    return S.select_named(M(spark, sf).categories, ids=[2, 4]).select("id", "name")


@query("SELECT id, name FROM videos WHERE id IN (3, 1)")
def f4_videos_by_id(spark, sf):
    return S.select_named(M(spark, sf).videos, ids=[3, 1]).select("id", "name")


@query("SELECT track_id, min(frame_index) AS first_frame FROM annotations a JOIN images i ON i.id = image_id WHERE video_id = 7 GROUP BY track_id")
def f5_tracks_of_video(spark, sf):
    return S.tracks_in_video(M(spark, sf), 7)


@query("SELECT i.id FROM images i JOIN videos v ON v.id = video_id WHERE width > 800 AND caption IN ('BUILDING', 'MACHINERY')")
def f6_query_images(spark, sf):
    return S.query_images(M(spark, sf), "width > 800", "caption in ('BUILDING', 'MACHINERY')")


@query("""SELECT id FROM images i WHERE width >= 800 AND i.id % 3 = 0 AND EXISTS (
  SELECT 1 FROM annotations a JOIN categories c ON c.id = a.category_id WHERE a.image_id = i.id AND c.id IN (1, 2, 3, 4, 5))""")
def f7_query_subset(spark, sf):
    m = M(spark, sf)
    names = [r["name"] for r in m.categories.where("id <= 5").select("name").collect()]
    return S.query_subset(m, images="width >= 800", categories=names, channels=["red", "blue"])


@query("SELECT id FROM annotations WHERE image_id < 500 AND category_id <= 20 AND w * h > 600 AND w * h < 1000")
def f8_annotation_ids(spark, sf):
    return S.annotation_ids(M(spark, sf), list(range(500)), list(range(1, 21)), (600, 1000), 0)


@query("SELECT id FROM categories WHERE supercategory IN (SELECT supercategory FROM categories WHERE id = 1) AND id < 12")
def f9_category_ids(spark, sf):
    m = M(spark, sf)
    top = m.categories.where("id = 1").first()["supercategory"]
    return S.category_ids(m, supercategories=[top], ids=list(range(12)))


@query("SELECT id FROM images WHERE id IN (SELECT image_id FROM annotations WHERE category_id IN (3, 9))")
def f10_images_with_categories(spark, sf):
    return S.image_ids_with(M(spark, sf), category_ids=[3, 9])


@query("SELECT id, image_id, score FROM annotations WHERE id IN (1001, 2001, 5002)")
def f11_load_annotations(spark, sf):
    return S.view(M(spark, sf).annotations, [1001, 2001, 5002]).select("id", "image_id", "score")


@query("SELECT name AS category, id AS category_id FROM categories WHERE id % 2 = 0 UNION ALL SELECT upper(name), id FROM categories WHERE id % 2 = 1 AND upper(name) <> name UNION ALL SELECT 'no such', NULL")
def f13_alias_to_category(spark, sf):
    c = M(spark, sf).categories
    names = c.select(F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.upper("name")).alias("category"))
    return S.resolve_aliases(c, names.union(spark.createDataFrame([("no such",)], "category string")))


@query("SELECT id, reflection_id FROM keypoint_categories WHERE name = 'ASIA'")
def f14_keypoint_category(spark, sf):
    return S.select_named(M(spark, sf).keypoint_categories, names=["ASIA"]).select("id", "reflection_id")


@query("SELECT CAST(k AS BIGINT) AS key, k IN (SELECT id FROM images) AS present FROM (VALUES (1), (-5)) t(k)")
def f16_contains(spark, sf):
    im = M(spark, sf).images
    return spark.createDataFrame([(k, S.contains(im, k)) for k in (1, -5)], "key bigint, present boolean")


@query("SELECT id, name FROM videos WHERE id = 2")
def f17_point_lookup(spark, sf):
    row = S.one(M(spark, sf).videos, 2)
    return spark.createDataFrame([(row["id"], row["name"])], "id bigint, name string")


@query("SELECT id AS image_id, file_name FROM images WHERE id % 3 = 1")
def f19_asset_with_channel(spark, sf):
    return S.asset_with(M(spark, sf).images, ["B8", "B9"])


@query("SELECT id AS image_id, file_name FROM images")
def f20_primary_asset(spark, sf):
    return S.primary_asset(M(spark, sf).images)


@query("""SELECT '/r/' || file_name AS path, CASE WHEN id % 7 = 0 THEN 'missing' ELSE 'ok' END AS state FROM images
UNION ALL SELECT '/r/img/new_' || id || '.png', 'unregistered' FROM images WHERE id % 11 = 0""")
def f23_unregistered(spark, sf):
    im = M(spark, sf).images
    there = S.paths(im.where("id % 7 <> 0"), "/r").select("path")
    new = im.where("id % 11 = 0").select(F.concat(F.lit("/r/img/new_"), "id", F.lit(".png")).alias("path"))
    return S.unregistered(S.paths(im, "/r"), there.union(new))


@query("SELECT id AS image_id, CAST(0 AS BIGINT) AS nth, file_name, channels, width, height FROM images")
def r21_assets(spark, sf):
    return S.assets(M(spark, sf).images).withColumn("nth", F.col("nth").cast("long"))


@query("SELECT id, CAST(CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 1 END AS BIGINT) AS n FROM images")
def r22_channel_count(spark, sf):
    return M(spark, sf).images.select("id", F.size(S.channel_list(F.col("channels"))).cast("long").alias("n"))


@query("SELECT i.id, v.name AS video FROM images i LEFT JOIN videos v ON v.id = video_id")
def r23_video_of_image(spark, sf):
    m = M(spark, sf)
    return m.images.select("id", "video_id").join(m.videos.select(F.col("id").alias("video_id"), F.col("name").alias("video")), "video_id", "left").select("id", "video")


@query("SELECT id, CAST(2 * x + 5 AS DOUBLE) AS vx, CAST(4 * y - 3 AS DOUBLE) AS vy, x AS back_x, y AS back_y FROM annotations WHERE x IS NOT NULL")
def r25_warp(spark, sf):
    from ..functions.geometry import affine_apply, affine_inverse

    b = S.boxes(M(spark, sf).annotations)
    t = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("a", "b", "tx", "c", "d", "ty"), (2, 0, 5, 0, 4, -3))])
    b = b.withColumn("v", affine_apply(t, F.col("x"), F.col("y")))
    b = b.withColumn("back", affine_apply(affine_inverse(t), F.col("v.x"), F.col("v.y")))
    return b.select("id", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), F.col("back.x").alias("back_x"), F.col("back.y").alias("back_y"))


@query("SELECT a.id, c.name AS category, i.name AS image FROM annotations a JOIN images i ON i.id = image_id JOIN categories c ON c.id = category_id")
def j1_inner_joins(spark, sf):
    m = M(spark, sf)
    cats = F.broadcast(m.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")))  # a row for each kind of part
    im = m.images.select(F.col("id").alias("image_id"), F.col("name").alias("image"))
    return m.annotations.select("id", "image_id", "category_id").join(cats, "category_id").join(im, "image_id").select("id", "category", "image")


@query("SELECT id, image_id FROM annotations WHERE image_id IN (SELECT id FROM images WHERE width = 640)")
def j5_semi_join(spark, sf):
    m = M(spark, sf)
    return m.annotations.select("id", "image_id").join(m.images.where("width = 640").select(F.col("id").alias("image_id")), "image_id", "left_semi")


@query("SELECT id FROM images WHERE id NOT IN (SELECT image_id FROM annotations)")
def j6_anti_join(spark, sf):
    m = M(spark, sf)
    return m.images.select("id").join(m.annotations.select(F.col("image_id").alias("id")), "id", "left_anti")


@query("""SELECT i.id, CASE WHEN starts_with(file_name, 'img/O/') THEN 'open/' || substr(file_name, 7) WHEN starts_with(file_name, 'img/') THEN 'all/' || substr(file_name, 5) ELSE file_name END AS file_name FROM images i""")
def j11_prefix_moves(spark, sf):
    from ..operators.edit import move_assets

    return move_assets(M(spark, sf), [("img/O", "open"), ("img", "all")]).images.select("id", "file_name")


@query("SELECT id, lower(replace(name, ' ', '_')) AS folded FROM videos")
def fn_normal_names(spark, sf):
    return M(spark, sf).videos.select("id", scalars.normal_name(F.col("name")).alias("folded"))


@query("""SELECT event_id, CAST(hour(ts) + minute(ts) / CAST(60 AS DOUBLE) + floor(second(ts)) / CAST(3600 AS DOUBLE) AS DECIMAL(18, 6))::DOUBLE AS hours,
  CAST(dayofyear(ts) AS BIGINT) AS day FROM events""", tables=False)
def fn_time_parts(spark, sf):
    e = star.table(spark, sf, "events")
    return e.select("event_id", scalars.time_of_day(F.col("ts")).cast("decimal(18,6)").cast("double").alias("hours"), F.dayofyear("ts").cast("long").alias("day"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", tables=False)
def fn_json_attribute(spark, sf):
    e = star.table(spark, sf, "events").withColumnRenamed("props", "extra")
    return e.select("event_id", S.value(e, "k", as_type="bigint").alias("k"))


@query("""SELECT id, w * h AS polygon_area, x + w AS right_edge, y + h AS bottom_edge FROM annotations WHERE x IS NOT NULL""")
def fn_polygon_area(spark, sf):
    from ..functions.geometry import box_polygon, polygon_area, to_corners

    a = M(spark, sf).annotations.where("bbox is not null")
    c = to_corners(F.col("bbox"))
    return a.select("id", polygon_area(box_polygon(F.col("bbox"))).alias("polygon_area"), c["right"].alias("right_edge"), c["bottom"].alias("bottom_edge"))
