"""Counts, distributions, order (A, W, T of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import select as S
from ..operators import stats as A
from ..sources import star
from ._register import registrar

QUERIES, SQL, query = registrar()
M = star.manifest

_DESCRIBED = """count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(min(v) AS DOUBLE) AS min,
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS med, round(quantile_cont(v, 0.75), 6) AS q75, CAST(max(v) AS DOUBLE) AS max"""


def rounded(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("""SELECT (SELECT count(*) FROM annotations) AS n_anns, (SELECT count(*) FROM images) AS n_imgs, (SELECT count(*) FROM videos) AS n_videos,
  (SELECT count(*) FROM categories) AS n_cats, (SELECT CASE WHEN s > k + 3 THEN s ELSE k END FROM
  (SELECT count(DISTINCT track_id) AS s FROM annotations), (SELECT count(*) AS k FROM tracks)) AS n_tracks""")
def a1_basic_stats(spark, sf):
    return A.basic_stats(M(spark, sf))


@query("""SELECT c.name AS category, count(a.id) AS n FROM categories c LEFT JOIN annotations a ON a.category_id = c.id GROUP BY c.name
UNION ALL SELECT NULL, count(*) FROM annotations WHERE category_id IS NULL HAVING count(*) > 0""")
def a2_category_annotation_frequency(spark, sf):
    return A.category_frequency(M(spark, sf))


@query(f""", pairs AS (SELECT DISTINCT image_id, category_id FROM annotations WHERE category_id IS NOT NULL), sizes AS (
  SELECT 'annots_per_img' AS stat, count(a.id) AS v FROM images i LEFT JOIN annotations a ON a.image_id = i.id GROUP BY i.id
  UNION ALL SELECT 'imgs_per_cat', count(image_id) FROM categories c LEFT JOIN pairs p ON p.category_id = c.id GROUP BY c.id
  UNION ALL SELECT 'cats_per_img', count(category_id) FROM images i LEFT JOIN pairs p ON p.image_id = i.id GROUP BY i.id
  UNION ALL SELECT 'annots_per_cat', count(a.id) FROM categories c LEFT JOIN annotations a ON a.category_id = c.id GROUP BY c.id
  UNION ALL SELECT 'imgs_per_video', count(i.id) FROM videos v LEFT JOIN images i ON i.video_id = v.id GROUP BY v.id
  UNION ALL SELECT 'annots_per_track', count(a.id) FROM tracks t LEFT JOIN annotations a ON a.track_id = t.id GROUP BY t.id
  UNION ALL SELECT 'imgs_with_annots', CAST(count(a.id) > 0 AS BIGINT) FROM images i LEFT JOIN annotations a ON a.image_id = i.id GROUP BY i.id)
SELECT stat, {_DESCRIBED} FROM sizes GROUP BY stat""")
def a3_extended_stats(spark, sf):
    return rounded(A.extended_stats(M(spark, sf)), "mean", "std", "q25", "med", "q75")


@query("""SELECT c.name AS category, count(*) AS n, round(avg(w), 6) AS mean_w, round(stddev_pop(w), 6) AS std_w, min(w) AS min_w, max(w) AS max_w,
  round(avg(h), 6) AS mean_h, round(stddev_pop(h), 6) AS std_h, min(h) AS min_h, max(h) AS max_h
FROM annotations a JOIN categories c ON c.id = category_id WHERE x IS NOT NULL GROUP BY ROLLUP (c.name)""")
def a4_box_stats(spark, sf):
    return rounded(A.box_stats(M(spark, sf)), "mean_w", "std_w", "mean_h", "std_h")


@query("""SELECT attribute, n_truthy, n_distinct FROM (
  SELECT 'id' AS attribute, count(*) FILTER (WHERE id <> 0) AS n_truthy, count(DISTINCT id) AS n_distinct FROM images
  UNION ALL SELECT 'width', count(*) FILTER (WHERE width <> 0), count(DISTINCT width) FROM images
  UNION ALL SELECT 'frame_index', count(*) FILTER (WHERE frame_index <> 0), count(DISTINCT frame_index) FROM images
  UNION ALL SELECT 'channels', count(*) FILTER (WHERE channels <> ''), count(DISTINCT channels) FROM images)""")
def a6_attribute_variety(spark, sf):
    return A.attribute_variety(M(spark, sf).images.select("id", "width", "frame_index", "channels"))


@query("""SELECT k.name AS keypoint_category, count(u.kid) AS n FROM keypoint_categories k LEFT JOIN (
  SELECT sk % 5 AS kid FROM annotations WHERE has_kp UNION ALL SELECT pk % 5 FROM annotations WHERE has_kp) u ON u.kid = k.id GROUP BY k.name""")
def a7_keypoint_frequency(spark, sf):
    return A.keypoint_frequency(M(spark, sf))


@query("""SELECT c.name AS category, CASE WHEN x IS NOT NULL AND has_kp THEN 'bbox+keypoints' WHEN x IS NOT NULL THEN 'bbox' WHEN has_kp THEN 'keypoints' ELSE '' END AS type,
  count(*) AS n FROM annotations a LEFT JOIN categories c ON c.id = category_id GROUP BY 1, 2""")
def a8_type_frequency(spark, sf):
    return A.type_frequency(M(spark, sf))


@query()
def a9_representative_images(spark, sf):
    m = M(spark, sf)
    each = m.annotations.groupBy(F.col("image_id").alias("id")).agg(F.collect_set("category_id").alias("members"), F.count("*").alias("n"))
    sets = m.images.select("id").join(each, "id", "left").select(
        "id", F.coalesce("members", F.array(F.lit(-1).cast("long"))).alias("members"), F.coalesce("n", F.lit(0)).alias("n")  # -1: no annotations
    )
    return A.representative(sets).select("cover", "nth", F.col("id").alias("image_id"))


@query("SELECT category_id, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY image_id) AS image_ids FROM (SELECT DISTINCT category_id, image_id FROM annotations WHERE category_id IS NOT NULL) GROUP BY 1")
def a11_images_per_category(spark, sf):
    return A.images_per_category(M(spark, sf)).select("category_id", F.array_join(F.col("image_ids").cast("array<string>"), ",").alias("image_ids"))


@query("""SELECT 'all' AS tag, count(*) AS n_imgs, count(DISTINCT video_id) AS n_videos, sum(width * height)::BIGINT AS pixels FROM images
UNION ALL SELECT 'wide', count(*), count(DISTINCT video_id), sum(width * height)::BIGINT FROM images WHERE width > 800""")
def a14_stats_of_several(spark, sf):
    im = M(spark, sf).images
    return A.image_totals(all=im, wide=im.where("width > 800"))


@query(""", parts AS (SELECT id, unnest(string_split(replace(channels, ',', '|'), '|')) AS c FROM images)
SELECT 'channel' AS kind, c AS key, count(*) AS n FROM parts GROUP BY c
UNION ALL SELECT 'set', k, count(*) FROM (SELECT string_agg(c, '|' ORDER BY c) AS k FROM parts GROUP BY id) GROUP BY k""")
def a15_channel_stats(spark, sf):
    return A.channel_stats(M(spark, sf))


@query(f"""SELECT measure, {_DESCRIBED} FROM (
  SELECT 'height' AS measure, CAST(height AS DOUBLE) AS v FROM images UNION ALL SELECT 'width', CAST(width AS DOUBLE) FROM images
  UNION ALL SELECT 'rt_area', sqrt(width * height) FROM images) GROUP BY measure""")
def a17_image_sizes(spark, sf):
    return rounded(A.image_sizes(M(spark, sf)), "mean", "std", "q25", "med", "q75")


@query("SELECT id, width, height FROM images ORDER BY width * height DESC, id LIMIT 1")
def a17_largest_image(spark, sf):
    return A.largest_image(M(spark, sf))


@query("""SELECT i.id AS image_id, count(a.id) AS anns_per_image, any_value(width) AS width, any_value(height) AS height,
  CAST(dayofyear(any_value(timestamp)) AS BIGINT) AS day_of_year FROM images i LEFT JOIN annotations a ON a.image_id = i.id GROUP BY i.id""")
def a18_per_image_table(spark, sf):
    return A.per_image_table(M(spark, sf)).drop("hour")


@query("""SELECT a.id, round(sqrt(w * h), 9) AS rt_area, round(w / width, 9) AS rel_width, round(h / height, 9) AS rel_height,
  round((x + w / 2) / width, 9) AS rel_cx, round((y + h / 2) / height, 9) AS rel_cy FROM annotations a JOIN images i ON i.id = image_id WHERE x IS NOT NULL""")
def a18_per_annotation_table(spark, sf):
    return rounded(A.per_annotation_table(M(spark, sf)), "rt_area", "rel_width", "rel_height", "rel_cx", "rel_cy", digits=9)


@query("""SELECT l.label AS "true", l.label * 3 % 10 AS pred, sum(l.n)::BIGINT AS total FROM (SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY 1) l GROUP BY 1, 2""", tables=False)
def a20_confusion_matrix(spark, sf):
    e = star.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("true"), (F.col("label").cast("long") * 3 % 10).alias("pred"), F.lit(1).cast("long").alias("weight"))
    return A.confusion(e)


@query("""WITH c AS (SELECT CAST(label AS BIGINT) AS t, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE CAST(label AS BIGINT) END AS p FROM embeddings)
SELECT round(sum((t = p)::INT) / count(*), 6) AS global_accuracy, (SELECT round(avg(a), 6) FROM (SELECT sum((t = p)::INT) / count(*) AS a FROM c GROUP BY t)) AS class_accuracy FROM c""", tables=False)
def a21_accuracy(spark, sf):
    e = star.table(spark, sf, "embeddings")
    t = F.col("label").cast("long")
    rows = e.select(t.alias("true"), F.when(F.col("vec_id") % 4 == 0, 0).otherwise(t).alias("pred"), F.lit(1).alias("weight"))
    return rounded(A.accuracy(A.confusion(rows)), "global_accuracy", "class_accuracy")


@query("SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM (SELECT count(a.id) AS n FROM images i LEFT JOIN annotations a ON a.image_id = i.id GROUP BY i.id)")
def a22_group_size_moments(spark, sf):
    g = S.annotations_per_image(M(spark, sf))
    return g.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


@query()
def a23_content_hash(spark, sf):
    """A digest of each of the six tables."""
    parts = [A.content_hash(df).withColumn("table", F.lit(name)) for name, df in M(spark, sf).tables().items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT count(DISTINCT category_id) AS cats, count(DISTINCT track_id) AS tracks, count(DISTINCT image_id) AS imgs FROM annotations")
def a25_distinct_aggregates(spark, sf):
    return A.distinct_counts(M(spark, sf).annotations, cats="category_id", tracks="track_id", imgs="image_id")


@query("SELECT id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index, id) - 1 AS frame_id FROM images WHERE video_id IS NOT NULL")
def w2_frame_ids(spark, sf):
    return S.frame_rank(M(spark, sf).images)


@query("SELECT 'images' AS tbl, greatest(max(id) + 1, count(*)) AS next_id FROM images UNION ALL SELECT 'annotations', greatest(max(id) + 1, count(*)) FROM annotations")
def w3_next_id(spark, sf):
    from ..operators.edit import next_id

    m = M(spark, sf)
    return spark.createDataFrame([("images", next_id(m.images)), ("annotations", next_id(m.annotations))], "tbl string, next_id bigint")


@query("SELECT day, sum(n) OVER (ORDER BY day)::BIGINT AS total FROM (SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n FROM images GROUP BY 1)")
def w10_images_over_time(spark, sf):
    days = M(spark, sf).images.groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", F.sum("n").over(Window.orderBy("day")).alias("total"))  # a row a day


@query("""SELECT track_id, frame_index, id, count(*) OVER (PARTITION BY track_id, video_id ORDER BY frame_index, id ROWS UNBOUNDED PRECEDING) AS trail FROM (
  SELECT a.id, track_id, video_id, frame_index FROM annotations a JOIN images i ON i.id = image_id)""")
def w11_track_trail(spark, sf):
    m = M(spark, sf)
    a = m.annotations.select("id", "image_id", "track_id").join(m.images.select(F.col("id").alias("image_id"), "video_id", "frame_index"), "image_id")
    w = Window.partitionBy("track_id", "video_id").orderBy("frame_index", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.select("track_id", "frame_index", "id", F.count("*").over(w).alias("trail"))


@query("SELECT track_id, min(id) AS first_id FROM annotations GROUP BY track_id")
def w12_first_appearance(spark, sf):
    return M(spark, sf).annotations.groupBy("track_id").agg(F.min("id").alias("first_id"))


@query("SELECT id, file_name, row_number() OVER (ORDER BY width DESC, file_name) AS nth FROM images")
def t1_sort_values(spark, sf):
    from ..operators.order import number_rows

    im = M(spark, sf).images.select("id", "file_name", "width")
    return number_rows(im, [F.desc("width"), "file_name"]).select("id", "file_name", "nth")


@query("SELECT image_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id DESC) AS r FROM annotations) WHERE r <= 2")
def t3_top_k_per_image(spark, sf):
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc("id"))
    a = M(spark, sf).annotations.withColumn("r", F.row_number().over(w))
    return a.where("r <= 2").select("image_id", "id", "score")


@query("SELECT 'images' AS tbl, id, name FROM (SELECT * FROM images ORDER BY id LIMIT 3) UNION ALL SELECT 'videos', id, name FROM (SELECT * FROM videos ORDER BY id LIMIT 3)")
def t5_head_of_tables(spark, sf):
    m = M(spark, sf)
    head = lambda t: m.table(t).select(F.lit(t).alias("tbl"), "id", "name").orderBy("id").limit(3)
    return head("images").unionByName(head("videos"))


@query("""SELECT category_id, id FROM (SELECT category_id, id, row_number() OVER (PARTITION BY category_id ORDER BY w * h, id) AS r,
  count(*) OVER (PARTITION BY category_id) AS n FROM annotations WHERE x IS NOT NULL AND category_id IS NOT NULL) WHERE r = n // 2 + 1""")
def t6_median_annotation(spark, sf):
    a = M(spark, sf).annotations.where("bbox is not null and category_id is not null")
    p = Window.partitionBy("category_id")
    a = a.withColumns({"r": F.row_number().over(p.orderBy(F.col("bbox.w") * F.col("bbox.h"), "id")), "n": F.count("*").over(p)})
    return a.where(F.col("r") == F.expr("n div 2") + 1).select("category_id", "id")
