"""Edits and validation (D, V of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import check as V
from ..operators import edit as D
from ..operators import select as S
from ..sources import star
from ._register import registrar

QUERIES, SQL, query = registrar()
M = star.manifest


def counts(m):
    """Rows of each table: what an edit did, at a glance."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t, df in m.tables().items() if t != "keypoint_categories"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counts(videos="videos", images="images", annotations="annotations", categories="categories", tracks="tracks") -> str:
    named = {"videos": videos, "images": images, "annotations": annotations, "categories": categories, "tracks": tracks}
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {src}" for t, src in named.items())


@query("SELECT id, name, caption FROM videos UNION ALL SELECT (SELECT greatest(max(id) + 1, count(*)) FROM videos), 'new clip', 'added'")
def d1_add_video(spark, sf):
    new = spark.createDataFrame([(None, "new clip", "added")], "id bigint, name string, caption string")
    return D.append(M(spark, sf), "videos", new, ("id", "name")).videos.select("id", "name", "caption")


@query("SELECT id, name FROM images UNION ALL SELECT CAST(-1 AS BIGINT), 'extra'")
def d2_add_image(spark, sf):
    new = spark.createDataFrame([(-1, "extra", "extra.png")], "id bigint, name string, file_name string")
    return D.append(M(spark, sf), "images", new, ("id", "name", "file_name")).images.select("id", "name")


@query("SELECT id AS image_id, CAST(1 AS BIGINT) AS nth, 'depth/' || id || '.png' AS file_name, 'depth' AS channels FROM images WHERE id % 4 = 0")
def d3_add_asset(spark, sf):
    im = M(spark, sf).images
    asset = F.struct(F.concat(F.lit("depth/"), "id", F.lit(".png")).alias("file_name"), F.lit("depth").alias("channels"), F.col("width"), F.col("height"))
    more = F.array_append(F.coalesce("assets", F.array().cast(im.schema["assets"].dataType)), asset)
    im = im.withColumn("assets", F.when(F.col("id") % 4 == 0, more).otherwise(F.col("assets")))
    return S.assets(im).where("nth > 0").select("image_id", F.col("nth").cast("long").alias("nth"), "file_name", "channels")


@query("SELECT count(*) + 1 AS n, greatest(max(id) + 1, count(*)) AS top FROM annotations")
def d4_add_annotation(spark, sf):
    new = spark.createDataFrame([(None, 1, 2)], "id bigint, image_id bigint, category_id bigint")
    return D.append(M(spark, sf), "annotations", new).annotations.agg(F.count("*").alias("n"), F.max("id").alias("top"))


@query("SELECT name FROM categories UNION SELECT 'brand new'")
def d7_ensure_category(spark, sf):
    m = M(spark, sf)
    known = m.categories.orderBy("id").limit(1).select("name")
    new = known.union(spark.createDataFrame([("brand new",)], "name string")).withColumn("id", F.lit(None).cast("long"))
    return D.ensure(m, "categories", new).categories.select("name")


@query("SELECT 'images' AS tbl, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'annotations', 0 UNION ALL SELECT 'videos', 0 UNION ALL SELECT 'categories', count(*) FROM categories UNION ALL SELECT 'tracks', count(*) FROM tracks")
def d9_clear(spark, sf):
    return counts(D.clear(M(spark, sf)))


@query("SELECT id, image_id FROM annotations WHERE score >= 0.1")
def d10_remove_annotations(spark, sf):
    m = M(spark, sf)
    return D.remove_annotations(m, m.annotations.where("score < 0.1").select("id")).annotations.select("id", "image_id")


@query(_counts(categories="(SELECT * FROM categories WHERE id > 3)", annotations="(SELECT * FROM annotations WHERE category_id IS NULL OR category_id > 3)"))
def d11_remove_categories(spark, sf):
    m = M(spark, sf)
    return counts(D.remove_categories(m, m.categories.where("id <= 3").select("id")))


@query("SELECT id, CASE WHEN category_id > 3 THEN category_id END AS category_id FROM annotations")
def d11_remove_categories_keep(spark, sf):
    m = M(spark, sf)
    return D.remove_categories(m, m.categories.where("id <= 3").select("id"), keep_annotations=True).annotations.select("id", "category_id")


@query(_counts(tracks="(SELECT * FROM tracks WHERE CAST(id AS BIGINT) % 2 = 0)", annotations="(SELECT * FROM annotations WHERE sk % 2 = 0)"))
def d12_remove_tracks(spark, sf):
    m = M(spark, sf)
    return counts(D.remove_tracks(m, m.tracks.where("cast(id as bigint) % 2 = 1").select("id")))


@query(_counts(images="(SELECT * FROM images WHERE id % 3 <> 0)", annotations="(SELECT * FROM annotations WHERE image_id % 3 <> 0)"))
def d13_remove_images(spark, sf):
    m = M(spark, sf)
    return counts(D.remove_images(m, m.images.where("id % 3 = 0").select("id")))


@query(_counts(
    videos="(SELECT * FROM videos WHERE id % 2 = 0)", images="(SELECT * FROM images WHERE video_id % 2 = 0)",
    annotations="(SELECT * FROM annotations WHERE image_id IN (SELECT id FROM images WHERE video_id % 2 = 0))",
))
def d14_remove_videos(spark, sf):
    m = M(spark, sf)
    return counts(D.remove_videos(m, m.videos.where("id % 2 = 1").select("id")))


@query("SELECT id, CAST((sk % 5 <> 1)::INT + (pk % 5 <> 1)::INT AS BIGINT) AS n FROM annotations WHERE has_kp")
def d15_remove_keypoints(spark, sf):
    a = D.remove_keypoints(M(spark, sf), [1]).annotations
    return a.where("keypoints is not null").select("id", F.size("keypoints").cast("long").alias("n"))


@query("SELECT id, CASE WHEN reflection_id <> 2 THEN reflection_id END AS reflection_id FROM keypoint_categories WHERE id <> 2")
def d16_remove_keypoint_categories(spark, sf):
    return D.remove_keypoint_categories(M(spark, sf), [2]).keypoint_categories.select("id", "reflection_id")


@query("SELECT id, CASE WHEN id = 1001 THEN 7 ELSE category_id END AS category_id FROM annotations WHERE image_id = 1")
def d17_set_category(spark, sf):
    return D.set_category(M(spark, sf), 1001, 7).annotations.where("image_id = 1").select("id", "category_id")


@query(""", renamed AS (SELECT id, CASE WHEN id IN (1, 2) THEN 'merged' WHEN id = 3 THEN (SELECT name FROM categories WHERE id = 4) ELSE name END AS name, id IN (1, 2, 3) AS new FROM categories)
SELECT name, arg_min(id, CASE WHEN new THEN 1000000 ELSE 0 END + id) AS id FROM renamed GROUP BY name""")
def d18_rename_categories(spark, sf):
    m = M(spark, sf)
    names = {r["id"]: r["name"] for r in m.categories.where("id <= 4").select("id", "name").collect()}
    return D.rename_categories(m, {names[1]: "merged", names[2]: "merged", names[3]: names[4]}).categories.select("name", "id")


@query(""", renamed AS (SELECT id, CASE WHEN id IN (1, 2) THEN 1 WHEN id = 3 THEN 4 ELSE id END AS new FROM categories)
SELECT r.new AS category_id, count(*) AS n FROM annotations a JOIN renamed r ON r.id = category_id GROUP BY 1""")
def d18_rename_annotations(spark, sf):
    m = M(spark, sf)
    names = {r["id"]: r["name"] for r in m.categories.where("id <= 4").select("id", "name").collect()}
    a = D.rename_categories(m, {names[1]: "merged", names[2]: "merged", names[3]: names[4]}, merge="ignore").annotations
    return a.where("category_id is not null").groupBy("category_id").agg(F.count("*").alias("n"))


@query("SELECT a.id, 9 + row_number AS category_id FROM annotations a LEFT JOIN (SELECT id, row_number() OVER (ORDER BY name) AS row_number FROM categories) c ON c.id = category_id")
def d19_renumber_categories(spark, sf):
    return D.renumber_categories(M(spark, sf), start=10).annotations.select("id", "category_id")


@query("SELECT id, CASE WHEN starts_with(file_name, 'img/O/') THEN 'store/' || substr(file_name, 7) ELSE file_name END AS file_name FROM images")
def d20_reroot_prefix(spark, sf):
    return D.reroot(M(spark, sf), "", old_prefix="img/O/", new_prefix="store/").images.select("id", "file_name")


@query("SELECT id, '/data/set/' || file_name AS file_name FROM images")
def d20_reroot_absolute(spark, sf):
    from dataclasses import replace

    return D.reroot(replace(M(spark, sf), root="/data/set"), "/data", absolute=True).images.select("id", "file_name")


@query("SELECT id, 'set/' || file_name AS file_name FROM images")
def d20_reroot_relative(spark, sf):
    from dataclasses import replace

    return D.reroot(replace(M(spark, sf), root="/data/set"), "/data").images.select("id", "file_name")


@query(""", kept AS (SELECT * FROM annotations WHERE category_id <= 20), im AS (SELECT * FROM images WHERE id IN (SELECT image_id FROM kept)) """ + _counts(
    videos="(SELECT * FROM videos WHERE id IN (SELECT video_id FROM im))", images="im", annotations="(SELECT * FROM kept UNION ALL SELECT * FROM annotations WHERE category_id IS NULL AND image_id IN (SELECT id FROM im))",
    categories="(SELECT * FROM categories WHERE id <= 20)",
))
def d22_modify_categories(spark, sf):
    m = M(spark, sf)
    m = m.with_tables(annotations=m.annotations.where("category_id is not null").unionByName(
        m.annotations.where("category_id is null").join(m.annotations.where("category_id <= 20").select("image_id").distinct(), "image_id", "left_semi").select(*m.annotations.columns)
    ))
    keep = [r["name"] for r in m.categories.where("id <= 20").select("name").collect()]
    return counts(D.modify_categories(m, keep=keep, drop_images=True))


@query("""SELECT a.id, image_id, category_id, CAST(0 AS BIGINT) AS iscrowd, weight < 0.5 AS "ignore", w * h AS area,
  row_number - 1 AS frame_id FROM annotations a LEFT JOIN (SELECT id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index, id) AS row_number FROM images) f ON f.id = image_id""")
def d26_conform(spark, sf):
    return D.conform(M(spark, sf))


@query()
def d28_perturb(spark, sf):
    return D.perturb(M(spark, sf).annotations, n_categories=25).select("id", "category_id", "score")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1", tables=False)
def v2_not_unique(spark, sf):
    return V.not_unique(star.table(spark, sf, "lineitem"), "l_orderkey")


@query("""SELECT attribute, n FROM (SELECT 'category_id' AS attribute, count(*) - count(category_id) AS n FROM annotations
UNION ALL SELECT 'bbox', count(*) - count(x) FROM annotations UNION ALL SELECT 'id', count(*) - count(id) FROM annotations) WHERE n > 0""")
def v3_missing_values(spark, sf):
    return V.missing_values(M(spark, sf).annotations, ["id", "category_id", "bbox"])


@query("SELECT id AS image_id, 'gray' AS channel, CAST(2 AS BIGINT) AS n FROM images WHERE id % 3 = 2 AND id % 10 = 0")
def v5_repeated_channels(spark, sf):
    m = M(spark, sf)
    twice = F.array(F.struct(F.lit("x.png").alias("file_name"), F.lit("gray").alias("channels"), F.col("width"), F.col("height")))
    return V.repeated_channels(m.with_tables(images=m.images.withColumn("assets", F.when(F.col("id") % 10 == 0, twice))))


@query("SELECT id AS image_id, CASE WHEN id % 9 = 0 THEN '/' ELSE '../' END || file_name AS file_name FROM images WHERE id % 9 < 2")
def v6_outside_paths(spark, sf):
    m = M(spark, sf)
    lead = F.when(F.col("id") % 9 == 0, "/").when(F.col("id") % 9 == 1, "../").otherwise("")
    return V.outside_paths(m.with_tables(images=m.images.withColumn("file_name", F.concat(lead, "file_name"))))


@query("SELECT CAST(image_id AS VARCHAR) AS value, count(*) AS n FROM annotations WHERE image_id % 50 = 0 GROUP BY 1")
def v7_dangling_images(spark, sf):
    m = M(spark, sf)
    return V.dangling(m.with_tables(images=m.images.where("id % 50 <> 0")), "annotations", "image_id", "images")


@query("SELECT id FROM tracks WHERE id NOT IN (SELECT track_id FROM annotations WHERE sk % 3 <> 0)")
def v10_unused_tracks(spark, sf):
    m = M(spark, sf)
    return V.unused_tracks(m.with_tables(annotations=m.annotations.where("cast(track_id as bigint) % 3 <> 0")))


@query("""SELECT 'error' AS level, 'annotations.image_id points nowhere' AS what, CAST(image_id AS VARCHAR) AS value, count(*) AS n FROM annotations WHERE image_id % 50 = 0 GROUP BY 3""")
def v1_validate(spark, sf):
    m = M(spark, sf)
    found = V.validate(m.with_tables(images=m.images.where("id % 50 <> 0")))
    return found.where("what = 'annotations.image_id points nowhere' or level = 'error'")


@query("SELECT 'left' AS side, count(*) AS n FROM images WHERE id % 100 = 0 UNION ALL SELECT 'right', count(*) FROM images WHERE id % 100 = 1")
def v12_difference(spark, sf):
    im = M(spark, sf).images.select("id", "name", "width")
    d = V.difference(im.where("id % 100 <> 1"), im.where("id % 100 <> 0"))
    return d.groupBy("side").agg(F.count("*").alias("n"))
