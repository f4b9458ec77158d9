"""Files, reports and remaining rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import check as V
from ..operators import curves as E
from ..operators import files as X
from ..operators import match, report
from ..operators import tree as C
from ..sources import star
from ._register import registrar
from .evaluation import _ALL, vectors

QUERIES, SQL, query = registrar()
M = star.manifest


def _there(spark, sf):
    """Sizes of the files of every image but each seventh."""
    return M(spark, sf).images.where("id % 7 <> 0").select("file_name", (F.col("id") * 10).alias("bytes"))


@query("SELECT id AS image_id, file_name FROM images WHERE id % 7 = 0")
def f21_missing_files(spark, sf):
    return X.missing(M(spark, sf), _there(spark, sf))


@query("SELECT count(*) FILTER (WHERE id % 7 <> 0) AS files, CAST(sum(CASE WHEN id % 7 <> 0 THEN id * 10 ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (WHERE id % 7 = 0) AS missing FROM images")
def a16_disk_usage(spark, sf):
    return X.disk_usage(M(spark, sf), _there(spark, sf))


@query("""SELECT 'images' AS tbl, count(*) AS n FROM images WHERE id % 7 <> 0 UNION ALL SELECT 'annotations', count(*) FROM annotations WHERE image_id % 7 <> 0""")
def d23_drop_missing(spark, sf):
    m = M(spark, sf)
    out = X.drop_files(m, m.images.where("id % 7 = 0").select("file_name"))
    row = lambda t: out.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n")
    return row("images").unionByName(row("annotations"))


@query("SELECT attribute, n FROM (SELECT 'visible' AS attribute, 0 AS n UNION ALL SELECT 'keypoint_category_id', count(*) FROM annotations WHERE has_kp AND sk % 5 = 3) WHERE n > 0")
def v4_missing_in_nested(spark, sf):
    a = M(spark, sf).annotations
    k = a.select(F.explode("keypoints").alias("k"), F.col("track_id").cast("long").alias("sk")).select("sk", "k.*")
    k = k.withColumn("keypoint_category_id", F.when(~((F.col("sk") % 5 == 3) & (F.col("visible") == 2)), F.col("keypoint_category_id")))
    return V.missing_values(k, ["visible", "keypoint_category_id"])


@query("SELECT DISTINCT lower(replace(name, ' ', '_')) AS child, lower(replace(supercategory, ' ', '_')) AS parent FROM categories")
def c9_normal_names(spark, sf):
    e = C.edges(M(spark, sf).categories)
    return e.select(scalars.normal_name(F.col("child")).alias("child"), scalars.normal_name(F.col("parent")).alias("parent")).distinct()


@query(f"""{_ALL} SELECT CASE WHEN t < 0 THEN 'false positive' WHEN p < 0 THEN 'false negative' WHEN t = p THEN 'true positive' ELSE 'confused' END AS role, count(*) AS n FROM cfsn GROUP BY 1""")
def m29_confusion_roles(spark, sf):
    return match.roles(vectors(spark, sf, "all")).groupBy("role").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, quality, CAST(crc32 AS DOUBLE) / 1000 AS score FROM (SELECT l.doc_id, quality, (l.doc_id * 7919) % 1000 AS crc32 FROM labels l))
SELECT CAST(floor(sum((score - quality) * (score - quality)) / count(*) * 1e6 + 1e-6) AS BIGINT) AS brier, count(*) AS n FROM s""", tables=False)
def m23_brier_score(spark, sf):
    l = star.table(spark, sf, "labels").select("quality", ((F.col("doc_id") * 7919) % 1000 / F.lit(1000.0)).alias("score"))
    return report.brier(l, "score", "quality").select(F.floor(F.col("brier") * 1e6 + 1e-6).cast("long").alias("brier"), "n")


@query("""WITH s AS (SELECT CAST(quality AS BIGINT) AS y, ((doc_id * 7919) % 1000) AS b FROM labels), g AS (SELECT b, sum(y) AS t, sum(1 - y) AS f FROM s GROUP BY b),
c AS (SELECT b, CAST(sum(t) OVER w AS DOUBLE) AS tp, CAST(sum(f) OVER w AS DOUBLE) AS fp FROM g WINDOW w AS (ORDER BY b DESC))
SELECT b / CAST(1000 AS DOUBLE) AS thresh, tp, fp, (SELECT sum(t) FROM g) - tp AS fn, (SELECT sum(f) FROM g) - fp AS tn FROM c""", tables=False)
def m13_curve_of_labels(spark, sf):
    l = star.table(spark, sf, "labels").select(
        F.col("quality").cast("long").alias("is_true"), ((F.col("doc_id") * 7919) % 1000 / F.lit(1000.0)).alias("pred_score"), F.lit(1.0).alias("weight")
    )
    return E.curve(l).select("thresh", "tp", "fp", "fn", "tn")


@query("""WITH s AS (SELECT CAST(quality AS BIGINT) AS y, ((doc_id * 7919) % 1000) // 100 AS b FROM labels)
SELECT CAST(b AS BIGINT) AS bin, CAST(sum(y) AS DOUBLE) AS t, CAST(sum(1 - y) AS DOUBLE) AS f FROM s GROUP BY 1""", tables=False)
def m21_running_curve(spark, sf):
    from ..streaming.online import running_curve

    l = star.table(spark, sf, "labels").select(
        F.col("quality").cast("long").alias("is_true"), ((F.col("doc_id") * 7919) % 1000 / F.lit(1000.0)).alias("pred_score"), F.lit(1.0).alias("weight")
    )
    return running_curve(l, bins=10)


@query("""SELECT event_id, CASE WHEN n >= 1048576 THEN 'MB' WHEN n >= 1024 THEN 'KB' ELSE 'B' END AS unit FROM (SELECT event_id, event_id * 37 AS n FROM events)""", tables=False)
def fn_human_bytes(spark, sf):
    e = star.table(spark, sf, "events")
    return e.select("event_id", F.element_at(F.split(scalars.human_bytes(F.col("event_id") * 37), " "), -1).alias("unit"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'clip' ELSE 'clip_x' END AS stem, CASE WHEN id % 2 = 0 THEN CAST(id AS BIGINT) END AS number FROM videos")
def fn_name_versions(spark, sf):
    v = M(spark, sf).videos
    name = F.when(F.col("id") % 2 == 0, F.format_string("clip_v%03d", "id")).otherwise("clip_x")
    stem, number = scalars.split_version(name)
    return v.select("id", stem.alias("stem"), number.cast("long").alias("number"))


@query("SELECT event_id, CAST(event_id % 50 AS DOUBLE) + 0.5 AS mag, 'meters' AS unit FROM events", tables=False)
def fn_resolutions(spark, sf):
    e = star.table(spark, sf, "events")
    q = scalars.quantity(F.concat((F.col("event_id") % 50).cast("string"), F.lit(".5 meters")))
    return e.select("event_id", q["mag"].alias("mag"), q["unit"].alias("unit"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM events", tables=False)
def fn_coerce_times(spark, sf):
    e = star.table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    unix = F.unix_timestamp("ts").cast("string")
    text = F.when(F.col("event_id") % 2 == 0, iso).otherwise(unix)
    return e.select("event_id", F.unix_timestamp(scalars.coerce_time(text)).alias("seconds"))


@query("""WITH b AS (SELECT CAST(nation.n_nationkey AS BIGINT) AS g, CAST(s_suppkey % 2 AS BIGINT) AS y FROM supplier JOIN nation ON n_nationkey = s_nationkey), n AS (SELECT g, count(*) AS n, sum(y) AS t FROM b GROUP BY g)
SELECT g, CASE WHEN n < 7 THEN 7 ELSE n END AS n, CAST(t AS BIGINT) + CASE WHEN n < 7 THEN (7 - n) - (7 - n) // 2 ELSE 0 END AS n_true FROM n""", tables=False)
def m15_stabilized(spark, sf):
    s = star.table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("g"), (F.col("s_suppkey") % 2).alias("is_true"), F.lit(0.5).alias("pred_score"), F.lit(1.0).alias("weight")
    )
    return E.stabilized(s, ["g"]).groupBy("g").agg(F.count("*").alias("n"), F.sum("is_true").alias("n_true"))


@query(f"""{_ALL}, k AS (SELECT CAST(t >= 0 AS BIGINT) AS y, floor(score * 10) / 10 AS b, weight FROM cfsn WHERE isfinite(score)),
g AS (SELECT b, sum(weight * y) AS t, sum(weight * (1 - y)) AS f FROM k GROUP BY b)
SELECT b AS thresh, CAST(sum(t) OVER w AS DOUBLE) AS tp, CAST(sum(f) OVER w AS DOUBLE) AS fp FROM g WINDOW w AS (ORDER BY b DESC)""")
def m20_binned_thresholds(spark, sf):
    v = vectors(spark, sf, "all").withColumn("part", F.pmod("gid", F.lit(3)))
    parts = E.curve(v.select("part", (F.col("true") >= 0).cast("long").alias("is_true"), F.col("score").alias("pred_score"), "weight"), ["part"])
    return E.combine(parts, bins=10).where(F.col("thresh") > E.NEVER_SEEN).select("thresh", "tp", "fp")


@query("""SELECT '' AS old_prefix, 'disk' AS new_prefix, count(DISTINCT file_name) AS fixed, count(DISTINCT file_name) AS missing FROM images""")
def d21_find_reroot(spark, sf):
    from ..operators import edit

    im = M(spark, sf).images
    there = im.select(F.concat(F.lit("disk/"), "file_name").alias("file_name"))
    return edit.find_reroot(im, there)


@query("SELECT image_id, id FROM annotations")
def p15_flatten(spark, sf):
    from ..operators import select as S

    an = M(spark, sf).annotations
    return S.flatten(an.groupBy("image_id").agg(F.collect_list("id").alias("id")), "id")


@query("SELECT name, supercategory FROM categories UNION SELECT supercategory, NULL FROM categories WHERE supercategory NOT IN (SELECT name FROM categories)")
def c11_tree_to_rows(spark, sf):
    return C.to_categories(C.edges(star.categories(spark, sf)))


@query("SELECT image_id, coalesce(category_id, -1) AS category_id, x, h, score FROM annotations WHERE x IS NOT NULL")
def s36_results_of_arrays(spark, sf):
    from ..sources.documents import load_arrays

    m = M(spark, sf)
    b = F.col("bbox")
    row = F.array(F.col("image_id").cast("double"), b["x"], b["y"], b["w"], b["h"], F.col("score"), F.coalesce("category_id", F.lit(-1)).cast("double"))
    return load_arrays(m, m.annotations.where("bbox is not null").select(row.alias("row"))).annotations.select("image_id", "category_id", "bbox.x", "bbox.h", "score")
