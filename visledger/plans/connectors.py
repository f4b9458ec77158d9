"""Readers, writers and streams (S of the inventory, and extensions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as S
from ..sources import formats, star
from ..storage import new_path as scratch
from ..streaming import online
from ._register import registrar

QUERIES, SQL, query = registrar()
M = star.manifest


def _in_document(spark, sf, large: bool = False):
    """The manifest after a round trip through one JSON document."""
    from ..sources import documents

    path = scratch(spark, "document") + ".json"
    documents.write_document(M(spark, sf), path)
    return documents.read_large_documents(spark, [path]) if large else documents.read_documents(spark, path)


@query("SELECT id, name, width FROM images")
def s10_document_round_trip(spark, sf):
    return _in_document(spark, sf).images.select("id", "name", "width")


@query("""SELECT id, image_id, category_id, CAST(track_id AS VARCHAR) AS track_id, x, w, score FROM annotations""")
def s11_document_annotations(spark, sf):
    return _in_document(spark, sf).annotations.select("id", "image_id", "category_id", "track_id", "bbox.x", "bbox.w", "score")


@query("""SELECT 'categories' AS tbl, count(*) AS n FROM categories UNION ALL SELECT 'images', count(*) FROM images UNION ALL SELECT 'videos', count(*) FROM videos
UNION ALL SELECT 'annotations', count(*) FROM annotations UNION ALL SELECT 'tracks', count(DISTINCT track_id) FROM annotations""")
def s23_large_document(spark, sf):
    m = _in_document(spark, sf, large=True)
    rows = [m.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t in ("categories", "images", "videos", "annotations", "tracks")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT id, image_id, category_id, score FROM annotations")
def s12_parquet_view(spark, sf):
    from ..sources.documents import read_view, write_view

    path = scratch(spark, "view")
    write_view(M(spark, sf), path)
    return read_view(spark, path).annotations.select("id", "image_id", "category_id", "score")


@query("SELECT count(*) AS n FROM videos")
def s16_sql_view(spark, sf):
    M(spark, sf).register("manifest_")
    return spark.sql("SELECT count(*) AS n FROM manifest_videos")


@query("""SELECT CAST(track_id AS DOUBLE) AS track_id, CAST(count(*) OVER (PARTITION BY track_id) AS DOUBLE) AS track_length, CAST(frame_index AS DOUBLE) AS frame_number,
  x AS img_bbox_tl_x, y AS img_bbox_tl_y, x + w AS img_bbox_br_x, y + h AS img_bbox_br_y FROM annotations a JOIN images i ON i.id = image_id WHERE x IS NOT NULL""")
def s26_to_kw18(spark, sf):
    rows = formats.to_kw18(M(spark, sf))
    return rows.select("track_id", "track_length", "frame_number", "img_bbox_tl_x", "img_bbox_tl_y", "img_bbox_br_x", "img_bbox_br_y")


@query("""SELECT 'images' AS tbl, count(DISTINCT frame_index) AS n FROM annotations a JOIN images i ON i.id = image_id WHERE x IS NOT NULL
UNION ALL SELECT 'annotations', count(*) FROM annotations WHERE x IS NOT NULL
UNION ALL SELECT 'tracks', count(DISTINCT track_id) FROM annotations WHERE x IS NOT NULL
UNION ALL SELECT 'categories', count(DISTINCT category_id) FROM annotations WHERE x IS NOT NULL""")
def s27_kw18_round_trip(spark, sf):
    path = scratch(spark, "kw18")
    formats.kw18_lines(formats.to_kw18(M(spark, sf))).write.option("compression", "gzip").text(path)
    m = formats.from_kw18(formats.read_kw18(spark, path))
    row = lambda t: m.only(t, "track_id" if t == "annotations" else "id").agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n")
    return row("images").unionByName(row("annotations")).unionByName(row("tracks")).unionByName(row("categories"))


@query("""SELECT a.id, CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ' ' || CAST(x + w AS BIGINT) || ' ' || CAST(y + h AS BIGINT) AS corners FROM annotations a WHERE x IS NOT NULL""")
def s32_to_kpf(spark, sf):
    lines = formats.to_kpf(M(spark, sf))
    return lines.select(F.get_json_object("value", "$.geom.id0").cast("long").alias("id"), F.get_json_object("value", "$.geom.g0").alias("corners"))


@query("SELECT image_id, category_id, x, score FROM annotations WHERE x IS NOT NULL")
def s35_load_results(spark, sf):
    from ..sources.documents import load_results

    m = M(spark, sf)
    found = m.annotations.where("bbox is not null").select("image_id", "category_id", F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h").alias("bbox"), "score")
    return load_results(m, found).annotations.select("image_id", "category_id", "bbox.x", "score")


@query("SELECT count(*) AS n, count(DISTINCT file_name) AS files FROM images")
def s5_images_from_paths(spark, sf):
    from ..sources.documents import from_image_paths

    im = from_image_paths(spark, M(spark, sf).images.select("file_name")).images
    return im.agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("files"))


@query("SELECT o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1", tables=False)
def s6_class_folders(spark, sf):
    from ..operators.stats import category_frequency
    from ..sources.documents import from_class_folders

    return category_frequency(from_class_folders(spark, M(spark, sf).images.select("file_name")))


@query("""SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""", tables=False)
def x1_windowed_counts(spark, sf):
    w = online.windowed_counts(star.table(spark, sf, "events"))
    return w.select(F.col("window_start").cast("timestamp").cast("long").alias("hour"), "event_type", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1", tables=False)
def x2_streamed_counts(spark, sf):
    import uuid as ids

    schema = star.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet".replace("/events.parquet", "/event[s].parquet"))
    g = stream.groupBy("event_type").agg(F.count("*").alias("n"))
    return online.run_to_table(g, f"streamed_{ids.uuid4().hex}")


@query("SELECT id, name FROM images ORDER BY id LIMIT 4 OFFSET 6")
def s21_list_slice(spark, sf):
    return S.slice_rows(M(spark, sf).images, 6, 10).select("id", "name")
