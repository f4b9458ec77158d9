"""Other annotation formats: KW18 tracks, LabelMe, Pascal VOC, KPF."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..manifest import TABLES, DeferredManifest, Manifest, conform_table, empty
from ..operators.order import number_rows

#: Columns of a KW18 line (fixed by the format).
KW18_COLUMNS = (
    "track_id", "track_length", "frame_number", "tracking_plane_loc_x", "tracking_plane_loc_y", "velocity_x", "velocity_y",
    "image_loc_x", "image_loc_y", "img_bbox_tl_x", "img_bbox_tl_y", "img_bbox_br_x", "img_bbox_br_y", "area",
    "world_loc_x", "world_loc_y", "world_loc_z", "timestamp", "confidence", "object_type_id", "activity_type_id",
)


def read_kw18(spark: SparkSession, path: str) -> DataFrame:
    """Rows of KW18 text; lines that begin with ``#`` and empty lines are passed over, absent last columns are null."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(*[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(KW18_COLUMNS)])


def to_kw18(m: Manifest) -> DataFrame:
    """KW18 rows of all annotations with a box; tracks that are null get numbers behind the others."""
    im = m.images.select(F.col("id").alias("image_id"), "frame_index", "timestamp")
    a = m.annotations.where("bbox is not null").join(im, "image_id", "left")
    known = F.try_to_number("track_id", F.lit("999999999999999999"))
    top = a.agg(F.coalesce(F.max(known.cast("long")), F.lit(0)).alias("top"))
    loose = a.where("track_id is null")
    a = a.where("track_id is not null").withColumn("tid", known.cast("long"))
    if not loose.isEmpty():
        loose = number_rows(loose, ["id"], "_nth").crossJoin(F.broadcast(top)).withColumn("tid", F.col("top") + F.col("_nth")).drop("_nth", "top")  # one row
        a = a.unionByName(loose)
    b = F.col("bbox")
    cx, cy = b["x"] + b["w"] / 2, b["y"] + b["h"] / 2
    given = {
        "track_id": F.col("tid"), "track_length": F.count("*").over(Window.partitionBy("tid")), "frame_number": F.coalesce("frame_index", "image_id"),
        "tracking_plane_loc_x": cx, "tracking_plane_loc_y": cy, "velocity_x": F.lit(0), "velocity_y": F.lit(0), "image_loc_x": cx, "image_loc_y": cy,
        "img_bbox_tl_x": b["x"], "img_bbox_tl_y": b["y"], "img_bbox_br_x": b["x"] + b["w"], "img_bbox_br_y": b["y"] + b["h"], "area": b["w"] * b["h"],
        "timestamp": F.coalesce(F.unix_timestamp("timestamp"), F.lit(-1)), "confidence": F.coalesce("score", F.lit(1.0)),
        "object_type_id": F.coalesce("category_id", F.lit(-1)),
    }
    return a.select(*[given.get(c, F.lit(-1)).cast("double").alias(c) for c in KW18_COLUMNS])


def kw18_lines(rows: DataFrame) -> DataFrame:
    """``value``: KW18 rows as lines of text."""
    number = lambda c: F.when(F.col(c) == F.floor(c), F.col(c).cast("long").cast("string")).otherwise(F.col(c).cast("string"))
    return rows.select(F.concat_ws(" ", *[number(c) for c in KW18_COLUMNS]).alias("value"))


def from_kw18(rows: DataFrame, video: str = "video") -> Manifest:
    """A manifest of KW18 rows: a video, an image for each frame, a category for each object type. Tables are made when they are asked for."""
    spark = rows.sparkSession
    framed = rows.withColumn("frame_index", F.col("frame_number").cast("long"))

    @functools.cache
    def images():
        return number_rows(framed.select("frame_index").distinct(), ["frame_index"], "id").select(
            "id", "frame_index", F.lit(1).cast("long").alias("video_id"), F.format_string("frame_%06d", F.col("frame_index")).alias("name"))

    box = F.struct(
        F.col("img_bbox_tl_x").alias("x"), F.col("img_bbox_tl_y").alias("y"),
        (F.col("img_bbox_br_x") - F.col("img_bbox_tl_x")).alias("w"), (F.col("img_bbox_br_y") - F.col("img_bbox_tl_y")).alias("h"),
    )
    track = F.col("track_id").cast("long").cast("string")
    told = {
        "category_id": F.when(F.col("object_type_id") >= 0, F.col("object_type_id").cast("long")), "track_id": track, "bbox": box, "score": F.col("confidence"),
    }

    def annotations(wanted: tuple):
        a = framed.where("frame_index is not null")
        if "image_id" in wanted:
            a = a.join(images().select("frame_index", F.col("id").alias("image_id")), "frame_index")
        if "id" in wanted:
            a = number_rows(a, ["track_id", "frame_index", "img_bbox_tl_x", "img_bbox_tl_y"], "id")
        return conform_table(a.select(*[c for c in ("id", "image_id") if c in wanted], *[col.alias(c) for c, col in told.items()]), "annotations")

    def tracks():
        t = framed.where("frame_index is not null").select(track.alias("id")).distinct()
        return conform_table(t.withColumn("name", F.concat(F.lit("track_"), "id")), "tracks")

    def categories():
        cats = rows.select(F.col("object_type_id").cast("long").alias("id")).where("id >= 0").distinct()
        return conform_table(cats.select("id", F.concat(F.lit("class_"), "id").alias("name")), "categories")

    none = empty(spark)
    makers = {name: functools.partial(getattr, none, name) for name in TABLES} | {
        "videos": lambda: conform_table(spark.createDataFrame([(1, video)], "id bigint, name string"), "videos"), "images": lambda: conform_table(images(), "images"),
        "categories": categories, "tracks": tracks, "annotations": lambda: annotations(("id", "image_id")),
    }
    return DeferredManifest(makers, parts={"annotations": annotations})


def read_labelme(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``file_name, width, height, label, shape_type, points, bbox`` for each shape of LabelMe JSON files, or of files with a record on each line."""
    schema = "imagePath string, imageWidth bigint, imageHeight bigint, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>"
    docs = spark.read.schema(schema).option("multiLine", not lines).json(path)
    s = docs.select(F.col("imagePath").alias("file_name"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.explode("shapes").alias("s"))
    xs, ys = F.transform("s.points", lambda p: p[0]), F.transform("s.points", lambda p: p[1])
    box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))
    return s.select("file_name", "width", "height", "s.label", F.coalesce("s.shape_type", F.lit("polygon")).alias("shape_type"), "s.points", box.alias("bbox"))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, width, height, label, bbox, weight`` for each object of Pascal VOC files.

    Corners count from 1; a difficult object weighs 0.
    """
    schema = (
        "filename string, size struct<width:bigint,height:bigint>, "
        "object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    )
    docs = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    o = docs.select("filename", "size", F.explode("object").alias("o"))
    b = F.col("o.bndbox")
    box = F.struct((b["xmin"] - 1).alias("x"), (b["ymin"] - 1).alias("y"), (b["xmax"] - b["xmin"]).alias("w"), (b["ymax"] - b["ymin"]).alias("h"))
    return o.select(
        F.col("filename").alias("file_name"), "size.width", "size.height", F.col("o.name").alias("label"), box.alias("bbox"),
        (1.0 - F.coalesce("o.difficult", F.lit(0))).alias("weight"),
    )


def from_labels(rows: DataFrame) -> Manifest:
    """A manifest of rows ``file_name, label, bbox[, width, height, weight]``: images and categories by name."""
    im = rows.groupBy("file_name").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    im = number_rows(im, ["file_name"], "id")
    cats = rows.select(F.col("label").alias("name")).where("name is not null").distinct()
    cats = cats.withColumn("id", F.row_number().over(Window.orderBy("name")).cast("long"))  # a row for each class
    a = rows.join(im.select("file_name", F.col("id").alias("image_id")), "file_name").join(
        F.broadcast(cats.select(F.col("name").alias("label"), F.col("id").alias("category_id"))), "label", "left"
    )
    keep = [c for c in ("weight", "score", "segmentation") if c in rows.columns]
    a = number_rows(a, ["image_id", "label", "bbox.x", "bbox.y", "bbox.w", "bbox.h"], "id").select("id", "image_id", "category_id", "bbox", *keep)
    return empty(rows.sparkSession).with_tables(
        images=conform_table(im, "images"), categories=conform_table(cats, "categories"), annotations=conform_table(a, "annotations")
    )


def to_kpf(m: Manifest) -> DataFrame:
    """``value``: KPF geometry packets, a JSON line for each annotation with a box, corners as left, top, right, bottom."""
    im = m.images.select(F.col("id").alias("image_id"), "frame_index")
    a = m.annotations.where("bbox is not null").join(im, "image_id", "left")
    b = F.col("bbox")
    corners = F.concat_ws(" ", *[x.cast("long").cast("string") for x in (b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])])
    geom = F.struct(a["id"].alias("id0"), F.col("track_id").alias("id1"), F.coalesce("frame_index", "image_id").alias("ts0"), corners.alias("g0"))
    return a.select(F.to_json(F.struct(geom.alias("geom"))).alias("value"))
