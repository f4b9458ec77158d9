"""A manifest out of star-schema tables (customers, orders, line items, parts, suppliers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..manifest import Manifest, conform_table

LINE_COLUMNS = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("name"), F.col("p_type").alias("supercategory")).distinct()
    return kinds.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", "supercategory")  # few rows


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    frame = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return o.select(
        key.alias("id"), F.concat(F.lit("order_"), key).alias("name"),
        F.concat(F.lit("img/"), "o_orderstatus", F.lit("/"), key, F.lit(".png")).alias("file_name"),
        F.col("o_custkey").alias("video_id"), frame.cast("long").alias("frame_index"), F.col("o_orderdate").alias("timestamp"),
        (640 + 160 * (key % 4)).cast("long").alias("width"), F.lit(480).cast("long").alias("height"),
        F.when(key % 3 == 0, "red|green|blue").when(key % 3 == 1, "B1,B8|B11").otherwise("gray").alias("channels"),
    )


def annotations(spark: SparkSession, sf_dir: str, cats: DataFrame) -> DataFrame:
    """One annotation for each line item; ``pk``, ``sk`` and ``ln`` keep part, supplier and line for :func:`predictions`."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", "p_brand").alias("cat"))
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS))
    rows = line.withColumn("nth", nth).join(part, "l_partkey").join(F.broadcast(cats.select(F.col("id").alias("cid"), F.col("name").alias("cat"))), "cat")
    kp = F.array(
        F.struct(pk.cast("double").alias("x"), sk.cast("double").alias("y"), F.lit(2).alias("visible"), (sk % 5).alias("keypoint_category_id")),
        F.struct(sk.cast("double").alias("x"), pk.cast("double").alias("y"), F.lit(1).alias("visible"), (pk % 5).alias("keypoint_category_id")),
    )
    box = F.struct(
        ((7 * pk + 3 * ln) % 40).cast("double").alias("x"), ((5 * sk + ln) % 40).cast("double").alias("y"),
        (20 + pk % 20).cast("double").alias("w"), (20 + sk % 20).cast("double").alias("h"),
    )
    return rows.select(
        (F.col("l_orderkey") * 1000 + F.col("nth")).alias("id"), F.col("l_orderkey").alias("image_id"),
        F.when(pk % 23 != 0, F.col("cid")).alias("category_id"), sk.cast("string").alias("track_id"),
        F.when(ln % 6 != 0, box).alias("bbox"), F.when(ln % 4 == 0, kp).alias("keypoints"),
        ((31 * F.col("l_orderkey") + 17 * ln + pk) % 1000 / F.lit(1000.0)).alias("score"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("weight"),
        F.to_json(F.struct(F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag"))).alias("extra"),
        pk.alias("pk"), sk.alias("sk"), ln.cast("long").alias("ln"),
    )


def predictions(anns: DataFrame, n_cats: int) -> DataFrame:
    """Noisy copies of annotations with boxes: shifted, some of another class, some dropped, some made up."""
    has = anns.where("bbox is not null")
    moved = F.struct(
        (F.col("bbox.x") + F.col("pk") % 25 - 12).alias("x"), (F.col("bbox.y") + F.col("sk") % 19 - 9).alias("y"),
        F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"),
    )
    swapped = F.when(F.col("pk") % 11 == 0, F.col("category_id") % n_cats + 1).otherwise(F.col("category_id"))
    near = has.where("sk % 13 <> 0").select(
        (F.col("id") * 2).alias("id"), "image_id", swapped.alias("category_id"), moved.alias("bbox"), "score", F.lit(1.0).alias("weight")
    )
    made_up = F.struct((F.col("bbox.x") + 100).alias("x"), (F.col("bbox.y") + 100).alias("y"), F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"))
    extra = has.where("pk % 17 = 0").select(
        (F.col("id") * 2 + 1).alias("id"), "image_id", "category_id", made_up.alias("bbox"), (F.col("score") / 2).alias("score"), F.lit(1.0).alias("weight")
    )
    return near.unionByName(extra)


def manifest(spark: SparkSession, sf_dir: str) -> Manifest:
    cats = categories(spark, sf_dir)
    c, s, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "region"))
    return Manifest(
        categories=conform_table(cats, "categories"),
        keypoint_categories=conform_table(
            r.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), ((F.col("r_regionkey") + 1) % 5).cast("long").alias("reflection_id")),
            "keypoint_categories",
        ),
        videos=conform_table(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("caption")), "videos"),
        images=conform_table(images(spark, sf_dir), "images"),
        tracks=conform_table(s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")), "tracks"),
        annotations=conform_table(annotations(spark, sf_dir, cats).drop("pk", "sk", "ln"), "annotations"),
    )


#: The same tables as common table expressions for DuckDB.
SQL = """
videos AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS caption FROM customer),
images AS (
  SELECT o_orderkey AS id, 'order_' || o_orderkey AS name, 'img/' || o_orderstatus || '/' || o_orderkey || '.png' AS file_name,
    o_custkey AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_index,
    o_orderdate AS timestamp, CAST(640 + 160 * (o_orderkey % 4) AS BIGINT) AS width, CAST(480 AS BIGINT) AS height,
    CASE o_orderkey % 3 WHEN 0 THEN 'red|green|blue' WHEN 1 THEN 'B1,B8|B11' ELSE 'gray' END AS channels FROM orders),
categories AS (
  SELECT row_number() OVER (ORDER BY name) AS id, name, supercategory
  FROM (SELECT DISTINCT p_type || '/' || p_brand AS name, p_type AS supercategory FROM part)),
keypoint_categories AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST((r_regionkey + 1) % 5 AS BIGINT) AS reflection_id FROM region),
tracks AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier),
lines AS (
  SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id FROM lineitem),
annotations AS (
  SELECT l.id, l_orderkey AS image_id, CASE WHEN l_partkey % 23 <> 0 THEN c.id END AS category_id, CAST(l_suppkey AS VARCHAR) AS track_id,
    CASE WHEN l_linenumber % 6 <> 0 THEN CAST((7 * l_partkey + 3 * l_linenumber) % 40 AS DOUBLE) END AS x,
    CASE WHEN l_linenumber % 6 <> 0 THEN CAST((5 * l_suppkey + l_linenumber) % 40 AS DOUBLE) END AS y,
    CASE WHEN l_linenumber % 6 <> 0 THEN CAST(20 + l_partkey % 20 AS DOUBLE) END AS w,
    CASE WHEN l_linenumber % 6 <> 0 THEN CAST(20 + l_suppkey % 20 AS DOUBLE) END AS h,
    l_linenumber % 4 = 0 AS has_kp, ((31 * l_orderkey + 17 * l_linenumber + l_partkey) % 1000) / CAST(1000 AS DOUBLE) AS score,
    CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight,
    CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln
  FROM lines l JOIN part ON p_partkey = l_partkey JOIN categories c ON c.name = p_type || '/' || p_brand),
predictions AS (
  SELECT id * 2 AS id, image_id, CASE WHEN pk % 11 = 0 THEN category_id % (SELECT count(*) FROM categories) + 1 ELSE category_id END AS category_id,
    x + pk % 25 - 12 AS x, y + sk % 19 - 9 AS y, w, h, score, CAST(1 AS DOUBLE) AS weight FROM annotations WHERE x IS NOT NULL AND sk % 13 <> 0
  UNION ALL
  SELECT id * 2 + 1, image_id, category_id, x + 100, y + 100, w, h, score / 2, CAST(1 AS DOUBLE) FROM annotations WHERE x IS NOT NULL AND pk % 17 = 0)
"""


def sql(query: str) -> str:
    return f"WITH RECURSIVE {SQL.strip()}\n{query.strip()}" if not query.lstrip().startswith(",") else f"WITH RECURSIVE {SQL.strip()}{query}"
