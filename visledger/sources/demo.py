"""Demo manifests of any size, the same at every run for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..manifest import Manifest, conform_table, empty

CLASSES = ("star", "superstar", "eff")
WIDTH, HEIGHT = 600, 400


def _draw(tag: str, seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that follows a seed and keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(tag)), F.lit(1_000_000)) / 1e6


def _numbered(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1)


def demo(spark: SparkSession, key: str = "vidshapes2-frames5-tracks3", seed: int = 0) -> Manifest:
    """A manifest by key: ``shapesN`` (N images with a few shapes each) or ``vidshapesN[-framesF][-tracksT]`` (N videos of F frames with T moving shapes each)."""
    head, *more = key.split("-")
    options = {"frames": 2, "tracks": 2} | {k.rstrip("0123456789"): int(k[len(k.rstrip("0123456789")) :]) for k in more}
    kind = head.rstrip("0123456789")
    n = int(head[len(kind) :] or 8)
    if kind not in ("shapes", "vidshapes") or set(options) != {"frames", "tracks"}:
        raise ValueError(f"no demo manifest {key}")
    cats = spark.createDataFrame(list(enumerate(CLASSES, 1)), "id bigint, name string")
    which = lambda *keys: (F.floor(_draw("class", seed, *keys) * len(CLASSES)) + 1).cast("long")
    box = lambda x, y, *keys: F.struct(x.alias("x"), y.alias("y"), (20 + 60 * _draw("w", seed, *keys)).alias("w"), (20 + 60 * _draw("h", seed, *keys)).alias("h"))
    if kind == "shapes":
        im = _numbered(spark, n).select("id", F.format_string("img_%05d", "id").alias("name"), F.format_string("images/img_%05d.png", "id").alias("file_name"))
        an = im.select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(1), F.floor(_draw("n", seed, F.col("id")) * 5).cast("int") + 1)).alias("k"))
        an = an.select((F.col("image_id") * 8 + F.col("k")).alias("id"), "image_id", which(F.col("image_id"), F.col("k")).alias("category_id"),
                       box(WIDTH * _draw("x", seed, F.col("image_id"), F.col("k")), HEIGHT * _draw("y", seed, F.col("image_id"), F.col("k")), F.col("image_id"), F.col("k")).alias("bbox"))
        tables = {"images": im, "annotations": an}
    else:
        frames, tracks = options["frames"], options["tracks"]
        vid = _numbered(spark, n).select("id", F.format_string("toy_video_%d", "id").alias("name"))
        trk = vid.select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(tracks))).alias("k")).select("v", ((F.col("v") - 1) * tracks + F.col("k")).alias("t"))
        im = vid.select(F.col("id").alias("video_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("frame_index"))
        im = im.withColumn("id", (F.col("video_id") - 1) * frames + F.col("frame_index") + 1)
        im = im.withColumns({"name": F.format_string("video_%d_frame_%05d", "video_id", "frame_index"), "file_name": F.format_string("videos/%d/%05d.png", "video_id", "frame_index")})
        an = im.select(F.col("id").alias("image_id"), F.col("video_id").alias("v"), "frame_index").join(trk, "v")
        at = lambda tag, size: size * (0.2 + 0.6 * _draw(tag, seed, F.col("t"))) + F.col("frame_index") * (20 * _draw(tag + "v", seed, F.col("t")) - 10)
        an = an.select(((F.col("image_id") - 1) * tracks + F.pmod(F.col("t") - 1, F.lit(tracks)) + 1).alias("id"), "image_id", which(F.col("t")).alias("category_id"),
                       F.col("t").cast("string").alias("track_id"), box(at("x", WIDTH), at("y", HEIGHT), F.col("t")).alias("bbox"))
        tables = {"videos": vid, "images": im, "annotations": an, "tracks": trk.select(F.col("t").cast("string").alias("id"), F.concat(F.lit("track_"), "t").alias("name"))}
    tables["images"] = tables["images"].withColumns({"width": F.lit(WIDTH).cast("long"), "height": F.lit(HEIGHT).cast("long")})
    tables = {"categories": cats, **tables}
    return empty(spark).with_tables(**{t: conform_table(df, t) for t, df in tables.items()})
