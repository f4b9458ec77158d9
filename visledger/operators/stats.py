"""Counts and distributions over a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..manifest import Manifest
from ..storage import forget, materialize
from .select import assets, channel_list


def basic_stats(m: Manifest) -> DataFrame:
    """One row ``n_anns, n_imgs, n_videos, n_cats, n_tracks``.

    Tracks are those of the table, unless annotations name more than three more.
    """
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = m.annotations.agg(F.count("*").alias("n_anns"), F.count_distinct("track_id").alias("seen"))
    for df, name in ((m.images, "n_imgs"), (m.videos, "n_videos"), (m.categories, "n_cats"), (m.tracks, "known")):
        out = out.crossJoin(n(df, name))  # one row each
    tracks = F.when(F.col("seen") > F.col("known") + 3, F.col("seen")).otherwise(F.col("known")).alias("n_tracks")
    return out.select("n_anns", "n_imgs", "n_videos", "n_cats", tracks)


def category_frequency(m: Manifest) -> DataFrame:
    """``category, n``: annotations of each category, zero included, and of no category (null) if there are any."""
    n = m.only("annotations", "category_id").groupBy("category_id").agg(F.count("*").alias("n"))
    named = m.only("categories", "id", "name").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    known = named.join(n, "category_id", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    return known.unionByName(n.where("category_id is null").select(F.lit(None).cast("string").alias("category"), "n"))


def describe(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """``n, mean, std`` (of the population), ``min, q25, med, q75, max`` of a column."""
    c = F.col(col).cast("double")
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs = [
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), q.alias("q"), F.max(c).alias("max"),
    ]
    out = df.groupBy(*(by or [])).agg(*aggs)
    return out.select(*(by or []), "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q75"), "max")


def group_sizes(m: Manifest) -> dict[str, DataFrame]:
    """The groupings whose sizes are described: each a table with a column ``n``."""
    a = m.annotations

    def count(df: DataFrame, key: str, parent: DataFrame) -> DataFrame:
        n = df.groupBy(key).agg(F.count("*").alias("n"))
        return parent.select(F.col("id").alias(key)).join(n, key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))

    pairs = a.where("category_id is not null").select("image_id", "category_id").distinct()
    per_image = count(a, "image_id", m.images)
    return {
        "annots_per_img": per_image,
        "imgs_per_cat": count(pairs, "category_id", m.categories),
        "cats_per_img": count(pairs, "image_id", m.images),
        "annots_per_cat": count(a, "category_id", m.categories),
        "imgs_per_video": count(m.images, "video_id", m.videos),
        "annots_per_track": count(a, "track_id", m.tracks),
        "imgs_with_annots": per_image.select((F.col("n") > 0).cast("long").alias("n")),
    }


def extended_stats(m: Manifest) -> DataFrame:
    """Distributions of all group sizes in one pass: ``stat, n, mean, std, min, q25, med, q75, max``."""
    parts = [df.select(F.lit(name).alias("stat"), "n") for name, df in group_sizes(m).items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return describe(every.withColumnRenamed("n", "size"), "size", ["stat"])


def box_stats(m: Manifest) -> DataFrame:
    """Box widths and heights of each category and of all (null category): one scan, by rollup."""
    a = m.annotations.where("bbox is not null and category_id is not null").join(
        F.broadcast(m.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))), "category_id"
    )
    aggs = [f(F.col(f"bbox.{c}")).alias(f"{name}_{c}") for c in "wh" for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))]
    return a.rollup("category").agg(F.count("*").alias("n"), *aggs)


def anchors(m: Manifest, k: int = 5, seed: int = 0) -> DataFrame:
    """k-means centres of box sizes: ``w, h``; not more than there are sizes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    sizes = m.annotations.where("bbox is not null").select("bbox.w", "bbox.h")
    rows = VectorAssembler(inputCols=["w", "h"], outputCol="features").transform(sizes)
    centers = KMeans(k=k, seed=seed, maxIter=40, tol=1e-6).fit(rows).clusterCenters()
    return m.annotations.sparkSession.createDataFrame([(float(w), float(h)) for w, h in centers], "w double, h double")


def attribute_variety(df: DataFrame) -> DataFrame:
    """Per attribute: values that are neither null, zero nor empty, and distinct values."""
    names = df.columns
    aggs = []
    for c, kind in df.dtypes:
        text = F.col(c).cast("string") if kind in ("bigint", "int", "double", "string", "boolean", "timestamp") else F.to_json(F.struct(c))
        real = F.col(c).isNotNull() & ~text.isin("", "0", "0.0", "false")
        aggs += [F.count_if(real).alias(f"{c}__n"), F.count_distinct(F.when(F.col(c).isNotNull(), text)).alias(f"{c}__d")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"{c}__n").alias("n_truthy"), F.col(f"{c}__d").alias("n_distinct")) for c in names]))
    return one.select(rows.alias("r")).select("r.*")


def keypoint_frequency(m: Manifest) -> DataFrame:
    """``keypoint_category, n``, zero included."""
    seen = m.annotations.select(F.explode("keypoints").alias("k")).groupBy(F.col("k.keypoint_category_id").alias("kid")).agg(F.count("*").alias("n"))
    names = m.keypoint_categories.select(F.col("id").alias("kid"), F.col("name").alias("keypoint_category"))
    return names.join(seen, "kid", "left").select("keypoint_category", F.coalesce("n", F.lit(0)).alias("n"))


def type_frequency(m: Manifest, kinds: tuple = ("bbox", "keypoints", "segmentation")) -> DataFrame:
    """``category, type, n``: which of the geometry columns annotations of a category have, joined by a plus."""
    kind = F.concat_ws("+", *[F.when(F.col(k).isNotNull(), k) for k in kinds])
    a = m.annotations.select("category_id", kind.alias("type")).groupBy("category_id", "type").agg(F.count("*").alias("n"))
    return a.join(m.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left").select("category", "type", "n")


def images_per_category(m: Manifest) -> DataFrame:
    """``category_id, image_ids`` (distinct, sorted)."""
    a = m.annotations.where("category_id is not null")
    return a.groupBy("category_id").agg(F.array_sort(F.collect_set("image_id")).alias("image_ids"))


def channel_stats(m: Manifest) -> DataFrame:
    """``kind, key, n``: files by channel and images by channel set."""
    every = assets(m.images).select("image_id", channel_list(F.col("channels")).alias("c"))
    single = every.select(F.explode("c").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("channel").alias("kind"), "key", "n")
    sets = every.select("image_id", F.explode("c").alias("c")).groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("c")), "|").alias("key"))
    return single.unionByName(sets.groupBy("key").agg(F.count("*").alias("n")).select(F.lit("set").alias("kind"), "key", "n"))


def image_sizes(m: Manifest) -> DataFrame:
    """Description of heights, widths and the root of areas: ``measure, n, mean, std, min, ...``."""
    s = m.images.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("double").alias("v")) for n, c in (
            ("height", F.col("height")), ("width", F.col("width")), ("rt_area", F.sqrt(F.col("width") * F.col("height")))
        )])).alias("s")
    ).select("s.*")
    return describe(s, "v", ["measure"])


def largest_image(m: Manifest) -> DataFrame:
    """The image of the largest area; the least id among equals."""
    key = F.struct(F.col("width") * F.col("height"), -F.col("id"))
    return m.images.agg(F.max_by(F.struct("id", "width", "height"), key).alias("i")).select("i.*")


def per_image_table(m: Manifest) -> DataFrame:
    """``image_id, anns_per_image, width, height, hour, day_of_year`` for plots."""
    from ..functions.scalars import time_of_day

    n = m.annotations.groupBy("image_id").agg(F.count("*").alias("n"))
    im = m.images.withColumnRenamed("id", "image_id").join(n, "image_id", "left")
    return im.select(
        "image_id", F.coalesce("n", F.lit(0)).alias("anns_per_image"), "width", "height", time_of_day(F.col("timestamp")).alias("hour"),
        F.dayofyear("timestamp").cast("long").alias("day_of_year"),
    )


def per_annotation_table(m: Manifest) -> DataFrame:
    """``id, rt_area, rel_width, rel_height, rel_cx, rel_cy`` of annotations with a box."""
    im = m.images.select(F.col("id").alias("image_id"), "width", "height")
    a = m.annotations.where("bbox is not null").join(im, "image_id")
    b = F.col("bbox")
    return a.select(
        a["id"], F.sqrt(b["w"] * b["h"]).alias("rt_area"), (b["w"] / F.col("width")).alias("rel_width"), (b["h"] / F.col("height")).alias("rel_height"),
        ((b["x"] + b["w"] / 2) / F.col("width")).alias("rel_cx"), ((b["y"] + b["h"] / 2) / F.col("height")).alias("rel_cy"),
    )


def content_hash(df: DataFrame) -> DataFrame:
    """One row ``n, digest``: a hash of a table that doesn't depend on the order of rows or partitions.

    Rows are hashed as JSON; their hashes are summed in two halves as decimals,
    so any number of tasks adds up to the same.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    halves = [F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)")) for i in (1, 16)]
    total = F.concat_ws(":", F.count("*").cast("string"), *[x.cast("string") for x in halves])
    return df.agg(F.count("*").alias("n"), F.sha2(total, 512).alias("digest"))


def confusion(rows: DataFrame, true: str = "true", pred: str = "pred", weight: str = "weight") -> DataFrame:
    """``true, pred, total``: the weighted confusion matrix as a table."""
    return rows.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.sum(weight).alias("total"))


def coarsened(rows: DataFrame, above: DataFrame, other: str = "none", true: str = "true", pred: str = "pred", weight: str = "weight") -> DataFrame:
    """The confusion matrix of coarser classes: ``above`` has a row ``cls, top`` for each class; classes without one are ``other``."""
    up = lambda side: F.broadcast(above.select(F.col("cls").alias(side), F.col("top").alias(f"{side}_top")))  # noqa: E731  a row for each class
    found = rows.join(up(true), true, "left").join(up(pred), pred, "left")
    named = lambda side: F.coalesce(f"{side}_top", F.lit(other)).alias(side)
    return confusion(found.select(named(true), named(pred), weight), true, pred, weight)


def distinct_counts(df: DataFrame, **columns: str) -> DataFrame:
    """One row: how many different values some columns have (names of the result to columns); null is none."""
    return df.agg(*[F.count_distinct(c).alias(n) for n, c in columns.items()])


def image_totals(**groups: DataFrame) -> DataFrame:
    """``tag, n_imgs, n_videos, pixels`` of several tables of images, side by side in one pass."""
    every = None
    for tag, im in groups.items():
        part = im.select("video_id", "width", "height", F.lit(tag).alias("tag"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("tag").agg(
        F.count("*").alias("n_imgs"), F.count_distinct("video_id").alias("n_videos"), F.sum(F.col("width") * F.col("height")).alias("pixels")
    )


def accuracy(matrix: DataFrame) -> DataFrame:
    """``global_accuracy`` and the mean over classes of each class's accuracy."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("total")).otherwise(0)
    per = matrix.groupBy("true").agg(F.sum(hit).alias("hit"), F.sum("total").alias("all"))
    return per.agg(F.try_divide(F.sum("hit"), F.sum("all")).alias("global_accuracy"), F.avg(F.try_divide("hit", "all")).alias("class_accuracy"))


def greedy_cover(sets: DataFrame, cost: Column | None = None) -> DataFrame:
    """``nth, id`` of a greedy cover of ``id, members``, from 0: each picks the most members not yet covered for its ``cost``, least id first among equals.

    A set that comes before all others that share a member with it is picked
    whatever happens elsewhere, since values only fall; so each round picks all
    of these at once, until no member is left. Nothing is collected.
    """
    cost = F.lit(1.0) if cost is None else cost.cast("double")
    pairs = sets.select("id", cost.alias("cost"), F.explode(F.array_distinct("members")).alias("member")).where("member is not null")
    pairs, picked = materialize(pairs, "cover"), None
    while not pairs.isEmpty():
        gains = pairs.groupBy("id").agg(F.count("*").alias("gain"), (F.count("*") / F.first("cost")).alias("value"))
        valued = pairs.join(gains, "id")
        best = valued.groupBy("member").agg(F.min_by("id", F.struct(-F.col("value"), "id")).alias("best"))
        firsts = best.groupBy(F.col("best").alias("id")).agg(F.count("*").alias("firsts"))
        won = materialize(gains.join(firsts, "id").where("gain = firsts").select("id", "value"), "cover")
        picked = won if picked is None else picked.unionByName(won)
        covered = pairs.join(won, "id", "left_semi").select("member")
        pairs, old = materialize(pairs.join(covered, "member", "left_anti"), "cover"), pairs
        forget(old)
    if picked is None:
        picked = sets.select("id", F.lit(0.0).alias("value")).limit(0)
    nth = F.row_number().over(Window.orderBy(F.desc("value"), "id")) - 1  # at most a row for each member
    return picked.select(nth.alias("nth"), "id")


def set_cover(sets: DataFrame) -> list:
    """Ids of :func:`greedy_cover` in its order."""
    return [r["id"] for r in greedy_cover(sets).orderBy("nth").collect()]


def representative(sets: DataFrame) -> DataFrame:
    """``cover, nth, id`` of three greedy covers of ``id, members, n``: plain, at a cost of ``n``, and of ``1 / (n + 1)``; each of the sets that are left."""
    out = None
    for k, cost in enumerate((None, F.greatest("n", F.lit(1)), 1 / (F.col("n") + 1))):
        cover = materialize(greedy_cover(sets, cost), "cover").select(F.lit(k).alias("cover"), "nth", "id")
        sets = sets.join(cover, "id", "left_anti")
        out = cover if out is None else out.unionByName(cover)
    return out


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default
