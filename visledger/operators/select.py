"""Columns, views and lookups: projections, filters and the joins along video, image, annotation and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..manifest import Manifest

# ------------------------------------------------------------ columns


def value(df: DataFrame, key: str, default=None, as_type: str = "string") -> Column:
    """A column by name, or an attribute of the overflow column; ``default`` where it is null."""
    if key in df.columns:
        col = F.col(key)
    else:
        col = F.try_variant_get(F.try_parse_json(F.col("extra")), f"$.{key}", as_type) if "extra" in df.columns else F.lit(None).cast(as_type)
    return col if default is None else F.coalesce(col, F.lit(default))


def lookup(df: DataFrame, keys: str | list[str], default=None, as_type: str = "string") -> DataFrame:
    """``id`` and the named attributes of every row."""
    keys = [keys] if isinstance(keys, str) else keys
    return df.select("id", *[value(df, k, default, as_type).alias(k) for k in keys])


def assign(df: DataFrame, key: str, values) -> DataFrame:
    """Set a column to a scalar, an expression, or to the rows ``id, value`` of another table."""
    if isinstance(values, DataFrame):
        new = values.select("id", F.col("value").alias("_value"))
        return df.drop(key).join(new, "id", "left").withColumnRenamed("_value", key)
    return df.withColumn(key, values if isinstance(values, Column) else F.lit(values))


def view(df: DataFrame, ids: list) -> DataFrame:
    """Rows of ``df`` in the order of ``ids``, repeats kept, with their place ``pos``; unknown ids give nothing."""
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, id {df.schema['id'].dataType.simpleString()}")
    return F.broadcast(wanted).join(df, "id")


def unique(viewed: DataFrame) -> DataFrame:
    """Each id once, at its first place."""
    return viewed.groupBy("id").agg(F.min("pos").alias("pos"))


def take(viewed: DataFrame, places: list[int]) -> DataFrame:
    return view(viewed.withColumnsRenamed({"id": "_id", "pos": "id"}), places).withColumnsRenamed({"id": "_pos"}).withColumnRenamed("_id", "id").drop("_pos")


def compress(viewed: DataFrame, flag: Column) -> DataFrame:
    return viewed.where(flag)


def slice_rows(df: DataFrame, start: int, stop: int, by: str = "id") -> DataFrame:
    """Rows ``start`` to ``stop`` in the order of ``by``."""
    return df.orderBy(by).offset(start).limit(stop - start)


def attribute_frequency(df: DataFrame) -> DataFrame:
    """How many rows have each attribute, as rows ``attribute, n``; a column that is null is absent."""
    cols = [c for c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("n")) for c in cols])).alias("p")
    return counts.select(pairs).select("p.attribute", "p.n")


# ------------------------------------------------- relations of tables


def annotations_per_image(m: Manifest) -> DataFrame:
    """``image_id, n``, images without annotations included."""
    n = m.annotations.groupBy("image_id").agg(F.count("*").alias("n"))
    return m.images.select(F.col("id").alias("image_id")).join(n, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("n"))


def annotation_groups(m: Manifest) -> DataFrame:
    """``image_id, annotation_ids`` (sorted, possibly empty)."""
    ids = m.annotations.groupBy("image_id").agg(F.array_sort(F.collect_list("id")).alias("annotation_ids"))
    empty = F.array().cast("array<bigint>")
    return m.images.select(F.col("id").alias("image_id")).join(ids, "image_id", "left").select("image_id", F.coalesce("annotation_ids", empty).alias("annotation_ids"))


def frames(m: Manifest) -> DataFrame:
    """``video_id, image_ids`` in the order of frames, videos without images included."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "id"))), lambda s: s["id"])
    ids = m.images.where("video_id is not null").groupBy("video_id").agg(pairs.alias("image_ids"))
    empty = F.array().cast("array<bigint>")
    return m.videos.select(F.col("id").alias("video_id")).join(ids, "video_id", "left").select("video_id", F.coalesce("image_ids", empty).alias("image_ids"))


def track_annotations(m: Manifest) -> DataFrame:
    """``track_id, annotation_ids`` in the order of frames."""
    at = m.annotations.where("track_id is not null").select("id", "image_id", "track_id")
    at = at.join(m.images.select(F.col("id").alias("image_id"), "frame_index"), "image_id", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "image_id", "id"))), lambda s: s["id"])
    return at.groupBy("track_id").agg(ids.alias("annotation_ids"))


def images_of(m: Manifest, anns: DataFrame) -> DataFrame:
    """The image of each annotation, repeats kept: ``id, image_id`` and the image's name and file."""
    im = m.images.select(F.col("id").alias("image_id"), F.col("name").alias("image_name"), "file_name")
    return anns.select("id", "image_id").join(im, "image_id")


def category_names(m: Manifest, anns: DataFrame) -> DataFrame:
    cats = m.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return anns.select("id", "category_id").join(cats, "category_id", "left").select("id", "category")


def set_category_names(m: Manifest, names: DataFrame) -> DataFrame:
    """Annotations with the categories named by rows ``id, category``, found by name or alias."""
    found = resolve_aliases(m.categories, names.select("category").distinct())
    new = names.join(found, "category", "left").select("id", F.col("category_id").alias("_cid"), F.lit(True).alias("_set"))
    out = m.annotations.join(new, "id", "left")
    return out.withColumn("category_id", F.when(F.col("_set"), F.col("_cid")).otherwise(F.col("category_id"))).select(*m.annotations.columns)


def boxes(anns: DataFrame) -> DataFrame:
    return anns.where("bbox is not null").select("id", "bbox.x", "bbox.y", "bbox.w", "bbox.h")


def tabular_targets(m: Manifest) -> DataFrame:
    """Annotations as rows of id, category, centre, size and size of their image."""
    im = m.images.select(F.col("id").alias("image_id"), F.col("width").alias("img_width"), F.col("height").alias("img_height"))
    a = m.annotations.where("bbox is not null").join(im, "image_id")
    return a.select(
        "id", "image_id", "category_id", (F.col("bbox.x") + F.col("bbox.w") / 2).alias("center_x"),
        (F.col("bbox.y") + F.col("bbox.h") / 2).alias("center_y"), F.col("bbox.w").alias("width"), F.col("bbox.h").alias("height"),
        "img_width", "img_height",
    )


def paths(df: DataFrame, root: str) -> DataFrame:
    """``id, path``: file names under ``root`` unless absolute."""
    whole = F.when(F.col("file_name").startswith("/"), F.col("file_name")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "file_name"))
    return df.select("id", whole.alias("path"))


# ------------------------------------------------------------ filters


def select_annotations(
    m: Manifest, ids: list | None = None, image_id=None, track_id=None, video_id=None, image_name=None, track_name=None, video_name=None,
) -> DataFrame:
    """Annotations of the most particular filter given: video before track before image before ids."""
    a = m.annotations
    if video_name is not None or video_id is not None:
        vids = m.videos.where(F.col("name") == video_name if video_name is not None else F.col("id") == video_id).select(F.col("id").alias("video_id"))
        of = m.images.join(vids, "video_id", "left_semi").select(F.col("id").alias("image_id"))
        return a.join(of, "image_id", "left_semi")
    if track_name is not None:
        of = m.tracks.where(F.col("name") == track_name).select(F.col("id").alias("track_id"))
        return a.join(of, "track_id", "left_semi")
    if track_id is not None:
        return a.where(F.col("track_id") == str(track_id))
    if image_name is not None:
        of = m.images.where(F.col("name") == image_name).select(F.col("id").alias("image_id"))
        return a.join(of, "image_id", "left_semi")
    if image_id is not None:
        return a.where(F.col("image_id") == image_id)
    return a if ids is None else view(a, ids)


def select_images(m: Manifest, ids: list | None = None, video_id=None, names: list | None = None, video_name=None) -> DataFrame:
    """Images by ids or names in the order asked for, or of a video in the order of frames (by their ``frame_index``)."""
    if names is not None:
        wanted = m.images.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], "pos int, name string")
        return F.broadcast(wanted).join(m.images, "name")
    if video_name is not None:
        vids = m.videos.where(F.col("name") == video_name).select(F.col("id").alias("video_id"))
        return m.images.join(vids, "video_id", "left_semi")
    if video_id is not None:
        return m.images.where(F.col("video_id") == video_id)
    return m.images if ids is None else view(m.images, ids)


def select_named(df: DataFrame, ids: list | None = None, names: list | None = None) -> DataFrame:
    """Rows of categories, videos or tracks by ids or names, in the order asked for."""
    if names is not None:
        wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], "pos int, name string")
        return F.broadcast(wanted).join(df, "name")
    return df if ids is None else view(df, ids)


def tracks_in_video(m: Manifest, video_id) -> DataFrame:
    """``track_id, first_frame``: distinct tracks seen in a video, with the frame where each first appears."""
    im = m.images.where(F.col("video_id") == video_id).select(F.col("id").alias("image_id"), "frame_index")
    a = m.annotations.where("track_id is not null").select("image_id", "track_id").join(im, "image_id")
    return a.groupBy("track_id").agg(F.min("frame_index").alias("first_frame"))


def query_images(m: Manifest, images: str | Column | None = None, videos: str | Column | None = None, valid_ids: list | None = None) -> DataFrame:
    """``id`` of images that meet a predicate on images and, if given, are of videos that meet one on videos."""
    out = m.images
    if images is not None:
        out = out.where(images)
    if videos is not None:
        out = out.join(m.videos.where(videos).select(F.col("id").alias("video_id")), "video_id", "left_semi")
    if valid_ids is not None:
        out = out.where(F.col("id").isin(valid_ids))
    return out.select("id")


def channel_list(col: Column) -> Column:
    """Channels of a specification: commas part streams, bars part channels, ``rgb`` is three."""
    parts = F.split(F.regexp_replace(F.coalesce(col, F.lit("")), r"\brgb\b", "red|green|blue"), r"[|,]")
    return F.filter(F.transform(parts, lambda c: F.trim(c)), lambda c: c != "")


def query_subset(m: Manifest, images=None, videos=None, categories: list[str] | None = None, channels: list[str] | None = None) -> DataFrame:
    """``id`` of images that meet all conditions: predicates, at least one of the categories, all of the channels."""
    out = query_images(m, images, videos)
    if categories is not None:
        cids = m.categories.where(F.col("name").isin(categories)).select(F.col("id").alias("category_id"))
        held = m.annotations.join(cids, "category_id", "left_semi").select(F.col("image_id").alias("id"))
        out = out.join(held, "id", "left_semi")
    if channels is not None:
        need = F.array(*[F.lit(c) for c in channels])
        ok = m.images.where(F.size(F.array_except(need, channel_list(F.col("channels")))) == 0).select("id")
        out = out.join(ok, "id", "left_semi")
    return out


def annotation_ids(m: Manifest, image_ids=None, category_ids=None, area: tuple | None = None, iscrowd: int | None = None) -> DataFrame:
    """``id`` by image, category, box area (both ends exclusive) and crowd flag."""
    a = m.annotations
    if image_ids is not None:
        a = a.where(F.col("image_id").isin(image_ids))
    if category_ids is not None:
        a = a.where(F.col("category_id").isin(category_ids))
    if area is not None:
        size = F.col("bbox.w") * F.col("bbox.h")
        a = a.where((size > area[0]) & (size < area[1]))
    if iscrowd is not None:
        a = a.where(F.coalesce("iscrowd", F.lit(0)) == iscrowd)
    return a.select("id")


def category_ids(m: Manifest, names=None, supercategories=None, ids=None) -> DataFrame:
    c = m.categories
    for col, wanted in (("name", names), ("supercategory", supercategories), ("id", ids)):
        if wanted is not None:
            c = c.where(F.col(col).isin(wanted))
    return c.select("id")


def image_ids_with(m: Manifest, image_ids=None, category_ids=None) -> DataFrame:
    """``id`` of images that hold any of the categories."""
    im = m.images if image_ids is None else m.images.where(F.col("id").isin(image_ids))
    if category_ids is not None:
        held = m.annotations.where(F.col("category_id").isin(category_ids)).select(F.col("image_id").alias("id"))
        im = im.join(held, "id", "left_semi")
    return im.select("id")


def resolve_aliases(categories: DataFrame, names: DataFrame) -> DataFrame:
    """``category, category_id`` for rows ``category``: the exact name, else the first that fits a name or alias in any case."""
    exact = categories.select(F.col("name").alias("category"), F.col("id").alias("exact_id"))
    every = categories.select("id", F.explode(F.concat(F.array("name"), F.coalesce("alias", F.array().cast("array<string>")))).alias("called"))
    folded = every.groupBy(F.lower("called").alias("folded")).agg(F.min("id").alias("alias_id"))
    out = names.join(exact, "category", "left").join(folded, F.lower("category") == F.col("folded"), "left")
    return out.select("category", F.coalesce("exact_id", "alias_id").alias("category_id"))


def contains(df: DataFrame, key: str, col: str = "id") -> bool:
    return not df.where(F.col(col) == key).isEmpty()


def one(df: DataFrame, key, col: str = "id"):
    """The single row with a key; an error if there is none or more than one."""
    found = df.where(F.col(col) == key).take(2)
    if len(found) != 1:
        raise KeyError(f"{col} {key!r}: {'more than one row' if found else 'no row'}")
    return found[0]


def unregistered(registered: DataFrame, present: DataFrame) -> DataFrame:
    """``path, state`` of files: ``ok``, ``missing`` (registered, not there) or ``unregistered``."""
    a, b = registered.select("path").distinct().withColumn("r", F.lit(1)), present.select("path").distinct().withColumn("p", F.lit(1))
    state = F.when(F.col("p").isNull(), "missing").when(F.col("r").isNull(), "unregistered").otherwise("ok")
    return a.join(b, "path", "full").select("path", state.alias("state"))


# -------------------------------------------------------------- assets


def assets(images: DataFrame) -> DataFrame:
    """One row for each file of an image, the image's own first: ``image_id, nth, file_name, channels, width, height``."""
    own = F.when(
        F.col("file_name").isNotNull(), F.array(F.struct("file_name", "channels", "width", "height"))
    ).otherwise(F.array().cast("array<struct<file_name:string,channels:string,width:bigint,height:bigint>>"))
    more = F.coalesce("assets", F.array().cast("array<struct<file_name:string,channels:string,width:bigint,height:bigint>>"))
    return images.select(F.col("id").alias("image_id"), F.posexplode(F.concat(own, more)).alias("nth", "a")).select("image_id", "nth", "a.*")


def asset_with(images: DataFrame, channels: list[str]) -> DataFrame:
    """The first file of each image that shares a channel."""
    want = F.array(*[F.lit(c) for c in channels])
    fit = assets(images).where(F.arrays_overlap(channel_list(F.col("channels")), want))
    return fit.groupBy("image_id").agg(F.min_by("file_name", "nth").alias("file_name"))


def primary_asset(images: DataFrame) -> DataFrame:
    """The main file of each image: its own, else the largest."""
    key = F.struct(-(F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))), F.col("nth"))
    largest = assets(images.where("file_name is null")).groupBy("image_id").agg(F.min_by("file_name", key).alias("file_name"))
    return images.where("file_name is not null").select(F.col("id").alias("image_id"), "file_name").unionByName(largest)


def frame_rank(images: DataFrame) -> DataFrame:
    """Frames renumbered from zero within each video, in the order of ``frame_index``."""
    w = Window.partitionBy("video_id").orderBy("frame_index", "id")
    return images.where("video_id is not null").select("id", "video_id", (F.row_number().over(w) - 1).cast("long").alias("frame_id"))


def flatten(groups: DataFrame, col: str) -> DataFrame:
    """A row for each element of the lists in ``col``; empty and null lists give none."""
    return groups.withColumn(col, F.explode(col))
