"""Edits: each returns a new manifest. Removals cascade from videos to images to annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..manifest import Manifest, conform_table
from ..storage import materialize
from .order import number_rows


def next_id(df: DataFrame) -> int:
    """The next free id: above all ids and not below the number of rows."""
    top, n = df.agg(F.max("id"), F.count("*")).first()
    return max((top or 0) + 1, n)


def append(m: Manifest, table: str, rows: DataFrame, unique: tuple = ("id",)) -> Manifest:
    """Insert rows; ids that are null are numbered from the next free one. Taken keys are an error."""
    old = m.table(table)
    new = conform_table(rows, table)
    if table != "tracks":
        start = next_id(old)
        given = new.where("id is not null")
        missing = new.where("id is null").drop("id")
        new = given.unionByName(number_rows(missing, [c for c in ("name", "image_id", "extra") if c in new.columns], "id", start))
    for key in unique:
        clash = new.where(F.col(key).isNotNull()).join(old.select(key), key, "left_semi")
        twice = new.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
        if not clash.isEmpty() or not twice.isEmpty():
            raise ValueError(f"{table}.{key} is taken")
    return m.with_tables(**{table: old.unionByName(new)})


def ensure(m: Manifest, table: str, rows: DataFrame, key: str = "name") -> Manifest:
    """Insert the rows whose key isn't there yet."""
    return append(m, table, rows.join(m.table(table).select(key), key, "left_anti"), unique=("id",))


def without(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    return df.join(keys.select(F.col(keys.columns[0]).alias(col)), col, "left_anti").select(*df.columns)


def remove_annotations(m: Manifest, ids: DataFrame) -> Manifest:
    return m.with_tables(annotations=without(m.annotations, ids, "id"))


def remove_images(m: Manifest, ids: DataFrame) -> Manifest:
    return m.with_tables(images=without(m.images, ids, "id"), annotations=without(m.annotations, ids, "image_id"))


def remove_videos(m: Manifest, ids: DataFrame) -> Manifest:
    gone = m.images.join(ids.select(F.col(ids.columns[0]).alias("video_id")), "video_id", "left_semi").select("id")
    return remove_images(m, gone).with_tables(videos=without(m.videos, ids, "id"))


def remove_categories(m: Manifest, ids: DataFrame, keep_annotations: bool = False) -> Manifest:
    """Unknown ids are ignored. Annotations go too, or stay without a category."""
    cats = without(m.categories, ids, "id")
    if not keep_annotations:
        return m.with_tables(categories=cats, annotations=without(m.annotations, ids, "category_id"))
    return m.with_tables(categories=cats, annotations=_cleared(m.annotations, ids, "category_id"))


def remove_tracks(m: Manifest, ids: DataFrame, keep_annotations: bool = False) -> Manifest:
    trk = without(m.tracks, ids, "id")
    a = _cleared(m.annotations, ids, "track_id") if keep_annotations else without(m.annotations, ids, "track_id")
    return m.with_tables(tracks=trk, annotations=a)


def _cleared(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """``df`` with a pointer set to null where it is among ``ids``."""
    gone = ids.select(F.col(ids.columns[0]).alias(col), F.lit(True).alias("_gone")).distinct()
    out = df.join(gone, col, "left")
    return out.withColumn(col, F.when(F.col("_gone").isNull(), F.col(col))).select(*df.columns)


def remove_keypoints(m: Manifest, kp_ids: list[int]) -> Manifest:
    """Drop keypoints of the given categories from all annotations."""
    keep = F.filter("keypoints", lambda k: ~k["keypoint_category_id"].isin(kp_ids))
    return m.with_tables(annotations=m.annotations.withColumn("keypoints", keep))


def remove_keypoint_categories(m: Manifest, kp_ids: list[int], clean_annotations: bool = True) -> Manifest:
    kpc = m.keypoint_categories.where(~F.col("id").isin(kp_ids))
    kpc = kpc.withColumn("reflection_id", F.when(~F.col("reflection_id").isin(kp_ids), F.col("reflection_id")))
    out = m.with_tables(keypoint_categories=kpc)
    return remove_keypoints(out, kp_ids) if clean_annotations else out


def set_category(m: Manifest, annotation_id: int, category_id: int | None) -> Manifest:
    new = F.when(F.col("id") == annotation_id, F.lit(category_id).cast("long")).otherwise(F.col("category_id"))
    return m.with_tables(annotations=m.annotations.withColumn("category_id", new))


def clear(m: Manifest, images: bool = True) -> Manifest:
    """Without annotations, and without images unless told otherwise."""
    none = m.with_tables(annotations=m.annotations.limit(0))
    return none.with_tables(images=m.images.limit(0), videos=m.videos.limit(0)) if images else none


def rename_categories(m: Manifest, mapping: dict[str, str], merge: str = "update") -> Manifest:
    """Rename categories; those that end up with one name are merged.

    The merged category has the id of a category that had the name already, else
    the least id. With ``update`` its other attributes come from the last renamed
    category that has them, with ``ignore`` from the one that had the name, if any.
    """
    c = m.categories
    spark = c.sparkSession
    unknown = spark.createDataFrame([(k,) for k in mapping], "name string").join(c, "name", "left_anti")
    if mapping and not unknown.isEmpty():
        raise KeyError("a category to rename is not there")
    pairs = spark.createDataFrame(list(mapping.items()) or [("", "")], "name string, new string")
    r = c.join(F.broadcast(pairs), "name", "left").withColumn("to", F.coalesce("new", "name"))
    kept = F.min_by("id", F.struct(F.col("new").isNotNull(), F.col("id")))
    others = [x for x in c.columns if x not in ("id", "name")]
    if merge == "update":
        attrs = [F.max_by(x, F.when(F.col(x).isNotNull(), F.struct(F.col("new").isNotNull(), F.col("id")))).alias(x) for x in others]
    else:
        attrs = [F.max_by(x, F.when(F.col("new").isNull(), F.col("id"))).alias(x) for x in others]
    merged = r.groupBy("to").agg(kept.alias("kept"), *attrs)
    ids = r.join(merged.select("to", "kept"), "to").select("id", "kept")
    return m.with_tables(
        categories=merged.select(F.col("kept").alias("id"), F.col("to").alias("name"), *others).select(*c.columns),
        annotations=remap(m.annotations, ids.select("id", F.col("kept").alias("new")), "category_id"),
    )


def remap(df: DataFrame, pairs: DataFrame, col: str) -> DataFrame:
    """``df`` with a pointer replaced by rows ``id, new``; others stay."""
    p = pairs.select(F.col("id").alias(col), F.col("new").alias("_new"))
    return df.join(p, col, "left").withColumn(col, F.coalesce("_new", col)).select(*df.columns)


def renumber_categories(m: Manifest, start: int = 1, order: str | list[str] = "sort") -> Manifest:
    """Number categories from ``start`` by name, or by a list of names with the others behind in the order of ids."""
    c = m.categories
    if order == "sort":
        by: list[Column] = [F.col("name")]
    else:
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("name"))
        by = [F.when(place == 0, len(order) + 1).otherwise(place), F.col("id")]
    pairs = c.select("id", (F.row_number().over(Window.orderBy(*by)) - 1 + start).cast("long").alias("new"))
    return m.with_tables(
        categories=c.join(pairs, "id").withColumn("id", F.col("new")).select(*c.columns), annotations=remap(m.annotations, pairs, "category_id")
    )


def reroot(m: Manifest, new_root: str, old_prefix: str | None = None, new_prefix: str | None = None, absolute: bool = False) -> Manifest:
    """Rewrite all paths: replace a prefix, then make them absolute or relative to the new root."""

    def fixed(path: Column) -> Column:
        if old_prefix is not None:
            path = F.when(path.startswith(old_prefix), F.concat(F.lit(new_prefix or ""), F.substring(path, F.lit(len(old_prefix) + 1), F.length(path)))).otherwise(path)
        old = m.root.rstrip("/") + "/"
        whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(old), path))
        if absolute:
            return whole
        top = new_root.rstrip("/") + "/"
        return F.when(whole.startswith(top), F.substring(whole, F.lit(len(top) + 1), F.length(whole))).otherwise(whole)

    im = m.images.withColumns({
        "file_name": fixed(F.col("file_name")), "assets": F.transform("assets", lambda a: a.withField("file_name", fixed(a["file_name"])))
    })
    return Manifest(**{**m.tables(), "images": im}, root=new_root, info=m.info)


#: A last part of paths that so many files share tells nothing about where one of them went.
AMBIGUOUS = 100


def find_reroot(paths: DataFrame, there: DataFrame) -> DataFrame:
    """``old_prefix, new_prefix, fixed, missing``: replacements of a leading folder that make missing paths (``file_name``) exist, best first.

    Every missing path proposes: it is compared with the files that share its
    longest end (its last parts), unless that end is one of more than
    ``AMBIGUOUS`` files; what stands before the common end is the proposal. All
    proposals are counted over all missing paths below their old folder.
    """
    files = there.select("file_name").where("file_name is not null").distinct()
    lost = materialize(paths.select("file_name").where("file_name is not null").distinct().join(files, "file_name", "left_anti"), "missing")

    def ends(df: DataFrame, head: str) -> DataFrame:
        parts = F.split("file_name", "/")
        each = F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n")
        end = F.array_join(F.slice("parts", F.size("parts") - F.col("n") + 1, F.col("n")), "/")
        return df.withColumn("parts", parts).select("file_name", "parts", each).select("file_name", "n", end.alias("end"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("n")), "/").alias(head))

    names = lost.select(F.substring_index("file_name", "/", -1).alias("last")).distinct()
    near = files.withColumn("last", F.substring_index("file_name", "/", -1)).join(names, "last", "left_semi").select("file_name")
    new = ends(near, "new_prefix")
    few = new.groupBy("end").count().withColumnRenamed("count", "sharing")
    longest = ends(lost, "old_prefix").join(few, "end").groupBy("file_name").agg(F.max_by(F.struct("end", "old_prefix", "sharing"), "n").alias("b"))
    told = longest.where(F.col("b.sharing") <= AMBIGUOUS).select("b.end", "b.old_prefix").distinct()
    asked = materialize(told.join(new.select("end", "new_prefix"), "end").select("old_prefix", "new_prefix").where("old_prefix <> new_prefix").distinct(), "proposals")

    below = ends(lost, "old_prefix").select("old_prefix", F.col("end").alias("tail"))
    tried = below.join(asked, "old_prefix")
    tried = tried.select("old_prefix", "new_prefix", F.when(F.col("new_prefix") == "", F.col("tail")).otherwise(F.concat_ws("/", "new_prefix", "tail")).alias("file_name"))
    fixed = tried.join(files, "file_name", "left_semi").groupBy("old_prefix", "new_prefix").agg(F.count("*").alias("fixed"))
    return fixed.crossJoin(F.broadcast(lost.agg(F.count("*").alias("missing")))).orderBy(F.desc("fixed"), "old_prefix", "new_prefix")


def move_assets(m: Manifest, moves: list[tuple[str, str]]) -> Manifest:
    """Rewrite paths below moved folders; the first move that fits applies."""

    def moved(path: Column) -> Column:
        out = path
        for old, new in reversed(moves):
            old = old.rstrip("/")
            inside = (path == old) | path.startswith(old + "/")
            out = F.when(inside, F.concat(F.lit(new.rstrip("/")), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(out)
        return out

    return m.with_tables(images=m.images.withColumns({
        "file_name": moved(F.col("file_name")), "assets": F.transform("assets", lambda a: a.withField("file_name", moved(a["file_name"])))
    }))


def drop_empty(m: Manifest) -> Manifest:
    """Without images that have no annotation, and without videos that then have no image."""
    im = m.images.join(m.annotations.select(F.col("image_id").alias("id")), "id", "left_semi").select(*m.images.columns)
    vids = m.videos.join(im.select(F.col("video_id").alias("id")), "id", "left_semi").select(*m.videos.columns)
    return m.with_tables(images=im, videos=vids)


def modify_categories(m: Manifest, mapping: dict[str, str] | None = None, keep: list[str] | None = None, drop_images: bool = False, start: int | None = None) -> Manifest:
    """Rename, keep only some categories, drop images left empty, renumber: in that order."""
    if mapping:
        m = rename_categories(m, mapping)
    if keep is not None:
        m = remove_categories(m, m.categories.where(~F.col("name").isin(keep)).select("id"))
    if drop_images:
        m = drop_empty(m)
    return m if start is None else renumber_categories(m, start)


def conform(m: Manifest) -> DataFrame:
    """Annotations in the older interchange form: ``id, image_id, category_id, iscrowd, ignore, area, frame_id``."""
    from .select import frame_rank

    a = m.annotations.join(frame_rank(m.images).select(F.col("id").alias("image_id"), "frame_id"), "image_id", "left")
    return a.select(
        "id", "image_id", "category_id", F.coalesce("iscrowd", F.lit(0)).cast("long").alias("iscrowd"),
        (F.coalesce("weight", F.lit(1.0)) < 0.5).alias("ignore"), (F.col("bbox.w") * F.col("bbox.h")).alias("area"), "frame_id",
    )


def perturb(anns: DataFrame, seed: int = 0, box_noise: float = 5.0, n_categories: int = 1, swap: float = 0.1, drop: float = 0.1) -> DataFrame:
    """A noisy copy of annotations for trials, the same at every run: shifted boxes, swapped classes, dropped rows, random scores."""

    def draw(tag: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(tag)), F.lit(1_000_000)) / 1e6

    shift = lambda tag: (draw(tag) - 0.5) * 2 * box_noise
    box = F.struct((F.col("bbox.x") + shift("x")).alias("x"), (F.col("bbox.y") + shift("y")).alias("y"), F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"))
    cat = F.when(draw("c") < swap, F.col("category_id") % n_categories + 1).otherwise(F.col("category_id"))
    return anns.where(draw("d") >= drop).withColumns({"bbox": F.when(F.col("bbox").isNotNull(), box), "category_id": cat, "score": draw("s")})
