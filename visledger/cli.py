"""Commands over manifests: ``python -m visledger.cli COMMAND SRC [--dst DST] ...``.

Sources are JSON documents, zips, bundles or Parquet views; a destination that
ends in ``.json`` or ``.zip`` is written as one document, any other as a view.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import TABLES, Manifest
from .operators import check, curves, edit, match, select, setops, shapes, stats
from .operators import evaluate as scoring
from .sources import documents
from .storage import remove


def save(m: Manifest, dst: str) -> None:
    if dst.endswith((".json", ".zip")):
        documents.write_document(m, dst)
    else:
        documents.write_view(m, dst)


def show(df: DataFrame) -> None:
    """Print a result, a JSON line a row; the driver holds one partition at a time."""
    for r in df.toJSON().toLocalIterator():
        print(r)


def evaluate(true: Manifest, pred: Manifest, thresholds: tuple = (0.5,), compat: str = "mutex", fallback: str | None = "file_name", ranges: tuple = scoring.AREA_RANGES) -> DataFrame:
    """Scores of predicted against true boxes, class by name (null: whatever the class); images are matched by name."""
    def side(m: Manifest) -> DataFrame:
        v = m.videos.select(F.col("id").alias("video_id"), F.col("name").alias("video"))
        return m.images.join(v, "video_id", "left").select("id", "name", "file_name", "video")

    pairs = match.associate(side(true), side(pred), fallback)
    classes = match.unify_classes(true.categories, pred.categories)

    def dets(m: Manifest, gid: str) -> DataFrame:
        ids = m.categories.select(F.col("id").alias("cls"), "name").join(classes.withColumnRenamed("cls", "new"), "name").select("cls", "new")
        d = match.detections(m).join(pairs.select(F.col(gid).alias("gid"), F.col("gid1").alias("pair")), "gid").join(ids, "cls", "left")
        return d.select(F.col("pair").alias("gid"), "id", F.col("new").alias("cls"), "bbox", "score", "weight")

    names = classes.groupBy("cls").agg(F.min("name").alias("name"))
    rest = curves.rest_classes(names.withColumnRenamed("cls", "id"))
    found = scoring.evaluate(dets(true, "gid1"), dets(pred, "gid2"), rest, thresholds, ranges, compat)
    return found.join(names, "cls", "left").drop("cls")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["stats", "info", "validate", "union", "subset", "split", "eval", "conform", "modify_categories", "reroot", "move_assets", "fixup", "move", "find_unregistered_images", "plot_stats", "toydata"])
    p.add_argument("src", nargs="+")
    p.add_argument("--dst", nargs="*", default=[])
    p.add_argument("--images", help="a condition on images")
    p.add_argument("--videos", help="a condition on videos")
    p.add_argument("--categories", nargs="*")
    p.add_argument("--channels", nargs="*")
    p.add_argument("--rename", type=json.loads, default={}, help="a JSON object of old and new names")
    p.add_argument("--start", type=int)
    p.add_argument("--drop-empty", action="store_true")
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--fold", type=int, default=0)
    p.add_argument("--root", default="")
    p.add_argument("--absolute", action="store_true")
    p.add_argument("--moves", nargs="*", default=[], help="OLD=NEW folders")
    p.add_argument("--thresholds", nargs="*", type=float, default=[0.5])
    p.add_argument("--rows", type=int, default=5)
    p.add_argument("--areas", action="store_true", help="also scores by ranges of areas and whatever the class")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("visledger").getOrCreate()
    if a.command == "toydata":  # the source is the key of a demo
        from .sources.demo import demo

        return save(demo(spark, a.src[0]), a.dst[0])
    sources = [documents.read_any(spark, s) for s in a.src]
    m = sources[0]
    if a.command == "stats":
        for s in sources:
            show(stats.basic_stats(s))
            show(stats.category_frequency(s))
            show(stats.extended_stats(s))
    elif a.command == "info":
        for name in TABLES:
            show(m.table(name).orderBy("id").limit(a.rows))
    elif a.command == "validate":
        show(check.validate(m))
    elif a.command == "eval":
        scores = evaluate(sources[0], sources[1], tuple(a.thresholds), ranges=scoring.AREA_RANGES if a.areas else scoring.AREA_RANGES[:1])
        show(scores if a.areas else scores.where("name is not null"))
    elif a.command == "conform":
        show(edit.conform(m)) if not a.dst else edit.conform(m).write.mode("overwrite").parquet(a.dst[0])
    elif a.command == "find_unregistered_images":
        from .operators import files

        root = a.root or m.root
        there = files.present(spark, root).select(F.concat(F.lit(root.rstrip("/") + "/"), "file_name").alias("path"))
        show(select.unregistered(select.paths(m.images, root), there).where("state = 'unregistered'").select("path"))
    elif a.command == "plot_stats":
        for name, df in (("images", stats.per_image_table(m)), ("annotations", stats.per_annotation_table(m)), ("polygons", shapes.polygon_shapes(m)), ("boxes", stats.box_stats(m))):
            df.write.mode("overwrite").parquet(f"{a.dst[0]}/{name}")
    elif a.command == "split":
        for part, dst in zip(setops.split(m, a.folds, a.fold), a.dst):
            save(part, dst)
    else:
        if a.command == "union":
            m = setops.union(sources)
        elif a.command == "subset":
            m = setops.subset(m, select.query_subset(m, a.images, a.videos, a.categories, a.channels))
        elif a.command == "modify_categories":
            m = edit.modify_categories(m, a.rename, a.categories, a.drop_empty, a.start)
        elif a.command == "reroot":
            m = edit.reroot(m, a.root, absolute=a.absolute)
        elif a.command == "move":  # paths stay what they point to
            m = edit.reroot(m, os.path.dirname(os.path.abspath(a.dst[0])))
        elif a.command == "move_assets":
            m = edit.move_assets(m, [tuple(x.split("=", 1)) for x in a.moves])
        elif a.command == "fixup":
            from .operators import files

            m = edit.drop_empty(files.drop_files(m, files.missing(m, files.present(spark, a.root or m.root))))
        save(m, a.dst[0])
        if a.command == "move":
            remove(spark, a.src[0])


if __name__ == "__main__":
    main()
