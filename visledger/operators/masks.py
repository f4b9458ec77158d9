"""Masks of annotations as tables of runs.

A run table has rows ``gid, id, line, start, stop``: pixels ``start`` to ``stop -
1`` of the pixel column ``line`` of an image. Polygons are filled and run-length
codes read in Arrow batches, all masks of a batch together; areas, unions and
overlaps are joins and sums of runs. Strips are the same runs with a row for each
annotation and so many columns of its image, ``line, start, stop`` as arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import runs as R
from ..manifest import Manifest

#: Runs in a batch that a task hands on.
BATCH = 1 << 16
#: Pairs whose masks are held at a time.
SHARED = 1000


def _sized(m: Manifest, keep: tuple = ()) -> DataFrame:
    im = m.images.select(F.col("id").alias("image_id"), F.col("width").alias("w"), F.col("height").alias("h"))
    a = m.annotations.where("segmentation is not null").select("id", "image_id", "segmentation", *keep)
    return a.join(im, "image_id").where("w > 0 and h > 0").select("image_id", "id", "w", "h", "segmentation", *keep)


def _masks(b: pa.RecordBatch, text: str = "segmentation"):
    """The masks of a batch with ``w, h`` in pieces ``row, line, start, stop`` (:func:`.runs.of_segmentations`)."""
    return R.of_segmentations(*(b.column(c).to_pylist() for c in (text, "w", "h")))


def runs(m: Manifest) -> DataFrame:
    """The run table of all annotations with a segmentation, within their images. Images without a size have none."""

    def read(batches):
        for b in batches:
            gid, aid = (b.column(c).to_numpy(zero_copy_only=False) for c in ("image_id", "id"))
            for row, line, start, stop in _masks(b):
                for k in range(0, len(row), BATCH):
                    part = slice(k, k + BATCH)
                    cols = (gid[row[part]], aid[row[part]], line[part], start[part], stop[part])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["gid", "id", "line", "start", "stop"])

    return _sized(m).mapInArrow(read, "gid long, id long, line long, start long, stop long")


def strips(m: Manifest, width: int, keep: tuple = ()) -> DataFrame:
    """``gid, id, <keep>, tile, line, start, stop``: the runs of :func:`runs`, as arrays for each annotation and ``width`` columns; ``keep`` are columns of the annotations."""

    def read(batches):
        for b in batches:
            own = b.select(["image_id", "id", *keep])
            for row, line, start, stop in _masks(b):
                if not len(row):
                    continue
                tile = line // width
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(tile, prepend=-1) != 0))
                ends = pa.array(np.append(first, len(row)), pa.int32())
                told = own.take(pa.array(row[first]))
                lists = [pa.ListArray.from_arrays(ends, pa.array(c, pa.int64())) for c in (line, start, stop)]
                made = pa.RecordBatch.from_arrays([*told.columns, pa.array(tile[first]), *lists], ["gid", "id", *keep, "tile", "line", "start", "stop"])
                for k in range(0, len(first), BATCH // 8):
                    yield made.slice(k, BATCH // 8)

    sized = _sized(m, keep)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in sized.select(*keep).schema)
    return sized.mapInArrow(read, f"gid long, id long{kinds}, tile long, line array<long>, start array<long>, stop array<long>")


def measured(m: Manifest) -> DataFrame:
    """``gid, id, area, n_runs``: pixels and runs of each annotation that has any."""

    def read(batches):
        for b in batches:
            for row, _, start, stop in _masks(b):
                n = np.bincount(row, minlength=b.num_rows)
                area = np.bincount(row, stop - start, b.num_rows).astype(np.int64)
                some = np.flatnonzero(n)
                cols = [*(b.column(c).take(pa.array(some)) for c in ("image_id", "id")), pa.array(area[some]), pa.array(n[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["gid", "id", "area", "n_runs"])

    return _sized(m).mapInArrow(read, "gid long, id long, area long, n_runs long")


def encoded(m: Manifest) -> DataFrame:
    """``image_id, id, width, height, counts, area``: each annotation's mask as run-length text."""

    def write(batches):
        for b in batches:
            left = np.ones(b.num_rows, bool)
            w, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("w", "h"))

            def out(rows, at, found):
                n = len(rows)
                texts = R.to_texts(at, found, w[rows], h[rows])
                area = np.bincount(at, found[2] - found[1], n).astype(np.int64)
                cols = [*(b.column(c).take(pa.array(rows)) for c in ("image_id", "id", "w", "h")), pa.array(texts, pa.string()), pa.array(area)]
                return pa.RecordBatch.from_arrays(cols, ["image_id", "id", "width", "height", "counts", "area"])

            for row, *found in _masks(b):
                rows, at = np.unique(row, return_inverse=True)
                left[rows] = False
                if len(rows):
                    yield out(rows, at, found)
            if left.any():  # masks without a pixel
                yield out(np.flatnonzero(left), np.zeros(0, np.int64), R.NOTHING)

    return _sized(m).mapInArrow(write, "image_id long, id long, width long, height long, counts string, area long")


def with_encoded(m: Manifest) -> Manifest:
    """The manifest with every segmentation as run lengths of its image's size."""
    code = F.to_json(F.struct(F.array("height", "width").alias("size"), "counts"))
    e = encoded(m).select("id", code.alias("_code"))
    a = m.annotations.join(e, "id", "left").withColumn("segmentation", F.coalesce("_code", "segmentation")).select(*m.annotations.columns)
    return m.with_tables(annotations=a)


def counts(coded: DataFrame) -> DataFrame:
    """``coded`` (a run-length text ``counts``) with the array of lengths in its place."""
    others = [c for c in coded.columns if c != "counts"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*others).schema)

    def read(batches):
        for b in batches:
            texts = b.column("counts").to_pylist()
            found, at = R.from_texts([t or "" for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int64()), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), lists], [*others, "counts"])

    return coded.select(*others, "counts").mapInArrow(read, f"{kinds}, counts array<bigint>")


def polygon(points: Column) -> Column:
    """An array of points ``x, y`` as a segmentation in JSON."""
    return F.to_json(F.array(F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))))


def areas(table: DataFrame, keys: tuple = ("gid", "id")) -> DataFrame:
    """``<keys>, area``: pixels of disjoint runs by keys."""
    return table.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("area"))


def union(table: DataFrame, keys: tuple = ("gid",)) -> DataFrame:
    """``<keys>, line, start, stop``: the union of the runs of each key, disjoint and not touching.

    A run begins an island where it starts behind all that came before it in its column.
    """
    before = Window.partitionBy(*keys, "line").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    so_far = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int")
    r = table.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(so_far))
    return r.groupBy(*keys, "line", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def overlaps(true: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """``gid, tx, px, shared, iou`` of the masks of some pairs ``gid, tx, px``, as the overlap of their boxes gives them.

    ``true`` and ``pred`` are run tables. A pair's runs meet by column, so the
    work is in proportion to what the masks of a pair have in common; pairs
    without a shared pixel are left out.
    """
    t = true.select("gid", F.col("id").alias("tx"), "line", F.col("start").alias("ta"), F.col("stop").alias("tb"))
    p = pred.select(F.col("id").alias("px"), "line", F.col("start").alias("pa"), F.col("stop").alias("pb"))
    both = pairs.select("gid", "tx", "px").join(t.drop("gid"), "tx").join(p, ["px", "line"]).where("ta < pb and pa < tb")
    shared = both.groupBy("gid", "tx", "px").agg(F.sum(F.least("tb", "pb") - F.greatest("ta", "pa")).alias("shared"))
    a = areas(true, ("id",)).select(F.col("id").alias("tx"), F.col("area").alias("t_area"))
    b = areas(pred, ("id",)).select(F.col("id").alias("px"), F.col("area").alias("p_area"))
    found = shared.join(a, "tx").join(b, "px")
    return found.select("gid", "tx", "px", "shared", (F.col("shared") / (F.col("t_area") + F.col("p_area") - F.col("shared"))).alias("iou"))


def detections(m: Manifest) -> DataFrame:
    """Annotations with a box and a mask as :func:`.match.detections` has them, with ``segmentation`` and their image's ``w, h``."""
    own = _sized(m, ("category_id", "bbox", "score", "weight")).where("bbox is not null")
    score, weight = (F.coalesce(c, F.lit(1.0)).alias(c) for c in ("score", "weight"))
    return own.select(F.col("image_id").alias("gid"), "id", F.col("category_id").alias("cls"), "bbox", score, weight, "segmentation", "w", "h")


def shared(pairs: DataFrame) -> DataFrame:
    """``gid, tx, px, shared, iou`` as :func:`overlaps` has them, of pairs of :func:`detections` that carry ``segmentation, w, h`` of both sides.

    A row says all, so the masks of a pair meet where the pair is: no run is shuffled.
    """
    kept = pairs.select("gid", "tx", "px", F.col("t_w").alias("w"), F.col("t_h").alias("h"), "t_segmentation", "p_segmentation")

    def read(batches):
        for b in batches:
            n = b.num_rows
            area, both = [np.zeros(n, np.int64) for _ in range(2)], np.zeros(n, np.int64)
            for k in range(0, n, SHARED):
                held = []
                for side, text in enumerate(("t_segmentation", "p_segmentation")):
                    for found in _masks(b.slice(k, SHARED), text):
                        area[side] += np.bincount(found[0] + k, found[3] - found[2], n).astype(np.int64)
                        held.append(found)
                if held:
                    row, line, start, stop = (np.concatenate(c) for c in zip(*held))
                    across = int(line.max(initial=0)).bit_length()
                    united, start, stop = R.union(row << across | line, start, stop)
                    both += np.bincount((united >> across) + k, stop - start, n).astype(np.int64)
            common = area[0] + area[1] - both
            some = np.flatnonzero(common > 0)
            iou = common[some] / both[some]
            cols = [*(b.column(c).take(pa.array(some)) for c in ("gid", "tx", "px")), pa.array(common[some]), pa.array(iou)]
            yield pa.RecordBatch.from_arrays(cols, ["gid", "tx", "px", "shared", "iou"])

    return kept.mapInArrow(read, "gid long, tx long, px long, shared long, iou double")
