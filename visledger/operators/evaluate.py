"""A whole evaluation: thresholds, area ranges and classes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import curves, match

#: Areas of boxes: name, least, largest (fixed values).
AREA_RANGES = (("all", 0.0, 1e10), ("small", 0.0, 32.0**2), ("medium", 32.0**2, 96.0**2), ("large", 96.0**2, 1e10))


def evaluate(
    true: DataFrame, pred: DataFrame, classes: DataFrame, thresholds: tuple = (0.5,), ranges: tuple = AREA_RANGES, compat: str = "mutex", closure: DataFrame | None = None,
) -> DataFrame:
    """``iou_thresh, area, cls, ap, auc, max_f1, best_thresh, positives, support`` of predicted against true boxes.

    One matching serves all; a vector weighs nothing in a range that doesn't hold
    the area of its true (else its predicted) box. ``classes`` has the classes
    ``cls`` that are set against the rest; the row with a null class is that of
    objects against none, whatever their class.
    """
    v = match.confusion_vectors(true, pred, thresholds, compat, closure=closure, sized=True)
    v = materialize(v.select("iou_thresh", "true", "pred", "score", "weight", "size"), "vectors")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("area"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, lo, hi in ranges])).alias("r")
    weight = F.when(F.col("size").between(F.col("r.lo"), F.col("r.hi")), F.col("weight")).otherwise(0.0)
    v = v.select("iou_thresh", "true", "pred", "score", "weight", "size", each).select("iou_thresh", F.col("r.area").alias("area"), "true", "pred", "score", weight.alias("weight"))
    keys = ["iou_thresh", "area"]
    by_class = curves.one_vs_rest(v, classes, keys).drop("n")
    whole = curves.classless(v, keys=keys).withColumn("cls", F.lit(None).cast("long"))
    binary = by_class.unionByName(whole).withColumn("cls", F.coalesce("cls", F.lit(-1)))
    c = materialize(curves.curve(binary, [*keys, "cls"]), "curves")
    return curves.summary(c, [*keys, "cls"]).withColumn("cls", F.when(F.col("cls") != -1, F.col("cls")))
