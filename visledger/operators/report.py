"""One-vs-rest report of class probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .order import along

METRICS = ("auc", "ap", "kappa", "mcc", "f1", "brier")


def _binary(rows: DataFrame) -> DataFrame:
    """``cls, is_true, prob, other, rprob, weight``: each vector for each class, against the best of the other classes.

    Scores are brought to 0 to 1 by the least and largest of all; a class's
    probability is its share of a vector's scores, that of the others their best
    raw score by the same sum.
    """
    ends = rows.agg(F.min(F.array_min("prob")).alias("lo"), F.max(F.array_max("prob")).alias("hi"))
    scaled = lambda p: (p - F.col("lo")) / (F.col("hi") - F.col("lo"))
    r = rows.crossJoin(F.broadcast(ends))  # one row
    top = F.array_position("prob", F.array_max("prob")) - 1
    r = r.withColumns({"total": F.aggregate("prob", F.lit(0.0), lambda s, p: s + scaled(p)), "top": top, "best": F.array_max("prob")})
    r = r.withColumn("second", F.array_max(F.filter("prob", lambda p, i: i != F.col("top"))))
    each = r.select("true", "weight", "total", "top", "best", "second", "lo", "hi", F.posexplode("prob").alias("cls", "p"))
    other = F.when(F.col("cls") == F.col("top"), F.col("second")).otherwise(F.col("best"))
    each = each.select(
        F.col("cls").cast("long").alias("cls"), (F.col("cls") == F.col("true")).alias("is_true"), F.try_divide(scaled(F.col("p")), F.col("total")).alias("prob"),
        F.try_divide(other, F.col("total")).alias("other"), "total", "weight",
    )
    own = F.try_divide(F.when(F.col("is_true"), F.col("prob")).otherwise(F.col("other")), F.col("total"))
    return each.withColumn("rprob", F.greatest(F.lit(0.0), F.least(F.lit(1.0), own))).drop("total")


def _ranked(binary: DataFrame) -> DataFrame:
    """``cls, auc, ap``: means over the class and its complement, by tie-averaged ranks along ranges of scores.

    A positive is above the negatives of lower scores and half of those of its
    own; each class and side is one key, of any number of scores.
    """
    side = lambda k, yes, score: F.struct(F.lit(k).alias("side"), yes.alias("yes"), F.col(score).alias("score"))
    sides = F.explode(F.array(side(1, F.col("is_true"), "prob"), side(0, ~F.col("is_true"), "other"))).alias("s")
    long = binary.select("cls", "weight", sides).select("cls", "s.side", "s.score", "s.yes", "weight")
    w = lambda flag: F.sum(F.when(flag, F.col("weight")).otherwise(0.0))
    g = long.groupBy("cls", "side", "score").agg(w(F.col("yes")).alias("t"), w(~F.col("yes")).alias("f"))
    c = materialize(along(g, [F.desc("score")], sums={"tp": "t", "fp": "f"}, keys=["cls", "side"]), "ranked")
    total = c.groupBy("cls", "side").agg(F.sum("t").alias("pos"), F.sum("f").alias("neg"))
    c = c.join(F.broadcast(total), ["cls", "side"])  # two rows for each class
    above = F.col("t") * (F.col("neg") - F.col("fp") + F.col("f") / 2)
    gain = F.col("t") * F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    each = c.groupBy("cls", "side").agg(
        F.try_divide(F.sum(above), F.first("pos") * F.first("neg")).alias("auc"), F.coalesce(F.try_divide(F.sum(gain), F.first("pos")), F.lit(0.0)).alias("ap")
    )
    return each.groupBy("cls").agg(F.when(F.count("auc") == 2, F.avg("auc")).alias("auc"), F.avg("ap").alias("ap"))


def ovr_report(rows: DataFrame) -> DataFrame:
    """Per class of vectors ``true, prob (array by class number), weight``: ``cls, auc, ap, kappa, mcc, f1, brier, support, weight``.

    A vector is taken for a class if that is more probable than the best other
    one. ``auc`` and ``kappa`` are null where they are undefined, as without
    positives; ``weight`` is the class's share of all support.
    """
    b = materialize(_binary(rows), "one-vs-rest")
    named = F.col("prob") > F.col("other")
    w = lambda flag: F.sum(F.when(flag, F.col("weight")).otherwise(0.0))
    yes = F.col("is_true")
    counts = b.groupBy("cls").agg(
        w(yes & named).alias("tp"), w(~yes & named).alias("fp"), w(yes & ~named).alias("fn"), w(~yes & ~named).alias("tn"),
        F.sum(F.col("weight") * (1 - F.col("rprob")) * (1 - F.col("rprob"))).alias("loss"), F.sum("weight").alias("n"),
    )
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    chance = ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (n * n)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    m = counts.select(
        "cls", F.try_divide((tp + tn) / n - chance, 1 - chance).alias("kappa"), F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt(product)), F.lit(0.0)).alias("mcc"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), (F.col("loss") / n).alias("brier"), (tp + fn).alias("support"),
    )
    m = m.join(_ranked(b), "cls")
    all_ = m.agg(F.sum("support").alias("all_support"))
    return m.crossJoin(F.broadcast(all_)).select("cls", *METRICS, "support", F.try_divide("support", "all_support").alias("weight"))  # one row


def average(report: DataFrame) -> DataFrame:
    """One row: the metrics averaged by support, undefined ones left out, and all support."""
    return report.agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in METRICS], F.sum("support").alias("support"))


def brier(rows: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """``brier, n``: mean squared gap of a probability to what is true (0 or 1)."""
    gap = F.col(score) - F.col(truth)
    return rows.agg((F.sum(gap * gap) / F.count("*")).alias("brier"), F.count("*").alias("n"))
