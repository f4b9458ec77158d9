"""From confusion vectors to curves and scores.

A *binary* table has rows ``<keys>, is_true, pred_score, weight``; a *curve* a
row for each key and distinct score with the counts at or above that score. At
the score -inf stands what was never predicted: there anything would be, so the
count of false positives is unbounded, and no score is read off there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .order import along

NEVER_SEEN = float("-inf")


def classless(cfsn: DataFrame, negatives: list[int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Whether there is a true object at all; true classes among ``negatives`` count as none."""
    none = [-1, *(negatives or [])]
    return cfsn.select(*(keys or []), (~F.coalesce(F.col("true"), F.lit(-2)).isin(none)).cast("long").alias("is_true"), F.col("score").alias("pred_score"), "weight")


def rest_classes(categories: DataFrame, ignore: tuple = ("ignore",)) -> DataFrame:
    """``cls``: the classes that are set against the rest: all but the background and ignored ones."""
    return categories.where(~F.coalesce("name", F.lit("")).isin("background", *ignore)).select(F.col("id").alias("cls"))


def one_vs_rest(cfsn: DataFrame, classes: DataFrame, keys: list[str] | None = None, approx: bool = False, probs: str | None = None) -> DataFrame:
    """Binary tables of every class in one: ``<keys>, cls, is_true, pred_score, weight, n``.

    Every vector counts for every class. Its score is known for the class that
    it predicts and is -inf for the others; these are not made one by one but
    are two rows a class, of ``n`` vectors: what all vectors weigh, less what
    the class has otherwise. With ``approx`` a vector that predicts another
    class scores ``(1 - score) / (classes - 1)``; with ``probs``, an array by
    class number, its own entry (-inf where nothing was predicted).
    """
    keys = keys or []
    classes = classes.select("cls").where("cls is not null").distinct()
    is_true = F.coalesce(F.col("true") == F.col("cls"), F.lit(False)).cast("long").alias("is_true")
    one = F.lit(1).cast("long").alias("n")
    if probs or approx:
        if probs:
            each = cfsn.select("*", F.posexplode(probs).alias("cls", "_p")).withColumn("cls", F.col("cls").cast("long"))
            score = F.when(F.col("pred") == -1, F.lit(NEVER_SEEN)).otherwise(F.col("_p"))
        else:
            known = [r["cls"] for r in classes.orderBy("cls").collect()]  # kinds, not data
            each = cfsn.withColumn("cls", F.explode(F.array(*[F.lit(c).cast("long") for c in known])))
            guess = (1 - F.col("score")) / F.lit(max(1, len(known) - 1))
            score = F.when(F.col("pred") == F.col("cls"), F.col("score")).when(F.col("pred") == -1, F.lit(NEVER_SEEN)).otherwise(guess)
        return each.join(F.broadcast(classes), "cls", "left_semi").select(*keys, "cls", is_true, score.alias("pred_score"), "weight", one)
    known = cfsn.withColumn("cls", F.col("pred")).join(F.broadcast(classes), "cls", "left_semi")
    known = known.select(*keys, "cls", is_true, F.col("score").alias("pred_score"), "weight", one)
    summed = cfsn.groupBy(*keys, "true", "pred").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))  # a row for each pair of classes
    apart = (F.col("true") >= 0) & ~F.col("true").eqNullSafe(F.col("pred"))
    part = lambda kind, cls: F.struct(F.lit(kind).alias("kind"), cls.alias("cls"))
    sides = F.array(part("all", F.lit(None).cast("long")), part("seen", F.col("pred")), part("missed", F.when(apart, F.col("true"))))
    sums = summed.select(*keys, "w", "n", F.explode(sides).alias("s")).select(*keys, "w", "n", "s.*")
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    by_class = materialize(sums.groupBy(*keys, "cls").agg(
        of("all", "w").alias("w"), of("all", "n").alias("m"), of("missed", "w").alias("w1"), of("missed", "n").alias("n1"), of("seen", "w").alias("w0"), of("seen", "n").alias("n0"),
    ), "class-sums")
    total = by_class.where("m is not null").select(*keys, "w", "m")
    rest = by_class.where("cls is not null").select(*keys, "cls", "w0", "n0", "w1", "n1")
    both = total.crossJoin(F.broadcast(classes)).join(rest, [*keys, "cls"], "left").na.fill(0)  # a row a class
    rest = F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("is_true"), F.col("w1").cast("double").alias("weight"), F.col("n1").alias("n")),
        F.struct(F.lit(0).cast("long").alias("is_true"), (F.col("w") - F.col("w0") - F.col("w1")).cast("double").alias("weight"), (F.col("m") - F.col("n0") - F.col("n1")).alias("n")),
    )).alias("r")
    unseen = both.select(*keys, "cls", rest).select(*keys, "cls", "r.is_true", F.lit(NEVER_SEEN).alias("pred_score"), "r.weight", "r.n").where("n > 0")
    return known.unionByName(unseen)


def _along(df: DataFrame, keys: list[str] | None, order: Column, sums: dict | None = None, maxes: dict | None = None, lags: dict | None = None) -> DataFrame:
    """Running sums, maxima and values of the row before, within each key, or over the whole table by ranges where there is none."""
    if not keys:
        return along(df, [order], sums, maxes, lags)
    by = Window.partitionBy(*keys).orderBy(order)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {n: F.sum(c).over(so_far) for n, c in (sums or {}).items()} | {n: F.max(c).over(so_far) for n, c in (maxes or {}).items()}
    return df.withColumns(new | {n: F.lag(c).over(by) for n, c in (lags or {}).items()})


def _with_total(df: DataFrame, keys: list[str] | None, **aggs: Column) -> DataFrame:
    """``df`` with aggregates over each key, or over all."""
    if keys:
        return df.withColumns({n: c.over(Window.partitionBy(*keys)) for n, c in aggs.items()})
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggs.items()])))  # one row


def _counted(g: DataFrame, keys: list[str]) -> DataFrame:
    """A curve of rows ``<keys>, thresh, t, f``: what lies at each threshold."""
    g = _with_total(g, keys, pos=F.sum("t"), neg=F.sum("f"))
    c = _along(g, keys, F.desc("thresh"), sums={"tp": "t", "all_fp": "f"})
    c = c.withColumn("fp", F.when(F.col("thresh") == NEVER_SEEN, F.lit(float("inf"))).otherwise(F.col("all_fp")))
    return c.select(*keys, "thresh", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn"), "pos", "neg")


def curve(binary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``<keys>, thresh, tp, fp, fn, tn, pos, neg`` for each distinct score, NaN as -inf.

    Scores are grouped first, so the running sums see distinct scores only;
    without keys these go by ranges of scores. At -inf ``fp`` is infinite.
    """
    keys = keys or []
    score = F.when(F.isnan("pred_score"), F.lit(NEVER_SEEN)).otherwise(F.col("pred_score"))
    w_true = F.col("weight") * F.col("is_true")
    g = binary.groupBy(*keys, score.alias("thresh")).agg(F.sum(w_true).alias("t"), F.sum(F.col("weight") - w_true).alias("f"))
    return _counted(g, keys)


#: The logarithms of the weights of padding fall evenly between these (fixed values).
PAD_LOG_WEIGHTS = (2.7, 0.01)


def stabilized(binary: DataFrame, keys: list[str], least: int = 7) -> DataFrame:
    """A binary table whose groups of fewer than ``least`` rows are padded to that many with calibrated rows of total weight 1, as a prior.

    Scores go evenly from the lowest to the highest (0 to 1 if all are
    probabilities), the upper half true, weights falling geometrically from low
    to high scores.
    """
    s = F.when(F.abs("pred_score") < float("inf"), F.col("pred_score"))
    small = binary.groupBy(*keys).agg(F.count("*").alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi")).where(F.col("n") < least)
    share = (F.coalesce("lo", F.lit(0.0)) >= 0) & (F.coalesce("hi", F.lit(1.0)) <= 1)
    small = small.withColumns({"lo": F.when(share, 0.0).otherwise(F.col("lo")), "hi": F.when(share, 1.0).otherwise(F.col("hi"))})
    top, low = PAD_LOG_WEIGHTS

    def padding(k: int) -> Column:
        falls = [math.exp(top + (low - top) * i / max(1, k - 1)) for i in range(k)]
        return F.array(*[
            F.struct(F.lit(int(i >= k // 2)).cast("long").alias("is_true"), F.lit(i / max(1, k - 1)).alias("at"), F.lit(x / sum(falls)).alias("weight"))
            for i, x in enumerate(falls)
        ])

    rows = F.get(F.array(*[padding(k) for k in range(least - 1, 0, -1)]), (F.col("n") - 1).cast("int"))
    pad = small.select(*keys, "lo", "hi", F.explode(rows).alias("r"))
    pad = pad.select(*keys, "r.is_true", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("r.at")).alias("pred_score"), "r.weight")
    return binary.select(*keys, "is_true", "pred_score", "weight").unionByName(pad)


def _ratio(a: Column, b: Column) -> Column:
    """A quotient, 0 where both are."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(c: DataFrame, keys: list[str] | None = None, monotonic: bool = True) -> DataFrame:
    """Derived columns of a curve: precision (its upper envelope unless told otherwise), recall and the rest.

    At the threshold -inf precision is 0 and ``fpr`` infinite, and what needs
    true negatives is undefined (NaN). ``fpr`` is relative to the false
    positives at the lowest finite threshold. Quotients of nothing are 0.
    """
    keys = keys or []
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    seen = F.col("thresh") > NEVER_SEEN
    undefined = lambda col: F.when(seen, col).otherwise(F.lit(float("nan")))
    c = _with_total(c, keys, last_fp=F.max(F.when(seen, fp)))
    denominator = F.when(F.coalesce("last_fp", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("last_fp"))
    c = c.withColumns({
        "ppv": F.when(seen, _ratio(tp, tp + fp)).otherwise(0.0), "tpr": _ratio(tp, tp + fn), "fpr": fp / denominator, "tnr": undefined(_ratio(tn, tn + fp)),
        "npv": undefined(_ratio(tn, tn + fn)), "acc": undefined(_ratio(tp + tn, tp + tn + fp + fn)),
    }).drop("last_fp")
    if monotonic:
        c = _along(c.withColumnRenamed("ppv", "own_ppv"), keys, F.asc("thresh"), maxes={"ppv": "own_ppv"}).drop("own_ppv")
    ppv, tpr, fpr, tnr, npv = (F.col(x) for x in ("ppv", "tpr", "fpr", "tnr", "npv"))
    fnr = F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.try_divide(F.col("fn"), F.col("tp") + F.col("fn")))
    return c.withColumns({
        "bm": tpr + tnr - 1, "mk": ppv + npv - 1, "f1": _ratio(2 * ppv * tpr, ppv + tpr), "g1": F.sqrt(ppv * tpr),
        "mcc": undefined(F.sqrt(ppv * tpr * tnr * npv) - F.sqrt((1 - ppv) * fnr * fpr * (1 - npv))),
    })


def _by(df: DataFrame, keys: list[str] | None):
    return df.groupBy(*(keys or []))


def average_precision(m: DataFrame, keys: list[str] | None = None, points: int = 101) -> DataFrame:
    """``<keys>, ap``: mean of the precision at evenly spaced recalls, 0 beyond the largest recall, null where nothing was predicted.

    A recall of ``i`` of ``points - 1`` parts is reached in whole numbers, ``tp *
    (points - 1) >= i * positives``; a row serves the recalls up to its own that
    its predecessor doesn't reach. 11 points give the measure of VOC 2007.
    """
    last = F.lit(points - 1)
    reach = F.floor(F.coalesce(F.try_divide(F.col("tp") * last, F.col("tp") + F.col("fn")), F.lit(-1.0)))
    r = _along(m.withColumn("reach", reach), keys, F.desc("thresh"), lags={"before": "reach"})
    gain = F.sum((F.col("reach") - F.coalesce("before", F.lit(-1))) * F.col("ppv")) / F.lit(float(points))
    return _by(r, keys).agg(F.when(F.max("thresh") > NEVER_SEEN, gain).alias("ap"))


def sklish_precision(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``<keys>, ap``: sum of precision times gain of recall; with monotone precision the area under the envelope, as VOC 2012 has it."""
    r = _along(m, keys, F.desc("thresh"), lags={"before": "tpr"})
    return _by(r, keys).agg(F.sum((F.col("tpr") - F.coalesce("before", F.lit(0.0))) * F.col("ppv")).alias("ap"))


def trapezoid_precision(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``<keys>, ap``: area under precision over recall by trapezoids, from precision 1 at recall 0; null where nothing was predicted."""
    r = _along(m, keys, F.desc("thresh"), lags={"before": "tpr", "level": "ppv"}).where(F.col("thresh") > NEVER_SEEN)
    area = (F.col("tpr") - F.coalesce("before", F.lit(0.0))) * (F.col("ppv") + F.coalesce("level", F.lit(1.0))) / 2
    return _kept_keys(m, _by(r, keys).agg(F.sum(area).alias("ap")), keys)


def _kept_keys(m: DataFrame, found: DataFrame, keys: list[str] | None) -> DataFrame:
    """All keys of ``m``, with null where ``found`` lacks them."""
    return m.select(*keys).distinct().join(found, keys, "left") if keys else found


def truncated(c: DataFrame, cutoff: float, keys: list[str] | None = None) -> DataFrame:
    """``<keys>, thresh, tp, fp, fn``: a curve up to ``cutoff`` false positives, extended to just so many at its last true positives."""
    keys = keys or []
    kept = c.where((F.col("thresh") > NEVER_SEEN) & (F.col("fp") <= cutoff))
    end = c.groupBy(*keys).agg(F.coalesce(F.max(F.when((F.col("thresh") > NEVER_SEEN) & (F.col("fp") <= cutoff), F.col("tp"))), F.lit(0.0)).alias("tp"), F.max(F.col("tp") + F.col("fn")).alias("pos"))
    end = end.select(*keys, F.lit(NEVER_SEEN).alias("thresh"), "tp", F.lit(float(cutoff)).alias("fp"), (F.col("pos") - F.col("tp")).alias("fn"))
    return kept.select(*keys, "thresh", "tp", "fp", "fn").unionByName(end)


def auc(c: DataFrame, keys: list[str] | None = None, cutoff: float | None = None) -> DataFrame:
    """``<keys>, auc``: trapezoids of recall over false positive rate between the finite thresholds of a curve.

    Where that rate is constant it is the largest difference of the two; null
    without positives or without predictions. With ``cutoff`` the curve is
    truncated (see :func:`truncated`), so large and small tables compare.
    """
    rows = truncated(c, cutoff, keys) if cutoff is not None else c.where(F.col("thresh") > NEVER_SEEN).select(*(keys or []), "thresh", "tp", "fp", "fn")
    r = _with_total(rows, keys, last_fp=F.max("fp"))
    fpr = F.col("fp") / F.when(F.col("last_fp") == 0, F.lit(1.0)).otherwise(F.col("last_fp"))
    r = r.select(*(keys or []), "thresh", fpr.alias("fpr"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"))
    r = _along(r, keys, F.desc("thresh"), lags={"px": "fpr", "py": "tpr"})
    area = F.sum((F.col("fpr") - F.col("px")) * (F.col("tpr") + F.col("py")) / 2)
    flat = F.max("fpr") == F.min("fpr")
    found = _by(r, keys).agg(F.when(flat, F.max(F.col("tpr") - F.col("fpr"))).otherwise(area).alias("auc"))
    return _kept_keys(c, found, keys)


def best_thresholds(m: DataFrame, keys: list[str] | None = None, names: tuple = ("mcc", "g1", "f1", "acc")) -> DataFrame:
    """``<keys>, metric, value, thresh``: the largest value of each metric at a finite threshold, at its highest threshold."""
    keys = keys or []
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")
    long = m.where(F.col("thresh") > NEVER_SEEN).select(*keys, "thresh", rows).select(*keys, "thresh", "m.*").where(~F.isnan("value"))
    return long.groupBy(*keys, "metric").agg(F.max(F.struct("value", "thresh")).alias("b")).select(*keys, "metric", "b.value", "b.thresh")


def summary(c: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``<keys>, ap, auc, max_f1, best_thresh, positives, support``: the figures of each curve in a row."""
    m = metrics(c, keys)
    best = best_thresholds(m, keys, ("f1",)).select(*(keys or []), F.col("value").alias("max_f1"), F.col("thresh").alias("best_thresh"))
    size = _by(c, keys).agg(F.max("pos").alias("positives"), F.max(F.col("pos") + F.col("neg")).alias("support"))
    out = size
    for part in (average_precision(m, keys), auc(c, keys), best):
        out = out.join(part, keys, "left") if keys else out.crossJoin(F.broadcast(part))
    return out.select(*(keys or []), "ap", "auc", "max_f1", "best_thresh", "positives", "support")


def combine(curves: DataFrame, keys: list[str] | None = None, digits: int | None = None, bins: int | None = None) -> DataFrame:
    """One curve of several (told apart by ``part``): steps between thresholds add up.

    Thresholds stay as they are, are rounded to ``digits``, or lowered to the
    edges of ``bins`` even bins of 0 to 1.
    """
    keys = keys or []
    w = Window.partitionBy(*keys, "part").orderBy(F.desc("thresh"))
    every = curves.withColumn("fp", F.when(F.col("thresh") == NEVER_SEEN, F.col("neg")).otherwise(F.col("fp")))
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))
    d = every.select(*keys, "part", "thresh", step("tp").alias("t"), step("fp").alias("f"))
    thresh = F.col("thresh") if digits is None else F.round("thresh", digits)
    if bins is not None:  # -inf stays
        thresh = F.when(F.col("thresh") == NEVER_SEEN, F.col("thresh")).otherwise(F.floor(F.col("thresh") * bins) / bins)
    return _counted(d.groupBy(*keys, thresh.alias("thresh")).agg(F.sum("t").alias("t"), F.sum("f").alias("f")), keys)


def report(matrix: DataFrame) -> DataFrame:
    """Per class of a confusion table ``true, pred, total``: ``cls, precision, recall, fpr, markedness, bookmaker, mcc, f1, support``."""
    t = matrix.groupBy(F.col("true").alias("cls")).agg(F.sum("total").alias("support"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("total")).otherwise(0)).alias("tp"))
    p = matrix.groupBy(F.col("pred").alias("cls")).agg(F.sum("total").alias("named"))
    n = matrix.agg(F.sum("total").alias("everything"))
    r = t.join(p, "cls", "full").crossJoin(F.broadcast(n)).na.fill(0)
    tp, fp, fn = F.col("tp"), F.col("named") - F.col("tp"), F.col("support") - F.col("tp")
    tn = F.col("everything") - tp - fp - fn
    ppv, tpr, tnr, npv = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp), _ratio(tn, tn + fn)
    r = r.withColumns({"precision": ppv, "recall": tpr, "fpr": 1 - tnr, "markedness": ppv + npv - 1, "bookmaker": tpr + tnr - 1})
    pr, rc = F.col("precision"), F.col("recall")
    mcc = F.sqrt(F.abs(F.col("markedness") * F.col("bookmaker"))) * F.signum(F.col("bookmaker"))
    return r.select("cls", "precision", "recall", "fpr", "markedness", "bookmaker", mcc.alias("mcc"), _ratio(2 * pr * rc, pr + rc).alias("f1"), "support")


def area_weights(cfsn: DataFrame, areas: DataFrame, low: float, high: float) -> DataFrame:
    """Vectors with weight 0 where the area of the true (else the predicted) box is outside of [low, high].

    ``areas`` has ``id, area`` of boxes by ``txs`` or ``pxs`` in columns ``kind`` ('t', 'p').
    """
    t = areas.where("kind = 't'").select(F.col("id").alias("txs"), F.col("area").alias("ta"))
    p = areas.where("kind = 'p'").select(F.col("id").alias("pxs"), F.col("area").alias("pa"))
    r = cfsn.join(t, "txs", "left").join(p, "pxs", "left")
    a = F.coalesce("ta", "pa")
    return r.withColumn("weight", F.when((a >= low) & (a <= high), F.col("weight")).otherwise(0.0)).select(*cfsn.columns)


def weights_in_ranges(sized: DataFrame, ranges: tuple) -> DataFrame:
    """``area, weight, n``: for each range ``name, low, high`` of areas the sum of weights of vectors with ``size`` and their number, in one pass over them.

    A vector outside of a range counts there with weight 0, as in :func:`area_weights`.
    """
    inside = lambda lo, hi: F.when(F.col("size").between(lo, hi), F.col("weight")).otherwise(0.0)
    sums = [F.struct(F.lit(n).alias("area"), F.sum(inside(lo, hi)).alias("weight"), F.count("*").alias("n")) for n, lo, hi in ranges]
    return sized.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def top_class(probs: DataFrame) -> DataFrame:
    """``id, cls``: the place of the largest of ``prob``, the first among equals."""
    return probs.select("id", (F.array_position("prob", F.array_max("prob")) - 1).cast("long").alias("cls"))
