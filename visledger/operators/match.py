"""Matching of predicted to true boxes.

Detections are long tables, one row each: ``gid, id, cls, bbox, score, weight``.
The result is the table of confusion vectors, ``gid, true, pred, score, weight,
iou, txs, pxs, iou_thresh``, with -1 for what has no partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import intersection, iou
from ..manifest import Manifest
from ..storage import forget, materialize

CONFUSION = "gid bigint, true bigint, pred bigint, score double, weight double, iou double, txs bigint, pxs bigint, iou_thresh double"
NEVER_SEEN = float("-inf")


def detections(m: Manifest) -> DataFrame:
    """Annotations with a box as detections; score and weight are 1 where they are absent."""
    return m.annotations.where("bbox is not null").select(
        F.col("image_id").alias("gid"), "id", F.col("category_id").alias("cls"), "bbox",
        F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
    )


def associate(a: DataFrame, b: DataFrame, fallback: str | None = "id", valid_ids: list | None = None) -> DataFrame:
    """Pairs ``video, gid1, gid2`` of images of two manifests (``id, name, video`` each).

    Images of equally named videos match by name; images without a video, or
    whose video has no namesake, by name among themselves. A null name falls
    back to another column, or is an error without one.
    """
    if valid_ids is not None:
        a = a.where(F.col("id").isin(valid_ids))
    if fallback is None and not (a.where("name is null").isEmpty() and b.where("name is null").isEmpty()):
        raise ValueError("an image has no name and there is no fallback")

    def keyed(df: DataFrame, gid: str, shared: DataFrame) -> DataFrame:
        key = F.coalesce("name", F.concat(F.lit("\0"), F.col(fallback).cast("string"))) if fallback else F.col("name")
        return df.select(F.col("id").alias(gid), key.alias("key"), "video").join(shared, "video", "left").withColumn(
            "video", F.when(F.col("both").isNotNull(), F.col("video"))
        ).select(gid, "key", "video")

    shared = a.select("video").where("video is not null").distinct().intersect(b.select("video").distinct()).withColumn("both", F.lit(1))
    x, y = keyed(a, "gid1", shared), keyed(b, "gid2", shared).withColumnsRenamed({"key": "key2", "video": "video2"})
    return x.join(y, (F.col("key") == F.col("key2")) & F.col("video").eqNullSafe(F.col("video2"))).select("video", "gid1", "gid2")


def unify_classes(true_names: DataFrame, pred_names: DataFrame) -> DataFrame:
    """``name, cls``: class names of both sides (``name``) in one numbering, alike up to case and spaces; background is 0."""
    from pyspark.sql import Window

    from ..functions.scalars import normal_name

    every = pred_names.select("name", F.lit(0).alias("side")).union(true_names.select("name", F.lit(1).alias("side")))
    every = every.withColumn("folded", normal_name(F.col("name")))
    heads = every.groupBy("folded").agg(F.min(F.struct("side", "name")).alias("at"))
    first = F.when(F.col("folded") == "background", 0).otherwise(1)
    heads = heads.withColumn("cls", (F.row_number().over(Window.orderBy(first, "at.side", "folded")) - 1).cast("long"))
    return every.select("name", "folded").distinct().join(heads, "folded").select("name", "cls")


#: Boxes of a side from which an image is crowded: its pairs are sought by cells of a grid.
CROWDED = 1000
#: Predictions with candidates from which an image's assignment goes in rounds.
LONG_FOLD = 1000


def _pairs_by_cell(t: DataFrame, p: DataFrame, bias: float) -> DataFrame:
    """Pairs of boxes of an image that overlap, through grids of several cell sizes.

    A box belongs to the grid whose cells are as large as itself, where it lies
    in four cells at most; the grids grow fourfold. Of two boxes the smaller one
    is also entered in the grid of the larger. They meet in every cell they
    share and are a pair in that of the upper left corner of their overlap, so
    once. Work is in proportion to the boxes and to what lies close together.
    """
    def placed(df: DataFrame, box: str) -> DataFrame:
        side = F.greatest(F.col(f"{box}.w"), F.col(f"{box}.h")) + F.lit(bias)
        level = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(side, F.lit(1.0))))).cast("int")
        return df.where(F.col(box).isNotNull()).withColumn("level", level)

    t, p = placed(t, "tbox"), placed(p, "pbox")

    def entered(df: DataFrame, box: str, other: DataFrame, own: str, above) -> DataFrame:
        levels = other.groupBy("gid").agg(F.collect_set("level").alias("there"))  # a few sizes for each image
        at = F.concat(
            F.array(F.struct(F.lit(own).alias("grid"), F.col("level").alias("size"))),
            F.transform(F.filter("there", above), lambda k: F.struct(F.lit("pt".replace(own, "")).alias("grid"), k.alias("size"))),
        )
        rows = df.join(levels, "gid").withColumn("at", F.explode(at)).withColumn("cell", F.pow(F.lit(4.0), F.col("at.size")))

        def span(low, high):
            return F.sequence(F.floor(low / F.col("cell")), F.floor(F.greatest(low, high) / F.col("cell")))

        x, y = F.col(f"{box}.x"), F.col(f"{box}.y")
        rows = rows.withColumn("cx", F.explode(span(x, x + F.col(f"{box}.w") + bias)))
        return rows.withColumn("cy", F.explode(span(y, y + F.col(f"{box}.h") + bias))).drop("there", "level")

    a = entered(t, "tbox", p, "t", lambda k: k > F.col("level"))
    b = entered(p, "pbox", t, "p", lambda k: k >= F.col("level"))
    met = a.join(b.drop("cell"), ["gid", "at", "cx", "cy"])
    corner = lambda c: F.floor(F.greatest(F.col(f"tbox.{c}"), F.col(f"pbox.{c}")) / F.col("cell"))
    return met.where((corner("x") == F.col("cx")) & (corner("y") == F.col("cy"))).drop("at", "cell", "cx", "cy")


def candidates(
    true: DataFrame, pred: DataFrame, compat: str = "mutex", bias: float = 0.0, closure: DataFrame | None = None, crowded: int | None = CROWDED,
    carry: tuple = (),
) -> DataFrame:
    """Pairs that may match, with their IoU (above 0) and ``apart``: one equi-join on the image (and class), the rest a filter.

    ``compat``: ``mutex`` (same class), ``all`` (any), or ``ancestors`` (the true
    class is the predicted one or above it, by a table ``ancestor, descendant,
    dist``). ``apart`` is 0 for equal classes, the steps up for ancestors, else 1.
    Images with more than ``crowded`` boxes on both sides go by cells of a grid
    (see :func:`_pairs_by_cell`), which gives the same pairs; None: no image does.
    Columns ``carry`` of both sides stand in the pairs as ``t_..`` and ``p_..``.
    """
    more = {side: [F.col(c).alias(f"{side}_{c}") for c in carry] for side in "tp"}
    t = true.select("gid", F.col("id").alias("tx"), F.col("cls").alias("tcls"), F.col("bbox").alias("tbox"), F.col("weight").alias("tweight"), *more["t"])
    p = pred.select("gid", F.col("id").alias("px"), F.col("cls").alias("pcls"), F.col("bbox").alias("pbox"), *more["p"])
    many = None
    if crowded is not None:
        many = t.groupBy("gid").count().where(F.col("count") > crowded).select("gid").join(p.groupBy("gid").count().where(F.col("count") > crowded).select("gid"), "gid")
        many = None if many.isEmpty() else materialize(many, "crowded")
    apart = F.when(F.col("tcls").eqNullSafe(F.col("pcls")), 0).otherwise(1).cast("long")
    same = F.col("tcls") == F.col("pcls")
    few_t, few_p = (x if many is None else x.join(many, "gid", "left_anti") for x in (t, p))
    pairs = few_t.join(few_p, (few_t["gid"] == few_p["gid"]) & same).drop(few_p["gid"]) if compat == "mutex" else few_t.join(few_p, "gid")
    if many is not None:
        near = _pairs_by_cell(t.join(many, "gid", "left_semi"), p.join(many, "gid", "left_semi"), bias)
        pairs = pairs.unionByName(near.where(same) if compat == "mutex" else near)
    if compat == "ancestors":
        steps = F.col("dist") if "dist" in closure.columns else F.when(F.col("ancestor") == F.col("descendant"), 0).otherwise(1)
        up = closure.select(F.col("ancestor").alias("tcls"), F.col("descendant").alias("pcls"), steps.cast("long").alias("steps"))
        pairs, apart = pairs.join(up, ["tcls", "pcls"]), F.col("steps")
    overlap = iou(F.col("tbox"), F.col("pbox"), bias)
    return pairs.withColumn("iou", overlap).where("iou > 0").select("gid", "px", "tx", "tweight", "iou", apart.alias("apart"), *[f"{side}_{c}" for side in more for c in carry])


def _greedy(ordered: Column, reuse: bool = False) -> Column:
    """Fold over predictions in order: each takes the first of its candidates that is free, or with ``reuse`` least used."""
    zero = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<px:bigint,tx:bigint,iou:double>>").alias("out"))

    def choice(state, p):
        if not reuse:
            return F.get(F.filter(p["cands"], lambda c: ~F.array_contains(state["used"], c["tx"])), F.lit(0))
        counted = F.transform(
            p["cands"],
            lambda c: F.struct(F.size(F.filter(state["used"], lambda u: u == c["tx"])).alias("uses"), c["nth"].alias("nth"), c["tx"].alias("tx"), c["iou"].alias("iou")),
        )
        return F.array_min(counted)

    def step(state, p):
        best = choice(state, p)
        taken = F.struct(p["px"].alias("px"), best["tx"].alias("tx"), best["iou"].alias("iou"))
        return F.struct(
            F.when(best.isNotNull(), F.array_append(state["used"], best["tx"])).otherwise(state["used"]).alias("used"),
            F.when(best.isNotNull(), F.array_append(state["out"], taken)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(ordered, zero, step, lambda s: s["out"])


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """The greedy assignment of ``gid, iou_thresh, px, tx, iou, first, neg_score, neg_px`` by deferred acceptance.

    Every prediction asks for its best truth; a truth keeps the first of those
    that ask, in the order of scores, and all later ones give it up at once and
    ask for their next. All truths go by that one order, so what is left when
    nobody is turned away is what a fold in that order gives. No image is one row
    or one task; a round is two aggregations and a join of the pairs still open.
    """
    key, order = ["gid", "iou_thresh"], F.struct("neg_score", "neg_px")
    rows = materialize(pairs.withColumn("order", order), "rounds")
    while True:
        asked = rows.groupBy(*key, "px").agg(F.min(F.struct("first", (-F.col("iou")).alias("neg"), "tx", "order")).alias("b"))
        held = materialize(asked.groupBy(*key, F.col("b.tx").alias("tx")).agg(F.min(F.struct("b.order", "px", "b.neg")).alias("k"), F.count("*").alias("n")), "held")
        if held.where("n > 1").isEmpty():
            forget(rows)
            return held.select("gid", "k.px", "tx", (-F.col("k.neg")).alias("iou"), "iou_thresh")
        bound = held.select(*key, "tx", F.col("k.order").alias("held"))
        rest = rows.join(bound, [*key, "tx"], "left").where(F.col("held").isNull() | (F.col("order") <= F.col("held"))).drop("held")
        rest = materialize(rest, "rounds")
        forget(rows, held)
        rows = rest


def match(
    true: DataFrame, pred: DataFrame, pairs: DataFrame, thresholds: tuple = (0.5,), max_dets: int | None = None, prioritize: str = "iou",
    reuse: bool = False, long_fold: int | None = LONG_FOLD,
) -> DataFrame:
    """``gid, px, tx, iou, iou_thresh`` of the greedy assignment.

    Predictions go by descending score (the larger id first among equals) and
    take the free truth of the largest IoU above the threshold (the lesser id
    first among equals); with ``prioritize="class"`` the nearest class comes
    before the overlap. With ``reuse`` a truth may serve again, the least used
    one first. An image is one fold over its candidates; one with more than
    ``long_fold`` predictions that have candidates goes in rounds instead, with
    the same result (not with ``reuse``, whose choices depend on all before).
    """
    thr = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    first = F.col("apart") if prioritize == "class" else F.lit(0).cast("long")
    some = pairs.withColumn("iou_thresh", thr).where("iou > iou_thresh").withColumn("first", first)
    ranked = pred.select("gid", F.col("id").alias("px"), "score")
    if max_dets is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("gid").orderBy(F.desc("score"), F.desc("px"))
        ranked = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_dets).drop("r")
    some = some.join(ranked, ["gid", "px"]).select("gid", "iou_thresh", "px", "tx", "iou", "first", (-F.col("score")).alias("neg_score"), (-F.col("px")).alias("neg_px"))
    some = materialize(some, "pairs")
    long = None
    if long_fold is not None and not reuse:
        long = some.groupBy("gid", "iou_thresh").agg(F.approx_count_distinct("px").alias("n")).where(F.col("n") > long_fold).select("gid", "iou_thresh")
        long = None if long.isEmpty() else long
    short = some if long is None else some.join(long, ["gid", "iou_thresh"], "left_anti")
    cand = F.struct("first", (-F.col("iou")).alias("neg"), "tx")
    lists = short.groupBy("gid", "iou_thresh", "px", "neg_score", "neg_px").agg(F.array_sort(F.collect_list(cand)).alias("c"))
    cands = F.transform("c", lambda c, i: F.struct(i.alias("nth"), c["tx"].alias("tx"), (-c["neg"]).alias("iou")))
    ordered = F.array_sort(F.collect_list(F.struct("neg_score", "neg_px", "px", "cands")))
    out = lists.withColumn("cands", cands).groupBy("gid", "iou_thresh").agg(ordered.alias("ps"))
    out = out.select("gid", "iou_thresh", F.explode(_greedy(F.col("ps"), reuse)).alias("m")).select("gid", "m.px", "m.tx", "m.iou", "iou_thresh")
    return out if long is None else out.unionByName(_in_rounds(some.join(long, ["gid", "iou_thresh"], "left_semi")))


def confusion_vectors(
    true: DataFrame, pred: DataFrame, thresholds: tuple = (0.5,), compat: str = "mutex", bias: float = 0.0, bg_weight: float = 1.0,
    closure: DataFrame | None = None, max_dets: int | None = None, matched: DataFrame | None = None, sized: bool = False,
) -> DataFrame:
    """Confusion vectors of all images at every threshold; ``sized`` with the area of the true (else the predicted) box as ``size``."""
    area = [(F.col("bbox.w") * F.col("bbox.h")).alias("_area")] if sized else []
    if matched is None:
        matched = materialize(match(true, pred, candidates(true, pred, compat, bias, closure), thresholds, max_dets), "matched")
    thr = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("iou_thresh")
    p = pred.select("gid", F.col("id").alias("px"), F.col("cls").alias("pred"), "score", *area, thr)
    if max_dets is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("gid", "iou_thresh").orderBy(F.desc("score"), F.desc("px"))
        p = p.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_dets).drop("r")
    size = [F.coalesce("_tarea", "_area").alias("size")] if sized else []
    t = true.select("gid", F.col("id").alias("tx"), F.col("cls").alias("true"), F.col("weight").alias("tweight"), *[a.alias("_tarea") for a in area])
    preds = p.join(matched, ["gid", "px", "iou_thresh"], "left").join(t, ["gid", "tx"], "left")
    none = F.lit(-1).cast("long")
    rows = preds.select(
        "gid", F.when(F.col("tx").isNotNull(), F.col("true")).otherwise(none).alias("true"), "pred", "score",
        F.when(F.col("tx").isNotNull(), F.col("tweight")).otherwise(F.lit(bg_weight)).alias("weight"), F.coalesce("iou", F.lit(-1.0)).alias("iou"),
        F.coalesce("tx", none).alias("txs"), F.col("px").alias("pxs"), "iou_thresh", *size,
    )
    missed = true.select("gid", F.col("id").alias("tx"), F.col("cls").alias("true"), F.col("weight").alias("tweight"), *area, thr)
    missed = missed.join(matched.select("gid", "tx", "iou_thresh"), ["gid", "tx", "iou_thresh"], "left_anti")
    rest = missed.select(
        "gid", "true", none.alias("pred"), F.lit(NEVER_SEEN).alias("score"), F.col("tweight").alias("weight"), F.lit(-1.0).alias("iou"),
        F.col("tx").alias("txs"), none.alias("pxs"), "iou_thresh", *([F.col("_area").alias("size")] if sized else []),
    )
    return rows.unionByName(rest)


def roles(vectors: DataFrame) -> DataFrame:
    """Confusion vectors with their ``role``: true positive, confused (of another class), false positive or false negative."""
    t, p = F.col("true"), F.col("pred")
    role = F.when(t < 0, "false positive").when(p < 0, "false negative").when(t == p, "true positive").otherwise("confused")
    return vectors.withColumn("role", role)


def confusion_manifest(true: Manifest, pred: Manifest, vectors: DataFrame) -> Manifest:
    """The true manifest with an annotation for each true and each predicted box that says in ``extra`` which role it has, with what overlap and partner.

    Predicted boxes are numbered behind the true ones; images and classes are
    those of the true manifest.
    """
    r = roles(vectors)
    top = true.annotations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    note = lambda side, other: F.to_json(F.struct(F.lit(side).alias("side"), "role", F.when(F.col("iou") >= 0, F.col("iou")).alias("iou"), F.when(F.col(other) >= 0, F.col(other)).alias("partner")))
    t = true.annotations.drop("extra").join(r.where("txs >= 0").select(F.col("txs").alias("id"), note("true", "pxs").alias("extra")), "id")
    p = pred.annotations.drop("extra").join(r.where("pxs >= 0").select(F.col("pxs").alias("id"), note("pred", "txs").alias("extra")), "id")
    p = p.crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top") + 1).drop("top")  # one row
    cols = true.annotations.columns
    return true.with_tables(annotations=t.select(*cols).unionByName(p.select(*cols)))


def ignored(pred: DataFrame, regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``gid, px, covered``: predictions of which more than ``threshold`` lies in ignore regions (``gid, bbox``)."""
    r = regions.select("gid", F.col("bbox").alias("rbox"))
    part = F.least(F.lit(1.0), F.try_divide(intersection(F.col("bbox"), F.col("rbox")), F.col("bbox.w") * F.col("bbox.h")))
    return pred.join(r, "gid").groupBy("gid", F.col("id").alias("px")).agg(F.sum(part).alias("covered")).where(F.col("covered") > threshold)


def voc_match(true: DataFrame, pred: DataFrame, threshold: float = 0.5, bias: float = 1.0) -> DataFrame:
    """``px, hit``: each prediction looks at its best box of its class alone; the first by score gets it, later ones are false."""
    from pyspark.sql import Window

    pairs = candidates(true, pred, "mutex", bias)
    best = pairs.groupBy("gid", "px").agg(F.min_by(F.struct("tx", "iou"), F.struct(-F.col("iou"), F.col("tx"))).alias("b"))
    p = pred.select("gid", F.col("id").alias("px"), "score").join(best, ["gid", "px"], "left")
    near = F.coalesce(F.col("b.iou") >= threshold, F.lit(False))
    w = Window.partitionBy("gid", "b.tx", near).orderBy(F.desc("score"), F.desc("px"))
    return p.withColumn("near", near).withColumn("r", F.row_number().over(w)).select("gid", "px", (F.col("near") & (F.col("r") == 1)).alias("hit"))
