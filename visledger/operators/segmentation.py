"""Scores of predicted against true masks, pixel by pixel without pixels.

The masks of an image cut its columns into stretches over which nothing changes;
truth, weight and score are found for each stretch, and its length counts. A tile
is a number of columns of an image, so a large image is the work of many tasks; a
task sweeps the tiles of many images together.
What no mask touches is the rest of the image: true of nothing, with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..storage import materialize
from . import curves, masks

#: What classes do that are not plain objects, by name (fixed values).
BEHAVIORS = {"ignore": "ignore", "Unknown": "ignore", "background": "background", "positive": "undistinguished", "negative": "negative"}
#: Pixel columns of a tile.
TILE = 128
#: The name under which all objects are one class.
SALIENT = ""

def behaviors(classes: DataFrame, table: dict | None = None) -> DataFrame:
    """``name, behavior`` of classes (``name``): ``foreground`` unless :data:`BEHAVIORS` says otherwise."""
    known = [(n, b) for n, b in (BEHAVIORS if table is None else table).items()]
    names = F.create_map(*[F.lit(x) for pair in known for x in pair]) if known else F.lit(None).cast("map<string,string>")
    return classes.select("name", F.coalesce(F.try_element_at(names, F.col("name")), F.lit("foreground")).alias("behavior"))


#: Behaviors of what is painted as an object: for all objects as one, and for each class.
_OBJECTS = {"all": ("foreground", "negative", "undistinguished"), "each": ("foreground", "negative")}
#: Behaviors that weigh nothing.
_VOID = {"all": ("ignore",), "each": ("ignore", "undistinguished")}


def _shares(true: DataFrame, kinds: tuple, name: str) -> DataFrame:
    """``gid, id, <name>``: how much more a pixel of each object weighs for all objects of an image to weigh alike."""
    some = true.where(F.col("behavior").isin(*kinds))
    if "tile" in some.columns:
        some = some.select("gid", "id", F.explode(F.arrays_zip("line", "start", "stop")).alias("r")).select("gid", "id", "r.*")
    own = masks.areas(some)
    whole = masks.areas(masks.union(some), ("gid",)).select("gid", F.col("area").alias("whole"))
    n = own.groupBy("gid").agg(F.count("*").alias("n"))
    return own.join(whole.join(n, "gid"), "gid").select("gid", "id", (F.col("whole") / F.col("n") / F.col("area")).alias(name))


def strokes(true: DataFrame, pred: DataFrame, balance: bool = False) -> DataFrame:
    """All runs with what they paint: ``gid, tile, line, start, stop, nth, cls, found, behavior, all, each, score``; line, start and stop are arrays.

    ``true`` is a run table, or strips of :data:`TILE` columns, with ``name,
    behavior, weight``, ``pred`` one with ``name, score``. ``all`` and ``each`` are the weights that an object gives
    its pixels, where all objects are one class and where each class is told:
    0 where it is void there; its own weight, if that is not 1 or balanced; else
    null, so that what lies below stays.
    """
    t = true
    for way, kinds in _OBJECTS.items():
        if balance:
            t = t.join(_shares(true, kinds, f"{way}_share"), ["gid", "id"], "left")
        share = F.coalesce(f"{way}_share", F.lit(1.0)) if balance else F.lit(1.0)
        weight = F.coalesce("weight", F.lit(1.0)) * share
        own = F.when(F.col("behavior").isin(*kinds) & (F.lit(balance) | (weight != 1)), weight)
        t = t.withColumn(way, F.when(F.col("behavior").isin(*_VOID[way]), 0.0).otherwise(own))
    def placed(df):
        if "tile" not in df.columns:
            df = df.withColumn("tile", F.floor(F.col("line") / TILE).cast("long")).withColumns({c: F.array(c) for c in ("line", "start", "stop")})
        return df

    at = ["gid", "tile", "line", "start", "stop", F.col("id").alias("nth"), F.col("name").alias("cls")]
    none = F.lit(None).cast("double")
    truth = placed(t).where("behavior <> 'background'").select(*at, F.lit(False).alias("found"), "behavior", "all", "each", F.lit(0.0).alias("score"))
    found = placed(pred).select(*at, F.lit(True).alias("found"), F.lit("").alias("behavior"), none.alias("all"), none.alias("each"), F.col("score").cast("double").alias("score"))
    return truth.unionByName(found)


def _sweep(table: pa.Table, by_image: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``gid, cls, is_true, pred_score, weight, n, found`` of whole tiles, in order of ``gid, tile, nth``.

    They are for all objects as one, for each class where it is said or found
    (``found``: a prediction is among them), both summed over images unless
    ``by_image``, and (null) for all that is covered of each image. A stretch is
    told by itself, so they are gone through a bounded number of coverings at a time.
    """
    gid, tile = table["gid"].to_numpy(), table["tile"].to_numpy()
    lists = {c: table[c].combine_chunks() for c in ("line", "start", "stop")}
    stroke = np.repeat(np.arange(len(gid)), pc.list_value_length(lists["line"]).to_numpy())
    line, start, stop = (a.flatten().to_numpy() for a in lists.values())
    first = np.flatnonzero((np.diff(gid, prepend=gid[:1] - 1) != 0) | (np.diff(tile, prepend=tile[:1] - 1) != 0))
    group = (np.cumsum(np.bincount(first, minlength=len(gid))) - 1)[stroke]
    line = line - np.minimum.reduceat(line, np.searchsorted(stroke, first))[group]
    across, down = int(line.max()).bit_length(), int(stop.max()).bit_length()
    column = (group << across | line) << down
    cuts, place = np.unique(np.concatenate([column + start, column + stop]), return_inverse=True)
    lo, hi = place[: len(line)], place[len(line) :]
    size, group_of = np.diff(cuts), cuts[:-1] >> across + down
    depth = np.cumsum(np.bincount(lo, minlength=len(cuts)) - np.bincount(hi, minlength=len(cuts)))[:-1]
    found, score = table["found"].to_numpy(), table["score"].to_numpy()
    is_in = lambda kinds: pc.is_in(table["behavior"], pa.array(kinds)).to_numpy() & ~found
    objects, told = is_in(_OBJECTS["all"]), found | is_in(_OBJECTS["each"])
    paints = [(way, is_in(_VOID[way]), table[way].to_numpy()) for way in _OBJECTS]
    levels, level = np.unique(np.append(score, 0.0), return_inverse=True)
    names = table["cls"].combine_chunks().dictionary_encode()
    cls, names = names.indices.to_numpy(), [SALIENT, *names.dictionary.to_pylist()]
    parts, bare = [], []
    for a, b in R.spans(depth, R.HELD):
        m, runs = b - a, np.flatnonzero((lo < b) & (hi > a))
        begin = np.maximum(lo[runs], a) - a
        n = np.minimum(hi[runs], b) - a - begin
        at = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
        by = np.repeat(stroke[runs], n)
        weights = {}
        for way, void, paint in paints:
            weights[way] = np.ones(m)
            weights[way][at[void[by]]] = 0.0
            own = (~void & ~np.isnan(paint))[by]
            weights[way][at[own]] = paint[by[own]]  # of several on a stretch the last one stays
        truth, best, covered = np.zeros(m, bool), np.full(m, level[-1]), depth[a:b] > 0
        truth[at[objects[by]]] = True
        is_found = found[by]
        np.maximum.at(best, at[is_found], level[by[is_found]])
        some = told[by]
        at, by, is_found = at[some], by[some], is_found[some]
        spot, of = np.unique(cls[by] * np.int64(m) + at, return_inverse=True)
        said, seen, top = np.zeros(len(spot), bool), np.zeros(len(spot), bool), np.full(len(spot), level[-1])
        said[of[~is_found]] = True
        seen[of[is_found]] = True
        np.maximum.at(top, of[is_found], level[by[is_found]])
        where, stretch = np.flatnonzero(covered), np.append(np.flatnonzero(covered), spot % m)
        is_true, height, seen = np.append(truth[where], said), np.append(best[where], top), np.append(np.zeros(len(where), bool), seen)
        name = np.append(np.zeros(len(where), np.int64), spot // m + 1)
        weight = np.append(weights["all"][where], weights["each"][spot % m]) * size[a + stretch]
        keys = ((group_of[a + stretch] if by_image else 0) * len(names) + name) * 2 + is_true
        parts.append(_summed(keys * len(levels) + height, weight, size[a + stretch], seen))
        bare.append(_summed(group_of[a + where], (weights["each"] * size[a:b])[where], size[a + where], np.zeros(len(where), bool)))
    keys, weight, n, seen = _summed(*(np.concatenate(c) for c in zip(*parts)))
    image, w_bare, n_bare, _ = _summed(*(np.concatenate(c) for c in zip(*bare)))
    gids, none, keyed = pa.array(gid[first]), np.zeros(len(image), np.int64), keys // len(levels)
    cols = [
        pa.concat_arrays([gids.take(pa.array(keyed // (2 * len(names)))) if by_image else pa.nulls(len(keys), pa.int64()), gids.take(pa.array(image))]),
        pa.concat_arrays([pa.array(names, pa.string()).take(pa.array(keyed // 2 % len(names))), pa.nulls(len(none), pa.string())]),
        pa.array(np.append(keyed % 2, none), pa.int64()), pa.array(np.append(levels[keys % len(levels)], none)),
        pa.array(np.append(weight, w_bare)), pa.array(np.append(n, n_bare).astype(np.int64)), pa.array(np.append(seen, none > 0)),
    ]
    yield pa.RecordBatch.from_arrays(cols, ["gid", "cls", "is_true", "pred_score", "weight", "n", "found"])


def _summed(keys: np.ndarray, weight: np.ndarray, n: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, with the sums of weights and numbers, and whether it was seen."""
    keys, of = np.unique(keys, return_inverse=True)
    return keys, np.bincount(of, weight, len(keys)), np.bincount(of, n, len(keys)), np.bincount(of, seen, len(keys)) > 0


def _swept(strokes: DataFrame, by_image: bool) -> DataFrame:
    """:func:`_sweep` of all tiles: those of a partition stand in order, and many are swept together."""

    def sweep(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            gid, tile = b.column("gid").to_numpy(), b.column("tile").to_numpy()
            last = np.flatnonzero((gid != gid[-1]) | (tile != tile[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last tile may go on in the next batch
            before = held[-1] if held else None
            ended = cut or before is not None and (before.column("gid")[-1].as_py() != gid[0] or before.column("tile")[-1].as_py() != tile[0])
            if ended:
                yield from _sweep(pa.Table.from_batches([*held, *([b.slice(0, cut)] if cut else [])]), by_image)
                held = []
            held.append(b.slice(cut))
        if held:
            yield from _sweep(pa.Table.from_batches(held), by_image)

    ordered = strokes.repartition("gid", "tile").sortWithinPartitions("gid", "tile", "nth")
    return ordered.mapInArrow(sweep, "gid long, cls string, is_true long, pred_score double, weight double, n long, found boolean")


def pixels(
    true: DataFrame, pred: DataFrame, images: DataFrame, balance: bool = False, bins: int | None = None, by_image: bool = False, classes: DataFrame | None = None,
) -> DataFrame:
    """Binary rows ``[gid,] cls, is_true, pred_score, weight`` of images (``id, width, height``); weight is the sum over pixels.

    ``cls`` is a class, or empty for all objects as one; a pixel's score is the
    largest of the predictions on it, 0 without one. The classes scored are those
    predicted anywhere (of ``classes``, by ``name``, if that is given) that are
    plain objects. With ``bins`` scores are raised to the next of so many even steps.
    """
    keys = ["gid"] if by_image else []
    swept = materialize(_swept(strokes(true, pred, balance), by_image), "pixels")
    size = images.select(F.col("id").alias("gid"), (F.col("width") * F.col("height")).alias("size"))
    covered = swept.where(F.col("cls").isNull()).groupBy("gid").agg(F.sum("n").alias("n"), F.sum("weight").alias("w"))
    rest = size.where("size > 0").join(covered, "gid", "left").groupBy(*keys).agg(
        F.sum(F.col("size") - F.coalesce("n", F.lit(0))).cast("double").alias("bare"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")
    )
    special = [n for n, b in BEHAVIORS.items() if b != "foreground"]
    scored = swept.where("found").select("cls").distinct().where(~F.col("cls").isin(special))
    if classes is not None:
        scored = scored.join(classes.select(F.col("name").alias("cls")).distinct(), "cls", "left_semi")
    scored = F.broadcast(materialize(scored, "pixel-classes"))  # a row for each class
    told = swept.join(scored, "cls", "left_semi")
    parts = told.groupBy(*keys, "cls").agg(F.sum("weight").alias("told"))
    zero = [F.lit(0).cast("long").alias("is_true"), F.lit(0.0).alias("pred_score")]
    untold = rest.crossJoin(scored).join(parts, [*keys, "cls"], "left")  # a row for each class (of each image)
    untold = untold.select(*keys, "cls", *zero, (F.col("bare") + F.col("w") - F.coalesce("told", F.lit(0.0))).alias("weight"))
    bare = rest.select(*keys, F.lit(SALIENT).alias("cls"), *zero, F.col("bare").alias("weight"))
    held = swept.where(F.col("cls") == SALIENT).unionByName(told).select(*keys, "cls", "is_true", "pred_score", "weight")
    every = held.unionByName(untold).unionByName(bare)
    if bins is not None:
        every = every.withColumn("pred_score", F.ceil(F.col("pred_score") * (bins - 1)) / (bins - 1))
    return every.groupBy(*keys, "cls", "is_true", "pred_score").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def evaluate(true: DataFrame, pred: DataFrame, images: DataFrame, balance: bool = False, bins: int | None = None, by_image: bool = False, classes: DataFrame | None = None) -> DataFrame:
    """``[gid,] cls, ap, auc, max_f1, best_thresh, positives, support`` of masks; the empty class is all objects as one."""
    keys = ["gid", "cls"] if by_image else ["cls"]
    c = materialize(curves.curve(pixels(true, pred, images, balance, bins, by_image, classes), keys), "pixel-curves")
    return curves.summary(c, keys)


def mean_scores(scores: DataFrame) -> DataFrame:
    """``classes, map, mauc``: means over the classes that have positives, without that of all objects."""
    some = scores.where((F.col("cls") != SALIENT) & (F.col("positives") > 0))
    return some.agg(F.count("*").alias("classes"), F.avg("ap").alias("map"), F.avg("auc").alias("mauc"))
