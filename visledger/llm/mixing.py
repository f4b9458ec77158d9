"""Mixing sources to target weights by fitting a budget as a subset sum.

Each source has a budget of words. Whole rounds over a source come first; for
the rest, documents are counted by exact length, a like share of every length is
taken, and a bounded-knapsack dynamic program over the remaining counts meets
what is left of the budget. Which documents of a length are taken follows a
seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, with_row_key

#: Hash buckets of the documents of one length, so that no length is ranked in one task.
SALTS = 4096
#: Words that the first program covers, and its distinct lengths: the shortest ones, of which small sums are made.
PROGRAM_WORDS = 1 << 13
PROGRAM_LENGTHS = 256
#: Words that the programs over all lengths cover, tried in turn until the budget is met. What is within the
#: last is fitted exactly; a larger budget that none meets is also fitted as a whole, in so many units.
WIDER_WORDS = (1 << 17, 1 << 21, 1 << 24)
MOST_COPIES = 3


def word_count(col):
    """Number of runs of other characters than space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), share: float = 1.0, cap: float = MOST_COPIES) -> DataFrame:
    """Words that each source should give: rows ``source, source_size`` gain ``weight`` and ``target``.

    Sources in the order of code points, null last, weigh ``weights``, repeating,
    and share ``share`` of all sizes. A target stops at ``cap`` times its source's
    size; the excess is shared anew by weight until none is above. That is one
    level for all: with sources in the order of ``cap * size / weight``, the
    first whose share of what the earlier ones leave is within its cap sets it.
    """
    everything = Window.partitionBy()  # a row for each source
    order = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(order, (rank % len(weights) + 1).cast("int")))
    rows = rows.withColumns({"most": F.col("source_size") * F.lit(float(cap)), "total": F.sum("source_size").over(everything) * F.lit(share)})
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumns({"level": level, "place": F.row_number().over(by)})
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level")))
    rows = rows.withColumn("water", first.over(everything)["level"])
    target = F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _fill(size: np.ndarray, rest: np.ndarray, left: int) -> np.ndarray:
    """How many of each to take, at most ``rest``, so that the sum is the reachable one nearest ``left``, never above."""
    take = np.zeros(len(size), np.int64)
    items = []
    for i in np.flatnonzero((rest > 0) & (size <= left)):
        n, part = min(int(rest[i]), left // int(size[i])), 1
        while n > 0:  # counts as powers of two
            part = min(part, n)
            items.append((int(i), part))
            n -= part
            part *= 2
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    via = np.full(left + 1, -1, np.int32)
    top = 0
    for k, (i, n) in enumerate(items):
        step = int(size[i]) * n
        if step > left:
            continue
        if reach[left]:
            break
        top = min(left, top + step)
        fresh = np.flatnonzero(reach[: top - step + 1] & ~reach[step : top + 1]) + step
        via[fresh] = k
        reach[fresh] = True
    at = int(np.flatnonzero(reach).max())
    while at > 0:
        i, n = items[via[at]]
        take[i] += n
        at -= int(size[i]) * n
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes as near ``budget`` as can be found, never above.

    ``lengths`` are distinct and positive. An equal share of every count is
    rounded down; then long lengths are taken while more than ``PROGRAM_WORDS``
    is left; then the program takes the reachable sum nearest the rest. Where
    that leaves a gap, less is shared and wider programs over all lengths fit
    more: all of a budget up to the last of ``WIDER_WORDS`` times the lengths'
    common divisor, so that no sum is nearer. A larger budget that is still not
    met is fitted whole in units of its part by that number, lengths rounded
    up, so that each document taken leaves less than a unit.
    """
    order = np.argsort(lengths)
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    best = np.zeros(len(size), np.int64)
    if int((size * have).sum()) and budget > 0:
        unit = int(np.gcd.reduce(size[have > 0]))
        size = size // unit
        total = int((size * have).sum())
        budget = min(budget // unit, total)
        gap = budget
        for window in (PROGRAM_WORDS, *WIDER_WORDS):
            first = window == PROGRAM_WORDS
            shared = budget if first else max(0, budget - window)
            take = np.array([int(c) * shared // total for c in have], np.int64)
            left = budget - int((take * size).sum())
            usable = np.flatnonzero(have > take)[: PROGRAM_LENGTHS if first else None]
            reachable = min(window, int((size[usable] * (have - take)[usable]).sum()))
            for i in range(len(size) - 1, -1, -1):
                if left <= reachable:
                    break
                n = min(int(have[i] - take[i]), -(-(left - reachable) // int(size[i])), left // int(size[i]))
                take[i] += n
                left -= n * int(size[i])
            usable = np.flatnonzero((have > take) & (size <= left))[: PROGRAM_LENGTHS if first else None]
            if left <= window:
                take[usable] += _fill(size[usable], (have - take)[usable], left)
            left = budget - int((take * size).sum())
            if left < gap:
                best, gap = take, left
            if not gap or (not first and window >= budget):
                break
        if gap and budget > WIDER_WORDS[-1]:
            coarse = -(-budget // WIDER_WORDS[-1])
            take = _fill(-(-size // coarse), have, budget // coarse)
            left = budget - int((take * size).sum())
            take += _fill(size, have - take, min(left, WIDER_WORDS[-1]))
            if budget - int((take * size).sum()) < gap:
                best = take
    out = np.zeros(len(lengths), np.int64)
    out[order] = best
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole rounds and further documents of each length, for one source."""
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    goal = int(round(target))
    rounds = min(MOST_COPIES, goal // total) if total else 0
    pdf = pdf.sort_values("size")
    rest = goal - rounds * total if rounds < MOST_COPIES else 0
    more = np.zeros(len(pdf), np.int64)
    real = (pdf["size"] > 0).to_numpy()
    if rest > 0:
        more[real] = fit_budget(pdf["size"].to_numpy()[real], pdf["n"].to_numpy()[real], rest)
    return pdf.assign(rounds=rounds, more=more)[["source", "size", "source_size", "target", "rounds", "more"]]


def mix(
    docs: DataFrame, weights: tuple = (1, 2, 3), share: float = 1.0, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: str | None = None,
) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: the id column, ``size`` (words), ``source``,
    ``source_size``, ``target`` (words, of its source), ``copies`` (0 to 3) and
    ``taken`` (``copies * size``); with ``keep`` also that column. A null source is a source; null and empty
    texts have size 0, and are taken as often as their source goes round whole;
    rows without an id are told apart by their place in the input. Repeated rows are documents of their own,
    taken alike or not as their rank falls. An empty table gives an empty one.
    Reruns agree: choice follows a hash of seed, id, size and text.

    Only ids, sizes and sources are moved. Documents of a source and length are
    ranked in ``SALTS`` hash buckets, of which all but one are taken whole or not
    at all. One task plans a source from its counts by length.
    """
    more = [F.col(keep).alias("kept_col")] if keep else []
    rows = docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("told"), *more)
    alone = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    draw = F.xxhash64(F.lit(seed), "id", "size", "told", alone)
    rows = materialize(rows.withColumn("draw", draw).drop("told"), "mix-sizes").withColumn("salt", F.pmod("draw", F.lit(SALTS)))
    by_salt = materialize(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-salts")
    lengths = by_salt.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    sources = materialize(sources, "mix-sources").select(F.col("source").alias("s"), "source_size", "target")
    plan = lengths.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s").groupBy("source").applyInPandas(
        _plan, "source string, size long, source_size long, target double, rounds int, more long"
    )
    plan = materialize(plan, "mix-plan").select(F.col("source").alias("ps"), F.col("size").alias("pz"), "source_size", "target", "rounds", "more")
    earlier = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = by_salt.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    salts = salts.join(plan, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")))
    salts = salts.select(
        F.col("source").alias("ks"), F.col("size").alias("kz"), F.col("salt").alias("kk"), "source_size", "target", "rounds",
        F.greatest(F.lit(0), F.least("n", F.col("more") - F.col("before"))).alias("more"),
    )
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("draw", "id", *(["kept_col"] if keep else []))))
    chosen = ranked.join(
        salts, F.col("source").eqNullSafe(F.col("ks")) & (F.col("size") == F.col("kz")) & (F.col("salt") == F.col("kk"))
    )
    copies = F.col("rounds") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    return chosen.select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), *([F.col("kept_col").alias(keep)] if keep else []),
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` repeated as often as the mix takes each of them.

    Rows are told apart by numbers of their own, so rows that share an id, and
    those without one, are taken each as :func:`mix` says, and the words of the
    result are the sum of its ``taken``. Further columns pass through, whatever
    their names; an empty table gives an empty one.
    """
    rows, row = with_row_key(docs, "mix-input")
    copies = f"{row}_copies"
    taken = mix(rows, id_col=id_col, keep=row, **options).where("copies > 0").select(row, F.col("copies").alias(copies))
    taken = materialize(taken, "mix-taken")
    again = rows.join(maybe_broadcast(taken), row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return again.select(*docs.columns)
