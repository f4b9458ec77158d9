"""Embedding near-duplicates by a pivot-permutation index.

Each vector is described by its ``NEAREST`` nearest reference points in order.
Inverted lists hold the vectors that name a pivot; two vectors that share at
least ``SHARED`` pivots are candidates, met in the list of the least pivot that
they share, and verified by their cosine in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, hot_keys, materialize, skewed_join

NEAREST = 8
SHARED = 2
#: Reference points: four times the root of the number of vectors, within these bounds. The upper one (reached at a
#: thousand million vectors) bounds what is broadcast: so many vectors.
PIVOTS = (16, 1 << 17)
#: Vectors of a list that are compared at a time; longer lists are taken in pairs of such blocks.
BLOCK = 6144
#: Rows of a block whose cosines are held at a time.
STRIPE = 256


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``id, class`` (null class: a vector that links with nothing), and ``class, v, n`` of different vectors."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    usable = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))))
    rows = materialize(rows, "embed-rows")
    kinds = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    kinds = materialize(kinds.select(F.monotonically_increasing_id().alias("class"), "v", "n", "least"), "embed-classes")
    return rows, kinds


def _pivots(kinds: DataFrame, n: int) -> np.ndarray | None:
    """A bounded sample of unit vectors, by hash; all of the commonest length."""
    want = min(PIVOTS[1], max(PIVOTS[0], math.ceil(4 * math.sqrt(n))))
    rate = min(1.0, 1.2 * want / max(1, n) + 1e-12)
    draw = F.shiftrightunsigned(F.xxhash64("v"), 11) / float(1 << 53)
    drawn = kinds.where(draw < rate).select(F.transform("v", lambda x: x).alias("v")).limit(2 * want).toArrow().column("v")
    sizes = np.asarray(pc.list_value_length(drawn))
    if not len(sizes):
        return None
    size = int(np.bincount(sizes).argmax())
    kept = drawn.filter(pc.equal(pc.list_value_length(drawn), size)).combine_chunks()
    top = np.asarray(pc.list_flatten(kept), np.float64).reshape(-1, size)
    top = top[np.lexsort(top.T[::-1])]
    top = top[:: max(1, len(top) // want)][:want]
    top = top / np.abs(top).max(1, keepdims=True)
    return top / np.linalg.norm(top, axis=1, keepdims=True)


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def describe(kinds: DataFrame, pivots: np.ndarray | None) -> DataFrame:
    """Rows ``class, n, unit`` (doubles as bytes) and ``perm``: the nearest pivots in order.

    Vectors of another length than the pivots' are described by that length, so
    that they meet each other alone.
    """
    shared = kinds.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS[1] vectors

    def run(batches):
        p = shared.value
        for b in batches:
            vs = [np.array(v) for v in b.column(1).to_pylist()]
            units, perms = [], []
            for v in vs:
                u = _unit([v])[0]
                units.append(u.tobytes())
                if p is not None and len(u) == p.shape[1]:
                    d = p @ u
                    k = min(NEAREST, len(d))
                    near = np.argpartition(-d, k - 1)[:k]
                    perms.append(near[np.lexsort((near, -d[near]))].astype(np.int32).tolist())
                else:
                    perms.append([-len(u) * 2 - 1, -len(u) * 2 - 2])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(units, pa.binary()), pa.array(perms, pa.list_(pa.int32()))],
                ["class", "n", "unit", "perm"],
            )

    return kinds.select("class", "v", "n").mapInArrow(run, "class long, n long, unit binary, perm array<int>")


def _merge(label: np.ndarray, i: int, near: np.ndarray) -> None:
    """Give the groups of row ``i`` and of the rows ``near`` the least of their labels."""
    labels = label[near]
    low, high = min(int(labels.min()), int(label[i])), max(int(labels.max()), int(label[i]))
    if low != high:
        label[np.isin(label, np.append(labels, label[i]))] = low


def _compare(threshold: float, shared: int):
    """Verified links within a list, or between two of its blocks: counts of each vector and a spanning forest.

    Of the pairs whose cosine reaches the threshold, those count here that share
    ``shared`` pivots of which the least is the list's.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, one, two = (int(pdf[c].iloc[0]) for c in ("pivot", "one", "two"))
        pdf = pdf.sort_values(["block", "class"], kind="stable")
        x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        perms = np.stack([np.asarray(p, np.int32) for p in pdf["perm"]])
        cls, n, block = pdf["class"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy()
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
        links, label = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        right, right_perms = x[b].T, perms[b]
        for lo in range(0, len(a), STRIPE):
            rows = a[lo : lo + STRIPE]
            for i, near in zip(rows.tolist(), x[rows] @ right >= threshold):
                j = np.flatnonzero(near)
                j = j[b[j] != i]
                if not len(j):
                    continue
                same = perms[i][:, None, None] == right_perms[j].T[None, :, :]  # own pivots, theirs, candidates
                both = same.any(1)
                least = np.where(both, perms[i][:, None], np.iinfo(np.int32).max).min(0)
                j = j[(both.sum(0) >= shared) & (least == pivot)]
                if len(j):
                    links[i] += n[b[j]].sum()
                    if one != two:
                        links[b[j]] += n[i]
                    _merge(label, i, b[j])
        used = links > 0
        return pd.DataFrame({"class": cls[used], "links": links[used], "to": cls[label[used]]})

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shared: int = SHARED,
) -> DataFrame:
    """Links and components of vectors with a cosine of at least ``threshold``.

    Returns one row per input row: id, ``n_links`` (other rows linked directly),
    ``component_id`` (least id reachable, itself included) and ``kept`` (id equals
    component). Vectors that are null, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. Equal
    vectors are one class, linked with each other and compared once. A null id
    is passed over as a least one, and is kept only if alone. Pairs below the
    threshold are never linked; links may be missed where the descriptions share
    fewer than ``shared`` pivots (recall is measured in the tests). An empty
    table gives an empty one.

    A list longer than ``BLOCK`` is compared in pairs of blocks, each in a task
    of its own; a task returns counts and a spanning forest, not pairs.
    """
    rows, kinds = _classes(vectors, id_col, vector_col)
    pivots = _pivots(kinds, kinds.count())
    shared = min(shared, NEAREST, 2 if pivots is None else len(pivots))  # as many as any description has
    index = materialize(describe(kinds, pivots), "embed-index")
    lists = index.select("class", F.explode("perm").alias("pivot"))
    sizes = lists.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    posted = index.withColumn("pivot", F.explode("perm")).join(F.broadcast(sizes), "pivot")  # a row for each of PIVOTS at most, and each other length
    posted = posted.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    posted = posted.withColumn("other", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    found = posted.select("pivot", "one", "two", "block", "class", "n", "unit", "perm").groupBy("pivot", "one", "two").applyInPandas(
        _compare(threshold, shared), "class long, links long, to long"
    )
    found = materialize(found, "embed-links")
    forget(index)
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("class").alias("a"), F.col("to").alias("b")))
    of = comps.select(F.col("node").alias("class"), "root").join(kinds.select("class", "least"), "class")
    roots = materialize(of.groupBy("root").agg(F.min("least").alias("comp"), F.count("*").alias("n")), "embed-roots")
    comp = skewed_join(of.select("class", "root"), roots.select("root", "comp"), ["root"], hot_keys(roots, ["root"]), "class").select("class", "comp")
    known = kinds.join(counts, "class", "left").join(comp, "class", "left")
    known = known.select(
        F.col("v").alias("kv"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("comp", "least").alias("component_id"), "n",
    )
    known = materialize(known, "embed-known")
    hot = hot_keys(known, ["kv"])
    usable = skewed_join(rows.where("v is not null").withColumnRenamed("v", "kv"), known.drop("n"), ["kv"], hot, "id")
    alone = rows.where("v is null").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast(known.schema["component_id"].dataType).alias("component_id"))
    out = usable.select("id", "n_links", "component_id").unionByName(alone)
    comp = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
        F.coalesce(F.col("id") == comp, comp.isNull()).alias("kept"),
    )
