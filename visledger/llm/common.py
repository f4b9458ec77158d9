"""Helpers shared by the training-data operators: shared storage, joins and components."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, materialize, new_path, shared_dir  # noqa: F401  (used by the operators)

#: Rows below which a table of ids or keys may be broadcast (8 to 40 bytes a row).
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that a Python worker gets at a time (at least a row).
BATCH_BYTES = 4 << 20
#: A key with more than one in so many rows is hot; there are fewer such keys than this.
HOT_SHARE = 1000
#: Parts that the rows of a hot key are dealt to.
HOT_PARTS = 64


def open_shared(uri: str, mode: str):
    """Open a file of the shared storage inside a task, as a binary stream.

    Plain paths and ``file:`` are opened directly; other schemes through Arrow's
    file systems.
    """
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        path = unquote(parsed.path)
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def rename_shared(old: str, new: str) -> None:
    """Give a finished file its final name, replacing what a lost attempt left."""
    parsed = urlparse(old)
    if parsed.scheme in ("", "file"):
        os.replace(unquote(parsed.path), unquote(urlparse(new).path))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(old)
    store.move(path, fs.FileSystem.from_uri(new)[1])


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of ids is short enough to broadcast (reads at most rows + 1)."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a checked small table; otherwise leave the join to Spark."""
    return F.broadcast(df) if small_enough(df, rows) else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, for a pass through Python workers: texts may be long, so their session hands over ``BATCH_BYTES`` at a time unless it says otherwise."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def with_row_key(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written with a number for each row, unlike all others, and that column's name (one that ``df`` hasn't)."""
    name = "_row"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), tag), name


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The keys of ``counts`` with more than one in ``HOT_SHARE`` of all rows: fewer than ``HOT_SHARE``, whatever the input."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * F.lit(HOT_SHARE) > F.lit(total)).select(*keys)


def skewed_join(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few`` (one row a key) by ``keys``; rows of ``hot`` keys are dealt to ``HOT_PARTS`` parts by a hash of ``spread``.

    ``hot`` is a table of :func:`hot_keys`, so that it may be broadcast. Only the
    rows of ``few`` that have hot keys are repeated.
    """
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
    left = many.join(mark, keys, "left").withColumn("_part", part).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(mark, keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def _mixed(col):
    """A reversible shuffling of the bits of a long, so that no input order is the worst one."""
    for shift, right in ((13, False), (7, True), (17, False)) * 3:  # three times, for small ids to reach the high bits
        moved = F.shiftrightunsigned(col, shift) if right else F.shiftleft(col, shift)
        col = col.bitwiseXOR(moved)
    return col


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows ``a, b`` of longs.

    Each round, every vertex points to the least vertex among its neighbours and
    itself (ids are bit-mixed, so about half of all vertices vanish a round on
    any graph), pointers are doubled once, and edges are contracted. All state
    is in tables of the shared folder; nothing is collected but counts. Returns
    ``node, root`` for every vertex with an edge to another one; ``root`` is an
    arbitrary member of the component. Null ends and loops are ignored; repeated
    edges do not matter; an empty table gives an empty one.
    """
    todo = (
        edges.where("a is not null and b is not null and a <> b")
        .select(_mixed(F.col("a")).alias("a"), _mixed(F.col("b")).alias("b"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    )
    given = materialize(todo, "cc-edges")
    names = given.select(F.col("a").alias("node"), F.col("ra").alias("raw")).union(given.select("b", "rb")).distinct()
    names = materialize(names, "cc-names")
    labels, held = names.select("node", F.col("node").alias("root")), None
    todo, edges_held = given.select("a", "b"), given
    for _ in range(max_rounds):
        if todo.isEmpty():
            break
        both = todo.union(todo.select("b", "a"))
        point = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        first = materialize(point, "cc-point")
        up = first.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        point = materialize(first.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "cc-jump")
        pa = point.select(F.col("v").alias("a"), F.col("p").alias("na"))
        pb = point.select(F.col("v").alias("b"), F.col("p").alias("nb"))
        todo = materialize(
            todo.join(pa, "a").join(pb, "b").where("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(),
            "cc-edges",
        )
        step = point.select(F.col("v").alias("root"), F.col("p").alias("next"))
        labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-labels")
        forget(first, point, edges_held, held)
        held, edges_held = labels, todo
    else:
        raise RuntimeError("components did not settle")
    raw = names.select(F.col("node").alias("root"), F.col("raw").alias("root_raw"))
    found = labels.join(names, "node").join(raw, "root").select(F.col("raw").alias("node"), F.col("root_raw").alias("root"))
    found = materialize(found, "cc-found")
    forget(names, edges_held, held)
    return found


def ascii_lower_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.lower().split()
