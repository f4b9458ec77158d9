"""Numbers of rows and running sums in an order of the whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, materialize


def _ranged(df: DataFrame, order: list) -> tuple[DataFrame, list[Column]]:
    """Rows dealt by ranges of ``order``, sorted in each and written; ``_place`` has the range above bit 33, the row in it below."""
    order = [o if isinstance(o, Column) else F.col(o) for o in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(df, "unordered")  # ranges are sampled first, so the input is read twice
    dealt = held.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ordered")
    forget(held)
    return dealt.withColumn("_part", F.shiftright("_place", 33)), order


def number_rows(df: DataFrame, order: list, name: str = "nth", start: int = 1) -> DataFrame:
    """Rows numbered from ``start`` by ``order``, in which no two rows should be equal.

    Rows are dealt by ranges, sorted in each, and written; each range's numbers
    start after the counts of those before it.
    """
    rows, _ = _ranged(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    nth = F.col("_start") + F.col("_place") - F.shiftleft("_part", 33) + start
    return rows.join(F.broadcast(starts), "_part").select(*[c for c in df.columns if c != name], nth.cast("long").alias(name))


def along(df: DataFrame, order: list, sums: dict | None = None, maxes: dict | None = None, lags: dict | None = None, keys: list[str] | None = None) -> DataFrame:
    """``df`` with running sums, running maxima and values of the row before (dicts: new column to column) along ``order``, over the whole table or within each of ``keys``.

    What ranges hold comes first, a row for each range and key, then each row's
    within its range; so one key of any size is many tasks. Rows that are equal
    in ``order`` should have been grouped; keys aren't null. The first row has
    null for the row before.
    """
    keys = keys or []
    rows, _ = _ranged(df, [*keys, *order])
    parts = [("s", F.sum, sums or {}), ("m", F.max, maxes or {}), ("l", lambda c: F.max_by(F.struct(c), "_place"), lags or {})]
    aggs = [f(c).alias(f"_{kind}{i}") for kind, f, cols in parts for i, c in enumerate(cols.values())]
    every = Window.partitionBy(*keys) if keys else Window
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and key
    lead = {"s": lambda c: F.sum(c).over(before), "m": lambda c: F.max(c).over(before), "l": lambda c: F.last(c, ignorenulls=True).over(before)}
    heads = rows.groupBy("_part", *keys).agg(*aggs)
    heads = heads.select("_part", *keys, *[lead[kind](f"_{kind}{i}").alias(f"_{kind}{i}") for kind, _, cols in parts for i in range(len(cols))])
    place = Window.partitionBy("_part", *keys).orderBy("_place")
    within = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(place) == 1
    found = rows.join(heads if keys else F.broadcast(heads), ["_part", *keys])
    new = [(F.coalesce(f"_s{i}", F.lit(0)) + F.sum(c).over(within)).alias(n) for i, (n, c) in enumerate(parts[0][2].items())]
    new += [F.greatest(f"_m{i}", F.max(c).over(within)).alias(n) for i, (n, c) in enumerate(parts[1][2].items())]
    new += [F.when(first, F.col(f"_l{i}")[c]).otherwise(F.lag(c).over(place)).alias(n) for i, (n, c) in enumerate(parts[2][2].items())]
    return found.select(*df.columns, *new)
