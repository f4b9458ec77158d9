"""Category hierarchies: closure, distances, induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(categories: DataFrame, parent_col: str = "supercategory") -> DataFrame:
    """``child, parent`` by name; a category that is its own parent has none."""
    e = categories.where(F.col(parent_col).isNotNull() & (F.col(parent_col) != F.col("name")))
    return e.select(F.col("name").alias("child"), F.col(parent_col).alias("parent")).distinct()


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()


def closure(e: DataFrame, include_self: bool = True, max_depth: int = 64) -> DataFrame:
    """``ancestor, descendant, dist`` of a forest, by one recursive query."""
    e.createOrReplaceTempView("_tree_edges")
    spark = e.sparkSession
    start = "SELECT node AS descendant, node AS ancestor, 0 AS dist FROM (SELECT child AS node FROM _tree_edges UNION SELECT parent FROM _tree_edges)"
    out = spark.sql(f"""
        WITH RECURSIVE up(descendant, ancestor, dist) MAX RECURSION LEVEL {max_depth} AS (
          {start} UNION ALL
          SELECT u.descendant, t.parent, u.dist + 1 FROM up u JOIN _tree_edges t ON t.child = u.ancestor)
        SELECT ancestor, descendant, CAST(dist AS BIGINT) AS dist FROM up""")
    return out if include_self else out.where("dist > 0")


def ancestors(c: DataFrame) -> DataFrame:
    """``node, ancestors`` (sorted), from a closure."""
    return c.groupBy(F.col("descendant").alias("node")).agg(F.array_sort(F.collect_set("ancestor")).alias("ancestors"))


def descendants(c: DataFrame) -> DataFrame:
    return c.groupBy(F.col("ancestor").alias("node")).agg(F.array_sort(F.collect_set("descendant")).alias("descendants"))


def signed_distance(c: DataFrame) -> DataFrame:
    """``a, b, dist`` of related pairs: positive down from a to b, negative up; unrelated pairs have no row."""
    down = c.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"), "dist")
    up = c.where("dist > 0").select(F.col("descendant").alias("a"), F.col("ancestor").alias("b"), (-F.col("dist")).alias("dist"))
    return down.unionByName(up)


def roots(e: DataFrame) -> DataFrame:
    return nodes(e).join(e.select(F.col("child").alias("node")), "node", "left_anti")


def leaves(e: DataFrame) -> DataFrame:
    return nodes(e).join(e.select(F.col("parent").alias("node")), "node", "left_anti")


def siblings(e: DataFrame) -> DataFrame:
    """``parent, children`` (sorted)."""
    return e.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def subgraph(e: DataFrame, keep: DataFrame, through: bool = False) -> DataFrame:
    """Edges among the nodes ``keep`` (column ``node``).

    With ``through``, a kept node hangs below its nearest kept ancestor, even if
    nodes between them are gone; implied edges are left out.
    """
    k = keep.select("node").distinct()
    if not through:
        return e.join(k.withColumnRenamed("node", "child"), "child", "left_semi").join(k.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")
    c = closure(e, include_self=False)
    c = c.join(k.withColumnRenamed("node", "descendant"), "descendant", "left_semi").join(k.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    return c.groupBy(F.col("descendant").alias("child")).agg(F.min_by("ancestor", "dist").alias("parent"))


def numbering(e: DataFrame) -> DataFrame:
    """``node, idx``: dense numbers from zero in the order of names."""
    return nodes(e).select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("long").alias("idx"))


def is_mutex(e: DataFrame) -> bool:
    """Whether no category is below another."""
    return e.isEmpty()


def inherited(values: DataFrame, c: DataFrame) -> DataFrame:
    """``node, value`` where the nearest ancestor with a value (itself first) gives it; ``values`` has ``node, value``."""
    v = values.where("value is not null").select(F.col("node").alias("ancestor"), "value")
    return c.join(v, "ancestor").groupBy(F.col("descendant").alias("node")).agg(F.min_by("value", "dist").alias("value"))


def render(rows: list[tuple[str, str]]) -> str:
    """A forest given as (child, parent) pairs, as indented text."""
    below: dict[str, list[str]] = {}
    for child, parent in rows:
        below.setdefault(parent, []).append(child)
    tops = sorted(set(below) - {c for c, _ in rows})
    lines: list[str] = []
    todo = [(t, 0) for t in reversed(tops)]
    while todo:
        name, depth = todo.pop()
        lines.append("  " * depth + name)
        todo += [(c, depth + 1) for c in sorted(below.get(name, ()), reverse=True)]
    return "\n".join(lines)


def to_categories(e: DataFrame) -> DataFrame:
    """``name, supercategory`` of every node of a forest ``child, parent``; roots have none."""
    return nodes(e).withColumnRenamed("node", "name").join(e.select(F.col("child").alias("name"), F.col("parent").alias("supercategory")), "name", "left")
