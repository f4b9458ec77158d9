"""Category hierarchies (C of the inventory) over regions, nations and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree as C
from ..sources import star
from ._register import registrar

QUERIES, SQL, query = registrar()

EDGES = """edges AS (
  SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION SELECT s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey), nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges),
up AS (SELECT node AS descendant, node AS ancestor, CAST(0 AS BIGINT) AS dist FROM nodes
  UNION ALL SELECT u.descendant, e.parent, u.dist + 1 FROM up u JOIN edges e ON e.child = u.ancestor)"""


def forest(spark, sf):
    n, r, s = (star.table(spark, sf, t) for t in ("nation", "region", "supplier"))
    a = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.col("r_name").alias("supercategory"))
    b = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_name").alias("name"), F.col("n_name").alias("supercategory"))
    return C.edges(a.unionByName(b))


def _sql(text: str) -> str:
    return f"WITH RECURSIVE {EDGES} {text}"


@query("SELECT DISTINCT name AS child, supercategory AS parent FROM categories WHERE name <> supercategory")
def c1_category_edges(spark, sf):
    return C.edges(star.manifest(spark, sf).categories)


@query(_sql("SELECT descendant AS node, string_agg(ancestor, ',' ORDER BY ancestor) AS ancestors FROM up GROUP BY 1"), tables=False)
def c4_ancestors(spark, sf):
    return C.ancestors(C.closure(forest(spark, sf))).select("node", F.array_join("ancestors", ",").alias("ancestors"))


@query(_sql("SELECT ancestor AS node, string_agg(descendant, ',' ORDER BY descendant) AS descendants FROM up WHERE dist > 0 GROUP BY 1"), tables=False)
def c5_descendants(spark, sf):
    return C.descendants(C.closure(forest(spark, sf), include_self=False)).select("node", F.array_join("descendants", ",").alias("descendants"))


@query(_sql("SELECT ancestor AS a, descendant AS b, dist FROM up UNION ALL SELECT descendant, ancestor, -dist FROM up WHERE dist > 0"), tables=False)
def c6_pairwise_distance(spark, sf):
    return C.signed_distance(C.closure(forest(spark, sf)))


@query(_sql("SELECT count(*) = 0 AS is_mutex FROM edges"), tables=False)
def c7_is_mutex(spark, sf):
    return spark.createDataFrame([(C.is_mutex(forest(spark, sf)),)], "is_mutex boolean")


@query(_sql("SELECT child, parent FROM edges WHERE child NOT LIKE '%1' AND parent NOT LIKE '%1' AND child NOT LIKE 'A%' AND parent NOT LIKE 'A%'"), tables=False)
def c8_subgraph(spark, sf):
    e = forest(spark, sf)
    return C.subgraph(e, C.nodes(e).where("node not like '%1' and node not like 'A%'"))


@query(_sql("""SELECT descendant AS child, arg_min(ancestor, dist) AS parent FROM up WHERE dist > 0 AND descendant IN (
  SELECT node FROM nodes WHERE node LIKE 'S%' OR node IN (SELECT r_name FROM region)) AND ancestor IN (
  SELECT node FROM nodes WHERE node LIKE 'S%' OR node IN (SELECT r_name FROM region)) GROUP BY 1"""), tables=False)
def c8_subgraph_closure(spark, sf):
    e = forest(spark, sf)
    keep = C.nodes(e).where("node like 'S%'").union(star.table(spark, sf, "region").select("r_name"))
    return C.subgraph(e, keep, through=True)


@query(_sql("SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nodes"), tables=False)
def c10_numbering(spark, sf):
    return C.numbering(forest(spark, sf))


@query(_sql("SELECT parent, string_agg(child, ',' ORDER BY child) AS children FROM edges GROUP BY 1"), tables=False)
def c12_siblings(spark, sf):
    return C.siblings(forest(spark, sf)).select("parent", F.array_join("children", ",").alias("children"))


@query(_sql("SELECT descendant AS node, arg_min(ancestor, dist) AS value FROM up WHERE ancestor IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT r_name FROM region) GROUP BY 1"), tables=False)
def c14_inherited_values(spark, sf):
    e = forest(spark, sf)
    some = star.table(spark, sf, "nation").where("n_nationkey % 2 = 0").select("n_name").union(star.table(spark, sf, "region").select("r_name")).toDF("node")
    return C.inherited(some.withColumn("value", F.col("node")), C.closure(e))


@query(_sql("SELECT node, 'root' AS kind FROM nodes WHERE node NOT IN (SELECT child FROM edges) UNION ALL SELECT node, 'leaf' FROM nodes WHERE node NOT IN (SELECT parent FROM edges)"), tables=False)
def r27_roots_and_leaves(spark, sf):
    e = forest(spark, sf)
    return C.roots(e).withColumn("kind", F.lit("root")).unionByName(C.leaves(e).withColumn("kind", F.lit("leaf")))
