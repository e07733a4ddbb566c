"""Folder trees: closure, paths, sibling order.

A tree is an edge table (id, parent, ord, name).  Closures use a recursive query, so depth is not known in
advance; a path array guards against cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def tree(nodes: DataFrame) -> DataFrame:
    """Every node below a root with depth, path of ids, and sort key by (ord, name) at each level."""
    v = _view(nodes.select("id", "parent", "ord", "name"), "_tree_nodes")
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE t(id, parent, ord, name, depth, path, place) AS (
          SELECT id, parent, ord, name, 0, array(id), array(struct(ord, name, id)) FROM {v} WHERE parent IS NULL
          UNION ALL
          SELECT n.id, n.parent, n.ord, n.name, t.depth + 1, array_append(t.path, n.id), array_append(t.place, struct(n.ord, n.name, n.id))
          FROM t JOIN {v} n ON n.parent = t.id WHERE NOT array_contains(t.path, n.id))
        SELECT * FROM t""")


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, id, depth) of all pairs, the node itself included at depth 0; cycles end where they close."""
    v = _view(nodes.select("id", "parent"), "_closure_nodes")
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE t(ancestor, id, depth, path) AS (
          SELECT id, id, 0, array(id) FROM {v}
          UNION ALL
          SELECT t.ancestor, n.id, t.depth + 1, array_append(t.path, n.id) FROM t JOIN {v} n ON n.parent = t.id WHERE NOT array_contains(t.path, n.id))
        SELECT ancestor, id, depth FROM t""")


def ancestor_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-node path of each node (``path``)."""
    c = descendants(nodes)
    return c.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("ancestor").alias("a")))), lambda x: x["a"]).alias("path"))


def children(nodes: DataFrame, parent) -> DataFrame:
    """Direct children in sibling order; null asks for the roots."""
    return nodes.where(F.col("parent").eqNullSafe(F.lit(parent))).orderBy("ord", "name", "id")


def would_cycle(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (id, new_parent): ``cycle`` is true when the new parent lies below the node or is it."""
    c = descendants(nodes).select(F.col("ancestor").alias("id"), F.col("id").alias("new_parent"), F.lit(True).alias("cycle"))
    return moves.join(c, ["id", "new_parent"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def next_order(nodes: DataFrame, parent) -> DataFrame:
    """max + 1 among siblings, 0 for none."""
    return nodes.where(F.col("parent").eqNullSafe(F.lit(parent))).agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("ord"))


def reordered(nodes: DataFrame, wanted: Column) -> DataFrame:
    """Siblings renumbered from 0: those with a wanted place first, the rest in their old order."""
    w = Window.partitionBy("parent").orderBy(F.coalesce(wanted, F.lit(2**31 - 1)), "ord", "name", "id")
    return nodes.withColumn("ord", F.row_number().over(w) - 1)


def without_subtree(nodes: DataFrame, root) -> tuple[DataFrame, DataFrame]:
    """(nodes that stay, ids removed) when a node and all below it go."""
    gone = descendants(nodes).where(F.col("ancestor") == F.lit(root)).select("id")
    return nodes.join(gone, "id", "left_anti"), gone


def members_below(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct members of each node's subtree.  members: node, member."""
    c = descendants(nodes).select("ancestor", F.col("id").alias("node"))
    return c.join(members, "node").select(F.col("ancestor").alias("node"), "member").distinct()


def subtree_counts(nodes: DataFrame, members: DataFrame) -> DataFrame:
    return members_below(nodes, members).groupBy("node").agg(F.count("*").alias("n"))


def moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes with new parents; moves that would close a cycle are refused (kept as they were)."""
    ok = would_cycle(nodes, moves).where("NOT cycle").select("id", "new_parent", F.lit(True).alias("_m"))
    d = nodes.join(ok, "id", "left")
    return d.withColumn("parent", F.when(F.col("_m"), F.col("new_parent")).otherwise(F.col("parent"))).drop("new_parent", "_m")
