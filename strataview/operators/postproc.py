"""Post-processing of a spec's node tables, and navigation in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataview.functions.hierarchy import ancestors_column, is_generic_column, parent_column, path_above
from strataview.operators.sketches import NODE


def tree(nodes: DataFrame) -> DataFrame:
    """All nodes of the type trees: the given ones and their (empty) supertypes; n, parent, children."""
    lifted = nodes.select("path", F.explode(ancestors_column(F.col("class"), with_self=True)).alias("class")).distinct()
    full = lifted.join(nodes.select(*NODE, "n"), NODE, "left").select(*NODE, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    full = full.withColumn("parent", parent_column(F.col("class")))
    counts = full.where("parent is not null").groupBy("path", F.col("parent").alias("class")).agg(F.count("*").alias("children"))
    return full.join(counts, NODE, "left").withColumn("children", F.coalesce("children", F.lit(0)))


def compact(nodes: DataFrame) -> DataFrame:
    """(path, class) of the nodes that stay: a type that absorbed nothing and has one subtype only goes."""
    full = tree(nodes)
    goes = (F.col("n") == 0) & (F.col("children") == 1) & ~is_generic_column(F.col("class"))
    return full.where(~goes).select(*NODE)


def lift(table: DataFrame, kept: DataFrame) -> DataFrame:
    """Each row once for its own node and once for every kept supertype."""
    rest = [c for c in table.columns if c not in NODE]
    lifted = table.select("path", F.explode(ancestors_column(F.col("class"), with_self=True)).alias("class"), *rest)
    return lifted.join(kept, NODE, "left_semi")


def lift_ext(table: DataFrame, kept: DataFrame) -> DataFrame:
    """Dictionaries and histograms propagate only from boolean to atom and from ``<<>>`` over binary to bitstring."""
    rest = [c for c in table.columns if c not in NODE]
    own = F.col("class")
    targets = F.when(own == "boolean", F.array(F.lit("boolean"), F.lit("atom"))).when(own == "<<>>", F.array(*map(F.lit, ("<<>>", "binary", "bitstring")))).when(own == "binary", F.array(F.lit("binary"), F.lit("bitstring"))).otherwise(F.array(own))
    lifted = table.select("path", F.explode(targets).alias("class"), *rest)
    return lifted.join(kept, NODE, "left_semi")


def join_up_nodes(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    return lift(nodes.select(*NODE, "n"), kept).groupBy(*NODE).agg(F.sum("n").alias("n"))


def rollup_counts(nodes: DataFrame) -> DataFrame:
    """Counts of every node and of all its supertypes."""
    lifted = nodes.select("path", F.explode(ancestors_column(F.col("class"), with_self=True)).alias("class"), "n")
    return lifted.groupBy(*NODE).agg(F.sum("n").alias("n"))


def sorted_alternatives(nodes: DataFrame) -> DataFrame:
    """Alternatives of each position by descending count, ties by class."""
    order = Window.partitionBy("path").orderBy(F.desc("n"), "class")
    return nodes.withColumn("position", F.row_number().over(order)).orderBy("path", "position")


def path_parent(path):
    """Path one level up: the record, list or map that holds the position."""
    return F.when(path == "$", F.lit(None)).when(path.rlike(r"\[\|?\]$") & ~path.endswith("\\]"), F.regexp_replace(path, r"\[\|?\]$", "")).otherwise(F.regexp_replace(path, r"\.(?:[^.\[\]\\]|\\.)*$", ""))


def children_of(nodes: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Direct children of a node: the parameters of a generic, else the subtypes at the same path."""
    if name is None or name in ("nonempty_list", "map", "improper_list") or name.startswith(("#", "tuple/")):
        return nodes.where(path_parent(F.col("path")) == path)
    return nodes.where((F.col("path") == path) & (parent_column(F.col("class")) == name))


def stack_of(nodes: DataFrame, path: str) -> DataFrame:
    """The nodes on the way from the root to ``path``."""
    steps, at = [], path
    while at is not None:
        steps.append(at)
        at = path_above(at)
    depth = F.array_position(F.array(*map(F.lit, reversed(steps))), F.col("path")) - 1
    return nodes.where(F.col("path").isin(steps)).withColumn("depth", depth.cast("int"))


def _placed(nodes: DataFrame, fields: list[str] | None) -> DataFrame:
    """Nodes with the ``place`` of their position below its parent: in the order of ``fields``, then by name."""
    order = [F.col("path")]
    if fields:
        at = F.array_position(F.array(*map(F.lit, fields)), F.col("path"))
        order = [F.when(at > 0, at).otherwise(F.lit(len(fields) + 1)), *order]
    return nodes.withColumn("place", F.dense_rank().over(Window.partitionBy(path_parent(F.col("path"))).orderBy(*order)))


def siblings_of(nodes: DataFrame, path: str, fields: list[str] | None = None) -> DataFrame:
    """The nodes of all positions that share the parent of ``path``, numbered (``place``).

    ``fields``: the paths of a record's fields in their order (a spec's metadata has them); other positions follow by name.
    """
    above = path_above(path)
    if above is None:
        return nodes.where(F.col("path") == path).withColumn("place", F.lit(1))
    return _placed(nodes.where(path_parent(F.col("path")) == above), fields)


def neighbour_of(nodes: DataFrame, path: str, by: int, fields: list[str] | None = None) -> DataFrame:
    """The nodes ``by`` places to the right (left, if negative) of ``path``; none beyond the last."""
    around = siblings_of(nodes, path, fields)
    here = around.where(F.col("path") == path).select(F.col("place").alias("__here")).distinct()  # one row
    return around.join(F.broadcast(here), F.col("place") == F.col("__here") + by).drop("place", "__here")


def nth_child(nodes: DataFrame, path: str, n: int, fields: list[str] | None = None) -> DataFrame:
    """The nodes of the n-th position (from 1) below ``path``."""
    return _placed(nodes.where(path_parent(F.col("path")) == path), fields).where(F.col("place") == n).drop("place")
