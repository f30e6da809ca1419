"""Traversal over edge DataFrames: directions, one hop, and simple paths.

Edges have columns `_id`, `_src`, `_dst` and properties; nodes are ids.  All of
it is joins and column comparisons, left to Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def directed(edges: DataFrame, direction: str, source: str = "_src", target: str = "_dst") -> DataFrame:
    """Edges as (from, to, rest): as they are ("out"), turned round ("in"), or
    one after the other ("both", in which a loop comes twice)."""
    rest = [F.col(f"`{c}`") for c in edges.columns if c not in (source, target)]
    along = edges.select(F.col(f"`{source}`").alias("from"), F.col(f"`{target}`").alias("to"), *rest)
    against = edges.select(F.col(f"`{target}`").alias("from"), F.col(f"`{source}`").alias("to"), *rest)
    if direction == "both":
        return along.unionByName(against)
    return {"out": along, "in": against}[direction]


def simple_paths(steps: DataFrame, low: int, high: int, starts: DataFrame | None = None, one_kind: bool = True) -> DataFrame | None:
    """(first, last, length, path) of paths that meet no node twice, one row a path.

    ``steps`` holds (from, to); parallel ones give paths of their own.  All
    lengths come out of one chain of joins, one for each hop: a path long enough
    goes on twice, as one that ends there and as one that looks for a next node.
    A path's nodes stay in columns that each new node is compared with, and
    filters on ``starts`` (n0) prune before the first hop.  Without `one_kind`
    every second node is of another table, and only nodes of one table are
    compared.  ``path`` lists the nodes' ids.  None: no such path.
    """
    if one_kind:
        steps = steps.where("from != to")
    low = max(1, low)
    if high < low:
        return None
    paths = steps.select(F.col("from").alias("n0"), F.col("to").alias("n1"))
    paths = paths if starts is None else paths.join(starts, "n0")
    paths = paths.select("n0", "n1", F.col("n1").alias("last"), F.lit(1).alias("length"))
    for hop in range(2, high + 1):
        fresh = _fresh(hop, range(hop - 1) if one_kind else range(hop % 2, hop - 1, 2))
        step = steps.select(F.col("from").alias("at"), F.col("to").alias(f"n{hop}"))
        if hop <= low:  # none may end yet
            paths = paths.join(step, paths["last"] == step["at"]).drop("at").where(fresh)
            paths = paths.withColumns({"last": F.col(f"n{hop}"), "length": F.lit(hop)})
            continue
        on = F.array(F.lit(True), F.lit(False))
        paths = paths.withColumn("on", F.explode(F.when(F.col("length") == hop - 1, on).otherwise(F.array(F.lit(False)))))
        step = step.withColumn("more", F.lit(True))
        met = paths.join(step, (F.col("last") == F.col("at")) & (F.col("on") == F.col("more")), "left")
        went = met.where(~F.col("on") | (F.col("more") & fresh))
        paths = went.withColumns({"last": F.coalesce(f"n{hop}", "last"), "length": F.when(F.col("on"), F.lit(hop)).otherwise(F.col("length"))}).drop("on", "at", "more")
    nodes = [F.col(f"n{k}").cast("string") for k in range(high + 1)]  # nulls past a path's end
    return paths.select(F.col("n0").alias("first"), "last", F.col("length").cast("long").alias("length"), F.concat_ws("->", *nodes).alias("path"))


def _fresh(hop: int, seen: range) -> Column:
    out = F.lit(True)
    for k in seen:
        out = out & (F.col(f"n{hop}") != F.col(f"n{k}"))
    return out
