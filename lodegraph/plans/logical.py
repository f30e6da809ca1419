"""Logical plans: what a query computes, as a tree over named columns.

Columns are named `var.property`; `var._id` identifies a node.  A plan turns
into a lazy DataFrame; Catalyst optimises and Spark runs it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions.expressions import Aggregate as AggregateCall
from ..functions.expressions import Expr, Property, named
from ..operators.traverse import directed, simple_paths
from ..types import GraphType


class Plan:
    """A node of the tree.  `schema` maps output columns to property types."""

    def children(self) -> tuple[Plan, ...]:
        return ()

    def with_children(self, children: tuple[Plan, ...]) -> Plan:
        return self

    @property
    def schema(self) -> dict[str, GraphType]:
        raise NotImplementedError

    def frame(self, graph) -> DataFrame:
        """The DataFrame; `graph` holds the tables."""
        raise NotImplementedError

    def describe(self) -> str:
        raise NotImplementedError

    def tree(self, depth: int = 0) -> str:
        return "  " * depth + self.describe() + "\n" + "".join(c.tree(depth + 1) for c in self.children())


class _One(Plan):
    """A plan over one input."""

    def children(self):
        return (self.input,)

    def with_children(self, children):
        return replace(self, input=children[0])

    @property
    def schema(self):
        return self.input.schema


@dataclass(frozen=True)
class NodeScan(Plan):
    """All nodes of a table, with pushed filters and wanted columns."""

    table: object
    var: str
    filters: tuple[Expr, ...] = ()
    columns: tuple[str, ...] | None = None

    @property
    def schema(self):
        wanted = [c for c in self.table.columns if self.columns is None or c.name in self.columns]
        return {f"{self.var}._id": GraphType.INT64} | {f"{self.var}.{c.name}": c.type for c in wanted}

    def frame(self, graph):
        base = graph.nodes(self.table.name)
        read = {c.name for c in self.table.columns if self.columns is None or c.name in self.columns or any(f"{self.var}.{c.name}" in f.uses for f in self.filters)}
        out = base.select(F.col("_id").alias(f"{self.var}._id"), *[named(c.name).alias(f"{self.var}.{c.name}") for c in self.table.columns if c.name in read])
        for f in self.filters:
            out = out.where(f.keeps())
        return out.select(*[named(k) for k in self.schema])

    def describe(self):
        return f"NodeScan: {self.table.name} as {self.var}" + "".join(f" [{f}]" for f in self.filters)


@dataclass(frozen=True)
class RelScan(Plan):
    """All relationships of a table."""

    table: object
    var: str = "_rel"

    @property
    def schema(self):
        hidden = {f"{self.var}.{k}": GraphType.INT64 for k in ("_id", "_src", "_dst")}
        return hidden | {f"{self.var}.{c.name}": c.type for c in self.table.columns}

    def frame(self, graph):
        return _edges(graph, self.table, self.var)

    def describe(self):
        return f"RelScan: {self.table.name} as {self.var}"


def _edges(graph, table, var: str) -> DataFrame:
    base = graph.rels(table.name)
    return base.select(*[F.col(k).alias(f"{var}.{k}") for k in ("_id", "_src", "_dst")], *[named(c.name).alias(f"{var}.{c.name}") for c in table.columns])


def _directed(graph, table, var: str, direction: str) -> DataFrame:
    """Edges as `var.from`, `var.to`, `var._id` and properties."""
    out = directed(_edges(graph, table, var), direction, f"{var}._src", f"{var}._dst")
    return out.withColumnsRenamed({"from": f"{var}.from", "to": f"{var}.to"})


def _told_by_edges(plan: Plan, graph, rel) -> bool:
    """Do the edges' ends tell all that is read of these nodes?  They do where no
    edge dangles and nothing is read but a key that serves as the id."""
    if not (isinstance(plan, NodeScan) and plan.columns is not None and graph.is_whole(rel.name)):
        return False
    read = {f"{plan.var}.{c}" for c in plan.columns}.union(*(f.uses for f in plan.filters))
    return read <= ({f"{plan.var}.{plan.table.primary_key[0]}"} if graph.key_is_id(plan.table.name) else set())


def _with_ends(frame: DataFrame, plan: NodeScan, var: str, end: str) -> DataFrame:
    """The columns of nodes that the edges tell of, and the nodes' filters."""
    frame = frame.withColumn(f"{var}._id", named(end))
    if plan.columns or plan.filters:
        frame = frame.withColumn(f"{var}.{plan.table.primary_key[0]}", named(end))
    for f in plan.filters:
        frame = frame.where(f.keeps())
    return frame


@dataclass(frozen=True)
class Extend(Plan):
    """Follow one relationship from the input's source to the target's nodes.

    A side of which the edges' end points tell all that is read is not joined.
    """

    input: Plan
    target: Plan
    rel: object
    source_var: str
    rel_var: str
    target_var: str
    direction: str = "out"

    def children(self):
        return self.input, self.target

    def with_children(self, children):
        return replace(self, input=children[0], target=children[1])

    @property
    def schema(self):
        edge = {f"{self.rel_var}._id": GraphType.INT64} | {f"{self.rel_var}.{c.name}": c.type for c in self.rel.columns}
        return self.input.schema | edge | self.target.schema

    def frame(self, graph):
        r = self.rel_var
        out = _directed(graph, self.rel, r, self.direction)
        for plan, var, end in ((self.input, self.source_var, "from"), (self.target, self.target_var, "to")):
            if _told_by_edges(plan, graph, self.rel):
                out = _with_ends(out, plan, var, f"{r}.{end}")
            else:
                nodes = plan.frame(graph)
                out = nodes.join(out, nodes[f"`{var}._id`"] == out[f"`{r}.{end}`"])
        return out.select(*[named(k) for k in self.schema])

    def describe(self):
        return f"Extend: {self.rel.name} ({self.source_var} -> {self.target_var}) {_DIRECTION[self.direction]}"


_DIRECTION = {"out": "Forward", "in": "Backward", "both": "Both"}


@dataclass(frozen=True)
class PathExpand(Plan):
    """Paths of low to high relationships, no node twice, a row for each path.

    The walk sees the edges' end points only, and starts at the nodes that pass
    the source's filters.
    """

    input: Plan
    target: Plan
    rel: object
    source_var: str
    path_var: str
    target_var: str
    low: int
    high: int
    direction: str = "out"

    def children(self):
        return self.input, self.target

    def with_children(self, children):
        return replace(self, input=children[0], target=children[1])

    @property
    def schema(self):
        return self.input.schema | {f"{self.path_var}.length": GraphType.INT64, f"{self.path_var}.path": GraphType.STRING} | self.target.schema

    def frame(self, graph):
        steps = directed(graph.rels(self.rel.name).select("_src", "_dst"), self.direction)
        # a node of another table is another node, whatever its id
        one_kind = self.rel.source == self.rel.target
        high = self.high if one_kind or self.direction == "both" else min(self.high, 1)
        source, target = self.input, self.target
        # the walk carries ids only; properties join at its two ends
        starts = None
        if not (isinstance(source, NodeScan) and not source.filters and graph.is_whole(self.rel.name)):
            scan = isinstance(source, NodeScan)  # whose ids are unique
            ids = (replace(source, columns=()) if scan else source).frame(graph).select(named(f"{self.source_var}._id").alias("n0"))
            starts = ids if scan else ids.distinct()
        found = simple_paths(steps, self.low, high, starts, one_kind)
        if found is None:
            found = graph.spark.createDataFrame([], "first long, last long, length long, path string")
        found = found.withColumnsRenamed({k: f"{self.path_var}.{k}" for k in ("length", "path")})
        for plan, var, end in ((source, self.source_var, "first"), (target, self.target_var, "last")):
            filtered = plan.filters if isinstance(plan, NodeScan) else ()
            bare = replace(plan, filters=()) if filtered and end == "first" else plan  # the walk began at nodes that pass
            if _told_by_edges(bare, graph, self.rel):
                found = _with_ends(found, bare, var, end)
            else:
                nodes = plan.frame(graph)
                found = found.join(nodes, found[end] == nodes[f"`{var}._id`"])
        return found.select(*[named(k) for k in self.schema])

    def describe(self):
        return f"PathExpand: {self.rel.name} ({self.source_var} -> {self.target_var}) *{self.low}..{self.high} {_DIRECTION[self.direction]}"


@dataclass(frozen=True)
class Filter(_One):
    input: Plan
    condition: Expr

    def frame(self, graph):
        return self.input.frame(graph).where(self.condition.keeps())

    def describe(self):
        return f"Filter: {self.condition}"


@dataclass(frozen=True)
class Project(_One):
    """(name, expression) columns."""

    input: Plan
    items: tuple[tuple[str, Expr], ...]

    @property
    def schema(self):
        return {name: e.type for name, e in self.items}

    def frame(self, graph):
        return self.input.frame(graph).select(*[e.column().alias(name) for name, e in self.items])

    def describe(self):
        return f"Project: [{', '.join(n if n == str(e) else f'{e} AS {n}' for n, e in self.items)}]"


@dataclass(frozen=True)
class Aggregate(_One):
    """Groups by the keys; without keys one row, also of nothing."""

    input: Plan
    keys: tuple[Property, ...]
    calls: tuple[AggregateCall, ...]

    @property
    def schema(self):
        return {k.key: k.type for k in self.keys} | {c.name: c.type for c in self.calls}

    def frame(self, graph):
        found = self.input.frame(graph)
        calls = [c.column().alias(c.name) for c in self.calls]
        return found.groupBy(*[named(k.key) for k in self.keys]).agg(*calls) if self.keys else found.agg(*calls)

    def describe(self):
        return f"Aggregate: [{', '.join(k.key for k in self.keys)}] [{', '.join(c.name for c in self.calls)}]"


@dataclass(frozen=True)
class Sort(_One):
    """(column, descending) keys, nulls last either way; ties keep `stable`."""

    input: Plan
    keys: tuple[tuple[str, bool], ...]
    stable: tuple[str, ...] = ()

    def frame(self, graph):
        keys = [named(k).desc_nulls_last() if down else named(k).asc_nulls_last() for k, down in self.keys]
        return self.input.frame(graph).orderBy(*keys, *[named(k).asc_nulls_last() for k in self.stable])

    def describe(self):
        return f"Sort: [{', '.join(f'{k} {'DESC' if d else 'ASC'}' for k, d in self.keys)}]"


@dataclass(frozen=True)
class Limit(_One):
    input: Plan
    skip: int | None = None
    limit: int | None = None

    def frame(self, graph):
        out = self.input.frame(graph)
        if self.skip is not None and self.skip > 0:
            out = out.offset(self.skip)
        return out if self.limit is None else out.limit(max(self.limit, 0))

    def describe(self):
        parts = [f"SKIP {self.skip}"] * (self.skip is not None) + [f"LIMIT {self.limit}"] * (self.limit is not None)
        return f"Limit: {' '.join(parts)}"


@dataclass(frozen=True)
class Distinct(_One):
    input: Plan

    def frame(self, graph):
        return self.input.frame(graph).distinct()

    def describe(self):
        return "Distinct"


@dataclass(frozen=True)
class HashJoin(Plan):
    """Equi-join of two plans; kind is inner, left, right or full."""

    left: Plan
    right: Plan
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    kind: str = "inner"

    def children(self):
        return self.left, self.right

    def with_children(self, children):
        return replace(self, left=children[0], right=children[1])

    @property
    def schema(self):
        if both := set(self.left.schema) & set(self.right.schema):
            raise PlanError(f"both sides have columns {sorted(both)}")
        return self.left.schema | self.right.schema

    def frame(self, graph):
        if self.kind not in ("inner", "left", "right", "full") or len(self.left_keys) != len(self.right_keys) or not self.left_keys:
            raise PlanError(f"no {self.kind} join on {self.left_keys} and {self.right_keys}")
        a, b = self.left.frame(graph), self.right.frame(graph)
        on = [a[f"`{x}`"] == b[f"`{y}`"] for x, y in zip(self.left_keys, self.right_keys)]
        return a.join(b, on, self.kind).select(*[named(k) for k in self.schema])

    def describe(self):
        return f"HashJoin: {self.kind} [{', '.join(f'{x} = {y}' for x, y in zip(self.left_keys, self.right_keys))}]"


@dataclass(frozen=True)
class Union(Plan):
    """All inputs' rows under the first one's names; without `all`, distinct."""

    inputs: tuple[Plan, ...]
    all: bool = True

    def children(self):
        return self.inputs

    def with_children(self, children):
        return replace(self, inputs=children)

    @property
    def schema(self):
        first = self.inputs[0].schema
        for other in self.inputs[1:]:
            if list(other.schema.values()) != list(first.values()):
                raise PlanError("the parts of a union must agree in number and types of columns")
        return first

    def frame(self, graph):
        names = list(self.schema)
        out = None
        for p in self.inputs:
            part = p.frame(graph).toDF(*names)
            out = part if out is None else out.union(part)
        return out if self.all else out.distinct()

    def describe(self):
        return "Union: ALL" if self.all else "Union"


@dataclass(frozen=True)
class Empty(Plan):
    """No rows, of a given schema."""

    columns: dict[str, GraphType] = field(default_factory=dict, hash=False)

    @property
    def schema(self):
        return self.columns

    def frame(self, graph):
        return graph.spark.createDataFrame([], T.StructType([T.StructField(k, t.spark) for k, t in self.columns.items()]))

    def describe(self):
        return "Empty"
