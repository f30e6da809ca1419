"""Schemas of node and relationship tables, in one namespace."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .errors import SchemaError
from .types import GraphType


@dataclass(frozen=True)
class Column:
    name: str
    type: GraphType


def _checked(owner: str, columns: tuple[Column, ...]) -> None:
    seen: dict[str, str] = {}
    for c in columns:
        if not c.name:
            raise SchemaError(f"table '{owner}' has a column without a name")
        if c.name.lower() in seen:
            raise SchemaError(f"table '{owner}' has columns '{seen[c.name.lower()]}' and '{c.name}': names must differ by more than case")
        seen[c.name.lower()] = c.name


@dataclass(frozen=True)
class NodeTable:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]
    kind: str = field(default="node", init=False)

    def check(self) -> None:
        if not self.columns:
            raise SchemaError(f"table '{self.name}' needs at least one column")
        _checked(self.name, self.columns)
        if not self.primary_key:
            raise SchemaError(f"table '{self.name}' needs a primary key")
        for key in self.primary_key:
            if self.column(key) is None:
                raise SchemaError(f"primary key column '{key}' is not in table '{self.name}'")

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass(frozen=True)
class RelTable:
    name: str
    source: str
    target: str
    columns: tuple[Column, ...]
    kind: str = field(default="rel", init=False)

    def check(self) -> None:
        _checked(self.name, self.columns)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


class Catalog:
    """All tables by name; names are case-sensitive."""

    def __init__(self):
        self.tables: dict[str, NodeTable | RelTable] = {}

    def add(self, table: NodeTable | RelTable) -> None:
        if table.name in self.tables:
            raise SchemaError(f"table '{table.name}' already exists")
        table.check()
        if isinstance(table, RelTable):
            for end in (table.source, table.target):
                if not isinstance(self.tables.get(end), NodeTable):
                    raise SchemaError(f"node table '{end}' of relationship '{table.name}' does not exist")
        self.tables[table.name] = table

    def node(self, name: str) -> NodeTable:
        found = self.tables.get(name)
        if not isinstance(found, NodeTable):
            raise SchemaError(f"node table '{name}' does not exist")
        return found

    def rel(self, name: str) -> RelTable:
        found = self.tables.get(name)
        if not isinstance(found, RelTable):
            raise SchemaError(f"relationship table '{name}' does not exist")
        return found

    def to_json(self) -> str:
        rows = []
        for t in self.tables.values():
            row = {"kind": t.kind, "name": t.name, "columns": [[c.name, c.type.value] for c in t.columns]}
            row |= {"primary_key": list(t.primary_key)} if isinstance(t, NodeTable) else {"source": t.source, "target": t.target}
            rows.append(row)
        return json.dumps(rows)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        out = cls()
        for row in json.loads(text):
            columns = tuple(Column(n, GraphType(k)) for n, k in row["columns"])
            out.add(NodeTable(row["name"], columns, tuple(row["primary_key"])) if row["kind"] == "node" else RelTable(row["name"], row["source"], row["target"], columns))
        return out
