"""Typed expressions over bound properties, translated to Spark columns.

Comparisons follow the engine's rules: different types, apart from numbers,
compare to nothing at all, and so do nulls and NaN.  They yield null, which a
filter drops, and NOT of it stays null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError, DivisionByZero, PlanError
from ..types import GraphType, comparable, literal_type

NOTHING = "boolean"


def named(name: str) -> Column:
    return F.col(f"`{name}`")


class Expr:
    """An expression; `type` is its property type, `uses` the columns it reads."""

    def column(self) -> Column:
        raise NotImplementedError

    def keeps(self) -> Column:
        """As a filter's condition, which need not tell false from null; so
        comparisons stay plain, and scans can take them."""
        return self.column()

    def children(self) -> tuple[Expr, ...]:
        return ()

    @property
    def uses(self) -> set[str]:
        return set().union(*(c.uses for c in self.children())) if self.children() else set()

    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class Literal(Expr):
    value: object

    @property
    def type(self) -> GraphType:
        return literal_type(self.value)

    def column(self) -> Column:
        return F.lit(self.value).cast(self.type.spark)

    def __str__(self):
        return repr(self.value)


@dataclass(frozen=True)
class Property(Expr):
    """A bound property, `var.name`."""

    var: str
    name: str
    type: GraphType

    @property
    def key(self) -> str:
        return f"{self.var}.{self.name}"

    @property
    def uses(self) -> set[str]:
        return {self.key}

    def column(self) -> Column:
        return named(self.key)

    def __str__(self):
        return self.key


OPERATORS = ("=", "<>", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr
    type = GraphType.BOOL

    def children(self):
        return self.left, self.right

    def _parts(self) -> tuple[Column, list[tuple[Expr, Column]]] | None:
        """The plain comparison, and the sides that may be NaN."""
        a, b = self.left.type, self.right.type
        if not comparable(a, b):
            return None
        x, y = self.left.column(), self.right.column()
        if a != b:  # integers are compared as doubles
            x, y = x.cast("double"), y.cast("double")
        got = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[self.op]
        return got, [(e, c) for e, c in ((self.left, x), (self.right, y)) if e.type.is_float and not isinstance(e, Literal)]

    def column(self) -> Column:
        parts = self._parts()
        if parts is None:
            return F.lit(None).cast(NOTHING)
        got, loose = parts
        # Spark orders NaN above all numbers and equal to itself
        for _, c in loose:
            got = F.when(~F.isnan(c), got)
        return got

    def keeps(self) -> Column:
        parts = self._parts()
        if parts is None:
            return F.lit(None).cast(NOTHING)
        got, loose = parts
        for e, c in loose:
            # NaN counts as the largest: against a literal it may fail by itself
            below = self.op in ("<", "<=", "=") if e is self.left else self.op in (">", ">=", "=")
            other = self.right if e is self.left else self.left
            if not (below and isinstance(other, Literal)):
                got = got & ~F.isnan(c)
        return got

    def __str__(self):
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class And(Expr):
    items: tuple[Expr, ...]
    type = GraphType.BOOL

    def children(self):
        return self.items

    def column(self) -> Column:
        out = F.lit(True)
        for k, e in enumerate(self.items):
            out = _truth(e) if k == 0 else out & _truth(e)
        return out

    def keeps(self) -> Column:
        return reduce(lambda a, b: a & b, [_kept(e) for e in self.items], F.lit(True))

    def __str__(self):
        return "(" + " AND ".join(map(str, self.items)) + ")"


@dataclass(frozen=True)
class Or(Expr):
    items: tuple[Expr, ...]
    type = GraphType.BOOL

    def children(self):
        return self.items

    def column(self) -> Column:
        out = F.lit(False)
        for k, e in enumerate(self.items):
            out = _truth(e) if k == 0 else out | _truth(e)
        return out

    def keeps(self) -> Column:
        return reduce(lambda a, b: a | b, [_kept(e) for e in self.items], F.lit(False))

    def __str__(self):
        return "(" + " OR ".join(map(str, self.items)) + ")"


@dataclass(frozen=True)
class Not(Expr):
    item: Expr
    type = GraphType.BOOL

    def children(self):
        return (self.item,)

    def column(self) -> Column:
        return ~_truth(self.item)

    def __str__(self):
        return f"NOT {self.item}"


@dataclass(frozen=True)
class IsNull(Expr):
    item: Expr
    negated: bool = False
    type = GraphType.BOOL

    def children(self):
        return (self.item,)

    def column(self) -> Column:
        got = self.item.column()
        return got.isNotNull() if self.negated else got.isNull()

    def __str__(self):
        return f"{self.item} IS {'NOT ' * self.negated}NULL"


@dataclass(frozen=True)
class Arithmetic(Expr):
    """+ - * / %; integer division and remainder truncate; / 0 fails."""

    op: str
    left: Expr
    right: Expr

    def children(self):
        return self.left, self.right

    @property
    def type(self) -> GraphType:
        a, b = self.left.type, self.right.type
        if not (a.is_numeric and b.is_numeric):
            raise BindError("type_mismatch", f"'{self.op}' needs numbers, not {a.value} and {b.value}")
        return a if a == b else GraphType.FLOAT64

    def column(self) -> Column:
        kind = self.type
        x, y = (e.column().cast(kind.spark) for e in (self.left, self.right))
        if self.op in "/%" and isinstance(self.right, Literal) and not self.right.value:
            raise DivisionByZero(str(self))
        if self.op == "/" and kind is GraphType.INT64:
            return F.call_function("div", x, y)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[self.op]()

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


def _truth(e: Expr) -> Column:
    if e.type is not GraphType.BOOL:
        raise BindError("type_mismatch", f"'{e}' is not a condition")
    return e.column()


def _kept(e: Expr) -> Column:
    _truth(e)
    return e.keeps()


AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class Aggregate:
    """COUNT, SUM, AVG, MIN or MAX of a property, or of rows (item None)."""

    function: str
    item: Property | None = None
    distinct: bool = False

    @property
    def name(self) -> str:
        return f"{self.function}({'DISTINCT ' * self.distinct}{self.item or '*'})"

    @property
    def type(self) -> GraphType:
        if self.function == "COUNT":
            return GraphType.INT64
        return GraphType.FLOAT64 if self.function == "AVG" else self.item.type

    @property
    def uses(self) -> set[str]:
        return self.item.uses if self.item else set()

    def column(self) -> Column:
        if self.item is None:
            if self.function != "COUNT":
                raise PlanError(f"{self.function}(*) has no meaning; only COUNT(*) has")
            return F.count(F.lit(1))
        x = self.item.column()
        if self.function in ("SUM", "AVG") and not self.item.type.is_numeric:
            raise BindError("type_mismatch", f"{self.function} needs a number, not {self.item.type.value}")
        if self.function == "COUNT":
            return F.count_distinct(x) if self.distinct else F.count(x)
        if self.function == "SUM":
            total = F.sum_distinct(x) if self.distinct else F.sum(x)
            return F.coalesce(total.cast(self.type.spark), F.lit(0).cast(self.type.spark))
        if self.function == "AVG":
            return F.avg(F.col(f"`{self.item.key}`")) if not self.distinct else (F.sum_distinct(x) / F.count_distinct(x))
        return F.min(x) if self.function == "MIN" else F.max(x)
