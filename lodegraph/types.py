"""Property types, their Spark counterparts and how values compare."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class GraphType(Enum):
    INT64 = "INT64"
    FLOAT64 = "FLOAT64"
    FLOAT32 = "FLOAT32"
    BOOL = "BOOL"
    STRING = "STRING"
    DATE = "DATE"
    TIMESTAMP = "TIMESTAMP"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def is_numeric(self) -> bool:
        return self in (GraphType.INT64, GraphType.FLOAT64, GraphType.FLOAT32)

    @property
    def is_float(self) -> bool:
        return self in (GraphType.FLOAT64, GraphType.FLOAT32)

    @classmethod
    def of(cls, kind: T.DataType) -> GraphType:
        """The property type that holds values of a Spark type."""
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return cls.INT64
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            return cls.STRING
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return cls.TIMESTAMP
        for mine, spark in _SPARK.items():
            if kind == spark:
                return mine
        raise TypeError(f"no property type holds {kind.simpleString()}")


_SPARK = {
    GraphType.INT64: T.LongType(),
    GraphType.FLOAT64: T.DoubleType(),
    GraphType.FLOAT32: T.FloatType(),
    GraphType.BOOL: T.BooleanType(),
    GraphType.STRING: T.StringType(),
    GraphType.DATE: T.DateType(),
    GraphType.TIMESTAMP: T.TimestampNTZType(),
}


def comparable(a: GraphType, b: GraphType) -> bool:
    """Equal types, or two numbers; anything else never compares true."""
    return a == b or (a.is_numeric and b.is_numeric)


def fits(value, kind: GraphType) -> bool:
    """May a literal be stored in a column of this type?  Integers widen."""
    if value is None:
        return True
    if isinstance(value, bool):
        return kind is GraphType.BOOL
    if isinstance(value, int):
        return kind in (GraphType.INT64, GraphType.FLOAT64, GraphType.FLOAT32)
    if isinstance(value, float):
        return kind.is_float
    return kind is GraphType.STRING


def literal_type(value) -> GraphType:
    if isinstance(value, bool):
        return GraphType.BOOL
    if isinstance(value, int):
        return GraphType.INT64
    if isinstance(value, float):
        return GraphType.FLOAT64
    return GraphType.STRING
