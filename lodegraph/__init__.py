"""A property-graph analytics engine on PySpark."""

from .session import CsvImportConfig, GraphSession, ImportProgress, ImportResult
from .types import GraphType

__all__ = ["CsvImportConfig", "GraphSession", "GraphType", "ImportProgress", "ImportResult"]
