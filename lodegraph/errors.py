"""Errors of the graph engine."""

from __future__ import annotations


class GraphError(Exception):
    """Root of all errors that the engine raises itself."""

    label = "Error"

    def __init__(self, message: str):
        super().__init__(f"{self.label}: {message}")
        self.message = message


class ParseError(GraphError):
    label = "Parse error"

    def __init__(self, message: str, line: int = 1, column: int = 1):
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


class SchemaError(GraphError):
    label = "Schema error"


class TypeMismatch(GraphError):
    label = "Type error"

    def __init__(self, expected: str, actual: str, what: str = ""):
        super().__init__(f"expected {expected}, got {actual}" + (f" for {what}" if what else ""))
        self.expected, self.actual = expected, actual


class ConstraintViolation(GraphError):
    label = "Constraint violation"


class ExecutionError(GraphError):
    label = "Execution error"


class DivisionByZero(ExecutionError):
    label = "Division by zero"


class StorageError(GraphError):
    label = "Storage error"


class ImportFailed(GraphError):
    label = "Import error"


class ValidationError(GraphError):
    label = "Validation error"


class BindError(GraphError):
    """Names or types that don't resolve; `kind` tells which."""

    label = "Bind error"

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class PlanError(GraphError):
    label = "Plan error"


class UnsupportedOperation(GraphError):
    label = "Unsupported operation"


class ReadOnlyError(GraphError):
    label = "Read-only"
