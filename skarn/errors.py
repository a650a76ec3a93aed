"""Errors of statements, each with its SQLSTATE and its number in the MySQL protocol."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException


class EngineError(Exception):
    """Any failure of a statement."""

    sqlstate, number = "XX000", 1105


class SyntaxFault(EngineError, ValueError):
    """Text that is no statement of the dialect."""

    sqlstate, number = "42601", 1064


class NotFound(EngineError):
    """Something that a statement names isn't there."""

    sqlstate, number = "42704", 1105


class TableNotFound(NotFound):
    sqlstate, number = "42P01", 1146


class DatabaseNotFound(NotFound):
    sqlstate, number = "3D000", 1049


class SchemaNotFound(NotFound):
    sqlstate, number = "3F000", 1049


class ColumnNotFound(NotFound):
    sqlstate, number = "42703", 1054


class Exists(EngineError):
    """A name that is taken."""

    sqlstate, number = "42P07", 1050


class DatabaseExists(Exists):
    sqlstate, number = "42P04", 1007


class SchemaExists(Exists):
    sqlstate, number = "42P06", 1007


class ColumnExists(Exists):
    sqlstate, number = "42701", 1060


class ActiveDatabaseDrop(EngineError):
    sqlstate, number = "55006", 1105


class DependentObjects(EngineError):
    """Other tables or constraints still need what a statement takes away."""

    sqlstate, number = "2BP01", 3730


class InvalidValue(EngineError, ValueError):
    sqlstate, number = "22P02", 1231


class TransactionState(EngineError):
    sqlstate, number = "25P01", 1305


class TransactionOpen(TransactionState):
    sqlstate, number = "25001", 1568


class NotSupported(EngineError, NotImplementedError):
    sqlstate, number = "0A000", 1235


class ConstraintViolation(EngineError, ValueError):
    """A row that a constraint forbids."""

    sqlstate, number = "23000", 1105


class NotNullViolation(ConstraintViolation):
    sqlstate, number = "23502", 1048


class UniqueViolation(ConstraintViolation):
    sqlstate, number = "23505", 1062


class CheckViolation(ConstraintViolation):
    sqlstate, number = "23514", 3819


class ForeignKeyViolation(ConstraintViolation):
    """A child row without its parent."""

    sqlstate, number = "23503", 1452


class ForeignKeyParentViolation(ConstraintViolation):
    """A parent row that a child row still needs."""

    sqlstate, number = "23503", 1451


class NoParentKey(EngineError):
    """A foreign key to columns that aren't unique."""

    sqlstate, number = "42830", 1822


#: Spark's error conditions and the numbers of theirs; the SQLSTATE is Spark's own.
_NUMBERS = {"DIVIDE_BY_ZERO": 1365, "REMAINDER_BY_ZERO": 1365, "ARITHMETIC_OVERFLOW": 1690, "BINARY_ARITHMETIC_OVERFLOW": 1690, "NUMERIC_VALUE_OUT_OF_RANGE": 1264, "CAST_INVALID_INPUT": 1366, "CAST_OVERFLOW": 1264, "SCALAR_SUBQUERY_TOO_MANY_ROWS": 1242, "TABLE_OR_VIEW_NOT_FOUND": 1146, "UNRESOLVED_COLUMN": 1054, "PARSE_SYNTAX_ERROR": 1064}


def of_spark(e: Exception) -> EngineError:
    """A failure of Spark, in analysis or in a job, as an error of the engine."""
    out = EngineError(str(e))
    if isinstance(e, PySparkException) and e.getCondition():
        condition, state = e.getCondition(), e.getSqlState()
    else:  # what Spark says in a job's failure
        said = re.search(r"\[([A-Z_]+)(?:\.[A-Z_]+)*\].*?SQLSTATE: (\w{5})", str(e), re.S)
        condition, state = said.groups() if said else ("", None)
    out.number, out.sqlstate = _NUMBERS.get(condition.split(".")[0], EngineError.number), state or EngineError.sqlstate
    return out
