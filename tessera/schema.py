"""Row schemas: dataclasses whose annotations become Spark types."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import types
import typing
import uuid

from pyspark.sql import types as T

#: Spark types of plain annotations.
PLAIN: dict[type, T.DataType] = {
    str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), decimal.Decimal: T.DecimalType(38, 18),
    bytes: T.BinaryType(), datetime.datetime: T.TimestampNTZType(), datetime.date: T.DateType(),
    datetime.timedelta: T.DayTimeIntervalType(), uuid.UUID: T.StringType(),
}


@dataclasses.dataclass(frozen=True)
class Column:
    """A column: its name, Spark type, whether it may be null, and its name in files."""

    name: str
    type: T.DataType
    nullable: bool = True
    alias: str | None = None

    @property
    def source_name(self) -> str:
        return self.alias or self.name


@dataclasses.dataclass(frozen=True)
class Schema:
    """Columns in order."""

    name: str
    columns: tuple[Column, ...]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])

    @property
    def is_flat(self) -> bool:
        return not any(isinstance(c.type, (T.ArrayType, T.MapType, T.StructType)) for c in self.columns)

    def require_flat(self, what: str) -> None:
        if not self.is_flat:
            raise TypeError(f"{what} takes flat rows only; {self.name} has nested columns")

    def matches(self, other: T.StructType) -> bool:
        """Whether a DataFrame's schema has these names and types, nullability aside."""
        return [(c.name, c.type.simpleString()) for c in self.columns] == [(f.name, f.dataType.simpleString()) for f in other]


def column(*, alias: str | None = None, type: str | T.DataType | None = None, nullable: bool | None = None, **more):  # noqa: A002, ANN003, ANN201
    """A dataclass field with the name it has in files, or a Spark type of its own."""
    return dataclasses.field(metadata={"alias": alias, "type": type, "nullable": nullable}, **more)


def _spark_type(kind: object) -> tuple[T.DataType, bool]:
    """The Spark type of an annotation, and whether it may be null."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1:
            raise TypeError(f"no Spark type for {kind}")
        return _spark_type(rest[0])[0], True
    if origin in (list, tuple, set):
        return T.ArrayType(*_spark_type(args[0])), False
    if origin is dict:
        return T.MapType(_spark_type(args[0])[0], *_spark_type(args[1])), False
    if isinstance(kind, type):
        if dataclasses.is_dataclass(kind):
            return schema_of(kind).struct, False
        if issubclass(kind, enum.Enum):
            return T.StringType(), False
        if kind in PLAIN:
            return PLAIN[kind], False
    raise TypeError(f"no Spark type for {kind}")


def schema_of(cls: type | Schema | T.StructType) -> Schema:
    """The schema of a dataclass (or of what already is one)."""
    if isinstance(cls, Schema):
        return cls
    if isinstance(cls, T.StructType):
        return Schema("rows", tuple(Column(f.name, f.dataType, f.nullable) for f in cls))
    hints = typing.get_type_hints(cls)
    made = []
    for f in dataclasses.fields(cls):
        given = f.metadata.get("type")
        if isinstance(given, str):
            given = T.DataType.fromDDL(given)
        kind, nullable = (given, False) if given is not None else _spark_type(hints[f.name])
        if given is not None:
            nullable = type(None) in typing.get_args(hints[f.name])
        if f.metadata.get("nullable") is not None:
            nullable = f.metadata["nullable"]
        made.append(Column(f.name, kind, nullable, f.metadata.get("alias")))
    return Schema(cls.__name__, tuple(made))
