"""Inspection levels, errors and results."""

from __future__ import annotations

import enum
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Level(enum.IntEnum):
    """How much of an input is inspected before anything runs."""

    NONE = 0
    SHALLOW = 1
    DEEP = 2


class ErrorType(enum.StrEnum):
    """Kinds of validation errors. Fixed names."""

    NOT_FOUND = "NotFound"
    INVALID_FORMAT = "InvalidFormat"
    SCHEMA_MISMATCH = "SchemaMismatch"
    TYPE_MISMATCH = "TypeMismatch"
    DESERIALIZATION_ERROR = "DeserializationError"
    EMPTY_DATASET = "EmptyDataset"
    INSPECTION_FAILURE = "InspectionFailure"


@dataclass(frozen=True)
class ValidationError:
    """One finding about one catalog entry."""

    key: str
    type: ErrorType
    message: str
    details: str | None = None

    def __str__(self) -> str:
        text = f"[{self.type}] {self.key}: {self.message}"
        return text if not self.details else text + "".join(f"\n  {line}" for line in self.details.splitlines())


class ValidationException(Exception):
    """Raised for a failed result; lists the errors by entry."""

    def __init__(self, errors: Iterable[ValidationError]) -> None:
        self.errors = tuple(errors)
        lines = [f"Validation failed with {len(self.errors)} error(s):"]
        for key in dict.fromkeys(e.key for e in self.errors):
            lines.append(f"{key}:")
            for e in self.errors:
                if e.key == key:
                    lines.append(f"  - [{e.type}] {e.message}")
                    lines += [f"      {line}" for line in (e.details or "").splitlines()]
        super().__init__("\n".join(lines))


@dataclass(frozen=True)
class ValidationResult:
    """A list of errors; valid if it is empty."""

    errors: tuple[ValidationError, ...] = ()

    @classmethod
    def success(cls) -> ValidationResult:
        return cls()

    @classmethod
    def failure(cls, key: str, type: ErrorType, message: str, details: str | None = None) -> ValidationResult:  # noqa: A002
        return cls((ValidationError(key, type, message, details),))

    @classmethod
    def from_exception(cls, key: str, error: Exception, type: ErrorType = ErrorType.INSPECTION_FAILURE) -> ValidationResult:  # noqa: A002
        return cls.failure(key, type, str(error).splitlines()[0] if str(error) else error.__class__.__name__, error.__class__.__name__)

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def add(self, error: ValidationError) -> ValidationResult:
        return ValidationResult((*self.errors, error))

    def merge(self, other: ValidationResult) -> ValidationResult:
        return ValidationResult(self.errors + other.errors)

    def raise_if_invalid(self) -> None:
        if self.errors:
            raise ValidationException(self.errors)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The errors as rows."""
        rows = [(e.key, str(e.type), e.message, e.details) for e in self.errors]
        return spark.createDataFrame(rows, "key string, type string, message string, details string")


@dataclass
class ValidationOptions:
    """Levels that a pipeline sets for single entries; they come before the entries' own."""

    levels: dict[str, Level] = field(default_factory=dict)

    def inspect(self, key: object, level: Level) -> ValidationOptions:
        self.levels[getattr(key, "key", key)] = level
        return self

    def level_of(self, entry) -> Level:  # noqa: ANN001
        """The pipeline's level, else the entry's, else shallow if it can be inspected."""
        if entry.key in self.levels:
            return self.levels[entry.key]
        if entry.preferred_level is not None:
            return entry.preferred_level
        return Level.SHALLOW if entry.can_inspect else Level.NONE

    def merged(self, others: Iterable[Mapping[str, Level]]) -> ValidationOptions:
        """All levels together, the deeper one where two differ."""
        out = dict(self.levels)
        for other in others:
            for k, v in other.items():
                out[k] = max(v, out.get(k, Level.NONE))
        return ValidationOptions(out)
