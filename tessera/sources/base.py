"""Catalog entries: datasets (tables) and objects (single values)."""

from __future__ import annotations

from abc import ABC, abstractmethod

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import Schema, schema_of
from tessera.sources import files
from tessera.validation import ErrorType, Level, ValidationResult

#: What a failed Spark job raises.
SPARK_ERRORS = (PySparkException, Py4JError)

#: Rows that a shallow inspection reads.
SAMPLE = 10


class ReadOnlyError(NotImplementedError):
    """Something was to be written to an entry that is only read."""


class CatalogEntry(ABC):
    """Something with a key that can be loaded, saved, counted and inspected."""

    read_only = False
    can_inspect = True
    is_object = False
    #: Whether counting reads only what is at hand: file footers, memory.
    cheap_count = False
    #: Whether ``save`` reads all rows at once, so that they can be counted on the way.
    reads_when_saved = False

    def __init__(self, key: str, path: str | None = None) -> None:
        if not key or not key.strip():
            raise ValueError("a catalog entry needs a key")
        self.key = key
        self.path = path
        self.preferred_level: Level | None = None

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.key!r})"

    @property
    def data_type(self) -> str:
        return "object"

    @property
    def schema(self) -> Schema | None:
        return None

    @abstractmethod
    def load(self, spark: SparkSession): ...  # noqa: ANN201

    @abstractmethod
    def save(self, spark: SparkSession, data) -> None: ...  # noqa: ANN001

    def exists(self, spark: SparkSession) -> bool:
        return self.path is not None and files.exists(spark, self.path)

    @abstractmethod
    def count(self, spark: SparkSession) -> int: ...

    def with_inspection_level(self, level: Level):  # noqa: ANN201
        self.preferred_level = level
        return self

    def inspect(self, spark: SparkSession, level: Level, sample: int = SAMPLE) -> ValidationResult:
        """Inspects at a level; anything unforeseen becomes an InspectionFailure."""
        if level == Level.NONE:
            return ValidationResult.success()
        try:
            return self.inspect_deep(spark) if level == Level.DEEP else self.inspect_shallow(spark, sample)
        except Exception as e:  # noqa: BLE001  an inspection reports, it doesn't raise
            return ValidationResult.from_exception(self.key, e)

    def fail(self, kind: ErrorType, message: str, details: str | None = None) -> ValidationResult:
        return ValidationResult.failure(self.key, kind, message, details)

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        if not self.exists(spark):
            return self.fail(ErrorType.NOT_FOUND, f"{self.path or self.key} does not exist")
        return ValidationResult.success()

    def inspect_deep(self, spark: SparkSession) -> ValidationResult:
        found = self.inspect_shallow(spark, 100)
        if found.is_valid:
            self.count(spark)
        return found


class Dataset(CatalogEntry):
    """A table with a declared schema."""

    def __init__(self, key: str, schema: type | Schema, path: str | None = None) -> None:
        super().__init__(key, path)
        self._schema = schema_of(schema)

    @property
    def schema(self) -> Schema:
        return self._schema

    @property
    def data_type(self) -> str:
        return self._schema.name

    @abstractmethod
    def load(self, spark: SparkSession) -> DataFrame: ...

    def check(self, data: DataFrame) -> DataFrame:
        """The frame's declared columns in their order; an error if one is missing or has another type."""
        if not isinstance(data, DataFrame):
            raise TypeError(f"{self.key} takes a DataFrame, not {type(data).__name__}")
        try:
            chosen = data.select(*(data[f"`{c.name}`"] for c in self._schema.columns))
        except PySparkException as e:
            raise TypeError(f"{self.key}: a declared column is missing: {str(e).splitlines()[0]}") from e
        if not self._schema.matches(chosen.schema):
            raise TypeError(f"{self.key} takes {self._schema.struct.simpleString()}, not {chosen.schema.simpleString()}")
        return chosen

    def count(self, spark: SparkSession) -> int:
        return self.load(spark).count() if self.exists(spark) else 0

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        found = super().inspect_shallow(spark, sample)
        if found.is_valid and not self.load(spark).limit(sample).collect():
            return self.fail(ErrorType.EMPTY_DATASET, "there are no rows")
        return found

    def misfits(self, texts: DataFrame, limit: int | None) -> ValidationResult | None:
        """Looks for texts that don't convert to their column's type; None if all do."""
        bad = {c.name: F.col(f"`{c.name}`").isNotNull() & F.col(f"`{c.name}`").try_cast(c.type).isNull() for c in self._schema.columns}
        bad |= {f"null {c.name}": F.col(f"`{c.name}`").isNull() for c in self._schema.columns if not c.nullable}
        if limit is None:
            row = texts.agg(F.count(F.lit(1)).alias("all rows"), *(F.count_if(v).alias(k) for k, v in bad.items())).first().asDict()
        else:  # a few rows are brought as they are, which needs no shuffle
            some = texts.limit(limit).select(*(v.alias(k) for k, v in bad.items())).collect()
            row = {"all rows": len(some)} | {k: sum(bool(r[i]) for r in some) for i, k in enumerate(bad)}
        if not row.pop("all rows"):
            return self.fail(ErrorType.EMPTY_DATASET, "there are no rows")
        wrong = {k: n for k, n in row.items() if n and not k.startswith("null ")}
        if wrong:
            kind = ErrorType.TYPE_MISMATCH if limit else ErrorType.DESERIALIZATION_ERROR
            return self.fail(kind, "values don't convert to their types", "\n".join(f"{k}: {n} row(s)" for k, n in wrong.items()))
        return None


class SingleObject(CatalogEntry):
    """A single value."""

    is_object = True
    cheap_count = True

    def count(self, spark: SparkSession) -> int:
        return int(self.exists(spark))


class ReadOnlyDataset(Dataset):
    """A table that only is read; subclasses give ``load`` and ``exists``."""

    read_only = True

    def save(self, spark: SparkSession, data) -> None:  # noqa: ANN001
        raise ReadOnlyError(f"{self.key} is read-only")


class ReadOnlyObject(SingleObject):
    """A value that only is read."""

    read_only = True

    def save(self, spark: SparkSession, data) -> None:  # noqa: ANN001
        raise ReadOnlyError(f"{self.key} is read-only")
