"""Single values in JSON, text and binary files, and in memory."""

from __future__ import annotations

import dataclasses
import enum
import json
import threading
from collections.abc import Mapping

from pyspark.sql import SparkSession

from tessera.functions.values import SIGNATURES
from tessera.sources import files
from tessera.sources.base import SAMPLE, SingleObject
from tessera.sources.tables import camel_case
from tessera.validation import ErrorType, ValidationResult

#: Bytes that a shallow inspection of a text reads.
TEXT_SAMPLE = 4096


class FileType(enum.StrEnum):
    """Types that first bytes tell apart."""

    PNG = "Png"
    JPEG = "Jpeg"
    GIF = "Gif"
    PDF = "Pdf"
    ZIP = "Zip"
    GZIP = "Gzip"
    BMP = "Bmp"
    WEBP = "WebP"
    MP4 = "Mp4"
    UNKNOWN = "Unknown"


#: First bytes of programs. Fixed values.
PROGRAMS = ((b"MZ", "Exe"), (b"\x7fELF", "Elf"))


def detect_file_type(start: bytes) -> FileType:
    """The type that the first 16 bytes show."""
    fits = lambda marks: all(start[at : at + len(mark) // 2] == bytes.fromhex(mark) for at, mark in marks)
    return next((FileType(name) for name, marks in SIGNATURES if fits(marks)), FileType.UNKNOWN)


def plain(value: object, rename: bool = True) -> object:
    """A value as JSON has it: dataclasses and mappings as objects with camel-case names, nulls left out."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        value = {f.name: getattr(value, f.name) for f in dataclasses.fields(value)}
    if isinstance(value, Mapping):
        return {camel_case(str(k)) if rename else str(k): plain(v, rename) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [plain(v, rename) for v in value]
    if isinstance(value, enum.Enum):
        return value.value
    return value


class JsonObject(SingleObject):
    """One JSON value; a dataclass type makes the loaded object one of it."""

    def __init__(self, key: str, path: str, kind: type | None = None, minified: bool = False) -> None:
        super().__init__(key, path)
        self.kind, self.minified = kind, minified

    @property
    def data_type(self) -> str:
        return self.kind.__name__ if self.kind else "object"

    def load(self, spark: SparkSession):  # noqa: ANN201
        if not self.exists(spark):
            raise FileNotFoundError(self.path)
        value = json.loads(files.read_bytes(spark, self.path).decode("utf-8-sig"))
        if value is None:
            raise ValueError(f"{self.key}: the value is null")
        if self.kind is not None and dataclasses.is_dataclass(self.kind):
            by_name = {camel_case(f.name): f.name for f in dataclasses.fields(self.kind)}
            return self.kind(**{by_name[k]: v for k, v in value.items() if k in by_name})
        return value

    def save(self, spark: SparkSession, data) -> None:  # noqa: ANN001
        if data is None:
            raise ValueError(f"{self.key}: no data")
        shape = {"separators": (",", ":")} if self.minified else {"indent": 2}
        files.write_bytes(spark, self.path, [json.dumps(plain(data), ensure_ascii=False, **shape).encode()])

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        found = super().inspect_shallow(spark, sample)
        if found.is_valid:
            try:
                if json.loads(files.read_bytes(spark, self.path).decode("utf-8-sig")) is None:
                    return self.fail(ErrorType.EMPTY_DATASET, "the value is null")
            except ValueError as e:
                return ValidationResult.from_exception(self.key, e, ErrorType.INVALID_FORMAT)
        return found

    def inspect_deep(self, spark: SparkSession) -> ValidationResult:
        found = self.inspect_shallow(spark)
        if found.is_valid:
            try:
                self.load(spark)
            except (TypeError, AttributeError) as e:
                return ValidationResult.from_exception(self.key, e, ErrorType.DESERIALIZATION_ERROR)
        return found


class TextObject(SingleObject):
    """A whole text file."""

    def __init__(self, key: str, path: str, encoding: str = "utf-8") -> None:
        super().__init__(key, path)
        self.encoding = encoding

    @property
    def data_type(self) -> str:
        return "string"

    def load(self, spark: SparkSession) -> str:
        if not self.exists(spark):
            raise FileNotFoundError(self.path)
        return files.read_bytes(spark, self.path).decode(self.encoding)

    def save(self, spark: SparkSession, data: str) -> None:
        if not isinstance(data, str):
            raise TypeError(f"{self.key} takes a text, not {type(data).__name__}")
        files.write_bytes(spark, self.path, [data.encode(self.encoding)])

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        found = super().inspect_shallow(spark, sample)
        if not found.is_valid:
            return found
        start = files.head(spark, self.path, TEXT_SAMPLE)
        kind = detect_file_type(start)
        program = next((name for mark, name in PROGRAMS if start.startswith(mark)), None)
        if program or kind in (FileType.PNG, FileType.PDF, FileType.ZIP, FileType.GIF, FileType.JPEG):
            return self.fail(ErrorType.INVALID_FORMAT, f"a {program or kind} file, not a text")
        try:
            start.decode(self.encoding)
        except UnicodeDecodeError as e:
            if len(start) < TEXT_SAMPLE or e.start < len(start) - 4:  # else the sample ends inside a character
                return ValidationResult.from_exception(self.key, e, ErrorType.TYPE_MISMATCH)
        return found

    def inspect_deep(self, spark: SparkSession) -> ValidationResult:
        found = self.inspect_shallow(spark)
        if found.is_valid:
            try:
                self.load(spark)
            except UnicodeDecodeError as e:
                return ValidationResult.from_exception(self.key, e, ErrorType.DESERIALIZATION_ERROR)
        return found


class BinaryObject(SingleObject):
    """A whole binary file, of a given type if one is named."""

    def __init__(self, key: str, path: str, file_type: FileType | None = None) -> None:
        super().__init__(key, path)
        self.file_type = file_type

    @property
    def data_type(self) -> str:
        return "bytes"

    def load(self, spark: SparkSession) -> bytes:
        if not self.exists(spark):
            raise FileNotFoundError(self.path)
        return files.read_bytes(spark, self.path)

    def save(self, spark: SparkSession, data: bytes) -> None:
        if not isinstance(data, (bytes, bytearray)):
            raise TypeError(f"{self.key} takes bytes, not {type(data).__name__}")
        files.write_bytes(spark, self.path, [bytes(data)])

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        found = super().inspect_shallow(spark, sample)
        if found.is_valid and self.file_type is not None:
            there = detect_file_type(files.head(spark, self.path, 16))
            if there != self.file_type:
                return self.fail(ErrorType.INVALID_FORMAT, f"a file of type {there}, not {self.file_type}")
        return found

    def inspect_deep(self, spark: SparkSession) -> ValidationResult:
        found = self.inspect_shallow(spark)
        if found.is_valid and not self.load(spark):
            return self.fail(ErrorType.EMPTY_DATASET, "the file is empty")
        return found


class MemoryObject(SingleObject):
    """A value in the driver's memory."""

    def __init__(self, key: str, kind: type = object) -> None:
        super().__init__(key)
        self.kind, self._lock, self._held = kind, threading.Lock(), ()

    @property
    def data_type(self) -> str:
        return self.kind.__name__

    def load(self, spark: SparkSession):  # noqa: ANN201
        with self._lock:
            if not self._held:
                raise RuntimeError(f"{self.key} was not saved before it was loaded")
            return self._held[0]

    def save(self, spark: SparkSession, data) -> None:  # noqa: ANN001
        if data is None or not isinstance(data, self.kind):
            raise TypeError(f"{self.key} takes {self.kind.__name__}, not {type(data).__name__}")
        with self._lock:
            self._held = (data,)

    def exists(self, spark: SparkSession) -> bool:
        return bool(self._held)

    def clear(self) -> None:
        with self._lock:
            self._held = ()
