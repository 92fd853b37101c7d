"""Tables in Parquet, CSV, JSON and Excel files, in memory, and nowhere."""

from __future__ import annotations

import io
import json
import re
import threading
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import storage
from tessera.schema import Schema, schema_of
from tessera.shipping import on_workers
from tessera.sources import files
from tessera.sources.base import SAMPLE, SPARK_ERRORS, Dataset, ReadOnlyDataset
from tessera.validation import ErrorType, ValidationResult


#: Where Spark puts a table's schema in a Parquet file's footer.
_ROW_METADATA = "org.apache.spark.sql.parquet.row.metadata"


def _footer(spark: SparkSession, path: str) -> tuple[StructType | None, bool]:
    """The schema that a Parquet file's footer names, None if another program wrote it, and whether the file has rows. Read
    by the driver: no job is needed for it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(where)
    try:
        named = reader.getFooter().getFileMetaData().getKeyValueMetaData().get(_ROW_METADATA)
        return StructType.fromJson(json.loads(named)) if named else None, reader.getRecordCount() > 0
    finally:
        reader.close()


class ParquetDataset(Dataset):
    """A Parquet folder, or with ``one_file`` a single Parquet file. ``partition_by`` parts the folder by columns."""

    cheap_count = True
    reads_when_saved = True

    def __init__(self, key: str, schema: type | Schema, path: str, one_file: bool = False) -> None:
        super().__init__(key, schema, path)
        self.one_file = one_file

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema.struct).parquet(self.path)

    def save(self, spark: SparkSession, data: DataFrame) -> None:
        files.write_frame(spark, self.check(data), self.path, "parquet", self.one_file)

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        if not self.exists(spark):
            return self.fail(ErrorType.NOT_FOUND, f"{self.path} does not exist")
        if files.head(spark, self.path, 4) != b"PAR1":
            return self.fail(ErrorType.INVALID_FORMAT, "the file does not begin as Parquet does")
        try:
            found, filled = _footer(spark, files.data_files(spark, self.path)[0])
            found = spark.read.parquet(self.path).schema if found is None else found
            there = {f.name: f.dataType.simpleString() for f in found}
        except SPARK_ERRORS as e:
            return ValidationResult.from_exception(self.key, e, ErrorType.INVALID_FORMAT)
        missing = [c.name for c in self.schema.columns if c.name not in there]
        if missing:
            return self.fail(ErrorType.SCHEMA_MISMATCH, f"missing columns: {', '.join(missing)}")
        wrong = [f"{c.name}: {there[c.name]}, not {c.type.simpleString()}" for c in self.schema.columns if there[c.name] != c.type.simpleString()]
        if wrong:
            return self.fail(ErrorType.TYPE_MISMATCH, "columns have other types", "\n".join(wrong))
        if not filled and not self.load(spark).limit(1).collect():
            return self.fail(ErrorType.EMPTY_DATASET, "there are no rows")
        return ValidationResult.success()

    def inspect_deep(self, spark: SparkSession) -> ValidationResult:
        found = self.inspect_shallow(spark, 100)
        if found.is_valid:
            try:
                self.load(spark).write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001  whatever a damaged page raises
                return ValidationResult.from_exception(self.key, e, ErrorType.DESERIALIZATION_ERROR)
        return found


#: Bytes in which a header is looked for.
HEADER_BYTES = 4096


def _plain_header(start: bytes, options: dict[str, str]) -> list[str] | None:
    """The names in a first line that needs no CSV parser: ASCII, unquoted, none empty or twice. None for any other, and if
    the options are more than a separator."""
    if {k.lower() for k in options} - {"header", "sep"} or str(options.get("header")).lower() != "true" or b"\n" not in start:
        return None
    line = start.partition(b"\n")[0].removesuffix(b"\r")
    if not line.isascii() or any(c < 32 and c != 9 for c in line) or any(c in line for c in b'"\\`#'):
        return None
    names = line.decode().split(options.get("sep", ","))
    plain = all(n and n == n.strip() for n in names) and len({n.lower() for n in names}) == len(names)
    return names if plain else None


class CsvDataset(Dataset):
    """CSV with a header, read by column name: the order of columns and further columns don't matter.

    ``options`` go to Spark's CSV reader and writer (sep, quote, escape, encoding ...). Empty fields are null; with
    ``keep_empty`` they stay empty texts. ``one_file`` (the default) makes a single file, joined from those that all tasks
    write; turn it off for large tables.
    """

    reads_when_saved = True

    def __init__(
        self, key: str, schema: type | Schema, path: str, options: dict[str, str] | None = None, keep_empty: bool = False, one_file: bool = True
    ) -> None:
        super().__init__(key, schema, path)
        self.schema.require_flat("CSV")
        self.options = {"header": "true", **(options or {})}
        self.keep_empty, self.one_file = keep_empty, one_file

    def raw(self, spark: SparkSession) -> DataFrame:
        """All columns as texts. A plain header is read from the file's start, which saves Spark a job; any other is left to
        Spark."""
        names = _plain_header(files.head(spark, self.path, HEADER_BYTES), self.options)
        reader = spark.read.options(**self.options)
        return reader.schema(", ".join(f"`{n}` string" for n in names)).csv(self.path) if names else reader.csv(self.path)

    def texts(self, spark: SparkSession) -> DataFrame:
        """The declared columns as texts, found by name in any case; an error if one is missing."""
        rows = self.raw(spark)
        by_name = {c.strip().lower(): c for c in reversed(rows.columns)}
        missing = [c.source_name for c in self.schema.columns if c.source_name.lower() not in by_name]
        if missing:
            raise KeyError(f"missing columns: {', '.join(missing)}")
        found = {c.name: rows[f"`{by_name[c.source_name.lower()]}`"] for c in self.schema.columns}
        if self.keep_empty:
            found |= {c.name: F.coalesce(found[c.name], F.lit("")) for c in self.schema.columns if c.type.simpleString() == "string"}
        return rows.select(*(v.alias(k) for k, v in found.items()))

    def load(self, spark: SparkSession) -> DataFrame:
        if not self.exists(spark):
            raise FileNotFoundError(self.path)
        return self.texts(spark).select(*(F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in self.schema.columns))

    def save(self, spark: SparkSession, data: DataFrame) -> None:
        named = self.check(data).toDF(*(c.source_name for c in self.schema.columns))
        files.write_frame(spark, named, self.path, "csv", self.one_file, **self.options)

    def _inspect(self, spark: SparkSession, limit: int | None) -> ValidationResult:
        if not self.exists(spark):
            return self.fail(ErrorType.NOT_FOUND, f"{self.path} does not exist")
        if not files.head(spark, self.path, 4096).strip():
            return self.fail(ErrorType.INVALID_FORMAT, "there is no header")
        try:
            texts = self.texts(spark)
        except KeyError as e:
            return self.fail(ErrorType.SCHEMA_MISMATCH, e.args[0])
        try:
            return self.misfits(texts, limit) or ValidationResult.success()
        except SPARK_ERRORS as e:
            return ValidationResult.from_exception(self.key, e, ErrorType.INVALID_FORMAT if limit else ErrorType.DESERIALIZATION_ERROR)

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        return self._inspect(spark, sample)

    def inspect_deep(self, spark: SparkSession) -> ValidationResult:
        found = self._inspect(spark, 100)
        return self._inspect(spark, None) if found.is_valid else found


def _indented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["  " + json.dumps(json.loads(x.as_py()), indent=2, ensure_ascii=False).replace("\n", "\n  ") for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])


def camel_case(name: str) -> str:
    """``review_scores`` and ``ReviewScores`` become ``reviewScores``."""
    first, *rest = name.split("_")
    return first[:1].lower() + first[1:] + "".join(w[:1].upper() + w[1:] for w in rest)


class JsonDataset(Dataset):
    """A file that holds one JSON array of objects: camel-case names, nulls left out, indented by two unless ``minified``.

    All tasks write their objects, and their files are joined into one. With ``lines`` the path is a folder of JSON lines
    instead; use it for large tables.
    """

    reads_when_saved = True

    def __init__(self, key: str, schema: type | Schema, path: str, minified: bool = False, lines: bool = False) -> None:
        super().__init__(key, schema, path)
        self.minified, self.lines = minified, lines

    def load(self, spark: SparkSession) -> DataFrame:
        if not self.exists(spark):
            raise FileNotFoundError(self.path)
        struct = schema_of(self.schema.struct).struct
        for f, c in zip(struct.fields, self.schema.columns, strict=True):
            f.name, f.nullable = camel_case(c.source_name), True
        rows = spark.read.schema(struct).option("multiLine", not self.lines).option("mode", "FAILFAST").json(self.path)
        return rows.toDF(*(c.name for c in self.schema.columns))

    def save(self, spark: SparkSession, data: DataFrame | None) -> None:
        if data is None:
            raise ValueError(f"{self.key}: no data")
        named = self.check(data).toDF(*(camel_case(c.source_name) for c in self.schema.columns))
        if self.lines:
            files.write_frame(spark, named, self.path, "json", False)
            return
        rows, separator = named.select(F.to_json(F.struct("*")).alias("value")), ","
        if not self.minified:
            rows, separator = rows.mapInArrow(_indented, "value string"), ",\n"
        beside = f"{self.path.rpartition('/')[0] or '.'}/.{uuid.uuid4().hex}.tmp"
        try:
            rows.write.option("lineSep", separator).text(beside)
            parts = files.data_files(spark, beside)
            some = any(files.head(spark, p, 1) for p in parts)
            start, end = (b"[\n", b"\n]") if some and not self.minified else (b"[", b"]")
            files.join_files(spark, parts, self.path, start, end, len(separator))
        finally:
            files.delete(spark, beside)

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        if not self.exists(spark):
            return self.fail(ErrorType.NOT_FOUND, f"{self.path} does not exist")
        start = files.head(spark, self.path, 4096).decode("utf-8", "replace").lstrip("﻿ \t\r\n")
        if not self.lines:
            if not start.startswith("["):
                return self.fail(ErrorType.INVALID_FORMAT, "the root is not an array")
            if start[1:].lstrip().startswith("]"):
                return self.fail(ErrorType.EMPTY_DATASET, "the array is empty")
        try:
            if not self.load(spark).limit(sample).collect():
                return self.fail(ErrorType.EMPTY_DATASET, "there are no rows")
        except SPARK_ERRORS as e:
            return ValidationResult.from_exception(self.key, e, ErrorType.INVALID_FORMAT)
        return ValidationResult.success()

    def inspect_deep(self, spark: SparkSession) -> ValidationResult:
        found = self.inspect_shallow(spark, 100)
        if found.is_valid:
            try:
                self.load(spark).write.format("noop").mode("overwrite").save()
            except SPARK_ERRORS as e:
                return ValidationResult.from_exception(self.key, e, ErrorType.DESERIALIZATION_ERROR)
        return found


def pascal_case(name: str) -> str:
    """``shuttle_type`` becomes ``ShuttleType``."""
    return "".join(w[:1].upper() + w[1:].lower() for w in name.split("_"))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts; whole numbers without a fraction, flags as TRUE or FALSE, blank cells None.

    Raises KeyError if there is no such sheet and ValueError if the content is no workbook."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"not a workbook: {e}") from e
    targets = {r.get("Id"): r.get("Target") for r in links}
    found = next((targets[s.get(_REL)] for s in names.iter(f"{_SHEET}sheet") if s.get("name") == sheet), None)
    if found is None:
        raise KeyError(f"there is no sheet {sheet}")
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
    for _, element in ElementTree.iterparse(book.open(found.lstrip("/") if found.startswith("/") else f"xl/{found}")):
        if element.tag != f"{_SHEET}row":
            continue
        row: list[str | None] = []
        for cell in element.iter(f"{_SHEET}c"):
            letters = re.match("[A-Z]*", cell.get("r") or "")[0]
            place = len(row)
            if letters:
                place = 0
                for c in letters:
                    place = place * 26 + ord(c) - 64
                place -= 1
            row += [None] * (place - len(row))
            value, kind = cell.find(f"{_SHEET}v"), cell.get("t")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            elif value is None or value.text is None:
                text = None
            elif kind == "s":
                text = shared[int(value.text)]
            elif kind == "b":
                text = "TRUE" if value.text == "1" else "FALSE"
            elif kind in ("str", "e", "d"):
                text = value.text
            else:
                number = float(value.text)
                text = str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
            row.append(text if text != "" else None)
        yield row
        element.clear()


#: Workbooks up to this size are sampled by the driver.
DRIVER_BYTES = 16 << 20


def declared_rows(content: bytes, sheet: str, columns: list[tuple[str, str]]) -> Iterator[list[str | None]]:
    """The values of the declared columns (name, name in the source) of each row that isn't blank."""
    rows = sheet_rows(content, sheet)
    header = [(x or "").strip().lower() for x in next(rows, [])]
    at = []
    for name, source in columns:
        tries = (source.lower(), name.lower(), pascal_case(source).lower())
        at.append(next((header.index(t) for t in tries if t in header), None))
    if missing := [c[1] for c, i in zip(columns, at, strict=True) if i is None]:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    yield from ([None if i >= len(r) else r[i] for i in at] for r in rows if any(x is not None for x in r))


class ExcelDataset(ReadOnlyDataset):
    """A sheet of a workbook (or of all workbooks of a folder), read-only. The first row has the column names, matched in
    any case, and with ``snake_case`` as ``SnakeCase``. Each workbook is one task's work."""

    def __init__(self, key: str, schema: type | Schema, path: str, sheet: str = "Sheet1") -> None:
        super().__init__(key, schema, path)
        self.schema.require_flat("Excel")
        self.sheet = sheet

    def texts(self, spark: SparkSession) -> DataFrame:
        """The declared columns as texts."""
        sheet, columns = self.sheet, [(c.name, c.source_name) for c in self.schema.columns]

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    values = declared_rows(content.as_py(), sheet, columns)
                    while part := list(islice(values, 4096)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, pa.string()) for x in zip(*part, strict=True)], names=[c[0] for c in columns]
                        )

        on_workers(spark)
        raw = spark.read.format("binaryFile").load(self.path).select("content")
        return raw.mapInArrow(parse, ", ".join(f"`{c.name}` string" for c in self.schema.columns))

    def first_texts(self, spark: SparkSession, limit: int) -> DataFrame:
        """The first rows as texts. Those of a single workbook of moderate size are read by the driver, only so far as they
        go; of others by a task for each workbook."""
        if files.data_files(spark, self.path) != [self.path] or files.size(spark, self.path) > DRIVER_BYTES:
            return self.texts(spark).limit(limit)
        columns = [(c.name, c.source_name) for c in self.schema.columns]
        rows = list(islice(declared_rows(files.read_bytes(spark, self.path), self.sheet, columns), limit))
        return spark.createDataFrame(pa.table({c[0]: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(columns)}))

    def load(self, spark: SparkSession) -> DataFrame:
        return self.texts(spark).select(*(F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in self.schema.columns))

    def _inspect(self, spark: SparkSession, limit: int | None) -> ValidationResult:
        if not self.exists(spark):
            return self.fail(ErrorType.NOT_FOUND, f"{self.path} does not exist")
        if files.head(spark, self.path, 2) != b"PK":
            return self.fail(ErrorType.INVALID_FORMAT, "not a workbook")
        try:
            texts = self.texts(spark) if limit is None else self.first_texts(spark, limit)
            return self.misfits(texts, limit) or ValidationResult.success()
        except (*SPARK_ERRORS, KeyError, ValueError) as e:
            for mark, kind in (("there is no sheet", ErrorType.NOT_FOUND), ("missing columns", ErrorType.SCHEMA_MISMATCH), ("not a workbook", ErrorType.INVALID_FORMAT)):
                if found := re.search(f"{mark}[^'\"\n]*", str(e)):
                    return self.fail(kind, found[0])
            raise

    def inspect_shallow(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        return self._inspect(spark, sample)

    def inspect_deep(self, spark: SparkSession) -> ValidationResult:
        found = self._inspect(spark, 100)
        return self._inspect(spark, None) if found.is_valid else found


class MemoryDataset(Dataset):
    """A table for the time of the run; saving computes it. It is held as files in the shared folder, not in executors: it
    is never computed again, from inputs that may have been replaced meanwhile, when an executor is lost."""

    cheap_count = True
    reads_when_saved = True

    def __init__(self, key: str, schema: type | Schema) -> None:
        super().__init__(key, schema)
        self._lock, self._at = threading.Lock(), None

    def load(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            if self._at is None:
                raise RuntimeError(f"{self.key} was not saved before it was loaded")
            return spark.read.schema(self.schema.struct).parquet(self._at)

    def save(self, spark: SparkSession, data: DataFrame) -> None:
        path = storage.new_folder(spark, "memory")
        self.check(data).write.parquet(path)
        with self._lock:
            old, self._at, self._spark = self._at, path, spark
        if old is not None:
            storage.delete(spark, old)

    def exists(self, spark: SparkSession) -> bool:
        return self._at is not None

    def count(self, spark: SparkSession) -> int:
        return self.load(spark).count() if self._at is not None else 0

    def clear(self) -> None:
        with self._lock:
            if self._at is not None:
                storage.delete(self._spark, self._at)
            self._at = None


class NullDataset(Dataset):
    """Loads one empty row, takes and drops anything; always there."""

    cheap_count = True

    def __init__(self, key: str) -> None:
        super().__init__(key, schema_of(_NOTHING))

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(F.lit(True).alias("nothing"))

    def save(self, spark: SparkSession, data: DataFrame | None) -> None:
        if isinstance(data, DataFrame):
            data.write.format("noop").mode("overwrite").save()

    def exists(self, spark: SparkSession) -> bool:
        return True

    def count(self, spark: SparkSession) -> int:
        return 1


_NOTHING = Schema("NoData", ())


class FrameSource(ReadOnlyDataset):
    """A read-only table from a function of the session: another format, a database, a service."""

    def __init__(self, key: str, schema: type | Schema, make, is_there=lambda spark: True) -> None:  # noqa: ANN001
        super().__init__(key, schema)
        self.make, self.is_there = make, is_there

    def load(self, spark: SparkSession) -> DataFrame:
        return self.check(self.make(spark))

    def exists(self, spark: SparkSession) -> bool:
        return bool(self.is_there(spark))
