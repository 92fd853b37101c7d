"""Sources and sinks: round trips, overwriting, inspections."""

from dataclasses import dataclass
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.schema import column, schema_of
from tessera.sources import BinaryObject, Catalog, CsvDataset, ExcelDataset, FileType, FrameSource, JsonDataset, JsonObject, MemoryDataset, MemoryObject, NoData, ParquetDataset, ReadOnlyError, TextObject, entry
from tessera.sources.workbooks import workbook
from tessera.validation import ErrorType, Level


@dataclass
class Row:
    id: int = column(alias="row_id")
    name: str | None = column()
    price: Decimal | None = column()
    ok: bool | None = column()


@dataclass
class Nested:
    id: int
    tags: list[str]
    scores: dict[str, float]
    inner: Row | None


DATA = [(1, "a,b", Decimal("1.5"), True), (2, None, None, False), (3, 'q"x', Decimal("-2"), None)]


def frame(spark, rows=DATA):
    return spark.createDataFrame(rows, schema_of(Row).struct)


def found(entry_, spark, level=Level.SHALLOW):
    return [e.type for e in entry_.inspect(spark, level).errors]


def test_schema():
    s = schema_of(Nested)
    assert not s.is_flat and s.struct.simpleString().startswith("struct<id:bigint,tags:array<string>,scores:map<string,double>,inner:struct<id:bigint")
    assert [c.nullable for c in schema_of(Row).columns] == [False, True, True, True] and schema_of(Row).columns[0].source_name == "row_id"
    with pytest.raises(TypeError, match="flat"):
        CsvDataset("x", Nested, "/tmp/x")


@pytest.mark.parametrize("make", [
    lambda p: ParquetDataset("d", Row, f"{p}/t"), lambda p: ParquetDataset("d", Row, f"{p}/t.parquet", one_file=True), lambda p: CsvDataset("d", Row, f"{p}/t.csv"),
    lambda p: CsvDataset("d", Row, f"{p}/t", one_file=False, options={"sep": "|"}), lambda p: JsonDataset("d", Row, f"{p}/t.json"),
    lambda p: JsonDataset("d", Row, f"{p}/m.json", minified=True), lambda p: JsonDataset("d", Row, f"{p}/l", lines=True), lambda p: MemoryDataset("d", Row),
])
def test_round_trip_and_overwrite(spark, tmp_path, make):
    d = make(tmp_path / "new")
    assert not d.exists(spark) and d.count(spark) == 0
    d.save(spark, frame(spark).coalesce(1))
    assert sorted(map(tuple, d.load(spark).collect())) == DATA and d.count(spark) == 3
    d.save(spark, d.load(spark).where("id < 3"))  # what is read may be overwritten
    assert d.count(spark) == 2 and d.inspect(spark, Level.DEEP).is_valid
    with pytest.raises(TypeError):
        d.save(spark, frame(spark).withColumn("id", F.lit("x")))
    with pytest.raises((TypeError, ValueError)):
        d.save(spark, None)
    if isinstance(d, MemoryDataset):
        d.clear()
        with pytest.raises(RuntimeError, match="not saved"):
            d.load(spark)


def test_json_forms(spark, tmp_path):
    d = JsonDataset("d", Row, f"{tmp_path}/t.json")
    d.save(spark, frame(spark).coalesce(1))
    text = (tmp_path / "t.json").read_text()
    assert text.startswith('[\n  {\n    "rowId": 1,\n    "name": "a,b"') and '"price": null' not in text
    JsonDataset("d", Row, f"{tmp_path}/m.json", minified=True).save(spark, frame(spark).limit(0))
    assert (tmp_path / "m.json").read_text() == "[]"


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("extra,OK,price,Name,row_id\nx,true,2.50,n,7\n")
    assert [tuple(r) for r in CsvDataset("d", Row, f"{tmp_path}/t.csv").load(spark).collect()] == [(7, "n", Decimal("2.5"), True)]
    (tmp_path / "e.csv").write_text("row_id,name,price,ok\n1,,,\n")
    assert CsvDataset("d", Row, f"{tmp_path}/e.csv").load(spark).first()["name"] is None

    @dataclass
    class Text:
        name: str

    assert CsvDataset("d", Text, f"{tmp_path}/e.csv", keep_empty=True).load(spark).first()["name"] == ""
    with pytest.raises(FileNotFoundError):
        CsvDataset("d", Text, f"{tmp_path}/no.csv").load(spark)


def test_csv_inspection(spark, tmp_path):
    def put(text):
        (tmp_path / "t.csv").write_text(text)
        return CsvDataset("d", Row, f"{tmp_path}/t.csv")

    assert found(CsvDataset("d", Row, f"{tmp_path}/no.csv"), spark) == [ErrorType.NOT_FOUND]
    assert found(put(""), spark) == [ErrorType.INVALID_FORMAT]
    assert found(put("row_id,name\n1,a\n"), spark) == [ErrorType.SCHEMA_MISMATCH]
    assert found(put("row_id,name,price,ok\n"), spark) == [ErrorType.EMPTY_DATASET]
    assert found(put("row_id,name,price,ok\nx,a,1,true\n"), spark) == [ErrorType.TYPE_MISMATCH]
    late = put("row_id,name,price,ok\n" + "1,a,1,true\n" * 200 + "x,a,1,true\n")
    assert found(late, spark) == [] and found(late, spark, Level.DEEP) == [ErrorType.DESERIALIZATION_ERROR]


def test_excel(spark, tmp_path):
    @dataclass
    class Cells:
        shuttle_id: str
        engines: str | None
        flag: str | None
        price: float | None

    d = ExcelDataset("d", Cells, f"{tmp_path}/t.xlsx")
    assert found(d, spark) == [ErrorType.NOT_FOUND]
    (tmp_path / "t.xlsx").write_bytes(workbook(["Price", "ShuttleId", "other", "ENGINES", "flag"], [[1.5, "s1", 0, 3, True], [None, "s<2>", 0, None, "t"], [None] * 5]))
    assert [tuple(r) for r in d.load(spark).collect()] == [("s1", "3", "TRUE", 1.5), ("s<2>", None, "t", None)]
    assert found(d, spark, Level.DEEP) == [] and found(ExcelDataset("d", Cells, f"{tmp_path}/t.xlsx", "Other"), spark) == [ErrorType.NOT_FOUND]
    assert found(ExcelDataset("d", Row, f"{tmp_path}/t.xlsx"), spark) == [ErrorType.SCHEMA_MISMATCH]
    with pytest.raises(ReadOnlyError):
        d.save(spark, d.load(spark))
    (tmp_path / "t.xlsx").write_bytes(workbook(["ShuttleId", "Engines", "Flag", "Price"], [["a", 1, "t", "much"]]))
    assert found(d, spark) == [ErrorType.TYPE_MISMATCH]
    (tmp_path / "t.xlsx").write_bytes(workbook(["ShuttleId", "Engines", "Flag", "Price"], []))
    assert found(d, spark) == [ErrorType.EMPTY_DATASET]
    (tmp_path / "t.xlsx").write_text("no workbook")
    assert found(d, spark) == [ErrorType.INVALID_FORMAT]


def test_json_inspection(spark, tmp_path):
    def put(text):
        (tmp_path / "t.json").write_text(text)
        return JsonDataset("d", Row, f"{tmp_path}/t.json")

    assert found(JsonDataset("d", Row, f"{tmp_path}/no.json"), spark) == [ErrorType.NOT_FOUND]
    assert found(put('{"rowId": 1}'), spark) == [ErrorType.INVALID_FORMAT] and found(put(" [ ]"), spark) == [ErrorType.EMPTY_DATASET]
    assert found(put('[{"rowId": 1'), spark) == [ErrorType.INVALID_FORMAT] and found(put('[{"rowId": 1}]'), spark, Level.DEEP) == []


@dataclass
class Metrics:
    r2_score: float
    note: str | None = None


def test_objects(spark, tmp_path):
    j = JsonObject("j", f"{tmp_path}/a/j.json", Metrics)
    assert found(j, spark) == [ErrorType.NOT_FOUND] and j.count(spark) == 0
    j.save(spark, Metrics(0.5))
    assert (tmp_path / "a/j.json").read_text() == '{\n  "r2Score": 0.5\n}' and j.load(spark) == Metrics(0.5) and j.count(spark) == 1
    (tmp_path / "a/j.json").write_text("null")
    assert found(j, spark) == [ErrorType.EMPTY_DATASET]
    t = TextObject("t", f"{tmp_path}/t.txt")
    t.save(spark, "é" * 5000)
    assert t.load(spark) == "é" * 5000 and found(t, spark, Level.DEEP) == []
    (tmp_path / "t.txt").write_bytes(b"\x89PNG\r\n\x1a\n")
    assert found(t, spark) == [ErrorType.INVALID_FORMAT]
    (tmp_path / "t.txt").write_bytes(b"\xff\xfeab")
    assert found(t, spark) == [ErrorType.TYPE_MISMATCH]
    (tmp_path / "t.txt").write_bytes(b"a" * 5000 + b"\xff")
    assert found(t, spark) == [] and found(t, spark, Level.DEEP) == [ErrorType.DESERIALIZATION_ERROR]
    b = BinaryObject("b", f"{tmp_path}/b.png", FileType.PNG)
    assert found(b, spark) == [ErrorType.NOT_FOUND]
    b.save(spark, b"GIF89a")
    assert found(b, spark) == [ErrorType.INVALID_FORMAT] and b.load(spark) == b"GIF89a"
    m = MemoryObject("m", dict)
    with pytest.raises(RuntimeError):
        m.load(spark)
    m.save(spark, {"a": 1})
    with pytest.raises(TypeError):
        m.save(spark, [1])
    assert m.load(spark) == {"a": 1}
    m.clear()
    assert m.count(spark) == 0


def test_parquet_inspection(spark, tmp_path):
    d = ParquetDataset("d", Row, f"{tmp_path}/t")
    d.save(spark, frame(spark).limit(0))
    assert found(d, spark) == [ErrorType.EMPTY_DATASET] and found(ParquetDataset("d", Nested, f"{tmp_path}/t"), spark) == [ErrorType.SCHEMA_MISMATCH]
    d.save(spark, frame(spark).coalesce(1))
    part = next(p for p in (tmp_path / "t").glob("*.parquet"))
    data = part.read_bytes()
    part.write_bytes(data[:4] + b"x" * (len(data) - 4))
    assert found(d, spark) == [ErrorType.INVALID_FORMAT]


def test_catalog(spark):
    made = []

    class Own(Catalog):
        @entry
        def first(self):
            made.append(1)
            return MemoryDataset("first", Row)

        @entry
        def second(self):
            return FrameSource("second", Row, frame)

    c = Own("base", extra=5)
    assert c.first is c.first and made == [1] and list(c.entries()) == ["first", "second"] and c.extra == 5 and c.path("a", "b") == "base/a/b"
    assert c.second.count(spark) == 3 and c.second.inspect(spark, Level.SHALLOW).is_valid
    c.clear()
    assert c.first and made == [1, 1]
    assert NoData.output().key != NoData.output().key and NoData.input().count(spark) == 1 and NoData.input().load(spark).count() == 1
