"""Queries whose rows are outcomes: of inspections, of the rules of entries, pipelines and applications, and of runs."""

from __future__ import annotations

import base64
import datetime
import io
import json
import os
import re
import tempfile
from collections.abc import Callable, Sequence
from contextlib import redirect_stderr, redirect_stdout
from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import reporting
from tessera.app import Application, ApplicationBuilder
from tessera.app import config as configuration
from tessera.functions import is_blank
from tessera.meta import dag, from_json, to_json, to_mermaid
from tessera.meta.exporters import STAMP, MetadataOptions, export
from tessera.operators import models, tables
from tessera.plans import Constant, Execution, Node, PassThrough, Pipeline, PipelineBuilder
from tessera.plans.results import format_result
from tessera.registry import folder, query, table
from tessera.samples import fleet
from tessera.schema import schema_of
from tessera.sources import (
    BinaryObject, Catalog, CsvDataset, ExcelDataset, FileType, FrameSource, JsonDataset, JsonObject, MemoryDataset, MemoryObject, NoData, ParquetDataset, TextObject,
    detect_file_type, entry, files,
)
from tessera.sources.base import Dataset, ReadOnlyDataset
from tessera.sources.objects import plain
from tessera.sources.tables import camel_case, pascal_case
from tessera.sources.workbooks import workbook
from tessera.validation import ErrorType, Level, ValidationException, ValidationOptions, ValidationResult


def values(columns: str, *rows: Sequence[object]) -> str:
    """SQL of a constant table: what the rules say the outcomes are."""
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({columns})"


def outcomes(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """One row for each case: its name, and what it gives as text, or the name of the error that it raises. Reports that it
    prints are dropped."""
    rows = []
    for name, run in cases.items():
        try:
            with redirect_stdout(io.StringIO()), redirect_stderr(io.StringIO()):
                found = run()
        except Exception as e:  # noqa: BLE001  the error is the outcome
            found = type(e).__name__
        rows.append((name, str(found)))
    return spark.createDataFrame(rows, "rule string, outcome string")


def inspected(spark: SparkSession, entries: Sequence, levels: Sequence[Level] = (Level.SHALLOW, Level.DEEP)) -> DataFrame:
    """The kinds of errors that inspections of entries find; ``Valid`` where there are none."""
    rows = []
    for e in entries:
        for level in levels:
            found = e.inspect(spark, level)
            rows += [(e.key, level.name.title(), str(x.type)) for x in found.errors] or [(e.key, level.name.title(), "Valid")]
    return spark.createDataFrame(rows, "key string, level string, type string")


def _twice(*rows: tuple[str, str, str]) -> str:
    return values("key, level, type", *[r for key, shallow, deep in rows for r in ((key, "Shallow", shallow), (key, "Deep", deep))])


# --- inspections ------------------------------------------------------------------------------------------------------


@dataclass
class Item:
    id: int
    name: str | None
    price: Decimal | None


def _text(spark: SparkSession, path: str, text: str) -> str:
    files.write_bytes(spark, path, [text.encode()])
    return path


@query(_twice(
    ("Good", "Valid", "Valid"), ("Reordered", "Valid", "Valid"), ("Piped", "Valid", "Valid"), ("Missing", "NotFound", "NotFound"), ("Blank", "InvalidFormat", "InvalidFormat"),
    ("NoColumn", "SchemaMismatch", "SchemaMismatch"), ("NoRows", "EmptyDataset", "EmptyDataset"), ("BadEarly", "TypeMismatch", "TypeMismatch"),
    ("BadLate", "Valid", "DeserializationError"),
))
def csv_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, good = folder(spark), "id,name,price\n" + "1,a,2.5\n" * 150
    make = lambda key, text, **more: CsvDataset(key, Item, _text(spark, f"{at}/{key}.csv", text), **more)
    return inspected(spark, [
        make("Good", good), make("Reordered", "extra,PRICE,Name,id\nx,2.50,n,7\n"), make("Piped", good.replace(",", "|"), options={"sep": "|"}), CsvDataset("Missing", Item, f"{at}/none.csv"),
        make("Blank", " \n"), make("NoColumn", "id,price\n1,2\n"), make("NoRows", "id,name,price\n"), make("BadEarly", "id,name,price\nx,a,1\n"), make("BadLate", good + "x,a,1\n"),
    ])


@query(_twice(
    ("Good", "Valid", "Valid"), ("Missing", "NotFound", "NotFound"), ("NoBook", "InvalidFormat", "InvalidFormat"), ("OtherSheet", "NotFound", "NotFound"),
    ("NoColumn", "SchemaMismatch", "SchemaMismatch"), ("NoRows", "EmptyDataset", "EmptyDataset"), ("BadLate", "Valid", "DeserializationError"),
))
def excel_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, names, rows = folder(spark), ["Id", "Name", "Price"], [[i, "a", 2.5] for i in range(150)]

    def make(key: str, header: Sequence[str], content: Sequence[Sequence[object]], sheet: str = "Sheet1") -> ExcelDataset:
        files.write_bytes(spark, f"{at}/{key}.xlsx", [workbook(header, content)])
        return ExcelDataset(key, Item, f"{at}/{key}.xlsx", sheet)

    _text(spark, f"{at}/NoBook.xlsx", "text")
    return inspected(spark, [
        make("Good", names, rows), ExcelDataset("Missing", Item, f"{at}/none.xlsx"), ExcelDataset("NoBook", Item, f"{at}/NoBook.xlsx"),
        make("OtherSheet", names, rows, "Sheet2"), make("NoColumn", ["Id", "Price"], [[1, 2.5]]), make("NoRows", names, []), make("BadLate", names, [*rows, ["x", "a", 1]]),
    ])


@query(_twice(
    ("Good", "Valid", "Valid"), ("Lines", "Valid", "Valid"), ("Missing", "NotFound", "NotFound"), ("NoArray", "InvalidFormat", "InvalidFormat"), ("Empty", "EmptyDataset", "EmptyDataset"),
    ("Broken", "InvalidFormat", "InvalidFormat"), ("Object", "Valid", "Valid"), ("NullObject", "EmptyDataset", "EmptyDataset"), ("BrokenObject", "InvalidFormat", "InvalidFormat"),
    ("OtherObject", "Valid", "DeserializationError"),
))
def json_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, row = folder(spark), '{"id": 1, "name": "a"}'
    make = lambda key, text, **more: JsonDataset(key, Item, _text(spark, f"{at}/{key}.json", text), **more)
    one = lambda key, text: JsonObject(key, _text(spark, f"{at}/{key}.json", text), fleet.SplitParams)
    return inspected(spark, [
        make("Good", f"[{row},\n{row}]"), make("Lines", f"{row}\n{row}\n", lines=True), JsonDataset("Missing", Item, f"{at}/none.json"), make("NoArray", row), make("Empty", " [ ]"),
        make("Broken", f"[{row}, {{"), one("Object", '{"testSize": 0.5}'), one("NullObject", "null"), one("BrokenObject", "{"), one("OtherObject", "[1]"),
    ])


@query(_twice(
    ("Text", "Valid", "Valid"), ("NoText", "NotFound", "NotFound"), ("Picture", "InvalidFormat", "InvalidFormat"), ("Program", "InvalidFormat", "InvalidFormat"),
    ("EmptyArchive", "InvalidFormat", "InvalidFormat"), ("BadEarly", "TypeMismatch", "TypeMismatch"), ("BadLate", "Valid", "DeserializationError"), ("Binary", "Valid", "Valid"),
    ("NoBinary", "NotFound", "NotFound"), ("OtherKind", "InvalidFormat", "InvalidFormat"), ("EmptyBinary", "Valid", "EmptyDataset"),
))
def object_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, png = folder(spark), b"\x89PNG\r\n\x1a\n...."

    def put(key: str, content: bytes) -> str:
        files.write_bytes(spark, f"{at}/{key}", [content])
        return f"{at}/{key}"

    text = lambda key, content: TextObject(key, put(key, content))
    return inspected(spark, [
        text("Text", "é text".encode()), TextObject("NoText", f"{at}/none"), text("Picture", png), text("Program", b"MZ\x90"), text("EmptyArchive", b"PK\x05\x06" + b"\0" * 18),
        text("BadEarly", b"a\xff\xfe"), text("BadLate", b"a" * 5000 + b"\xff"), BinaryObject("Binary", put("Binary", png), FileType.PNG), BinaryObject("NoBinary", f"{at}/none"),
        BinaryObject("OtherKind", put("OtherKind", png), FileType.PDF), BinaryObject("EmptyBinary", put("EmptyBinary", b"")),
    ])


class _Feed(ReadOnlyDataset):
    """A source of one's own, only read."""

    def __init__(self, key: str, rows: int, there: bool = True) -> None:
        super().__init__(key, schema_of(Item))
        self.rows, self.there = rows, there

    def load(self, spark: SparkSession) -> DataFrame:
        if self.rows < 0:
            raise OSError("the service does not answer")
        return spark.createDataFrame([(i, "a", None) for i in range(self.rows)], self.schema.struct)

    def exists(self, spark: SparkSession) -> bool:
        return self.there


class _Store(Dataset):
    """A source of one's own, read and written."""

    held: dict[str, DataFrame] = {}

    def load(self, spark: SparkSession) -> DataFrame:
        return self.held[self.key]

    def save(self, spark: SparkSession, data: DataFrame) -> None:
        self.held[self.key] = self.check(data)

    def exists(self, spark: SparkSession) -> bool:
        return self.key in self.held


@query(_twice(
    ("Rows", "Valid", "Valid"), ("NoRows", "EmptyDataset", "EmptyDataset"), ("NotThere", "NotFound", "NotFound"), ("Silent", "InspectionFailure", "InspectionFailure"),
    ("Frame", "Valid", "Valid"), ("Store", "Valid", "Valid"), ("NoStore", "NotFound", "NotFound"), ("Memory", "Valid", "Valid"), ("Nothing", "Valid", "Valid"),
))
def generic_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of one's own, and those without files."""
    regions = table(spark, sf_dir, "region")
    store, memory = _Store("Store", regions.schema), MemoryDataset("Memory", regions.schema)
    store.save(spark, regions)
    memory.save(spark, regions)
    nothing = NoData.input()
    nothing.key = "Nothing"
    return inspected(spark, [
        _Feed("Rows", 3), _Feed("NoRows", 0), _Feed("NotThere", 3, False), _Feed("Silent", -1), FrameSource("Frame", regions.schema, lambda s: table(s, sf_dir, "region")), store,
        _Store("NoStore", regions.schema), memory, nothing,
    ])


@query(values(
    "n, line", (0, "Validation failed with 3 error(s):"), (1, "Orders:"), (2, "  - [NotFound] there is no file"), (3, "  - [EmptyDataset] there are no rows"), (4, "      looked at 2 files"),
    (5, "Parts:"), (6, "  - [InspectionFailure] no answer"), (7, "      OSError"),
))
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged results as the lines of the exception that they raise."""
    found = ValidationResult.failure("Orders", ErrorType.NOT_FOUND, "there is no file").merge(ValidationResult.from_exception("Parts", OSError("no answer")))
    found = ValidationResult.success().merge(found).merge(ValidationResult.failure("Orders", ErrorType.EMPTY_DATASET, "there are no rows", "looked at 2 files"))
    try:
        found.raise_if_invalid()
    except ValidationException as e:
        return spark.createDataFrame(list(enumerate(str(e).splitlines())), "n int, line string")
    raise AssertionError("errors must raise")


@query(values(
    "rule, outcome", ("without any", "SHALLOW"), ("the entry's", "DEEP"), ("the pipeline's first", "NONE"), ("not to be inspected", "NONE"), ("merged", "DEEP"), ("nothing inspected", "True"),
    ("external inputs", "Customer, Nation"),
))
def inspection_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which level an entry is inspected at, and which entries are."""
    make = lambda name: ParquetDataset(name.title(), table(spark, sf_dir, name).schema, f"{sf_dir}/{name}.parquet")
    plain_, deep, never = make("nation"), make("customer").with_inspection_level(Level.DEEP), make("region")
    never.can_inspect = False
    options = ValidationOptions().inspect(deep, Level.NONE)
    between = MemoryDataset("Between", plain_.schema)
    steps = PipelineBuilder("p").add_node(lambda a, b: a, {"a": deep, "b": plain_}, MemoryDataset("Out", deep.schema), "Use")
    steps.add_node(PassThrough(), plain_, between, "Copy").add_node(PassThrough(), between, MemoryDataset("Last", plain_.schema), "Again")
    return outcomes(spark, {
        "without any": lambda: options.level_of(plain_).name, "the entry's": lambda: ValidationOptions().level_of(deep).name, "the pipeline's first": lambda: options.level_of(deep).name,
        "not to be inspected": lambda: options.level_of(never).name, "merged": lambda: options.merged([{"Customer": Level.DEEP}, {"Customer": Level.SHALLOW}]).level_of(deep).name,
        "nothing inspected": lambda: ParquetDataset("x", plain_.schema, "/none").inspect(spark, Level.NONE).is_valid,
        "external inputs": lambda: ", ".join(e.key for e in steps.build().external_inputs),
    })


# --- entries ----------------------------------------------------------------------------------------------------------


class _Sales(Catalog):
    @entry
    def nations(self) -> ParquetDataset:
        return ParquetDataset("Nations", self.schemas["nation"], self.path("nation.parquet"))

    @entry
    def held(self) -> MemoryDataset:
        return MemoryDataset("Held", self.schemas["nation"])


@query(values(
    "rule, outcome", ("made once", "True"), ("all entries", "nations, held"), ("made anew after clear", "True"), ("blank key", "ValueError"), ("rows of another type", "TypeError"), ("no table", "TypeError"),
    ("only read", "ReadOnlyError"), ("load before save", "RuntimeError"), ("object before save", "RuntimeError"), ("object of another type", "TypeError"), ("cleared", "False"), ("nothing loads", "1"), ("nothing saved", "True"),
    ("nested rows in CSV", "TypeError"), ("missing file", "FileNotFoundError"), ("null value", "ValueError"), ("bad text", "UnicodeDecodeError"), ("paths", "base/raw/a.csv"),
))
def entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What catalogs and entries allow, and what they refuse."""
    at, nation = folder(spark), table(spark, sf_dir, "nation")
    catalog = _Sales(sf_dir, schemas={"nation": nation.schema})
    memory, one = MemoryDataset("m", nation.schema), MemoryObject("o", int)
    nested = spark.createDataFrame([], "a array<string>").schema

    def anew() -> bool:
        before = catalog.nations
        catalog.clear()
        return before is not catalog.nations

    def cleared() -> bool:
        memory.save(spark, nation)
        memory.clear()
        return memory.exists(spark)

    def saved_nowhere() -> bool:
        port = NoData.output()
        port.save(spark, nation)
        return port.exists(spark)

    files.write_bytes(spark, f"{at}/bad", [b"\xff"])
    return outcomes(spark, {
        "made once": lambda: catalog.nations is catalog.nations, "all entries": lambda: ", ".join(catalog.entries()), "made anew after clear": anew, "blank key": lambda: MemoryDataset(" ", nation.schema),
        "rows of another type": lambda: memory.save(spark, nation.withColumn("n_name", F.lit(1))), "no table": lambda: memory.save(spark, 5), "only read": lambda: _Feed("f", 1).save(spark, nation),
        "load before save": lambda: memory.load(spark), "object before save": lambda: one.load(spark), "object of another type": lambda: one.save(spark, "x"), "cleared": cleared,
        "nothing loads": lambda: NoData.input().load(spark).count(), "nothing saved": saved_nowhere, "nested rows in CSV": lambda: CsvDataset("c", nested, at), "missing file": lambda: CsvDataset("c", nation.schema, f"{at}/none").load(spark),
        "null value": lambda: JsonObject("j", at).save(spark, None), "bad text": lambda: TextObject("t", f"{at}/bad").load(spark), "paths": lambda: Catalog("base/").path("raw", "a.csv"),
    })


@query("""
SELECT 'json' AS kind, CAST(count(*) AS VARCHAR) || ' ' || CAST(min(o_custkey) AS VARCHAR) AS content FROM orders
UNION ALL SELECT 'memory', CAST(max(o_custkey) AS VARCHAR) FROM orders
UNION ALL SELECT 'text', string_agg(n_name, chr(10) ORDER BY n_nationkey) FROM nation
UNION ALL SELECT 'binary', base64(encode(string_agg(r_name, '/' ORDER BY r_regionkey))) FROM region
""")
def single_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of tables through single objects and back."""
    at = folder(spark)
    found = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("order_count"), F.min("o_custkey").alias("least"), F.max("o_custkey").alias("most")).first()
    nations, regions = (
        [r[0] for r in table(spark, sf_dir, t).orderBy(k).select(n).collect()] for t, k, n in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))
    )
    one = JsonObject("j", f"{at}/deep/j.json")
    one.save(spark, {"order_count": found["order_count"], "least": found["least"], "none": None})
    held = MemoryObject("m", int)
    held.save(spark, found["most"])
    text, binary = TextObject("t", f"{at}/t.txt"), BinaryObject("b", f"{at}/b.bin")
    text.save(spark, "\n".join(nations))
    binary.save(spark, "/".join(regions).encode())
    back = one.load(spark)
    rows = [
        ("json", f"{back['orderCount']} {back['least']}"), ("memory", str(held.load(spark))), ("text", text.load(spark)), ("binary", base64.b64encode(binary.load(spark)).decode()),
    ]
    return spark.createDataFrame(rows, "kind string, content string")


@query("SELECT r_regionkey * 2 AS doubled, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def own_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that only is read and one that is written too, of one's own, in a pipeline."""
    schema = spark.createDataFrame([], "doubled int, r_name string").schema
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 2).cast("int").alias("doubled"), "r_name")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("doubled"), F.col("n_name").alias("r_name"))
    feed, out = FrameSource("Feed", schema, lambda s: regions), _Store("Out", schema)
    PipelineBuilder("p").add_node(lambda data: tables.concatenated(data, nations), feed, out, "Add").build().execute(spark)
    return out.load(spark)


@query(values(
    "rule, outcome", ("camel", "reviewScoresRating"), ("camel of Pascal", "reviewScores"), ("Pascal", "ShuttleType"), ("label", "Train Model"), ("lower", "istanbul"), ("node id", "A_Copy_Of_x"),
    ("file name", "dag-a_b_c.json"), ("stamp", "2024-03-05-07-08-09"), ("plain", '{"aB": 1, "c": [1, 2]}'), ("blank", "True True False"), ("columns", "common a; left b; right c"),
    ("single of none", "ValueError"), ("single of two", "ValueError"), ("single", "7"), ("first", "0"),
))
def names_and_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in other spellings, columns compared in any case, single and first rows."""
    graph = {"pipelineName": "p", "generatedAt": "", "nodes": [{"id": "A Copy.Of-x", "label": "Train Model", "nodeType": "n", "layer": 0, "pipelineName": "p", "inputs": [], "outputs": []}], "catalogEntries": [], "edges": []}
    shown = to_mermaid(graph)

    def file_name() -> str:
        with tempfile.TemporaryDirectory() as at:
            built = PipelineBuilder("a/b:c").add_node(lambda: None, None, NoData.output(), "N").build()
            return export(built, MetadataOptions(at, mermaid=False))[0].name

    def compared() -> str:
        found = tables.column_differences(["A", "b"], ["a", "C"])
        return "; ".join(f"{k.removesuffix('_only')} {', '.join(v)}" for k, v in found.items())

    blank = spark.range(1).select(is_blank(F.lit(None)), is_blank(F.lit(" \t")), is_blank(F.lit("x"))).first()
    ten = spark.range(10)
    return outcomes(spark, {
        "camel": lambda: camel_case("review_scores_rating"), "camel of Pascal": lambda: camel_case("ReviewScores"), "Pascal": lambda: pascal_case("shuttle_type"),
        "label": lambda: re.search(r'\["(Train Model)"\]', shown)[1], "lower": lambda: spark.range(1).select(F.lower(F.lit("ISTANBUL"))).first()[0], "node id": lambda: re.search(r"(A_\w+)\[", shown)[1],
        "file name": file_name, "stamp": lambda: datetime.datetime(2024, 3, 5, 7, 8, 9).strftime(STAMP), "plain": lambda: json.dumps(plain({"a_b": 1, "c": (1, 2), "d": None})),  # noqa: DTZ001
        "blank": lambda: " ".join(map(str, blank)), "columns": compared, "single of none": lambda: tables.single(ten.limit(0)), "single of two": lambda: tables.single(ten),
        "single": lambda: tables.single(ten.where("id = 7"))["id"], "first": lambda: tables.take(ten, 1, ["id"]).first()["id"],
    })


# --- pipelines --------------------------------------------------------------------------------------------------------


class _Doubled(Node):
    """A node of a class without arguments."""

    def transform(self, data: DataFrame) -> DataFrame:
        return data.select((F.col("r_regionkey") * 2).alias("r_regionkey"), "r_name")


@query(values(
    "rule, outcome", ("two producers", "PipelineError"), ("a cycle", "PipelineError"), ("two nodes of a name", "PipelineError"), ("an input not mapped", "PipelineError"), ("an unknown input", "PipelineError"),
    ("a constant as output", "PipelineError"), ("a read-only output", "ReadOnlyError"), ("other rows passed through", "PipelineError"), ("not built", "PipelineError"), ("built twice", "True"), ("merged", "a.N, b.N"),
    ("one value unwrapped", "5"), ("two values", "ValueError"), ("several outputs", "3 7"), ("an output not given", "KeyError"), ("a node by its class", "0, 2, 4, 6, 8"), ("a node tried alone", "5"),
    ("failure stops", "False 1"), ("failure of one in a layer", "False 2"), ("parallel", "True 2"), ("a constant", "6"), ("layers", "0 1 1"),
))
def pipeline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pipelines allow when they are built, and what they do when they run."""
    region = table(spark, sf_dir, "region")
    make = lambda name: MemoryDataset(name, region.schema)
    source = ParquetDataset("Region", region.schema, f"{sf_dir}/region.parquet")
    a, b = make("a"), make("b")
    started = lambda: PipelineBuilder("p")
    same = lambda data: data
    number = MemoryObject("number", int)

    def fail(data: DataFrame) -> DataFrame:
        raise ArithmeticError("no")

    def kept(node: Callable, inputs: object = None, out: object = number) -> object:
        started().add_node(node, inputs, out, "N").build().execute(spark)
        return out.load(spark)

    def built_twice() -> bool:
        made = started().add_node(same, source, a, "N").build()
        return made.build() is made and len(made.layers) == 1

    def several() -> str:
        outs = {"x": MemoryObject("x", int), "y": MemoryObject("y", int)}
        started().add_node(lambda: {"x": 3, "y": 7}, None, outs, "N").build().execute(spark)
        return " ".join(str(o.load(spark)) for o in outs.values())

    def ran(stop: bool, at_once: int, second: Callable) -> str:
        steps = started().add_node(second, source, a, "One").add_node(same, source, b, "Two").build()
        result = steps.run(spark, Execution(stop_on_first_error=stop, parallel_nodes=at_once))
        return f"{result.success} {len(result.nodes)}"

    def layers() -> str:
        steps = started().add_node(same, source, a, "One").add_node(same, a, b, "Two").add_node(same, a, make("c"), "Three").build()
        return " ".join(str(s.layer) for s in steps.steps)

    return outcomes(spark, {
        "two producers": lambda: started().add_node(same, source, a, "One").add_node(same, source, a, "Two").build(), "a cycle": lambda: started().add_node(same, a, b, "One").add_node(same, b, a, "Two").build(),
        "two nodes of a name": lambda: started().add_node(same, source, a, "N").add_node(same, source, b, "N"), "an input not mapped": lambda: started().add_node(lambda x, y: x, {"x": source}, a, "N"),
        "an unknown input": lambda: started().add_node(lambda x: x, {"x": source, "z": source}, a, "N"), "a constant as output": lambda: started().add_node(same, source, Constant(1), "N"),
        "a read-only output": lambda: started().add_node(same, source, _Feed("f", 1), "N"), "other rows passed through": lambda: started().add_node(PassThrough(), source, MemoryDataset("x", schema_of(Item)), "N"),
        "not built": lambda: Pipeline("p", []).external_inputs, "built twice": built_twice,
        "merged": lambda: ", ".join(s.name for s in Pipeline.merge({n: started().add_node(same, source, make(n), "N").build() for n in "ab"}).build().steps),
        "one value unwrapped": lambda: kept(lambda: [5]), "two values": lambda: kept(lambda: [5, 6]), "several outputs": several,
        "an output not given": lambda: started().add_node(lambda: {"x": 3}, None, {"x": MemoryObject("x", int), "y": MemoryObject("y", int)}, "N").build().execute(spark),
        "a node by its class": lambda: ", ".join(str(r[0]) for r in kept(_Doubled, source, make("d")).orderBy("r_regionkey").collect()), "a node tried alone": lambda: _Doubled().transform(region).count(),
        "failure stops": lambda: ran(True, 1, fail), "failure of one in a layer": lambda: ran(False, 1, fail), "parallel": lambda: ran(True, 2, same),
        "a constant": lambda: kept(lambda data, more: data.count() + more, {"data": source, "more": Constant(1)}), "layers": layers,
    })


@query(values(
    "n, line", (0, "Pipeline 'good' succeeded in T s"), (1, "  ✓ Copy T s (     5 →      5 records)"), (2, "Pipeline 'good': dry run, 1 node(s) in 1 layer(s), 1 external input(s) valid"),
    (3, "Pipeline 'bad' failed in T s"), (4, "  ✗ Fail T s (     5 →      - records)"), (5, "  ArithmeticError: no"), (6, "stack of 10 lines"),
))
def result_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of a run, a dry run and a failed run, without times."""
    region = table(spark, sf_dir, "region")
    source = ParquetDataset("Region", region.schema, f"{sf_dir}/region.parquet")

    def fail(data: DataFrame) -> DataFrame:
        def deeper(n: int) -> DataFrame:
            if n:
                return deeper(n - 1)
            raise ArithmeticError("no")

        return deeper(9)

    good = PipelineBuilder("good").add_node(PassThrough(), source, MemoryDataset("a", region.schema), "Copy").build()
    bad = PipelineBuilder("bad").add_node(fail, source, MemoryDataset("b", region.schema), "Fail").build()
    failed = format_result(bad.run(spark)).splitlines()
    lines = [*format_result(good.run(spark)).splitlines(), *format_result(good.dry_run()).splitlines(), *failed[:3], f"stack of {len(failed) - 3} lines"]
    shown = [re.sub(r"\s*\d+\.\d\d s", " T s", x) for x in lines]
    return spark.createDataFrame(list(enumerate(shown)), "n int, line string")


@query(values(
    "key, label, type, producer, consumers, fields", ("Orders", "Orders", "ParquetDataset", None, "Totals.Count", 6), ("Totals", "Totals", "MemoryDataset", "Totals.Count", "Report.Largest", 2),
    ("LargestTotal", "Largest Total", "MemoryObject", "Report.Largest", "", 0),
))
def dag_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a graph that went through JSON and back, with the fields of their schemas."""
    graph = dag(_totals(spark, sf_dir))
    back = from_json(to_json(graph, compact=True))
    rows = [
        (e["key"], e["label"], e["fields"]["catalogType"], e.get("producer"), ", ".join(e["consumers"]), len(e.get("schema", {}).get("fields", [])))
        for e in back["catalogEntries"]
    ]
    assert back == graph
    return spark.createDataFrame(rows, "key string, label string, type string, producer string, consumers string, fields int")


def _totals(spark: SparkSession, sf_dir: str) -> Pipeline:
    orders = ParquetDataset("Orders", table(spark, sf_dir, "orders").schema, f"{sf_dir}/orders.parquet")
    totals, largest = MemoryDataset("Totals", spark.createDataFrame([], "o_custkey long, n long").schema), MemoryObject("LargestTotal", int)
    count = PipelineBuilder("Totals").add_node(lambda data: data.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), orders, totals, "Count").build()
    report = PipelineBuilder("Report").add_node(lambda data: data.agg(F.max("n")).first()[0], totals, largest, "Largest").build()
    return Pipeline.merge({"Totals": count, "Report": report}).build()


@query(values("n, line", *enumerate((
    "```mermaid", "flowchart LR", "    %% External Data Inputs", '    Orders[("Orders")]', '    subgraph Report["Report"]', '        Report_Largest["Largest"]', '        LargestTotal[("Largest Total")]',
    "        Report_Largest --> LargestTotal", "    end", '    subgraph Totals["Totals"]', '        Totals_Count["Count"]', '        Totals[("Totals")]', "        Totals_Count --> Totals", "    end",
    "    %% External Data to Pipeline Edges", "    Orders --> Totals_Count", "    %% Cross-Pipeline Data Flow", "    Totals -.-> Report_Largest", "```",
))))
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = to_mermaid(dag(_totals(spark, sf_dir)), "LR")
    return spark.createDataFrame(list(enumerate(shown.splitlines())), "n int, line string")


@query(values(
    "rule, outcome", ("files", "dag-merged.json, dag-merged.md, dag-merged.txt"), ("compact", "True"), ("direction", "flowchart BT"), ("other direction", "ValueError"), ("own provider", "2 nodes"), ("no graph", "ValueError"),
    ("from a section", "out True False LR"), ("with a time", "True"),
))
def graph_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that graphs are written to."""
    pipeline = _totals(spark, sf_dir)
    with tempfile.TemporaryDirectory() as at:
        options = MetadataOptions(at, compact_json=True, direction="BT").add_provider("txt", lambda graph: f"{len(graph['nodes'])} nodes")
        made = {p.suffix: p.read_text("utf-8") for p in export(pipeline, options)}
        names = ", ".join(sorted(os.listdir(at)))
        stamped = export(pipeline, MetadataOptions(at, mermaid=False, timestamp=STAMP))[0].name
    found = MetadataOptions.from_config({"OutputDirectory": "out", "Providers": ["Json"], "Mermaid": {"Direction": "LR"}})
    return outcomes(spark, {
        "files": lambda: names, "compact": lambda: "\n" not in made[".json"], "direction": lambda: made[".md"].splitlines()[1], "other direction": lambda: to_mermaid(dag(pipeline), "XY"),
        "own provider": lambda: made[".txt"], "no graph": lambda: from_json("[]"), "from a section": lambda: f"{found.folder} {found.json} {found.mermaid} {found.direction}",
        "with a time": lambda: bool(re.fullmatch(r"dag-merged-\d{4}(-\d\d){5}\.json", stamped)),
    })


# --- applications -----------------------------------------------------------------------------------------------------


@dataclass
class CountParams:
    """Parameters of the pipelines below."""

    least: int = configuration.in_range(0, 100)
    name: str = "orders"


class ConfiguredCatalog(Catalog):
    """A catalog that a configuration can name."""


def counting(catalog: Catalog, params: CountParams) -> Pipeline:
    """Customers with so many orders at least."""
    spark = SparkSession.getActiveSession()
    schema = spark.createDataFrame([], "o_custkey long, n long").schema
    orders = ParquetDataset("Orders", spark.read.parquet(catalog.path("orders.parquet")).schema, catalog.path("orders.parquet"))
    count = lambda data: data.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= params.least)
    return PipelineBuilder("counting").add_node(count, orders, MemoryDataset(f"At least {params.least}", schema), "Count").build()


create = counting


@query("""
WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT 'Few.Count' AS node, true AS success, CAST((SELECT count(*) FROM t WHERE n >= 1) AS BIGINT) AS rows_out
UNION ALL SELECT 'Many.Count', true, CAST((SELECT count(*) FROM t WHERE n >= 12) AS BIGINT)
""")
def application_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pipelines of an application, run together."""
    app = Application.create(lambda b: b.use_catalog(Catalog(sf_dir)).register("Few", counting, CountParams(1)).register("Many", counting, CountParams(12)))
    with redirect_stdout(io.StringIO()):
        result = app.run_pipeline(spark)
    return result.to_frame(spark).select("node", "success", "rows_out")


@query(values(
    "rule, outcome", ("one", "0"), ("all", "0"), ("dry", "0"), ("unknown", "1"), ("no pipeline", "KeyError"), ("missing input", "1"), ("bad argument", "1"), ("failure raises", "ValidationException"),
    ("blank name", "ValueError"), ("name twice", "ValueError"), ("no catalog", "ConfigError"), ("nothing registered yet", "ValueError"), ("before configuration", "ConfigError"), ("described", "Counts. etl, daily DEEP"),
    ("registry", "One, Two"), ("catalog from services", "base"), ("execution", "3"), ("report", "counting is done"), ("exported", "dag-Count.json, dag-Count.md"),
))
def application_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes, registration, and what an application is configured with."""
    made = lambda configure: Application.create(configure)
    app = made(lambda b: b.use_catalog(Catalog(sf_dir)).register("Count", counting, CountParams(5)))
    app.formatter = lambda result: f"{result.name} is done"
    gone = lambda catalog: PipelineBuilder("g").add_node(lambda data: data, ParquetDataset("Gone", schema_of(Item), "/none"), MemoryDataset("x", schema_of(Item)), "N").build()
    missing = made(lambda b: b.use_catalog(Catalog(sf_dir)).register("Gone", gone))

    class Registered:
        def pipelines(self, registry) -> None:  # noqa: ANN001
            registry.register("One", counting, CountParams(1)).register("Two", counting, CountParams(2))

    def described() -> str:
        b = ApplicationBuilder().use_catalog(Catalog(sf_dir))
        b.register("Count", counting, CountParams(5)).with_description("Counts.").with_tags("etl", "daily").with_validation(lambda v: v.inspect("Orders", Level.DEEP))
        own = b.build().pipelines["Count"]
        return f"{own.description} {', '.join(own.tags)} {own.validation.levels['Orders'].name}"

    def exported() -> str:
        with tempfile.TemporaryDirectory() as at:
            own = made(lambda b: b.use_catalog(Catalog(sf_dir)).include_metadata(at).register("Count", counting, CountParams(5)))
            own.formatter = str
            own.run_pipeline(spark, "Count", dry_run=True)
            return ", ".join(sorted(os.listdir(at)))

    def serviced() -> str:
        return ApplicationBuilder().configure_services(base="base").configure_logging("WARNING").use_catalog(lambda services: Catalog(services["base"])).build().catalog.base_path

    return outcomes(spark, {
        "one": lambda: app.main(["Count"], spark), "all": lambda: app.main([], spark), "dry": lambda: app.main(["Count", "--dry-run"], spark), "unknown": lambda: app.main(["Nothing"], spark),
        "no pipeline": lambda: made(lambda b: b.use_catalog(Catalog(sf_dir))).run_pipeline(spark), "missing input": lambda: missing.main([], spark), "bad argument": lambda: app.main(["Count", "--what"], spark),
        "failure raises": lambda: missing.run_pipeline(spark), "blank name": lambda: ApplicationBuilder().register(" ", counting), "name twice": lambda: ApplicationBuilder().register("a", counting).register("a", counting),
        "no catalog": lambda: made(lambda b: b.register("a", counting, CountParams(1))), "nothing registered yet": lambda: ApplicationBuilder().with_tags("x"),
        "before configuration": lambda: ApplicationBuilder().register_from_config("a", counting, "x", CountParams), "described": described,
        "registry": lambda: ", ".join(ApplicationBuilder().use_catalog(Catalog(sf_dir)).register_all(Registered).build().pipelines), "catalog from services": serviced,
        "execution": lambda: ApplicationBuilder().configure_execution(parallel_nodes=3).execution.parallel_nodes,
        "report": lambda: made(lambda b: b.format_results(lambda r: f"{r.name} is done").use_catalog(Catalog(sf_dir)).register("counting", counting, CountParams(5))).formatter(app.pipelines["Count"].dry_run()).replace("Count", "counting"),
        "exported": exported,
    })


@query(values(
    "rule, outcome", ("environment given", "Test"), ("environment by variable", "Own"), ("environment by a general one", "General"), ("no environment", "Production"), ("no file", "ConfigError"), ("layers", "base yaml env env-yaml local local-yaml"),
    ("merged", "1 2"), ("any case", "1"), ("bound", "7 orders"), ("no section", "ConfigError"), ("out of range", "ConfigError"), ("another type", "ConfigError"), ("catalog", "ConfiguredCatalog base"),
    ("no such type", "ConfigError"), ("discovered", "Few, Many"), ("description", "Few orders. etl"), ("code first", "9"), ("from a section", "7"), ("metadata", "graphs LR"),
))
def application_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of configuration, typed sections, and what a configuration builds."""
    here = "tessera.outcomes"
    base = {
        "a": {"x": 1, "y": 1}, "from": "base", "Params": {"Least": 7}, "Bad": {"Least": 700}, "Wrong": {"Least": "x"},
        "Tessera": {
            "Catalog": {"Type": f"{here}.ConfiguredCatalog", "BasePath": "base"}, "Metadata": {"OutputDirectory": "graphs", "Mermaid": {"Direction": "LR"}},
            "Pipelines": {
                "Few": {"Type": here, "FactoryMethod": "counting", "Parameters": {"least": 1}, "Description": "Few orders.", "Tags": ["etl"]},
                "Many": {"Type": here, "Parameters": {"Least": 12}}, "Neither": {"Description": "no type"},
            },
        },
    }

    def in_environment(**variables: str) -> str:
        names = (configuration.ENVIRONMENT_VARIABLE, *configuration.FALL_BACKS)
        old = {n: os.environ.pop(n, None) for n in names}
        os.environ |= variables
        try:
            return configuration.environment()
        finally:
            for n in names:
                os.environ.pop(n, None)
            os.environ |= {n: v for n, v in old.items() if v is not None}

    with tempfile.TemporaryDirectory() as at:
        layered = []
        for n, (layer, words) in enumerate((("", ("base", "yaml")), (".Test", ("env", "env-yaml")), (".Local", ("local", "local-yaml")))):
            for ending, word in zip(("json", "yaml"), words, strict=True):
                content = (base if not n and ending == "json" else {}) | {"from": word} | ({"A": {"y": 2}} if word == "env" else {})
                Path(at, f"appsettings{layer}.{ending}").write_text(json.dumps(content))
                layered.append(configuration.load_config(at, env="Test")["from"])
        found = configuration.load_config(at, env="Test")
        builder = lambda: ApplicationBuilder().use_configuration(at, env="Test").use_catalog(Catalog(sf_dir))
        own = builder().build()
        code = builder().register("Few", counting, CountParams(9)).register_from_config("Seven", counting, "Params", CountParams).build()
        entries = {n: next(iter(p.steps[0].outputs.values())).key.rpartition(" ")[2] for n, p in code.pipelines.items()}
        return outcomes(spark, {
            "environment given": lambda: configuration.environment("Test"), "environment by variable": lambda: in_environment(TESSERA_ENV="Own", DOTNET_ENVIRONMENT="General"),
            "environment by a general one": lambda: in_environment(ASPNETCORE_ENVIRONMENT="General"), "no environment": in_environment, "no file": lambda: configuration.load_config(f"{at}/none"), "layers": lambda: " ".join(layered),
            "merged": lambda: f"{configuration.section(found, 'a:x')} {configuration.section(found, 'a:y')}", "any case": lambda: configuration.section(found, "A:X"),
            "bound": lambda: "{0.least} {0.name}".format(configuration.bind(found, "Params", CountParams)), "no section": lambda: configuration.bind(found, "None", CountParams),
            "out of range": lambda: configuration.bind(found, "Bad", CountParams), "another type": lambda: configuration.bind(found, "Wrong", CountParams),
            "catalog": lambda: "{0.__class__.__name__} {0.base_path}".format(configuration.build_catalog(found)), "no such type": lambda: configuration.named("no.such.Type"),
            "discovered": lambda: ", ".join(configuration.discover(found)), "description": lambda: f"{own.pipelines['Few'].description} {', '.join(own.pipelines['Few'].tags)}",
            "code first": lambda: entries["Few"], "from a section": lambda: entries["Seven"], "metadata": lambda: f"{own.metadata.folder} {own.metadata.direction}",
        })


# --- the sample -------------------------------------------------------------------------------------------------------


@query("""
SELECT 's' || s_suppkey AS id, n_name AS company_location, CAST(CAST(1000 + s_suppkey AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(s_suppkey % 90 AS DOUBLE) AS review_scores_rating,
  CAST(n_nationkey * 3 + 1 AS DOUBLE) / 100 AS company_rating, n_nationkey % 2 = 0 AS iata_approved, CAST(s_suppkey % 4 + 1 AS INTEGER) AS engines, CAST(CAST(s_suppkey % 7 AS FLOAT) + 0.1::FLOAT AS FLOAT) AS crew_float
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 13 <> 0 AND n_nationkey % 11 <> 5
""")
def sample_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample application's first pipeline over raw files made of the nations (CSV) and suppliers (a workbook, and CSV):
    every 13th review lacks a score, every 11th company a rating."""
    at = folder(spark)
    catalog = fleet.FleetCatalog(at)
    key, nation = F.col("n_nationkey"), table(spark, sf_dir, "nation")
    rating = F.when(key % 11 == 5, "n/a").otherwise(F.concat((key * 3 + 1).cast("string"), F.lit(" %")))
    companies = nation.select(
        F.concat(F.lit("c"), key).alias("id"), rating.alias("company_rating"), F.col("n_name").alias("company_location"), F.lit("1,234").alias("total_fleet_count"), F.when(key % 2 == 0, "t").otherwise("f").alias("iata_approved")
    )
    catalog.companies_raw.save(spark, companies)
    suppliers = table(spark, sf_dir, "supplier")
    who = F.col("s_suppkey")
    scores = {f"review_scores_{s}": F.when((who % 13 == 0) & (F.lit(s) == "crew"), "").otherwise((who % 90).cast("string")) for s in fleet.SCORES}
    reviews = suppliers.select(F.concat(F.lit("s"), who).alias("shuttle_id"), *(v.alias(k) for k, v in scores.items()), F.lit("7").alias("number_of_reviews"), F.lit("1.5").alias("reviews_per_month"))
    catalog.reviews_raw.save(spark, reviews)
    header = list(fleet.RawShuttle.__dataclass_fields__)
    rows = (
        [f"s{r['s_suppkey']}", "Isle", "Type V", "Plasma", "ThetaBase", r["s_suppkey"] % 4 + 1, 9, "strict", r["s_suppkey"] % 7, "t", "f", f"${(1000 + r['s_suppkey']) // 1000},{(1000 + r['s_suppkey']) % 1000:03}.0", f"c{r['s_nationkey']}"]
        for r in suppliers.orderBy("s_suppkey").toLocalIterator()
    )
    files.write_bytes(spark, f"{at}/raw/shuttles.xlsx", [workbook(header, rows)])
    fleet.data_processing(catalog).execute(spark)
    found = catalog.model_input.load(spark)
    return found.select(
        "id", "company_location", F.col("price").cast("double").alias("price"), F.col("review_scores_rating").cast("double").alias("review_scores_rating"),
        F.col("company_rating").cast("double").alias("company_rating"), "iata_approved", "engines", (F.col("crew").cast("float") + F.lit(0.1).cast("float")).alias("crew_float"),
    )


@query("""
SELECT n_name AS x, CAST(count(*) AS DOUBLE) AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def column_chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart's columns, read back from its JSON form."""
    counts = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).cast("double").alias("n"))
    chart = json.loads(reporting.chart_json(reporting.column_chart(counts, "n_name", "n", "Suppliers")))
    return spark.createDataFrame(list(zip(chart["data"][0]["x"], chart["data"][0]["y"], strict=True)), "x string, y double")


@query(values(
    "rule, outcome", ("columns", "bar Png"), ("too many columns", "ValueError"), ("heat map", "heatmap Png"), ("curve", "curve, points, mean Png"), ("too long a curve", "ValueError"), ("from a data URI", "Png"),
    ("report", "# Cross-validation | Measure | Value |  2"),
))
def charts_and_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of charts and of their pictures, and a report."""
    regions = table(spark, sf_dir, "region")
    bars = reporting.column_chart(regions, "r_name", "r_regionkey", "Regions")
    heat = reporting.heat_map([[1, 2], [3, 4]], ["0", "1"], ["0", "1"], "Confusion")
    curve = reporting.curve_chart(models.normal_curve(spark, 0.4, 0.05, 101), [(0.4, 0.0)], [("mean", 0.4)], "R²")
    kind_of = lambda content: str(detect_file_type(content[:16]))
    kind = lambda chart: kind_of(reporting.chart_png(chart))
    summary = {"mean_r2_score": 0.5, "num_folds": 2, "fold_metrics": [{"fold": 0, "r2_score": 0.4}, {"fold": 1, "r2_score": 0.6}]}
    lines = reporting.cross_validation_report(summary).splitlines()
    uri = "data:image/png;base64," + base64.b64encode(reporting.chart_png(bars)).decode()
    return outcomes(spark, {
        "columns": lambda: f"{bars['data'][0]['type']} {kind(bars)}", "too many columns": lambda: reporting.column_chart(regions, "r_name", "r_regionkey", limit=2), "heat map": lambda: f"{heat['data'][0]['type']} {kind(heat)}",
        "curve": lambda: f"{', '.join(t['name'] for t in curve['data'])} {kind(curve)}", "too long a curve": lambda: reporting.curve_chart(models.normal_curve(spark, 0.4, 0.05, 101), [], [], limit=100),
        "from a data URI": lambda: kind_of(reporting.decode_data_uri(uri)), "report": lambda: f"{lines[0]} {lines[2]}  {sum(x.startswith(('| 0 |', '| 1 |')) for x in lines)}",
    })

