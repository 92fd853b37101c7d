"""Pipelines, validation, configuration, applications and streams."""

import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tessera.app import Application, ConfigError, bind, load_config, section
from tessera.app.config import in_range
from tessera.meta import MetadataOptions, export
from tessera.plans import Constant, Execution, FunctionNode, Node, PassThrough, Pipeline, PipelineBuilder, PipelineError, format_result
from tessera.sources import Catalog, FrameSource, MemoryDataset, MemoryObject, NoData, ParquetDataset, ReadOnlyError
from tessera.streaming import read_files, run_node
from tessera.validation import ErrorType, Level, ValidationError, ValidationException, ValidationOptions, ValidationResult


@dataclass
class Number:
    n: int


def numbers(spark, upto=5):
    return spark.range(upto).select(F.col("id").alias("n"))


def source(key="source", upto=5):
    return FrameSource(key, Number, lambda spark: numbers(spark, upto))


def memory(key):
    return MemoryDataset(key, Number)


def double(data):
    return data.select((F.col("n") * 2).alias("n"))


def test_layers_counts_and_results(spark):
    a, b, c, model = source(), memory("b"), memory("c"), MemoryObject("model", int)
    p = (
        PipelineBuilder("p").add_node(lambda b, c: b.union(c).count(), {"b": b, "c": c}, model, "Count").add_node(double, a, b, "Double")
        .add_node(PassThrough(), b, c, "Copy").add_node(lambda data: print(data), model, NoData.output(), "Show").build()
    )
    assert [[s.name for s in layer] for layer in p.layers] == [["Double"], ["Copy"], ["Count"], ["Show"]]
    r = p.run(spark)
    assert r.success and model.load(spark) == 10 and (r.nodes["Count"].rows_in, r.nodes["Double"].rows_out) == (10, 5)
    assert r.nodes["Double"].rows_in is None and p.run(spark, Execution(count_all_inputs=True)).nodes["Double"].rows_in == 5
    assert "Pipeline 'p' succeeded" in format_result(r) and r.to_frame(spark).count() == 4
    assert p.build() is p
    d = p.dry_run()
    assert (d.node_count, d.layer_count, d.input_count) == (4, 4, 1) and "dry run" in format_result(d)


def test_many_outputs_constants_and_maps(spark):
    even, odd, total = memory("even"), memory("odd"), MemoryObject("total", int)

    class Part(Node):
        parameters = 2

        def transform(self, data, by):
            self.logger.info("parting")
            return {"even": data.where(F.col("n") % by == 0), "odd": data.where(F.col("n") % by == 1), "total": data.count() * self.parameters}

    node = Part(3)
    p = PipelineBuilder("p").add_node(node, {"data": source(), "by": Constant(2)}, {"even": even, "odd": odd, "total": total}).build()
    r = p.execute(spark)
    assert r.nodes["Part"].rows_out == 6 and even.count(spark) == 3 and total.load(spark) == 15
    assert node.transform(numbers(spark), 2)["odd"].count() == 2


def test_wiring_is_checked():
    b = memory("b")
    new = lambda: PipelineBuilder("p")
    with pytest.raises(PipelineError, match="not mapped: y"):
        new().add_node(lambda x, y: x, {"x": source()}, b)
    with pytest.raises(PipelineError, match="no such inputs: z"):
        new().add_node(lambda x: x, {"x": source(), "z": source()}, b)
    with pytest.raises(ReadOnlyError):
        new().add_node(double, b, source())
    with pytest.raises(PipelineError, match="no catalog entry"):
        new().add_node(double, source(), Constant(1))
    with pytest.raises(PipelineError, match="two producers"):
        new().add_node(double, source(), b, "one").add_node(double, source(), b, "two").build()
    with pytest.raises(PipelineError, match="two nodes"):
        new().add_node(double, source(), b).add_node(double, source(), memory("c"))
    with pytest.raises(PipelineError, match="a cycle: (x -> y -> x|y -> x -> y)"):
        c = memory("c")
        new().add_node(double, b, c, "x").add_node(double, c, b, "y").build()

    @dataclass
    class Other:
        s: str

    with pytest.raises(PipelineError, match="different rows"):
        new().add_node(PassThrough, source(), MemoryDataset("o", Other))
    with pytest.raises(PipelineError, match="not built"):
        Pipeline("p", []).run(None)
    assert new().add_node(double, b, b, "Self").build().layers[0][0].name == "Self"
    assert isinstance(new().add_node(double, b, b).steps[0].node, FunctionNode)


def test_failures(spark):
    def bad(data):
        raise RuntimeError("no luck")

    steps = lambda: PipelineBuilder("p").add_node(bad, source(), memory("x"), "Bad").add_node(double, source(), memory("y"), "Good")
    r = steps().build().run(spark)
    assert not r.success and list(r.nodes) == ["Bad"] and "no luck" in format_result(r) and "RuntimeError" in format_result(r)
    r = steps().build().run(spark, Execution(stop_on_first_error=False))
    assert not r.success and r.nodes["Good"].success
    r = steps().build().run(spark, Execution(parallel_nodes=2))
    assert not r.success and len(r.nodes) == 2
    with pytest.raises(RuntimeError, match="no luck"):
        steps().build().execute(spark)
    r = PipelineBuilder("p").add_node(lambda data: [1, 2], source(), MemoryObject("o", int), "Two").build().run(spark)
    assert "exactly one value" in str(r.error)
    assert PipelineBuilder("p").add_node(lambda data: [7], source(), MemoryObject("o", int), "One").build().run(spark).success


def test_merge_and_validation(spark, tmp_path):
    shared, missing = memory("shared"), ParquetDataset("missing", Number, f"{tmp_path}/none")
    late = ParquetDataset("late", Number, f"{tmp_path}/late").with_inspection_level(Level.DEEP)
    one = PipelineBuilder("one").add_node(lambda a, m: a, {"a": source(), "m": missing}, shared, "First").build()
    two = PipelineBuilder("two").add_node(lambda a, b: a, {"a": shared, "b": late}, memory("end"), "Last").build()
    one.validation.inspect(missing, Level.SHALLOW)
    merged = Pipeline.merge({"one": one, "two": two}).build()
    assert [s.name for layer in merged.layers for s in layer] == ["one.First", "two.Last"] and merged.validation.levels == {"missing": Level.SHALLOW}
    assert {e.key for e in merged.validate(spark).errors} == {"missing", "late"}  # also what is first read in a later layer
    merged.validation.inspect("missing", Level.NONE).inspect("late", Level.NONE)
    assert merged.validate(spark).is_valid


def test_validation_results(spark):
    e = ValidationError("k", ErrorType.NOT_FOUND, "gone", "line 1\nline 2")
    assert str(e) == "[NotFound] k: gone\n  line 1\n  line 2"
    r = ValidationResult.success().add(e).merge(ValidationResult.from_exception("j", OSError("bad")))
    with pytest.raises(ValidationException, match=r"2 error\(s\)") as x:
        r.raise_if_invalid()
    assert "k:\n  - [NotFound] gone\n      line 1" in str(x.value) and r.to_frame(spark).count() == 2
    options = ValidationOptions()
    assert options.level_of(source()) == Level.SHALLOW and options.level_of(source().with_inspection_level(Level.DEEP)) == Level.DEEP
    broken = FrameSource("b", Number, lambda spark: 1 / 0)
    assert [e.type for e in broken.inspect(spark, Level.SHALLOW).errors] == [ErrorType.INSPECTION_FAILURE]


# --- configuration and applications -----------------------------------------------------------------------------------


@dataclass
class Split:
    test_size: float = in_range(0, 1, 0.2)
    seed: int = 3


@dataclass
class Params:
    split: Split
    name: str
    fast: bool = False


class Numbers(Catalog):
    def __init__(self, base_path, connection=None, extra="x"):
        super().__init__(base_path, connection, extra=extra, made=memory("made"))


class Factory:
    @staticmethod
    def create(catalog: Numbers, params: Params):
        return PipelineBuilder("any").add_node(lambda a, n: a.limit(n), {"a": source(), "n": Constant(params.split.seed)}, catalog.made, "Take").build()


def write_config(folder):
    base = {"Tessera": {
        "Catalog": {"Type": "test_plans.Numbers", "BasePath": "data", "ConstructorArgs": {"Extra": "y"}},
        "Metadata": {"OutputDirectory": str(folder / "meta"), "Providers": ["json", "MERMAID", "other"], "Json": {"UseCompactFormat": True}, "Mermaid": {"Direction": "LR"}},
        "Pipelines": {"Auto": {"Type": "test_plans.Factory", "Description": "found", "Tags": ["t"], "Parameters": {"Split": {"TestSize": "0.5"}, "Name": "n"}}, "OnlyData": {"x": 1}},
    }, "A": {"b": 1, "c": [1]}}
    (folder / "appsettings.json").write_text(json.dumps(base))
    (folder / "appsettings.yaml").write_text("A:\n  b: 2\n")
    (folder / "appsettings.Stage.json").write_text('{"a": {"B": 3, "d": 4}}')
    (folder / "appsettings.Local.yaml").write_text("A:\n  d: 5\n")


def test_configuration(tmp_path, monkeypatch):
    with pytest.raises(ConfigError, match="does not exist"):
        load_config(str(tmp_path))
    write_config(tmp_path)
    assert section(load_config(str(tmp_path)), "a:B") == 2 and section(load_config(str(tmp_path)), "A:d") == 5
    monkeypatch.setenv("TESSERA_ENV", "Stage")
    config = load_config(str(tmp_path))
    assert section(config, "A") == {"b": 3, "c": [1], "d": 5} and section(config, "No:Such") is None
    assert bind(config, "Tessera:Pipelines:Auto:Parameters", Params) == Params(Split(0.5), "n")
    for wrong, text in (({"P": {"split": {"test_size": 3}, "name": "x"}}, "from 0 to 1"), ({"P": {"split": {}}}, "P:name is missing"), ({}, "no section"), ({"P": {"split": {"seed": "x"}, "name": "x"}}, "is no int")):
        with pytest.raises(ConfigError, match=text):
            bind(wrong, "P", Params)


def test_application_from_configuration(spark, tmp_path, capsys):
    write_config(tmp_path)
    app = Application.create(lambda b: b.use_configuration(str(tmp_path)))
    assert app.catalog.extra == "y" and app.pipelines["Auto"].description == "found" and app.pipelines["Auto"].tags == ("t",)
    assert app.main(["Auto"], spark) == 0 and app.catalog.made.count(spark) == 3
    assert "\n" not in (tmp_path / "meta/dag-Auto.json").read_text() and "flowchart LR" in (tmp_path / "meta/dag-Auto.md").read_text()
    assert app.main([], spark) == 0 and (tmp_path / "meta/dag-merged.json").exists()
    own = Application.create(lambda b: (b.use_configuration(str(tmp_path)), b.use_catalog(Numbers("z")), b.include_metadata(str(tmp_path / "m2"), json=False),
                                        b.configure_execution(parallel_nodes=2), b.format_results(lambda r: "OWN TEXT")))
    assert own.catalog.base_path == "z" and own.main(["Auto"], spark) == 0 and [p.name for p in (tmp_path / "m2").iterdir()] == ["dag-Auto.md"]
    assert "OWN TEXT" in capsys.readouterr().out


def test_registration_rules(spark):
    def configure(b):
        b.use_catalog(lambda: Numbers("lazy"))
        b.register("One", lambda c: PipelineBuilder("x").add_node(double, source(), c.made, "Own.Name").build())
        b.with_description("d").with_tags("a", "b").with_validation(lambda v: v.inspect("source", Level.NONE))
        for name in ("", "One"):
            with pytest.raises(ValueError, match="name|already"):
                b.register(name, lambda c: None)
        with pytest.raises(ConfigError, match="use_configuration"):
            b.register_from_config("Two", lambda c: None, "x", Params)

    app = Application.create(configure)
    one = app.pipelines["One"]
    assert (one.description, one.tags, one.validation.levels) == ("d", ("a", "b"), {"source": Level.NONE}) and one.steps[0].pipeline == "One"
    with pytest.raises(ConfigError, match="no catalog"):
        Application.create(lambda b: b.register("x", lambda c: None))
    with pytest.raises(ValueError, match="no pipeline was registered"):
        Application.create(lambda b: b.with_tags("x"))


def test_streams(spark, tmp_path):
    numbers(spark).write.parquet(f"{tmp_path}/in")
    for expected in (5, 5, 8):
        if expected == 8:
            numbers(spark, 3).write.mode("append").parquet(f"{tmp_path}/in")
        run_node(FunctionNode(double), read_files(spark, Number, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == expected
    with pytest.raises(ValueError, match="no stream"):
        run_node(FunctionNode(lambda d: numbers(spark)), read_files(spark, Number, f"{tmp_path}/in"), f"{tmp_path}/o2", f"{tmp_path}/c2")


def test_graphs_go_through_the_file_systems_of_spark(spark, tmp_path):
    made = PipelineBuilder("p").add_node(lambda: None, None, NoData.output(), "N").build()
    export(made, MetadataOptions(f"file:{tmp_path}/graphs"))
    assert sorted(x.name for x in (tmp_path / "graphs").iterdir()) == ["dag-p.json", "dag-p.md"]
