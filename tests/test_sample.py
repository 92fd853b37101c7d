"""The sample application from raw files to reports."""

import json
import random

import pytest

from tessera import reporting
from tessera.app import Application
from tessera.meta import dag, dag_frames, from_json, to_json, to_mermaid
from tessera.plans import Pipeline
from tessera.samples import fleet
from tessera.sources.workbooks import workbook
from tessera.validation import ValidationException


def raw_files(base, rows=120):
    rng = random.Random(5)
    (base / "raw").mkdir(parents=True)
    (base / "reference").mkdir()
    companies = ["id,company_rating,company_location,total_fleet_count,iata_approved"]
    companies += [f"c{i},{rng.choice(['100%', ' 90 %', '45%'])},Isle {i},\"{rng.choice(['1,234', '7', '5-'])}\",{rng.choice('tf')}" for i in range(20)]
    companies += ["c90,,Isle,3,t", "c91,abc,Isle,3,t", "c92,50%,  ,3,t", "c93,50%,Isle,1e3,f"]
    (base / "raw/companies.csv").write_text("\n".join(companies) + "\n")
    header = [c for c in fleet.RawShuttle.__dataclass_fields__]
    shuttles = []
    for i in range(rows):
        shuttles.append([f"s{i}", "Isle", f"Type V{i % 5}", "Plasma", "ThetaBase", rng.randrange(1, 5), rng.randrange(1, 20), "strict", rng.randrange(1, 9),
                         rng.choice("tf"), "f", f"${rng.randrange(1, 9)},{rng.randrange(100, 999)}.0", f"c{rng.randrange(22)}"])
    shuttles.append(["s900", "Isle", "T", "P", "B", "3.5", 3, "x", 3, "t", "t", "n/a", "c1"])
    (base / "raw/shuttles.xlsx").write_bytes(workbook(header, shuttles))
    names = list(fleet.RawReview.__dataclass_fields__)
    reviews = [",".join(names)]
    for i in range(rows):
        reviews.append(",".join([f"s{i}", *(str(rng.randrange(50, 100)) for _ in range(7)), str(i), f"{i}.5"]))
    reviews += [",".join(["s1", "", *"123456", "7", "8"]), ",".join(["nowhere", *"1234567", "7", "8"])]
    (base / "raw/reviews.csv").write_text("\n".join(reviews) + "\n")


def app_of(base):
    return Application.create(lambda b: fleet.configure(b, str(base)))


def test_sample_runs_whole(spark, tmp_path, capsys):
    raw_files(tmp_path)
    app = app_of(tmp_path)
    assert app.run_pipeline(spark, "DataProcessing").success
    made = app.catalog.model_input.load(spark)
    joined = made.count()
    assert len(made.columns) == 26 and 0 < joined <= 120
    assert app.catalog.companies.count(spark) == 20
    # the joined table is its own reference
    app.catalog.model_input_csv.save(spark, made)
    (tmp_path / "reference/model_input.csv").write_bytes((tmp_path / "diagnostics/model_input.csv").read_bytes())
    result = app.run_pipeline(spark)
    assert result.success, result.error
    assert len(result.nodes) == 4 + 5 + 5 + 10
    metrics = json.loads((tmp_path / "models/metrics.json").read_text())
    assert {"r2Score", "maxError"} <= metrics.keys()
    assert (tmp_path / "reports/Capacity.png").read_bytes().startswith(b"\x89PNG")
    assert "mean r2 score" in (tmp_path / "reports/cross_validation.md").read_text()
    assert "✓" in capsys.readouterr().out
    rows = {r["node"]: r for r in result.to_frame(spark).collect()}
    assert rows["DataProcessing.CreateModelInputTable"]["rows_out"] == joined


def test_reference_differences_are_named(spark):
    names = [*fleet.COMPARED_NUMBERS, *fleet.COMPARED_EXACTLY]
    base = {"id": "s", "reviews_per_month": 1.5} | {c: 2.0 for c in fleet.COMPARED_NUMBERS} | {c: "x" for c in fleet.COMPARED_EXACTLY}
    schema = ", ".join(f"{c} {'double' if c in ('reviews_per_month', *fleet.COMPARED_NUMBERS) else 'string'}" for c in base)
    frame = lambda rows: spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)
    left = frame([{"id": c} for c in names] + [{"id": "same"}, {"id": "same", "reviews_per_month": None}, {"id": "left"}])
    right = frame([{"id": c, c: 3.0 if c in fleet.COMPARED_NUMBERS else None} for c in names] + [{"id": "same", "crew": 2.001}, {"id": "same", "reviews_per_month": None}, {"id": "right"}])
    got = {tuple(r) for r in fleet.check_reference(left, right).collect()}
    assert got == {(f"{c}|1.5", "both", c) for c in names} | {("left|1.5", "model input only", ""), ("right|1.5", "reference only", "")}
    with pytest.raises(ValueError, match="more than once"):
        fleet.check_reference(left, right.union(right.where("id = 'crew'")))


def test_column_chart_leaves_no_group_out(spark):
    groups = spark.range(1001).selectExpr("id", "id * 2 as n")
    assert len(reporting.column_chart(groups, "id", "n", limit=1001)["data"][0]["x"]) == 1001
    with pytest.raises(ValueError, match="more than 1000"):
        reporting.column_chart(groups, "id", "n")


def test_merged_layers_and_graph(spark, tmp_path):
    app = app_of(tmp_path)
    merged = Pipeline.merge(app.pipelines).build()
    layer = {s.name: s.layer for s in merged.steps}
    assert layer["DataProcessing.PreprocessShuttles"] == 0
    assert layer["DataProcessing.CreateModelInputTable"] == 1
    assert layer["DataScience.SplitData"] == 2 and layer["DataScience.EvaluateModel"] == 4
    assert layer["Reporting.CapacityChart"] == 1 and layer["Reporting.ExportCrossValidationPng"] == 4
    assert [e.key for e in merged.external_inputs] == ["RawCompanies", "RawShuttles", "RawReviews", "ReferenceModelInput"]
    graph = dag(merged)
    assert from_json(to_json(graph)) == graph and "\n" not in to_json(graph, compact=True)
    text = to_mermaid(graph, "LR")
    assert text.startswith("```mermaid\nflowchart LR") and "ModelInputTable -.-> DataScience_SplitData" in text
    frames = dag_frames(spark, graph)
    assert frames["nodes"].count() == 24
    raw = {e["key"]: e for e in graph["catalogEntries"]}["RawShuttles"]
    assert raw["fields"]["isReadOnly"] and raw["schema"]["fields"][0] == {"name": "id", "type": "string", "isNullable": False}


def test_missing_inputs_stop_the_run(spark, tmp_path):
    app = app_of(tmp_path)
    with pytest.raises(ValidationException) as e:
        app.run_pipeline(spark, "DataProcessing")
    assert {x.type.value for x in e.value.errors} == {"NotFound"} and len(e.value.errors) == 3
    assert app.main(["DataProcessing", "--dry-run"], spark) == 1
    raw_files(tmp_path)
    assert app.main(["DataProcessing", "--dry-run"], spark) == 0
    assert app.main(["Nothing"], spark) == 1
    assert not (tmp_path / "clean").exists()
