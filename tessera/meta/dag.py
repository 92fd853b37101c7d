"""The graph of a built pipeline: nodes, catalog entries and edges."""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import Pipeline
from tessera.plans.node import node_type
from tessera.schema import Schema

DIRECTIONS = ("TB", "LR", "BT", "RL")

#: Fixed characters that Mermaid ids can't have.
_NO_ID = re.compile(r"[ \-.()\[\]]")


def _label(name: str) -> str:
    return re.sub(r"\B([A-Z])", r" \1", name)


def _schema(schema: Schema | None) -> dict | None:
    if schema is None or not schema.columns:
        return None
    return {"fields": [{"name": c.name, "type": c.type.simpleString(), "isNullable": c.nullable} for c in schema.columns]}


def dag(pipeline: Pipeline, now: datetime.datetime | None = None) -> dict:
    """The graph as plain data, keys as in the JSON form; null values are left out. Ports without data are hidden."""
    if pipeline.layers is None:
        raise ValueError(f"pipeline {pipeline.name!r} is not built")
    shown = lambda entries: [e for e in entries if not e.key.startswith("_nodata")]
    nodes, edges, entries = [], [], {}
    for s in pipeline.steps:
        read, written = shown(s.read), shown({id(e): e for e in s.outputs.values()}.values())
        nodes.append({
            "id": s.name, "label": _label(s.label), "nodeType": node_type(s.node), "layer": s.layer, "pipelineName": s.pipeline,
            "inputs": [e.key for e in read], "outputs": [e.key for e in written],
        })
        for e in (*read, *written):
            fields = {"catalogType": type(e).__name__, "isReadOnly": e.read_only}
            if e.path:
                fields["filepath"] = e.path
            if e.preferred_level is not None:
                fields["inspectionLevel"] = e.preferred_level.name.title()
            made = entries.setdefault(e.key, {"key": e.key, "label": _label(e.key), "dataType": e.data_type, "schema": _schema(e.schema), "fields": fields, "producer": None, "consumers": []})
            if e in written:
                made["producer"] = s.name
            if e in read:
                made["consumers"].append(s.name)
        edges += [{"source": e.key, "target": s.name, "dataType": e.data_type} for e in read]
        edges += [{"source": s.name, "target": e.key, "dataType": e.data_type} for e in written]
    found = [{k: v for k, v in e.items() if v is not None} for e in entries.values()]
    at = (now or datetime.datetime.now(datetime.UTC)).isoformat()
    return {"pipelineName": pipeline.name, "generatedAt": at, "nodes": nodes, "catalogEntries": found, "edges": edges}


def to_json(graph: dict, compact: bool = False) -> str:
    return json.dumps(graph, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 2}))


def from_json(text: str) -> dict:
    """The inverse of ``to_json``; an error if it is no graph."""
    graph = json.loads(text)
    if not isinstance(graph, dict) or not {"pipelineName", "nodes", "catalogEntries", "edges"} <= graph.keys():
        raise ValueError("not a graph of a pipeline")
    return graph


def dag_frames(spark: SparkSession, graph: dict) -> dict[str, DataFrame]:
    """The graph as three tables: nodes, entries, edges."""
    nodes = [(n["id"], n["label"], n["nodeType"], n["layer"], n["pipelineName"], n["inputs"], n["outputs"]) for n in graph["nodes"]]
    entries = [
        (e["key"], e["label"], e["dataType"], e["fields"]["catalogType"], e["fields"].get("filepath"), e["fields"]["isReadOnly"], e.get("producer"), e["consumers"])
        for e in graph["catalogEntries"]
    ]
    edges = [(e["source"], e["target"], e["dataType"]) for e in graph["edges"]]
    return {
        "nodes": spark.createDataFrame(nodes, "id string, label string, node_type string, layer int, pipeline string, inputs array<string>, outputs array<string>"),
        "entries": spark.createDataFrame(
            entries, "key string, label string, data_type string, catalog_type string, path string, read_only boolean, producer string, consumers array<string>"
        ),
        "edges": spark.createDataFrame(edges, "source string, target string, data_type string"),
    }


def to_mermaid(graph: dict, direction: str = "TB") -> str:
    """A fenced flowchart: external inputs, a subgraph for each pipeline, dotted edges between pipelines."""
    if direction not in DIRECTIONS:
        raise ValueError(f"the direction is one of {', '.join(DIRECTIONS)}")
    name = lambda x: _NO_ID.sub("_", x)
    text = lambda x: x.replace('"', "&quot;")
    entries = {e["key"]: e for e in graph["catalogEntries"]}
    home = {n["id"]: n["pipelineName"] for n in graph["nodes"]}
    external = [e for e in graph["catalogEntries"] if "producer" not in e]
    cylinder = lambda e: f'{name(e["key"])}[("{text(e["label"])}")]'
    lines = ["```mermaid", f"flowchart {direction}", "    %% External Data Inputs"]
    lines += [f"    {cylinder(e)}" for e in external]
    crossing = []
    for pipeline in sorted(set(home.values())):
        lines.append(f'    subgraph {name(pipeline)}["{text(_label(pipeline))}"]')
        own = sorted((n for n in graph["nodes"] if n["pipelineName"] == pipeline), key=lambda n: (n["layer"], n["id"]))
        lines += [f'        {name(n["id"])}["{text(n["label"])}"]' for n in own]
        lines += [f"        {cylinder(entries[k])}" for k in dict.fromkeys(k for n in own for k in n["outputs"])]
        for n in own:
            for k in n["inputs"]:
                made = entries[k].get("producer")
                if made is not None and home[made] == pipeline:
                    lines.append(f"        {name(k)} --> {name(n['id'])}")
                elif made is not None:
                    crossing.append(f"    {name(k)} -.-> {name(n['id'])}")
            lines += [f"        {name(n['id'])} --> {name(k)}" for k in n["outputs"]]
        lines.append("    end")
    lines.append("    %% External Data to Pipeline Edges")
    lines += [f"    {name(e['key'])} --> {name(c)}" for e in external for c in e["consumers"]]
    if crossing:
        lines += ["    %% Cross-Pipeline Data Flow", *dict.fromkeys(crossing)]
    return "\n".join([*lines, "```", ""])
