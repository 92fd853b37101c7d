"""Writing graphs to files."""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.meta.dag import dag, to_json, to_mermaid
from tessera.plans import Pipeline
from tessera.sources import files

#: Time in file names.
STAMP = "%Y-%m-%d-%H-%M-%S"


@dataclass
class MetadataOptions:
    """Where and how graphs are written; ``providers`` maps a file ending to a function of the graph."""

    folder: str = "metadata"
    enabled: bool = True
    json: bool = True
    mermaid: bool = True
    compact_json: bool = False
    direction: str = "TB"
    timestamp: str | None = None
    providers: dict[str, Callable[[dict], str]] = field(default_factory=dict)

    def add_provider(self, ending: str, make: Callable[[dict], str]) -> MetadataOptions:
        self.providers[ending] = make
        return self

    @classmethod
    def from_config(cls, found: Mapping) -> MetadataOptions:
        """From a configuration section: Enabled, OutputDirectory, Providers, Json:UseCompactFormat, Mermaid:Direction."""
        low = {str(k).lower(): v for k, v in found.items()}
        names = [str(p).lower() for p in low.get("providers", ("json", "mermaid"))]
        sub = lambda k, x, d: {str(a).lower(): b for a, b in (low.get(k) or {}).items()}.get(x, d)
        return cls(
            folder=low.get("outputdirectory", "metadata"), enabled=bool(low.get("enabled", True)), json="json" in names,
            mermaid="mermaid" in names, compact_json=bool(sub("json", "usecompactformat", False)), direction=sub("mermaid", "direction", "TB"),
        )


def export(pipeline: Pipeline, options: MetadataOptions) -> list[Path]:
    """Writes ``dag-<name>[-<time>]`` in each format: beside its place first, then moved there. A folder with a scheme
    (``hdfs://``, ``file:/``) is written through Spark's file systems, any other is one of this machine."""
    graph = dag(pipeline)
    made: dict[str, str] = {}
    if options.json:
        made["json"] = to_json(graph, options.compact_json)
    if options.mermaid:
        made["md"] = to_mermaid(graph, options.direction)
    made |= {ending: make(graph) for ending, make in options.providers.items()}
    name = "dag-" + re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", pipeline.name)
    if options.timestamp:
        name += datetime.datetime.now().strftime(f"-{options.timestamp}")
    if re.match(r"[a-z][a-z0-9+.-]+:/", options.folder):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError(f"{options.folder} needs an active session")
        for ending, text in made.items():
            files.write_bytes(spark, f"{options.folder.rstrip('/')}/{name}.{ending}", [text.encode()])
        return [Path(options.folder, f"{name}.{ending}") for ending in made]
    Path(options.folder).mkdir(parents=True, exist_ok=True)
    paths = []
    for ending, text in made.items():
        path = Path(options.folder, f"{name}.{ending}")
        beside = path.with_suffix(f".{ending}.tmp")
        beside.write_text(text, "utf-8")
        os.replace(beside, path)
        paths.append(path)
    return paths
