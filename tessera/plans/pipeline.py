"""Pipelines: nodes wired through catalog entries, ordered by what they need, run layer by layer."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.plans.node import Constant, FunctionNode, Node, PassThrough, input_names, node_type
from tessera.plans.results import NodeResult, PipelineResult
from tessera.sources.base import SAMPLE, CatalogEntry, ReadOnlyError
from tessera.validation import Level, ValidationOptions, ValidationResult

log = logging.getLogger("tessera")

Inputs = CatalogEntry | Constant | Mapping[str, CatalogEntry | Constant] | None
Outputs = CatalogEntry | Mapping[str, CatalogEntry] | None


class PipelineError(ValueError):
    """A pipeline that can't be built."""


@dataclass(frozen=True)
class Step:
    """A node with its wiring. A single input or output has the name ''."""

    name: str
    node: Node
    inputs: dict[str, CatalogEntry | Constant]
    outputs: dict[str, CatalogEntry]
    pipeline: str
    layer: int = -1

    @property
    def read(self) -> list[CatalogEntry]:
        return list({id(e): e for e in self.inputs.values() if isinstance(e, CatalogEntry)}.values())

    @property
    def label(self) -> str:
        return self.name.removeprefix(f"{self.pipeline}.")


@dataclass(frozen=True)
class Execution:
    """How a pipeline runs: whether it stops at the first failure, how many nodes of a layer run at once, and whether
    inputs are counted even where that reads them again."""

    stop_on_first_error: bool = True
    parallel_nodes: int = 1
    count_all_inputs: bool = False


class PipelineBuilder:
    """Collects nodes."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.steps: list[Step] = []

    def add_node(
        self, node: Node | type[Node] | Callable, inputs: Inputs = None, outputs: Outputs = None, name: str | None = None,
        configure: Callable[[Node], None] | None = None,
    ) -> PipelineBuilder:
        """Adds a node: an instance, a class without arguments, or a function. Its wiring is checked here: names and
        completeness of inputs, no constants or read-only entries as outputs, and one schema where a table only changes its
        format."""
        if isinstance(node, type) and issubclass(node, Node):
            node = node()
        elif not isinstance(node, Node):
            node = FunctionNode(node)
        if configure is not None:
            configure(node)
        name = name or node_type(node)
        if any(s.label == name for s in self.steps):
            raise PipelineError(f"there are two nodes {name!r} in {self.name!r}")
        read = {} if inputs is None else dict(inputs) if isinstance(inputs, Mapping) else {"": inputs}
        written = {} if outputs is None else dict(outputs) if isinstance(outputs, Mapping) else {"": outputs}
        for port, e in read.items():
            if not isinstance(e, (CatalogEntry, Constant)):
                raise PipelineError(f"{name}: input {port or 'data'} is no catalog entry")
        for port, e in written.items():
            if not isinstance(e, CatalogEntry):
                raise PipelineError(f"{name}: output {port or 'data'} is no catalog entry")
            if e.read_only:
                raise ReadOnlyError(f"{name}: {e.key} is read-only and can't be an output")
        names, needed, any_name = input_names(node)
        if "" not in read:
            if missing := [n for n in needed if n not in read]:
                raise PipelineError(f"{name}: inputs not mapped: {', '.join(missing)}")
            if not any_name and (unknown := [n for n in read if n not in names]):
                raise PipelineError(f"{name}: no such inputs: {', '.join(unknown)}")
        elif len(needed) > 1 or not (names or any_name):  # further parameters have defaults
            raise PipelineError(f"{name}: takes {len(needed)} inputs, one given")
        if isinstance(node, PassThrough) and "" in read and "" in written:
            a, b = getattr(read[""], "schema", None), written[""].schema
            if a is not None and b is not None and not a.matches(b.struct):
                raise PipelineError(f"{name}: {read[''].key} and {written[''].key} have different rows")
        self.steps.append(Step(name, node, read, written, self.name))
        return self

    def build(self) -> Pipeline:
        return Pipeline(self.name, self.steps).build()


@dataclass
class Pipeline:
    """Steps, ordered in layers once built."""

    name: str
    steps: list[Step]
    validation: ValidationOptions = field(default_factory=ValidationOptions)
    description: str = ""
    tags: tuple[str, ...] = ()
    layers: list[list[Step]] | None = None

    def build(self) -> Pipeline:
        """Checks that each entry has one producer and that there is no cycle, and gives each step its layer. Entries are
        the same if they are one object; what a step both reads and writes is no dependency."""
        if self.layers is not None:
            log.warning("pipeline %s is built already", self.name)
            return self
        producer: dict[int, int] = {}
        for i, s in enumerate(self.steps):
            for e in s.outputs.values():
                if producer.setdefault(id(e), i) != i:
                    raise PipelineError(f"{e.key!r} has two producers: {self.steps[producer[id(e)]].name!r} and {s.name!r}")
        needs = {i: {producer[id(e)] for e in s.read if producer.get(id(e), i) != i} for i, s in enumerate(self.steps)}
        sorter = TopologicalSorter(needs)
        try:
            sorter.prepare()
        except CycleError as e:
            raise PipelineError(f"a cycle: {' -> '.join(self.steps[i].name for i in reversed(e.args[1]))}") from e
        self.layers = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            self.layers.append([replace(self.steps[i], layer=len(self.layers)) for i in ready])
            sorter.done(*ready)
        self.steps = sorted((s for layer in self.layers for s in layer), key=lambda s: [x.name for x in self.steps].index(s.name))
        return self

    @staticmethod
    def merge(pipelines: Mapping[str, Pipeline], name: str = "merged") -> Pipeline:
        """All steps in one pipeline, named ``pipeline.node``; levels and tags of all."""
        steps = [replace(s, name=f"{k}.{s.name}", pipeline=k, layer=-1) for k, p in pipelines.items() for s in p.steps]
        levels = ValidationOptions().merged(p.validation.levels for p in pipelines.values())
        tags = tuple(dict.fromkeys(t for p in pipelines.values() for t in p.tags))
        return Pipeline(name, steps, levels, tags=tags)

    def _built(self) -> list[list[Step]]:
        if self.layers is None:
            raise PipelineError(f"pipeline {self.name!r} is not built")
        return self.layers

    @property
    def external_inputs(self) -> list[CatalogEntry]:
        """What steps read and none writes, in the order of layers, each key once."""
        layers = self._built()
        made = {id(e) for s in self.steps for e in s.outputs.values()}
        found = (e for layer in layers for s in layer for e in s.read if id(e) not in made)
        return list({e.key: e for e in reversed(list(found))}.values())[::-1]

    def validate(self, spark: SparkSession, sample: int = SAMPLE) -> ValidationResult:
        """Inspects every external input at its level; all errors together."""
        found = ValidationResult.success()
        for e in self.external_inputs:
            found = found.merge(e.inspect(spark, self.validation.level_of(e), sample))
        return found

    def dry_run(self) -> PipelineResult:
        return PipelineResult(
            self.name, True, 0.0, dry_run=True, node_count=len(self.steps), layer_count=len(self._built()), input_count=len(self.external_inputs)
        )

    def run(self, spark: SparkSession, how: Execution = Execution()) -> PipelineResult:  # noqa: B008  a frozen value
        """Runs the layers in order. Never raises: a failure is in the result."""
        began = time.perf_counter()
        done: dict[str, NodeResult] = {}
        error = None
        for layer in self._built():
            if how.parallel_nodes > 1 and len(layer) > 1:
                with ThreadPoolExecutor(min(how.parallel_nodes, len(layer))) as pool:
                    results = list(pool.map(lambda s: _run_step(spark, s, how), layer))
            else:
                results = []
                for s in layer:
                    results.append(_run_step(spark, s, how))
                    if not results[-1].success and how.stop_on_first_error:
                        break
            done |= {r.name: r for r in results}
            error = error or next((r.error for r in results if not r.success), None)
            if error is not None:
                break  # later layers may need what is missing
        return PipelineResult(
            self.name, error is None, time.perf_counter() - began, done, error,
            node_count=len(self.steps), layer_count=len(self.layers or ()), input_count=len(self.external_inputs),
        )

    def execute(self, spark: SparkSession, how: Execution = Execution()) -> PipelineResult:  # noqa: B008
        """As ``run``, but raises what a node raised."""
        result = self.run(spark, how)
        if result.error is not None:
            raise result.error
        return result


def _save(spark: SparkSession, entry: CatalogEntry, value: object) -> int | None:
    """Saves an output; its rows are counted by the job that writes them."""
    if entry.is_object:
        if isinstance(value, (list, tuple)) and getattr(entry, "kind", None) not in (list, tuple, object, None):
            if len(value) != 1:
                raise ValueError(f"{entry.key} takes exactly one value, not {len(value)}")
            value = value[0]
        entry.save(spark, value)
        return 1
    if not isinstance(value, DataFrame) or entry.key.startswith("_nodata"):
        entry.save(spark, value)
        return None
    if not entry.reads_when_saved:
        entry.save(spark, value)
        return entry.count(spark) if entry.cheap_count else None
    watch = Observation()
    entry.save(spark, value.observe(watch, F.count(F.lit(1)).alias("rows")))
    return int(watch.get["rows"])


def _run_step(spark: SparkSession, step: Step, how: Execution) -> NodeResult:
    began = time.perf_counter()
    rows_in: int | None = None
    try:
        counts = [e.count(spark) for e in step.read if e.cheap_count or how.count_all_inputs]
        rows_in = sum(counts) if len(counts) == len(step.read) else None
        given = {k: e.value if isinstance(e, Constant) else e.load(spark) for k, e in step.inputs.items()}
        log.info("node %s starts", step.name)
        value = step.node.transform(given[""]) if "" in given else step.node.transform(**given)
        rows_out: int | None = None
        if "" in step.outputs:
            rows_out = _save(spark, step.outputs[""], value)
        elif step.outputs:
            values = value if isinstance(value, Mapping) else {k: getattr(value, k) for k in step.outputs}
            if unknown := [k for k in step.outputs if k not in values]:
                raise KeyError(f"{step.name} gave no output: {', '.join(unknown)}")
            saved = [_save(spark, e, values[k]) for k, e in step.outputs.items() if values[k] is not None]
            rows_out = sum(n for n in saved if n is not None)
        return NodeResult(step.name, True, time.perf_counter() - began, rows_in, rows_out)
    except Exception as e:  # noqa: BLE001  it is reported in the result
        log.error("node %s failed: %s", step.name, e)
        return NodeResult(step.name, False, time.perf_counter() - began, rows_in, None, e)
