"""What a run leaves: results of nodes and of the pipeline, and their text."""

from __future__ import annotations

import traceback
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class NodeResult:
    """One node's run. Counts are None where counting would have meant another pass over the data."""

    name: str
    success: bool
    seconds: float
    rows_in: int | None = None
    rows_out: int | None = None
    error: BaseException | None = None


@dataclass(frozen=True)
class PipelineResult:
    """A pipeline's run, or what a dry run found."""

    name: str
    success: bool
    seconds: float
    nodes: dict[str, NodeResult] = field(default_factory=dict)
    error: BaseException | None = None
    dry_run: bool = False
    node_count: int = 0
    layer_count: int = 0
    input_count: int = 0

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The nodes' results as rows."""
        rows = [(self.name, n.name, n.success, n.seconds, n.rows_in, n.rows_out, None if n.error is None else str(n.error)) for n in self.nodes.values()]
        return spark.createDataFrame(rows, "pipeline string, node string, success boolean, seconds double, rows_in long, rows_out long, error string")


#: Lines of a stack that the report of a failure shows.
STACK_LINES = 10


def format_result(result: PipelineResult) -> str:
    """The report for people."""
    known = lambda n: "-" if n is None else str(n)
    if result.dry_run:
        return (
            f"Pipeline '{result.name}': dry run, {result.node_count} node(s) in {result.layer_count} layer(s), "
            f"{result.input_count} external input(s) valid"
        )
    lines = [f"Pipeline '{result.name}' {'succeeded' if result.success else 'failed'} in {result.seconds:.2f} s"]
    for n in result.nodes.values():
        counts = f"({known(n.rows_in):>6} → {known(n.rows_out):>6} records)"
        lines.append(f"  {'✓' if n.success else '✗'} {n.name:<40} {n.seconds:6.2f} s {counts}")
    if result.error is not None:
        lines.append(f"  {type(result.error).__name__}: {result.error}")
        stack = "".join(traceback.format_exception(result.error)).splitlines()
        lines += [f"    {x}" for x in stack[-STACK_LINES:]]
    return "\n".join(lines)
