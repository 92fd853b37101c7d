"""Nodes and pipelines."""

from tessera.plans.node import Constant, FunctionNode, Node, PassThrough
from tessera.plans.pipeline import Execution, Pipeline, PipelineBuilder, PipelineError, Step
from tessera.plans.results import NodeResult, PipelineResult, format_result

__all__ = [
    "Constant", "Execution", "FunctionNode", "Node", "NodeResult", "PassThrough", "Pipeline", "PipelineBuilder", "PipelineError",
    "PipelineResult", "Step", "format_result",
]
