"""Nodes: named transformations of named inputs."""

from __future__ import annotations

import inspect
import logging
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass


class Node(ABC):
    """A transformation. Subclasses give ``transform``, whose parameters name the inputs (and settings), and which returns
    a DataFrame, a value, a dict of outputs by name, or None. ``parameters`` and ``logger`` are set before it runs.

    A node can be tested by calling ``transform`` itself.
    """

    parameters: object = None

    def __init__(self, parameters: object = None) -> None:
        if parameters is not None:
            self.parameters = parameters
        self.logger = logging.getLogger(f"tessera.{type(self).__name__}")

    @abstractmethod
    def transform(self, *args, **inputs): ...  # noqa: ANN002, ANN003, ANN201


class FunctionNode(Node):
    """A node made of a function."""

    def __init__(self, function: Callable) -> None:
        super().__init__()
        self.function = function
        self.transform = function  # type: ignore[method-assign]

    def transform(self, *args, **inputs):  # noqa: ANN002, ANN003, ANN201
        return self.function(*args, **inputs)


class PassThrough(Node):
    """Gives its input as it is: a change of format."""

    def transform(self, data):  # noqa: ANN001, ANN201
        return data


@dataclass(frozen=True)
class Constant:
    """An input that is a value of its own and not an entry; it cannot be an output."""

    value: object


def input_names(node: Node) -> tuple[list[str], list[str], bool]:
    """Names of all inputs, of those that must be given, and whether any name is taken."""
    given = inspect.signature(node.transform).parameters.values()
    named = [p for p in given if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)]
    return [p.name for p in named], [p.name for p in named if p.default is p.empty], any(p.kind == p.VAR_KEYWORD for p in given)


def node_type(node: Node) -> str:
    return node.function.__name__ if isinstance(node, FunctionNode) else type(node).__name__
