"""Operators and commands by name, with typed parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Param:
    """A parameter of an operator, as forms and explanations show it."""

    name: str
    default: str | None = None
    doc: str = ""
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Operator:
    """``train`` takes (context, frame, path, options) and returns a frame."""

    name: str
    train: Callable
    params: tuple[Param, ...] = ()
    predict: Callable | None = None
    function: Callable | None = None
    doc: str = ""

    @property
    def resource(self) -> str:
        """Name under which authorisation knows the operator."""
        return f"__{''.join('_' + c.lower() if c.isupper() else c for c in self.name).strip('_')}_operator__"


OPERATORS: dict[str, Operator] = {}
COMMANDS: dict[str, str] = {}


def operator(name: str, *params: Param, predict: Callable | None = None, function: Callable | None = None):
    """Register a function as an operator."""

    def add(f: Callable) -> Callable:
        OPERATORS[name] = Operator(name, f, params, predict, function, (f.__doc__ or "").strip())
        return f

    return add


def command(name: str, template: str) -> None:
    """Register a command macro: script text with places for its arguments."""
    COMMANDS[name] = template
