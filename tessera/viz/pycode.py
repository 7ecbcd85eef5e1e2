"""Python source text, piece by piece."""

from __future__ import annotations


class Raw(str):
    """Text that stands for itself, without quotes."""


def literal(value) -> str:
    if isinstance(value, Raw):
        return str(value)
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k!r}: {literal(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value)


class Script:
    """Lines of a script; every method gives the script back."""

    def __init__(self):
        self.lines: list[str] = []

    def imports(self, *names: str) -> Script:
        self.lines += [f"import {n}" if " as " in n or "." not in n else f"from {n.rpartition('.')[0]} import {n.rpartition('.')[2]}" for n in names]
        return self

    def let(self, name: str, value) -> Script:
        self.lines.append(f"{name} = {literal(value)}")
        return self

    def call(self, function: str, *args, to: str | None = None, **named) -> Script:
        inner = ", ".join([*map(literal, args), *(f"{k}={literal(v)}" for k, v in named.items())])
        self.lines.append(f"{to + ' = ' if to else ''}{function}({inner})")
        return self

    def raw(self, text: str) -> Script:
        self.lines.append(text)
        return self

    def text(self) -> str:
        return "\n".join(self.lines) + "\n"
