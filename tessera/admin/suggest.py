"""Completions for a place in a script."""

from __future__ import annotations

from ..registry import COMMANDS, OPERATORS

_VERBS = ("set", "load", "select", "run", "train", "predict", "save", "connect", "include", "register")


def suggest(context, script: str, line: int, column: int) -> list[str]:
    """Names that can stand at (line, column), both from 0: verbs, commands, operators, tables, columns."""
    lines = script.split("\n")
    before = "\n".join([*lines[:line], lines[line][:column] if line < len(lines) else ""])
    statement = before.rsplit(";", 1)[-1].lstrip()
    word = statement.rsplit(None, 1)[-1] if statement and not statement[-1].isspace() else ""
    words = statement.lower().split()
    if word.startswith("!"):
        names = ["!" + c for c in COMMANDS]
    elif len(words) <= (1 if word else 0):
        names = list(_VERBS)
    elif words[0] in ("run", "train", "predict") and "as" in words:
        names = list(OPERATORS)
    elif "." in word and words[0] == "select":
        table = word.partition(".")[0]
        known = {t.name for t in context.spark.catalog.listTables()}
        names = [f"{table}.{c}" for c in context.spark.table(table).columns] if table in known else []
    else:
        names = sorted(t.name for t in context.spark.catalog.listTables())
    return [n for n in names if n.lower().startswith(word.lower())]
