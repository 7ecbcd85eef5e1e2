"""Python cells: ``#%key=value`` headers and a body that maps batches of a table.

The body defines ``run(batches)``, which takes and gives pandas frames. Headers
are ``input`` and ``output`` tables and the output ``schema``; ``cache=true``
keeps the result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_HINT = re.compile(r"\s*(?:#|--)%\s*([\w.]+)\s*=\s*(.*?)\s*$")


def read_hints(cell: str) -> tuple[dict[str, str], str]:
    """(headers, body) of a cell."""
    lines = cell.strip("\n").split("\n")
    headers: dict[str, str] = {}
    at = 0
    while at < len(lines) and (m := _HINT.match(lines[at])):
        headers[m[1]] = m[2]
        at += 1
    return headers, "\n".join(lines[at:])


def run_python_cell(ctx, cell: str) -> DataFrame:
    """Run a cell over its input table; only where the context allows code."""
    if not ctx.allow_shell:
        raise PermissionError("this context does not allow Python cells")
    headers, body = read_hints(cell)

    def run(batches):
        scope: dict = {}
        exec(compile(body, "cell", "exec"), scope)
        yield from scope["run"](batches)

    out = ctx.table(headers.get("input")).mapInPandas(run, headers["schema"])
    if headers.get("cache") == "true":
        out = out.cache()
    return ctx.publish(out, headers.get("output"))
