"""The context in which scripts run: session, variables, connections, tables and rights."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import library  # noqa: F401  registers operators and commands
from .admin.auth import Policy, Use
from .registry import COMMANDS, OPERATORS
from .script.parser import ScriptError, Statement, expand_command, expand_includes, interpolate, parse, split_statements
from .sources import formats


class ScriptContext:
    """Runs scripts; a table of a script is a temporary view of the session."""

    def __init__(self, spark: SparkSession, owner: str = "admin", policy: Policy | None = None, allow_shell: bool = False, includes: Callable[[str, str], str] | None = None):
        self.spark, self.owner, self.policy, self.allow_shell = spark, owner, policy, allow_shell
        self.variables: dict[str, str] = {}
        self.connections: dict[str, tuple[str, dict[str, str]]] = {}
        self.functions: dict[str, object] = {}
        self.last_table: str | None = None
        self.includes = includes or self._no_include

    @staticmethod
    def _no_include(kind: str, path: str) -> str:
        raise ScriptError(f"nothing to include for {kind}.`{path}`")

    def table(self, name: str | None) -> DataFrame:
        """A table by name; ``command`` is one row without meaning, for operators without input."""
        if name in (None, "command"):
            return self.spark.range(1)
        return self.spark.table(name)

    def publish(self, df: DataFrame, name: str | None) -> DataFrame:
        if name:
            df.createOrReplaceTempView(name)
            self.last_table = name
        return df

    def allow(self, kind: str, path: str, verb: str) -> None:
        if self.policy is not None:
            self.policy.check(self.owner, [Use(kind, path, verb)])

    def run(self, script: str) -> DataFrame | None:
        """Run all statements; the last result."""
        result = None
        for text in split_statements(expand_includes(script, self.includes)):
            result = self.execute(parse(interpolate(text, self.variables)))
        return result

    def execute(self, s: Statement) -> DataFrame | None:
        return getattr(self, f"_do_{s.verb}")(s)

    def _do_set(self, s: Statement) -> None:
        if s.options.get("type") == "defaultParam" and s.path in self.variables:
            return
        value = s.args[0]
        if s.options.get("type") == "sql":
            value = str(self.spark.sql(value).first()[0])
        elif s.options.get("type") == "conf":
            self.spark.conf.set(s.path, value)
        self.variables[s.path] = value

    def _connected(self, s: Statement) -> tuple[str, dict[str, str]]:
        """Path and options after a connection's own; ``name.rest`` addresses ``rest`` in it."""
        name, dot, rest = (s.path or "").partition(".")
        known = self.connections.get(name)
        if known and known[0] == s.format:
            return rest, {**known[1], **s.options}
        return s.path or "", dict(s.options)

    def _do_load(self, s: Statement) -> DataFrame:
        path, options = self._connected(s)
        self.allow("file", path, "load")
        return self.publish(formats.load(self, s.format, path, options), s.output)

    def _do_select(self, s: Statement) -> DataFrame:
        return self.publish(self.spark.sql(s.path), s.output)

    def _do_run(self, s: Statement) -> DataFrame:
        op = OPERATORS.get(s.format)
        if op is None:
            raise ScriptError(f"unknown operator: {s.format}")
        self.allow("system", op.resource, s.verb)
        out = op.train(self, self.table(s.table), s.path, {**s.options, "__dfname__": s.table or ""})
        return self.publish(out, s.output) if out is not None else None

    _do_train = _do_run

    def _do_predict(self, s: Statement) -> DataFrame:
        op = OPERATORS.get(s.format)
        if op is None or op.predict is None:
            raise ScriptError(f"{s.format} does not predict")
        self.allow("system", op.resource, "predict")
        return self.publish(op.predict(self, self.table(s.table), s.path, s.options), s.output)

    def _do_register(self, s: Statement) -> None:
        op = OPERATORS.get(s.format)
        if op is None or op.function is None:
            raise ScriptError(f"{s.format} gives no function")
        op.function(self, s.path, s.output, s.options)

    def _do_save(self, s: Statement):
        path, options = self._connected(s)
        self.allow("file", path, "save")
        return formats.save(self, self.table(s.table), s.format, path, s.mode, options, s.args)

    def _do_connect(self, s: Statement) -> None:
        self.connections[s.output] = (s.format, s.options)

    def _do_include(self, s: Statement):
        return self.run(self.includes(s.format, s.path))

    def _do_command(self, s: Statement) -> DataFrame | None:
        template = COMMANDS.get(s.format)
        if template is None:
            raise ScriptError(f"unknown command: !{s.format}")
        if template in OPERATORS:
            op = OPERATORS[template]
            self.allow("system", op.resource, "run")
            return op.train(self, self.table("command"), "", {"parameters": json.dumps(s.args, ensure_ascii=False), "__dfname__": "command"})
        return self.run(expand_command(template, s.args))


def expand_include(script: str, find: Callable[[str, str], str]) -> dict:
    """{success, sql}: a script with its includes replaced."""
    try:
        return {"success": True, "sql": expand_includes(script, find)}
    except ScriptError as error:
        return {"success": False, "sql": script, "message": str(error)}
