"""``python -m tessera script.file``: run a script and show its last table."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .context import ScriptContext


def main(args: list[str]) -> int:
    if len(args) != 1:
        print(__doc__)
        return 2
    with open(args[0], encoding="utf-8") as script:
        result = ScriptContext(SparkSession.builder.appName("tessera").getOrCreate()).run(script.read())
    if result is not None:
        result.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
