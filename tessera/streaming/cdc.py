"""Change data capture: JSON change events merged into tables, with schema changes replayed.

An event has database, table, type (INSERT, UPDATE, DELETE, ALTER, TRUNCATE),
ts, sql, pkNames and a data array of row objects. Row values are strings, as
the change log writes them, and are cast to the target's types.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from .versioned import VersionedTable

EVENT = T.StructType(
    [
        T.StructField("database", T.StringType()), T.StructField("table", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("ts", T.LongType()), T.StructField("sql", T.StringType()), T.StructField("isDdl", T.BooleanType()),
        T.StructField("pkNames", T.ArrayType(T.StringType())), T.StructField("data", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)
TS, DELETED = "___ts___", "___delete___"

#: MySQL column types as Spark types; fixed names.
MYSQL_TYPES = {
    "tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "integer": "int", "bigint": "bigint", "float": "float", "double": "double", "real": "double",
    "bit": "boolean", "bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "time": "string", "year": "int",
    "char": "string", "varchar": "string", "tinytext": "string", "text": "string", "mediumtext": "string", "longtext": "string", "enum": "string", "set": "string", "json": "string",
    "binary": "binary", "varbinary": "binary", "tinyblob": "binary", "blob": "binary", "mediumblob": "binary", "longblob": "binary",
}
#: The next wider type holds the values of an unsigned one.
_UNSIGNED = {"tinyint": "smallint", "smallint": "int", "int": "bigint", "bigint": "decimal(20,0)"}


def spark_type(mysql: str) -> str:
    """Spark type of a MySQL column type like ``decimal(10,2) unsigned``."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(([^)]*)\))?\s*(.*)", mysql.strip().lower(), re.S)
    if not m:
        raise ValueError(f"no column type: {mysql}")
    name, size, rest = m.groups()
    if name in ("decimal", "numeric", "dec", "fixed"):
        digits = [int(x) for x in (size or "10,0").split(",")]
        return f"decimal({min(digits[0], 38)},{digits[1] if len(digits) > 1 else 0})"
    if name == "tinyint" and (size or "").strip() == "1":
        return "boolean"
    if name not in MYSQL_TYPES:
        raise ValueError(f"unknown column type: {mysql}")
    kind = MYSQL_TYPES[name]
    return _UNSIGNED.get(kind, kind) if "unsigned" in rest else kind


def parse_events(df: DataFrame, table: str | None = None, min_ts: int = 0) -> DataFrame:
    """Events from a string column ``value``, of ``database.table`` and no older than ``min_ts``."""
    events = df.select(F.from_json("value", EVENT).alias("e")).select("e.*").where(F.col("ts") >= min_ts)
    return events if table is None else events.where(F.concat_ws(".", "database", "table") == table)


def latest_changes(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(row, ts, type) of the last change of each key; at equal times UPDATE wins over INSERT over DELETE."""
    rows = events.where(F.col("type").isin("INSERT", "UPDATE", "DELETE")).select("ts", "type", F.explode("data").alias("row"))
    # Maps have no order; their sorted entries have, and break ties for good.
    entries = F.array_sort(F.map_entries("row"))
    picked = F.max(F.struct("ts", "type", entries.alias("entries"))).alias("last")
    grouped = rows.groupBy(*[F.col("row")[k].alias(f"__k{n}") for n, k in enumerate(keys)]).agg(picked)
    return grouped.select(F.map_from_entries("last.entries").alias("row"), "last.ts", "last.type")


def merge_changes(target: DataFrame, events: DataFrame, keys: Sequence[str], only_newer: bool = True) -> DataFrame:
    """The target after the events: deletes, updates and inserts by key.

    One full outer join on the keys. ``only_newer`` keeps a row that is newer
    than the change, so that a batch may be replayed.
    """
    if TS not in target.columns:
        target = target.withColumn(TS, F.lit(0).cast("long"))
    fields = [f for f in target.schema.fields if f.name != TS]
    last = latest_changes(events, keys)
    values = [F.col("row")[f.name].try_cast(f.dataType).alias(f.name) for f in fields]
    changes = last.select(*values, F.col("ts").alias(TS), (F.col("type") == "DELETE").alias(DELETED))
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = target.withColumn("__t", F.lit(True)).alias("t").join(changes.withColumn("__c", F.lit(True)).alias("c"), on, "full_outer")
    wins = F.col("c.__c").isNotNull()
    if only_newer:
        wins = wins & (F.col("t.__t").isNull() | (F.col(f"c.{TS}") >= F.col(f"t.{TS}")))
    out = [F.when(wins, F.col(f"c.{f.name}")).otherwise(F.col(f"t.{f.name}")).alias(f.name) for f in [*fields, T.StructField(TS, T.LongType())]]
    return joined.where(~(wins & F.coalesce(F.col(f"c.{DELETED}"), F.lit(False))) & (wins | F.col("t.__t").isNotNull())).select(*out)


_ALTER = re.compile(r"\s*alter\s+table\s+(?:`?[\w$]+`?\.)?`?[\w$]+`?\s+(.*)", re.I | re.S)


def _clauses(text: str) -> list[str]:
    """Comma-separated clauses outside brackets and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for k, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and not depth:
            out.append(text[at:k])
            at = k + 1
    return [c.strip() for c in [*out, text[at:]] if c.strip()]


#: Clauses about keys, indexes and storage, which change no column.
_NO_COLUMN = re.compile(r"(?:add|drop|rename)\s+(?:(?:unique|fulltext|spatial)\s+)?(?:index|key|constraint|primary\s+key|unique|foreign\s+key|check|partition)\b|(?:engine|auto_increment|comment|charset|collate|row_format|default\s+(?:charset|character))\b|(?:convert|order|enable|disable|algorithm|lock|force|analyze|optimize)\b", re.I)


def _placed(df: DataFrame, name: str, rest: str) -> DataFrame:
    """The columns in order after FIRST or AFTER, which end a definition."""
    m = re.search(r"\s(?:(first)|after\s+(`[^`]+`|[\w$]+))\s*$", re.sub(r"'(?:[^']|'')*'", "''", rest), re.I)
    if not m:
        return df
    others = [c for c in df.columns if c.lower() != name.lower()]
    own = next(c for c in df.columns if c.lower() == name.lower())
    if m[1]:
        at = 0
    else:
        before = m[2].strip("`").lower()
        at = next((k + 1 for k, c in enumerate(others) if c.lower() == before), len(others))
    return df.select(*[F.col(f"`{c}`") for c in [*others[:at], own, *others[at:]]])


def apply_ddl(df: DataFrame, sql: str) -> DataFrame:
    """A table after ADD, DROP, CHANGE, MODIFY, RENAME COLUMN or TRUNCATE; changes of keys, indexes and storage leave it as it is."""
    text = sql.strip().rstrip(";")
    if re.match(r"truncate\b", text, re.I):
        return df.limit(0)
    m = _ALTER.fullmatch(text)
    if not m:
        raise ValueError(f"no schema change: {sql}")
    for clause in _clauses(m[1]):
        if _NO_COLUMN.match(clause):
            continue
        verb, _, rest = clause.partition(" ")
        rest = re.sub(r"^column\s+", "", rest.strip(), flags=re.I)
        verb = verb.lower()
        if verb in ("add", "change", "modify"):
            names, kind, default = _definition(rest, 2 if verb == "change" else 1)
            if verb == "add":
                df = df.withColumn(names[0], F.lit(default).cast(kind))
            elif verb == "change":
                df = df.withColumnRenamed(names[0], names[1]).withColumn(names[1], F.col(f"`{names[1]}`").try_cast(kind))
            else:
                df = df.withColumn(names[0], F.col(f"`{names[0]}`").try_cast(kind))
            df = _placed(df, names[-1], rest)
        elif verb == "drop":
            df = df.drop(rest.strip().strip("`"))
        elif verb == "rename":
            pair = re.fullmatch(r"(`[^`]+`|[\w$]+)\s+to\s+(`[^`]+`|[\w$]+)", rest.strip(), re.I)
            if pair:  # else the table itself has another name now
                df = df.withColumnRenamed(pair[1].strip("`"), pair[2].strip("`"))
        else:
            raise ValueError(f"schema change not known: {clause}")
    return df


def _definition(text: str, names: int) -> tuple[list[str], str, str | None]:
    found = []
    for _ in range(names):
        m = re.match(r"\s*(`[^`]+`|[\w$]+)\s+", text)
        if not m:
            raise ValueError(f"no column definition: {text}")
        found.append(m[1].strip("`"))
        text = text[m.end() :]
    kind = re.match(r"\w+(?:\s*\([^)]*\))?(?:\s+unsigned)?", text, re.I)
    default = re.search(r"\bdefault\s+(?:'((?:[^']|'')*)'|(\S+))", text, re.I)
    value = None if not default or (default[2] or "").lower() == "null" else (default[1] if default[1] is not None else default[2])
    return found, spark_type(kind[0]), value


def apply_batch(table: VersionedTable, events: DataFrame, keys: Sequence[str], only_newer: bool = True) -> DataFrame:
    """Merge one batch into a table: row changes up to a schema change, the change, and so on."""
    ddl = events.where(F.col("type").isin("ALTER", "TRUNCATE")).select("ts", "sql").distinct().orderBy("ts", "sql").collect()
    df, low = table.read(), None
    for step in [*ddl, None]:
        part = events if low is None else events.where(F.col("ts") >= low)
        if step is not None:
            part = part.where(F.col("ts") < step["ts"])
        df = merge_changes(df, part, keys, only_newer)
        if step is not None:
            df = apply_ddl(df, step["sql"])
            low = step["ts"]
    table.write(df, "overwrite", "cdc")
    return table.read()


def stream_into(stream: DataFrame, path: str, db_table: str, keys: Sequence[str], checkpoint: str, trigger: dict | None = None):
    """A running query that merges each micro-batch of JSON events into a versioned table."""

    def merge(batch: DataFrame, _: int) -> None:
        apply_batch(VersionedTable(batch.sparkSession, path), parse_events(batch, db_table), keys)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
