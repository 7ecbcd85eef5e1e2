"""HBase rows as (rowkey, content) tables: addresses, cell codecs and row building.

The client is a transport that a deployment gives: an object with
``scan(table, family)``, which yields (rowkey, {(family, column): (bytes, ts)}),
and ``put(table, rows)``. One with ``create(table, family, splits)`` makes a
missing table, split in as many regions as the option ``numReg`` says. One with
``regions(table)``, a list of (start, stop) keys, is scanned by executors, a task
a region, through ``scan_range(table, family, start, stop)``; it goes to them
pickled. Codecs and shapes are here and need none.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that a task of a scan hands on at once.
ROWS_AT_ONCE = 1000
_CODES = {"int": ">i", "long": ">q", "short": ">h", "float": ">f", "double": ">d"}
_ALIASES = {"integer": "int", "bigint": "long", "smallint": "short", "bool": "boolean"}


def encode(value, kind: str) -> bytes:
    """A value as HBase stores its type: big-endian numbers, UTF-8 texts, one byte for a boolean."""
    kind = _ALIASES.get(kind.lower(), kind.lower())
    if kind in _CODES:
        return struct.pack(_CODES[kind], value)
    if kind == "boolean":
        return b"\xff" if value else b"\x00"
    if kind == "binary":
        return bytes(value)
    return str(value).encode()


def decode(data: bytes, kind: str = "string"):
    kind = _ALIASES.get(kind.lower(), kind.lower())
    if kind in _CODES:
        return struct.unpack(_CODES[kind], data)[0]
    if kind == "boolean":
        return data != b"\x00"
    if kind == "binary":
        return list(data)
    return data.decode()


def parse_address(path: str) -> tuple[str | None, str, str]:
    """(connection, namespace, table) of ``conn:ns:table``, ``ns:table`` or ``table``."""
    parts = path.split(":")
    if len(parts) > 3 or not all(parts):
        raise ValueError(f"no table address: {path}")
    return (parts[0] if len(parts) == 3 else None, parts[-2] if len(parts) > 1 else "default", parts[-1])


def field_types(options: dict[str, str]) -> dict[str, str]:
    """Types by column from ``field.type.<column>`` options."""
    return {k.removeprefix("field.type."): v for k, v in options.items() if k.startswith("field.type.")}


def rows_of(scan: Iterable, types: dict[str, str], ts_suffix: str = "_ts") -> Iterator[tuple[str, str]]:
    """(rowkey, content): JSON of ``family:column`` values and their times; empty rows are left out."""
    for key, cells in scan:
        content: dict = {}
        for (family, column), (data, ts) in sorted(cells.items()):
            content[f"{family}:{column}"] = decode(data, types.get(column, "string"))
            content[f"{family}:{column}{ts_suffix}"] = ts
        if content:
            yield (key.decode() if isinstance(key, bytes) else key), json.dumps(content, ensure_ascii=False)


def read(spark: SparkSession, client, path: str, options: dict[str, str]) -> DataFrame:
    _, namespace, table = parse_address(path)
    name, family, types, suffix = f"{namespace}:{table}", options.get("family"), field_types(options), options.get("tsSuffix", "_ts")
    schema = "rowkey string, content string"
    if not hasattr(client, "regions"):
        return spark.createDataFrame(list(rows_of(client.scan(name, family), types, suffix)), schema)
    regions = [(k, bytes(start), bytes(stop)) for k, (start, stop) in enumerate(client.regions(name))]
    if not regions:
        return spark.createDataFrame([], schema)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in zip(batch.column("start").to_pylist(), batch.column("stop").to_pylist()):
                rows = rows_of(client.scan_range(name, family, start, stop), types, suffix)
                while part := list(itertools.islice(rows, ROWS_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([c for _, c in part])], ["rowkey", "content"])

    dealt = spark.createDataFrame(regions, "k int, start binary, stop binary").repartitionByRange(len(regions), "k")
    return dealt.select("start", "stop").mapInArrow(scan, schema)


def cells_of(row: dict, family: str = "f", rowkey: str = "rowkey", ts_suffix: str | None = None, types: dict[str, str] | None = None) -> tuple[bytes, dict]:
    """(rowkey, cells) of a row; with a suffix, ``<column><suffix>`` is the time of ``<column>``."""
    types = types or {}
    cells = {}
    for name, value in row.items():
        if name == rowkey or value is None or ts_suffix and name.endswith(ts_suffix) and name[: -len(ts_suffix)] in row:
            continue
        ts = row.get(f"{name}{ts_suffix}") if ts_suffix else None
        cells[family, name] = (encode(value, types.get(name, "string")), ts)
    return str(row[rowkey]).encode(), cells


def split_keys(regions: int) -> list[bytes]:
    """Keys that split a new table of more than three regions, evenly from aaaaaaa to zzzzzzz."""
    if regions <= 3:
        return []
    low, high = int.from_bytes(b"aaaaaaa", "big"), int.from_bytes(b"zzzzzzz", "big")
    return [(low + (high - low) * k // (regions - 2)).to_bytes(7, "big") for k in range(regions - 1)]


def write(df: DataFrame, connect, path: str, options: dict[str, str]) -> None:
    """Rows of each partition go to a client of their own, which ``connect`` makes."""
    _, namespace, table = parse_address(path)
    key, family, suffix = options.get("rowkey", "rowkey"), options.get("family", "f"), options.get("tsSuffix")
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    if int(options.get("numReg", 0)):
        own = connect()
        if hasattr(own, "create"):
            own.create(f"{namespace}:{table}", family, split_keys(int(options["numReg"])))

    def put(rows):
        connect().put(f"{namespace}:{table}", [cells_of(r.asDict(), family, key, suffix, types) for r in rows])

    df.where(F.col(key).isNotNull()).foreachPartition(put)
