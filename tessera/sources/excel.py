"""Excel workbooks as a Spark data source, read and written as zipped XML.

Addresses are cells (``A1``), ranges (``A1:C8``), either with a sheet
(``'My Sheet'!B2``), or tables (``Name[#All]``). Rows are read as a stream, so
a sheet never stands in memory whole.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_EPOCH = dt.datetime(1899, 12, 30)
#: Built-in number formats that show dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_address(address: str) -> tuple[str | None, int, int, int | None, int | None]:
    """(sheet, first row, first column, last row, last column), from 1; None where open."""
    sheet = None
    if "!" in address:
        sheet, _, address = address.rpartition("!")
        sheet = sheet.strip("'").replace("''", "'")
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)(?::\$?([A-Za-z]+)\$?(\d+))?", address.strip())
    if not m:
        raise ValueError(f"no cell address: {address}")
    last = (int(m[4]), column_number(m[3])) if m[3] else (None, None)
    return sheet, int(m[2]), column_number(m[1]), *last


class Workbook:
    """Sheets, tables, strings and styles of a workbook."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        rels = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        book = self._xml("xl/workbook.xml")
        self.sheets = [(s.get("name"), "xl/" + rels[s.get(_REL)].removeprefix("/xl/").removeprefix("xl/")) for s in book.iter(f"{_NS}sheet")]
        self.strings = []
        if "xl/sharedStrings.xml" in names:
            self.strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in self._xml("xl/sharedStrings.xml").iter(f"{_NS}si")]
        self.formats, self.colors = self._styles() if "xl/styles.xml" in names else ([], [])
        self.tables = {t.get("displayName") or t.get("name"): (n, t.get("ref")) for n in names if re.fullmatch(r"xl/tables/[^/]+\.xml", n) for t in [self._xml(n)]}

    def _xml(self, name: str) -> ET.Element:
        return ET.fromstring(self.zip.read(name))

    def _styles(self) -> tuple[list[bool], list[str | None]]:
        root = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_NS}numFmt")}
        fills = [next((c.get("rgb") for c in f.iter(f"{_NS}fgColor") if c.get("rgb")), None) for f in root.iter(f"{_NS}fill")]
        xfs = root.find(f"{_NS}cellXfs")
        dates, colors = [], []
        for xf in xfs if xfs is not None else []:
            n = int(xf.get("numFmtId") or 0)
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, ""))
            dates.append(n in _DATE_FORMATS or bool(re.search(r"[ymdhs]", code, re.I)))
            colors.append(fills[int(xf.get("fillId") or 0)] if int(xf.get("fillId") or 0) < len(fills) else None)
        return dates, colors

    def sheet_path(self, sheet: str | None) -> str:
        if not self.sheets:
            raise ValueError("the workbook has no sheet")
        if sheet is None:
            return self.sheets[0][1]
        for name, path in self.sheets:
            if name == sheet:
                return path
        if sheet.isdigit() and int(sheet) < len(self.sheets):
            return self.sheets[int(sheet)][1]
        raise ValueError(f"no sheet {sheet!r}")

    def table_sheet(self, table: str) -> tuple[str, str]:
        """(sheet path, range) of a table."""
        if table not in self.tables:
            raise ValueError(f"no table {table!r}")
        part, ref = self.tables[table]
        for _, path in self.sheets:
            rels = re.sub(r"([^/]+)$", r"_rels/\1.rels", path)
            if rels in self.zip.namelist() and any(r.get("Target", "").endswith(part.rpartition("/")[2]) for r in self._xml(rels)):
                return path, ref
        return self.sheets[0][1], ref

    def rows(self, path: str) -> Iterator[tuple[int, dict[int, tuple]]]:
        """(row number, {column: (value, color)}) in order, as a stream."""
        number = 0
        with self.zip.open(path) as source:
            for _, row in ET.iterparse(source):
                if row.tag != f"{_NS}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells, column = {}, 0
                for c in row.findall(f"{_NS}c"):
                    ref = c.get("r")
                    column = column_number(re.match("[A-Za-z]+", ref)[0]) if ref else column + 1
                    cells[column] = (self._value(c), self._color(c))
                yield number, cells
                row.clear()

    def _color(self, c) -> str | None:
        s = int(c.get("s") or 0)
        return self.colors[s] if s < len(self.colors) else None

    def _value(self, c):
        kind, v = c.get("t"), c.find(f"{_NS}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind in ("str", "e"):
            return v.text if kind == "str" else None
        number = float(v.text)
        s = int(c.get("s") or 0)
        if s < len(self.formats) and self.formats[s]:
            return _EPOCH + dt.timedelta(days=number)
        return number


def header_names(values: list, header: bool) -> list[str]:
    """Column names: blanks are ``_cN``, later duplicates get their place."""
    if not header:
        return [f"_c{k}" for k in range(len(values))]
    raw = [f"_c{k}" if v is None or str(v).strip() == "" else _plain(v) for k, v in enumerate(values)]
    seen = [r.lower() for r in raw]
    return [f"{r}{k}" if seen.count(r.lower()) > 1 else r for k, r in enumerate(raw)]


def _plain(v) -> str:
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return str(int(v))
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def infer_type(values: list, empty_as_null: bool = True) -> T.DataType:
    """Type of a column's excerpt: one kind stays, mixed kinds and none are strings."""
    kinds = {type(v) for v in values if v is not None and not (empty_as_null and v == "")}
    known = {float: T.DoubleType(), bool: T.BooleanType(), dt.datetime: T.TimestampNTZType()}
    return known.get(kinds.pop(), T.StringType()) if len(kinds) == 1 else T.StringType()


def _bytes(path: str) -> bytes:
    """A workbook's bytes, by the session's file systems if there is a session here, else as a local file."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None or "://" not in path:
        with open(path.removeprefix("file:"), "rb") as f:
            return f.read()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


class Options(dict):
    """Options by name in any case."""

    def __init__(self, items):
        super().__init__({k.lower(): v for k, v in items.items()})

    def __getitem__(self, key):
        return super().__getitem__(key.lower())

    def __contains__(self, key):
        return super().__contains__(key.lower())

    def get(self, key, default=None):
        return super().get(key.lower(), default)


def _flag(options, name: str, default: bool = False) -> bool:
    return str(options.get(name, default)).lower() == "true"


class Sheet:
    """Header and rows of the part of a workbook that options name."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        if "header" not in options and "useHeader" not in options:
            raise ValueError("excel needs the option 'header'")
        self.header = _flag(options, "header", _flag(options, "useHeader"))
        self.book = Workbook(_bytes(options["path"]))
        address = options.get("dataAddress", "A1")
        table = re.fullmatch(r"(\w+)\[#All\]", address)
        if table:
            self.path, ref = self.book.table_sheet(table[1])
            _, self.top, self.left, self.bottom, self.right = parse_address(ref)
        else:
            sheet, self.top, self.left, self.bottom, self.right = parse_address(address)
            self.path = self.book.sheet_path(sheet or options.get("sheetName"))
        self.top += int(options.get("skipFirstNLines", 0))

    def raw(self) -> Iterator[list[tuple]]:
        width = self.right - self.left + 1 if self.right else None
        for number, cells in self.book.rows(self.path):
            if number < self.top or self.bottom and number > self.bottom:
                continue
            if width is None:
                width = max((c for c in cells if c >= self.left), default=self.left) - self.left + 1
            row = [cells.get(self.left + k, (None, None)) for k in range(width)]
            if any(v is not None for v, _ in row) or self.bottom:
                yield row

    def parts(self) -> tuple[list[str], Iterator[list[tuple]]]:
        rows = self.raw()
        first = next(rows, None)
        if first is None:
            return [], iter(())
        names = header_names([v for v, _ in first], self.header)
        return names, rows if self.header else _chain(first, rows)

    def schema(self) -> T.StructType:
        names, rows = self.parts()
        kinds: list[T.DataType] = [T.StringType()] * len(names)
        if _flag(self.options, "inferSchema"):
            excerpt = [r for r, _ in zip(rows, range(int(self.options.get("excerptSize", 10))))]
            kinds = [infer_type([r[k][0] for r in excerpt], _flag(self.options, "treatEmptyValuesAsNulls", True)) for k in range(len(names))]
        fields = [T.StructField(n, k, True) for n, k in zip(names, kinds)]
        if _flag(self.options, "addColorColumns"):
            fields += [T.StructField(f"{n}_color", T.StringType(), True) for n in names]
        return T.StructType(fields)


def _chain(first, rest):
    yield first
    yield from rest


def cast_cell(v, kind: T.DataType, plain: bool = True, empty_as_null: bool = True):
    """A cell's value as a type; what doesn't fit is null."""
    if v is None or v == "" and (empty_as_null or not isinstance(kind, T.StringType)):
        return None
    try:
        if isinstance(kind, T.StringType):
            return _plain(v)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return v if isinstance(v, dt.datetime) else dt.datetime.fromisoformat(str(v))
        if isinstance(kind, T.DateType):
            return v.date() if isinstance(v, dt.datetime) else dt.date.fromisoformat(str(v))
        if isinstance(kind, T.BooleanType):
            return v if isinstance(v, bool) else str(v).lower() == "true"
        if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            return int(float(v))
        if isinstance(kind, T.DecimalType):
            from decimal import Decimal

            return Decimal(str(v))
        return float(v)
    except (ValueError, TypeError, ArithmeticError):
        return None


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def read(self, partition):
        sheet = Sheet(self.options)
        names, rows = sheet.parts()
        place = {n: k for k, n in enumerate(names)}
        empty = _flag(self.options, "treatEmptyValuesAsNulls", True)
        for row in rows:
            out = []
            for f in self.schema.fields:
                k = place.get(f.name)
                if k is None and f.name.endswith("_color") and f.name[:-6] in place:
                    k = place[f.name[:-6]]
                    out.append(row[k][1] if k < len(row) else None)
                else:
                    out.append(cast_cell(row[k][0], f.dataType, empty_as_null=empty) if k is not None and k < len(row) else None)
            yield tuple(out)


def write_workbook(path: str, sheets: dict[str, tuple[list[str], list[list]]], header: bool = True, top: int = 1, left: int = 1) -> None:
    """Sheets of names and rows as a workbook on a local path."""
    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (dt.datetime, dt.date)):
            moment = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
            days = (moment.replace(tzinfo=None) - _EPOCH) / dt.timedelta(days=1)
            return f'<c r="{ref}" s="{1 if isinstance(v, dt.datetime) else 2}"><v>{days!r}</v></c>'
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{rels}<Relationship Id="rId{len(sheets) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for k, (names, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as out:
                out.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for n, row in enumerate(([names] if header else []) + rows, top):
                    out.write(f'<row r="{n}">{"".join(cell(f"{column_letters(left + c)}{n}", v) for c, v in enumerate(row))}</row>'.encode())
                out.write(b"</sheetData></worksheet>")


class _Rows(WriterCommitMessage):
    def __init__(self, rows: list):
        self.rows = rows


class _Writer(DataSourceWriter):
    """Rows meet where the workbook is written: one file of a format that ends at about a million rows."""

    LIMIT = 1_048_576

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.options, self.overwrite = schema, options, overwrite

    def write(self, rows):
        kept = [list(r) for r in rows]
        if len(kept) > self.LIMIT:
            raise ValueError(f"a sheet holds {self.LIMIT} rows at most")
        return _Rows(kept)

    def commit(self, messages):
        import os

        path = self.options["path"].removeprefix("file:")
        rows = [r for m in messages if m is not None for r in m.rows]
        if len(rows) > self.LIMIT:
            raise ValueError(f"a sheet holds {self.LIMIT} rows at most")
        sheet, top, left, _, _ = parse_address(self.options.get("dataAddress", "A1"))
        sheet = sheet or self.options.get("sheetName", "Sheet1")
        sheets: dict = {}
        if os.path.exists(path) and not self.overwrite:
            book = Workbook(_bytes(path))
            for name, part in book.sheets:
                own = [[v for v, _ in (cells.get(k, (None, None)) for k in range(1, max(cells, default=0) + 1))] for _, cells in book.rows(part)]
                sheets[name] = (own[0] if own else [], own[1:])
        sheets[sheet] = (self.schema.names, rows)
        write_workbook(path, sheets, _flag(self.options, "header", True), top, left)


class ExcelSource(DataSource):
    """``spark.read.format("excel")`` after ``register``."""

    @classmethod
    def name(cls):
        return "excel"

    def schema(self):
        return Sheet(Options(self.options)).schema()

    def reader(self, schema):
        return _Reader(schema, Options(self.options))

    def writer(self, schema, overwrite):
        return _Writer(schema, Options(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(ExcelSource)
