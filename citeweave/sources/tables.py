"""Tables in SQLite files and in JSON documents, as Spark sources and sinks; column roles; reports."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from citeweave.sources.json_ranges import JsonDocument
from citeweave.sources.single_file import write_lines

# Names of the first columns of a positional table, and the keys that may wrap one.
POSITIONAL, WRAPPERS = ["SuraID", "AyahID", "AyahText"], ["rows", "data", "records", "verses"]
SLICE = 100_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    with open(path, "rb") as f:
        if f.read(16)[:15] != b"SQLite format 3":
            raise ValueError(f"{path} is no SQLite database")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def list_tables(path: str) -> list[str]:
    with _opened(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def table_sql(path: str, table: str) -> str | None:
    with _opened(path) as db:
        found = db.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()
    return found and found[0]


def _kind(declared: str):
    d = declared.upper()
    return LongType() if "INT" in d else StringType() if any(x in d for x in ("CHAR", "CLOB", "TEXT")) else BinaryType() if "BLOB" in d else DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else StringType()


class _Slice(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowid with SLICE rows each, wherever the numbers lie; a table without rowid is one partition."""
        with _opened(self.path) as db:
            try:
                cuts = [r[0] for r in db.execute(f"SELECT rowid FROM (SELECT rowid, row_number() OVER (ORDER BY rowid) AS n FROM {quoted(self.table)}) WHERE n % {SLICE} = 1 ORDER BY rowid")]
                high = db.execute(f"SELECT max(rowid) FROM {quoted(self.table)}").fetchone()[0]
            except sqlite3.OperationalError:
                return [_Slice(None, None)]
        return [_Slice(a, b) for a, b in zip(cuts, [*cuts[1:], high + 1])] if cuts else [_Slice(0, 0)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        casts = {LongType: int, DoubleType: float, StringType: str, BinaryType: bytes}

        def value(x, kind):
            try:
                return None if x is None else casts[type(kind)](x)
            except (TypeError, ValueError):
                return None

        with _opened(self.path) as db:
            every = f"SELECT {', '.join(quoted(f.name) for f in self.schema)} FROM {quoted(self.table)}"
            some = (every,) if partition.low is None else (f"{every} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (partition.low, partition.high))
            for row in db.execute(*some):
                yield tuple(value(x, f.dataType) for x, f in zip(row, self.schema))


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("table", name).load(path); ranges of rowid are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _opened(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(n, _kind(t or ""), True, {"declared": t or "", "primary_key": bool(pk), "not_null": bool(nn), "default": d if d is None else str(d)}) for _, n, t, nn, d, pk in found])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def write_sqlite(df: DataFrame, path: str, table: str, ddl: str | None = None) -> None:
    """A new database with one table, rows as they arrive, in one transaction. A SQLite file has one writer: the driver."""
    db = sqlite3.connect(path)
    try:
        with db:
            db.execute(ddl or f"CREATE TABLE {quoted(table)} ({', '.join(map(quoted, df.columns))})")
            db.executemany(f"INSERT INTO {quoted(table)} ({', '.join(map(quoted, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in df.toLocalIterator()))
    finally:
        db.close()


def update_sqlite(updates: DataFrame, path: str, table: str, column: str, key: str) -> int:
    """Set a column by key in a database as it lies, from rows (key, value), in one transaction; the rows that changed."""
    with _opened(path):
        pass
    db = sqlite3.connect(path)
    try:
        with db:
            return db.executemany(f"UPDATE {quoted(table)} SET {quoted(column)} = ? WHERE {quoted(key)} = ?", ((r[1], r[0]) for r in updates.toLocalIterator())).rowcount
    finally:
        db.close()


def read_table(spark: SparkSession, path: str, table: str | None = None) -> tuple[DataFrame, dict]:
    """A table from a .json document or a SQLite database (by default its first table), and how to write it back."""
    if path.lower().endswith(".json"):
        df, layout = read_json_table(spark, path)
        return df, {"format": "json", **layout}
    table = table or next(iter(list_tables(path)), None)
    if table is None:
        raise ValueError(f"{path} has no table")
    register(spark)
    return spark.read.format("sqlite").option("table", table).load(path), {"format": "sqlite", "table": table, "ddl": table_sql(path, table)}


def save_table(df: DataFrame, layout: dict, path: str, n_approved: int, form: str = "auto") -> str:
    """Write a table in the format it came in, or as JSON; returns the format. Without an approved change nothing is written."""
    if not n_approved:
        raise ValueError("nothing is approved")
    form = layout["format"] if form == "auto" else form
    if form == "sqlite":
        write_sqlite(df, path, layout["table"], layout.get("ddl"))
    elif layout["format"] == "json":
        write_json_table(df, layout, path)
    else:  # a database as JSON: an array of objects, in the order of the rows
        order = df.select(F.monotonically_increasing_id().alias("row_index"), *(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))).alias(c) for c in df.columns))
        cells = order.select("row_index", *(F.to_json(F.expr(f"variant_get(parse_json(`{c}`), '$.v')")).alias(c) for c in df.columns))
        write_json_table(cells, {"wrapper": None, "objects": True, "columns": df.columns}, path)
    return form


def read_json_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A table in one JSON document, cells as JSON text, in column order; and its layout, for writing it back.

    Arrays of arrays: short rows get nulls, a row that is no array is all null. Arrays of objects: the keys in the order
    they come. An object: the first of its keys rows, data, records, verses that isn't missing.
    """
    document, span = JsonDocument(spark, path), (None, None)
    layout: dict = {"wrapper": None}
    if document.keys is not None:
        values = {k: (a, b) for k, a, b in document.keys}
        for w in WRAPPERS:
            if w in values and not document.missing(*values[w]):
                span, layout["wrapper"] = values[w], w
                # what stands beside the rows is kept as it is, for writing it back
                layout["beside"] = [(k, None if k == w else document.text(*values[k])) for k in values]
                break
        else:
            raise ValueError("the document holds no table")
    rows = document.elements(*span).select("row_index", F.parse_json("value").alias("r"))
    first = rows.filter(F.col("r").isNotNull() & ~F.expr("is_variant_null(r)")).orderBy("row_index").select(F.expr("schema_of_variant(r)")).limit(1).collect()
    if not first:
        raise ValueError("the document holds no rows")
    if first[0][0].startswith("ARRAY"):
        layout["objects"] = False
        lists = rows.select("row_index", F.expr("if(schema_of_variant(r) like 'ARRAY%', cast(r as array<variant>), null)").alias("a"))
        width = lists.agg(F.max(F.size("a"))).first()[0]
        names = [*POSITIONAL, *(f"col{i}" for i in range(4, width + 1))][:width]
        table = lists.select("row_index", *(F.to_json(F.get("a", F.lit(i))).alias(n) for i, n in enumerate(names)))
    elif first[0][0].startswith("OBJECT"):
        layout["objects"] = True
        maps = rows.select("row_index", F.expr("if(schema_of_variant(r) like 'OBJECT%', cast(r as map<string, variant>), null)").alias("m"), F.expr("if(schema_of_variant(r) like 'OBJECT%', json_object_keys(to_json(r)), null)").alias("keys"))
        seen = maps.select("row_index", F.posexplode("keys").alias("p", "k")).groupBy("k").agg(F.min(F.struct("row_index", "p")).alias("o")).orderBy("o").collect()  # as many as columns
        names = [r[0] for r in seen]
        table = maps.select("row_index", *(F.to_json(F.try_element_at("m", F.lit(n))).alias(n) for n in names))
    else:
        raise ValueError("the document holds no table")
    layout["columns"] = names
    return table, layout


def write_json_table(table: DataFrame, layout: dict, path: str) -> None:
    """The document in its layout again, a row a line, with what stood beside the rows. Many tasks write it, and it
    appears as a whole; the path must lie where the driver and all executors see it."""
    names = [json.dumps(c, ensure_ascii=False) + ": " if layout["objects"] else "" for c in layout["columns"]]
    cells = F.concat_ws(", ", *(F.concat(F.lit(n), F.coalesce(F.col("`" + c.replace("`", "``") + "`"), F.lit("null"))) for n, c in zip(names, layout["columns"])))
    left, right = "{}" if layout["objects"] else "[]"
    before, after, seen = [], [], False
    for key, value in layout.get("beside") or [(layout["wrapper"], None)] if layout["wrapper"] else []:
        if key == layout["wrapper"]:
            seen = True
        else:
            (after if seen else before).append(f"\n  {json.dumps(key, ensure_ascii=False)}: {json.dumps(json.loads(value), ensure_ascii=False)}")
    header, footer = "[", "\n]"
    if layout["wrapper"]:
        header = "{" + "".join(f"{x}," for x in before) + f"\n  {json.dumps(layout['wrapper'], ensure_ascii=False)}: ["
        footer += "".join(f",{x}" for x in after) + "\n}"
    lines = table.select("row_index", F.concat(F.lit(left), cells, F.lit(right)).alias("line"))
    write_lines(lines, ["row_index"], path, ",\n  ", header, "\n  ", footer)


def guess_column(names: list[str], *patterns: str) -> str | None:
    """The column whose name is one of the patterns, whatever its case; else one that holds one; else the first."""
    low = [n.lower() for n in names]
    for test in (lambda n, p: n == p.lower(), lambda n, p: p.lower() in n):
        for p in patterns:
            for n, x in zip(names, low):
                if test(x, p):
                    return n
    return names[0] if names else None
