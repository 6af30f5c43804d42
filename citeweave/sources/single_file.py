"""One text file written by many tasks: a data source whose parts are joined at commit, and of which an abort leaves nothing."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Text that a task gathers before it writes, in characters.
_GATHERED = 1 << 20


@dataclass
class _Part(WriterCommitMessage):
    task: int
    name: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = os.path.abspath(options["path"].removeprefix("file://"))
        self.separator, self.header, self.lead, self.footer = (options.get(k, "") for k in ("separator", "header", "lead", "footer"))
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Part:
        """A part of its own for each attempt of a task; only those that are committed are joined."""
        os.makedirs(self.folder, exist_ok=True)
        name, rows, held, size = uuid.uuid4().hex, 0, [], 0
        with open(f"{self.folder}/{name}", "w", encoding="utf-8", newline="") as f:
            for row in iterator:
                line = row[0] or ""
                held.append(self.separator + line if rows else line)
                rows, size = rows + 1, size + len(line)
                if size > _GATHERED:
                    f.write("".join(held))
                    held, size = [], 0
            f.write("".join(held))
        return _Part(TaskContext.get().partitionId(), name, rows)

    def commit(self, messages: list[_Part | None]) -> None:
        """Header, parts in order of their tasks with separators between, footer; the file appears as a whole."""
        os.makedirs(self.folder, exist_ok=True)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.task)
        whole = f"{self.folder}/whole"
        with open(whole, "wb") as out:
            out.write((self.header + (self.lead if parts else "")).encode())
            for i, part in enumerate(parts):
                out.write(self.separator.encode() if i else b"")
                with open(f"{self.folder}/{part.name}", "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(self.footer.encode())
        os.replace(whole, self.path)
        shutil.rmtree(self.folder)

    def abort(self, messages: list[_Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class SingleFile(DataSource):
    """Rows (line) as one file. Options: path, separator (between lines), header, lead (behind it if there are lines), footer.

    The path must lie where the driver and all executors see it. Lines stand in the order of the partitions."""

    @classmethod
    def name(cls) -> str:
        return "citeweave_single_file"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def write_lines(lines: DataFrame, order: list[str | Column], path: str, separator: str = "\n", header: str = "", lead: str = "", footer: str = "") -> None:
    """The column `line` in an order as one file: dealt to tasks by ranges, each writes its part, joined at commit.

    A null line is an empty one. A job that fails leaves the file as it was before."""
    lines.sparkSession.dataSource.register(SingleFile)
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
    out = dealt.write.format(SingleFile.name()).mode("overwrite")
    for k, v in {"separator": separator, "header": header, "lead": lead, "footer": footer}.items():
        out = out.option(k, v)
    out.option("path", path).save()
