"""The elements of one large JSON array, read by many tasks: a document is cut in byte ranges, whatever stands there.

Whether a range begins within a string can't be seen from its bytes. So a first pass counts, for each range, its quotes
and by how much brackets outside of strings change the depth, for either case; sums over the ranges before then tell
where each one begins. A second pass counts the elements that begin in each range, a third reads them; the task where an
element begins reads on to its end. What reaches the driver is three numbers a range, and the keys of the outermost object.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a range, and of what a task holds in numpy at once; rows and characters of what it hands on at once.
RANGE, BLOCK = 32 << 20, 1 << 20
_ROWS, _CHARS = 1000, 4 << 20
_QUOTE, _BACK, _COMMA, _COLON = b'"\\,:'
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = b"\xef\xbb\xbf"


def _opened(path: str) -> BinaryIO | pa.NativeFile:
    if "://" in path and not path.startswith("file://"):
        where, inner = fs.FileSystem.from_uri(path)
        return where.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")


def _escaping(f, at: int) -> int:
    """How many backslashes stand right before a place, as far as odd and even go."""
    n = 0
    while at > n:
        step = min(4096, at - n)
        f.seek(at - n - step)
        data = f.read(step)
        tail = len(data) - len(data.rstrip(b"\\"))
        n += tail
        if tail < step:
            break
    return n % 2


def _blocks(f, start: int, stop: int, block: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Place, bytes, which of these are quotes, and which stand behind an odd number of quotes of this run, by blocks."""
    before, odd = _escaping(f, start), 0
    while start < stop:
        f.seek(start)
        data = f.read(min(block, stop - start))
        if not data:
            return
        buf, at = np.frombuffer(data, np.uint8), np.arange(len(data))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(buf != _BACK, at, -1))])  # of other bytes, before each
        run = at - 1 - last[:-1] + np.where(last[:-1] < 0, before, 0)
        quote = (buf == _QUOTE) & (run % 2 == 0)
        behind = (np.cumsum(quote) + odd) % 2 == 1
        yield start, data, quote, behind
        odd = int(behind[-1])
        before = int(len(data) - 1 - last[-1] + (before if last[-1] < 0 else 0)) % 2
        start += len(data)


def _steps(buf: np.ndarray) -> np.ndarray:
    return _STEP[buf]


def _events(f, start: int, stop: int, inside: bool, depth: int, block: int):
    """Place and bytes of each block, and in it the places, bytes and levels of brackets, commas and colons outside of
    strings. A bracket has the level of what it stands in, a comma or colon one more than the brackets around it."""
    for base, data, quote, behind in _blocks(f, start, stop, block):
        buf = np.frombuffer(data, np.uint8)
        step = _steps(buf)
        at = np.flatnonzero((behind == inside) & ~quote & ((step != 0) | (buf == _COMMA) | (buf == _COLON)))
        level = depth + np.cumsum(step[at])
        depth = int(level[-1]) if len(level) else depth
        yield base, data, at, buf[at], level - (step[at] > 0)


def _over(spark: SparkSession, n: int, work: Callable[[int], Iterator[tuple]], schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """What the work finds in each of n ranges, a task a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                held, size = [], 0
                for row in work(i):
                    held.append(row)
                    size += len(row[-1]) if isinstance(row[-1], str) else 0
                    if len(held) >= _ROWS or size >= _CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return spark.range(0, n, 1, n).mapInArrow(run, schema)


def _gathered(df: DataFrame) -> list:
    return sorted(tuple(r) for r in df.collect())


class JsonDocument:
    """A document cut in ranges. `keys`: of an object, its keys and their values' spans, in order; else None.

    The path must lie where the driver and all executors see it: a path of a shared file system, or a URI that Arrow
    opens. A document that isn't closed is a ValueError; what stands in an element is left to its reader.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = RANGE, block: int = BLOCK):
        self.spark, self.path, self.size, self.block = spark, path, size, block
        with _opened(path) as f:
            self.end = f.seek(0, os.SEEK_END)
            self.root, self.last = self._edge(f, 0, self.end, False), self._edge(f, 0, self.end, True)
            if self.root is None:
                raise ValueError(f"{path} is empty")
            f.seek(self.root)
            self.kind = f.read(1)
        self.n, end, longs = -(-self.end // size), self.end, [pa.int64()] * 4

        def first(i: int) -> Iterator[tuple]:
            odd, out, inner = False, 0, 0
            with _opened(path) as f:
                for _, data, quote, behind in _blocks(f, i * size, min((i + 1) * size, end), block):
                    step = _steps(np.frombuffer(data, np.uint8))
                    out, inner, odd = out + int(step[~behind & ~quote].sum()), inner + int(step[behind & ~quote].sum()), bool(behind[-1])
            yield i, int(odd), out, inner

        found = _gathered(_over(spark, self.n, first, "i long, odd long, plain long, quoted long", ["i", "odd", "plain", "quoted"], longs))
        self.state = list(accumulate(found, lambda s, r: (s[0] ^ bool(r[1]), s[1] + (r[3] if s[0] else r[2])), initial=(False, 0)))
        if self.state[-1] != (False, 0):
            raise ValueError(f"{path} is not closed")
        self.keys = self._keys() if self.kind == b"{" else None

    @staticmethod
    def _edge(f, low: int, high: int, back: bool) -> int | None:
        """The place of the first or last byte between two places that is no white space."""
        while low < high:
            a, b = (max(low, high - 65536), high) if back else (low, min(high, low + 65536))
            f.seek(a)
            data = f.read(b - a)
            if a == 0 and data.startswith(_MARK):
                data = b"   " + data[3:]
            text = data.rstrip() if back else data.lstrip()
            if text:
                return a + (len(text) - 1 if back else len(data) - len(text))
            low, high = (low, a) if back else (b, high)
        return None

    def text(self, start: int, stop: int) -> str:
        with _opened(self.path) as f:
            f.seek(start)
            return f.read(stop - start).decode("utf-8", "replace").strip()

    def missing(self, start: int, stop: int) -> bool:
        """Whether a value is null."""
        with _opened(self.path) as f:
            f.seek(self._edge(f, start, stop, False) or start)
            return f.read(4) == b"null"

    def _keys(self) -> list[tuple[str, int, int]]:
        path, size, block, end, state = self.path, self.size, self.block, self.end, self.state

        def found(i: int) -> Iterator[tuple]:
            with _opened(path) as f:
                for base, _, at, byte, level in _events(f, i * size, min((i + 1) * size, end), *state[i], block):
                    mine = (level == 1) & ((byte == _COMMA) | (byte == _COLON)) | (level == 0)
                    yield from zip((base + at[mine]).tolist(), byte[mine].tolist())

        marks = _gathered(_over(self.spark, self.n, found, "at long, byte long", ["at", "byte"], [pa.int64()] * 2))
        colons = [j for j, (_, byte) in enumerate(marks) if byte == _COLON]
        return [(json.loads(self.text(marks[j - 1][0] + 1, marks[j][0])), marks[j][0] + 1, marks[j + 1][0]) for j in colons]

    def elements(self, start: int | None = None, stop: int | None = None) -> DataFrame:
        """(row_index, value) of the array at the root, or of the one that a key's span holds: each element's text.

        An empty array has none. What is no array is a ValueError, as is an element of nothing but white space."""
        level = 1 if start is None else 2
        path, size, block, end, state = self.path, self.size, self.block, self.end, self.state
        with _opened(path) as f:
            low, high = (self.root, self.last) if start is None else (self._edge(f, start, stop, False), self._edge(f, start, stop, True))
            f.seek(low or 0)
            if f.read(1) != b"[":
                raise ValueError(f"{path} holds no rows")

        def cuts(f, i: int, until: int):
            for base, data, at, byte, lev in _events(f, i * size, until, *state[i], block):
                place = base + at
                yield base, data, at[(place >= low) & (place <= high) & ((byte == _COMMA) & (lev == level) | (lev == level - 1))].tolist()

        def counted(i: int) -> Iterator[tuple]:
            with _opened(path) as f:
                yield i, sum(len(c) - (base + c[-1] == high if c else 0) for base, _, c in cuts(f, i, min((i + 1) * size, end)))

        n = [r[1] for r in _gathered(_over(self.spark, self.n, counted, "i long, n long", ["i", "n"], [pa.int64()] * 2))]
        first = [0, *accumulate(n)]

        def read(i: int) -> Iterator[tuple]:
            index, held, stop_at, begun = first[i], None, min((i + 1) * size, end), 0
            if first[i] == first[i + 1]:
                return
            with _opened(path) as f:
                for base, data, places in cuts(f, i, end):
                    done = 0
                    for c in places:
                        if held is not None:
                            value = b"".join([*held, data[done:c]]).decode("utf-8", "replace").strip()
                            if value:
                                yield index, value
                            elif begun != low or base + c != high:
                                raise ValueError(f"{path}: nothing stands before byte {base + c}")
                            index, held = index + 1, None
                        if base + c >= min(stop_at, high):
                            return
                        held, done, begun = [], c + 1, base + c
                    if held is not None:
                        held.append(data[done:])
                    elif base + len(data) >= stop_at:
                        return

        return _over(self.spark, self.n, read, "row_index long, value string", ["row_index", "value"], [pa.int64(), pa.string()])
