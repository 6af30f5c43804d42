"""What the operators of this folder share: shared-folder tables, and numpy views of Arrow text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task holds in numpy at once; a longer single document makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


# --- Spark side -------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one where that is unset.

    On a cluster a folder of one machine would lose what others write, so there the setting must be given.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_citeweave_dir", None)
        if not found:
            found = spark._citeweave_dir = "file://" + tempfile.mkdtemp(prefix="citeweave-")
    return found


def small_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch of long texts takes, for the session's queries from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, as all that was made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:  # shuffle files of queries that have ended go when the driver collects what is left of these
        tables[0].sparkSession._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key():
    """With doc_id, what tells documents apart where an id comes twice: a hash of the text (null counts as empty)."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


#: Bits of a filter that goes to all tasks (8 MB), whatever the number of keys.
FILTER = 26


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size with a bit for the first bits of each key (64-bit hashes). What it lets through by chance
    has to be dropped by a join, so it decides about speed only."""
    slot = F.shiftrightunsigned(column, 64 - FILTER)
    marks = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("b")).toArrow()  # as many rows as the bitmap has words, at most
    bits = np.zeros(1 << (FILTER - 6), np.uint64)
    bits[marks.column("w").to_numpy()] = marks.column("b").to_numpy().view(np.uint64)
    return bits.view(np.uint8)


# --- inside tasks -----------------------------------------------------------------------------


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    slot = h >> np.uint64(64 - FILTER)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


_MULT = 0x9E3779B97F4A7C15 | 1
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            for name, base in (("_POW", _MULT), ("_INV", pow(_MULT, -1, 1 << 64))):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums: with span_hash they hash any span of buf at once."""
    n = len(buf)
    out = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(n + 1)[0][:n], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever its bytes stand."""
    with np.errstate(over="ignore"):
        inv = _powers(len(sums))[1]
        return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        out = h[:n].copy()
        for i in range(1, k):
            out = out * _GRAM + h[i : i + n]
        return mix(out + np.uint64(k))


def byte_set(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut


#: Bytes of `[^\x20\x09-\x0D]`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`.
NOT_SPACE = ~byte_set(b" \t\n\x0b\x0c\r")
ALNUM = byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """Texts of a slice as one byte array; a line feed stands after each. start, end: byte positions of each text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        text = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(text)
        size = np.asarray(pc.binary_length(text), dtype=np.int64)
        self.n = n
        self.end = np.cumsum(size + 1) - 1 if n else np.zeros(0, np.int64)
        self.start = self.end - size
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), text), pa.scalar("\n", pa.large_string()))[0].as_buffer()
        self.buf = np.empty(int(self.end[-1]) + 1 if n else 0, np.uint8)
        if n:
            self.buf[:-1] = np.frombuffer(joined, np.uint8) if len(self.buf) > 1 else 0
            self.buf[-1] = 10
        if lower:
            self.buf = LOWER[self.buf]

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word and the number of its text, in order. A line feed is never of a word."""
        mask = np.zeros(len(self.buf) + 2, np.int8)
        mask[1:-1] = is_word[self.buf]
        step = np.diff(mask)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return start, end, np.searchsorted(self.end, start).astype(np.int64)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        sums = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.end] - sums[self.start]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each part have about `limit` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
        part = np.cumsum(size + 64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    released()


def released() -> None:
    """Give freed memory back at the end of a task; Python workers live on, and their executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def counts(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n).astype(np.int64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each pair, one after another."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - first, length)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    grid = np.full(-(-len(a) // w) * w, np.iinfo(a.dtype).max, a.dtype)
    grid[: len(a)] = a
    grid = grid.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])
