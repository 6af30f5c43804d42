"""Spelling variants: words that differ by one letter, by products of letter counts, and the form each belongs to.

Two words one edit apart differ in the counts of at most two letters. With the letters in four classes, two classes at
least are untouched, so the words meet in a block that is named by the counts of two classes. In a block, products of
its matrix of letter counts give all squared distances at once; pairs at most two apart, of equal or adjacent lengths,
are verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, ragged, released, small_batches, stored

#: Fixed values of the contract: least letters and occurrences of a word, how much more frequent its form is.
LEAST_LETTERS, LEAST_COUNT, MORE = 7, 2, 10
#: Letters from frequent to rare, dealt in turn to four classes; the letters from U+00C0 on are dealt by code point.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
CLASSES = 4
PAIRS = list(combinations(range(CLASSES), 2))
#: Words of a block that one matrix takes; larger blocks are cut in tiles, and the tiles are compared pair by pair.
TILE = 2048
#: Rows gathered before the blocks among them are compared, and cells of what is held of a product.
ROWS, CELLS = 1 << 15, 1 << 21
ACCENTED = [chr(c) for c in range(0xC0, 0x100)]
LETTERS = len(BY_FREQUENCY) + len(ACCENTED)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all whole texts and their occurrences.

    A word is a maximal run of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased; if the crc32 of `<doc_id>:<run>` is divisible
    by 31 the run has lost the letter at crc32 modulo its length. Words of less than seven letters or one occurrence are
    left out. A null text has none; a null doc_id counts as an empty one; repeated rows count each.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    h = runs.withColumn("h", F.crc32(F.encode(F.concat("d", F.lit(":"), "run"), "UTF-8")))
    cut = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))).otherwise(F.col("run"))
    return h.select(word.alias("word")).filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# --- blocks -----------------------------------------------------------------------------------


def _class(k: int) -> str:
    """The letters of class k."""
    return "".join(c for i, c in enumerate(BY_FREQUENCY) if i % CLASSES == k) + "".join(c for c in ACCENTED if ord(c) % CLASSES == k)


def blocks(found: DataFrame) -> DataFrame:
    """(block, pair, word, n): each word once for each pair of classes, with a hash of its letters of the pair, sorted."""
    letters = [F.array_join(F.array_sort(F.split(F.regexp_replace("word", f"[^{_class(k)}]", ""), "")), "") for k in range(CLASSES)]
    keyed = found.select("word", "n", *(x.alias(f"c{k}") for k, x in enumerate(letters)))
    rows = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("pair"), F.xxhash64(F.lit(i), F.col(f"c{a}"), F.col(f"c{b}")).alias("block")) for i, (a, b) in enumerate(PAIRS)))
    return keyed.select("word", "n", F.explode(rows).alias("r")).select("r.block", "r.pair", "word", "n")


def tiled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the two tiles (i, j) that they are compared in, and the stored table of large blocks that was used.

    A block of at most TILE words is one tile (0, 0). Of a larger one, each word has a tile by its hash, and goes to all
    pairs of tiles that hold its own, so that no task gets a whole large block."""
    large = stored(rows.groupBy("block").count().filter(F.col("count") > TILE).select("block", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "large-blocks")
    own = F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("word", F.lit(7)), F.coalesce("tiles", F.lit(1)))).cast("int")
    out = rows.join(large, "block", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    return out.select("block", "pair", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n"), large


# --- inside tasks -----------------------------------------------------------------------------


class _Words:
    """Words of Latin letters as one array of code points, and their counts of letters."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        size = np.asarray(pc.binary_length(column), np.int64)
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), pa.scalar(b"", pa.large_binary()))[0].as_buffer(), np.uint8)
        row = np.repeat(np.arange(len(size)), size)
        first = (data & 0xC0) != 0x80  # what isn't the second byte of a letter
        at = np.flatnonzero(first)
        code = data[at].astype(np.int64)
        two = code >= 0x80
        code[two] = (code[two] & 0x1F) << 6 | (data[at[two] + 1] & 0x3F)
        self.code = code.astype(np.uint8)
        self.length = np.bincount(row[at], minlength=len(size)).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.row, self.letter = row[at], np.where(two, code - 0xC0 + 26, code - 97)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """A row of letter counts for each of the rows."""
        at = ragged(self.start[rows], self.length[rows])
        where = np.repeat(np.arange(len(rows)), self.length[rows])
        return np.bincount(where * LETTERS + self.letter[at], minlength=len(rows) * LETTERS).reshape(len(rows), LETTERS).astype(np.float32)

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs differ by exactly one replaced letter, or one letter that only b has. Lengths differ by at most one, b's is the longer."""
        out = np.zeros(len(a), bool)
        order = np.argsort(self.length[a], kind="stable")
        long = np.maximum(1, self.length[a[order]])
        cut = np.flatnonzero(np.diff(np.cumsum(long) // CELLS)) + 1
        for part in np.split(order, cut):
            x, y = a[part], b[part]
            most = int(self.length[x].max(initial=0))
            if not most:
                continue
            step = np.arange(most)
            within = step < self.length[x][:, None]
            p, q = self.start[x][:, None] + step, self.start[y][:, None] + step
            last = len(self.code) - 1
            left = self.code[np.minimum(p, last)]
            same = (left == self.code[np.minimum(q, last)]) | ~within
            shifted = (left == self.code[np.minimum(q + 1, last)]) | ~within
            prefix = np.where(same.all(1), most, (~same).argmax(1))
            behind = shifted | (step < prefix[:, None])
            equal = self.length[x] == self.length[y]
            out[part] = np.where(equal, (~same).sum(1) == 1, behind.all(1))
        return out


_CLASS_OF = np.array([i % CLASSES for i in range(len(BY_FREQUENCY))], np.int64)
_LETTER_CLASS = np.zeros(LETTERS, np.int64)
_LETTER_CLASS[[ord(c) - 97 for c in BY_FREQUENCY]] = _CLASS_OF
_LETTER_CLASS[26:] = [ord(c) % CLASSES for c in ACCENTED]
_IN_CLASS = np.eye(CLASSES, dtype=np.float32)[_LETTER_CLASS]
_FIRST = np.full(1 << CLASSES, -1, np.int64)
for _mask in range(1 << CLASSES):
    _FIRST[_mask] = next((i for i, (a, b) in enumerate(PAIRS) if not _mask >> a & 1 and not _mask >> b & 1), -1)


def _near(held: _Words, first: np.ndarray, size: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (row, row) in the blocks that begin at `first` and have `size` rows."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 1]
    at = 0
    while at < len(order):
        # blocks of near equal size make one stack of matrices
        s = int(size[order[at]])
        widest = max(s + s // 4, 3)
        end = at + int(np.searchsorted(size[order[at:]], widest, side="right"))
        end = min(end, at + max(1, CELLS // (widest * max(widest, LETTERS))))
        some = order[at:end]
        at = end
        widest = int(size[some].max())
        place = first[some][:, None] + np.arange(widest)
        there = np.arange(widest) < size[some][:, None]
        place = np.where(there, place, first[some][:, None])
        c = held.counts(place.ravel()).reshape(len(some), widest, LETTERS)
        norm = np.einsum("ijk,ijk->ij", c, c)
        tile = max(1, CELLS // (len(some) * widest))
        for top in range(0, widest, tile):
            rows = slice(top, min(widest, top + tile))
            square = norm[:, rows, None] + norm[:, None, :] - 2 * np.matmul(c[:, rows], c.transpose(0, 2, 1))
            near = square <= 2
            near &= there[:, rows, None] & there[:, None, :]
            near &= np.arange(widest)[rows][None, :, None] < np.arange(widest)[None, None, :]
            k, x, y = np.nonzero(near)
            found.append((place[k, x + top], place[k, y]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    crossing = (i[a] == j[a]) | (own[a] != own[b])
    apart = held.length[b] - held.length[a]
    a, b = np.where(apart < 0, b, a), np.where(apart < 0, a, b)
    keep = crossing & (np.abs(apart) <= 1)
    a, b = a[keep], b[keep]
    keep = held.one_edit(a, b)
    a, b = a[keep], b[keep]
    # words meet in each pair of classes that the edit leaves alone; the first of these tells them
    touched = (np.abs(held.counts(a) - held.counts(b)) @ _IN_CLASS > 0).astype(np.int64) @ (1 << np.arange(CLASSES))
    keep = _FIRST[touched] == pair[a]
    return a[keep], b[keep]


_SCHEMA = "word string, other string, other_n long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, of rows (block, pair, i, j, own, word, n) sorted by block and tiles."""

    def done(rows: pa.Table, whole: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        key = [rows.column(k).to_numpy() for k in ("block", "i", "j")]
        new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])]))
        end = rows.num_rows if whole else int(new[-1])
        if not end:
            return [], rows
        first = new if whole else new[:-1]
        size = np.diff(np.append(first, end))
        part = rows.slice(0, end).combine_chunks()
        text = part.column("word").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        a, b = _near(_Words(text), first, size, *(part.column(k).to_numpy() for k in ("own", "i", "j", "pair")))
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        out = pa.RecordBatch.from_arrays([text.take(pa.array(x)), text.take(pa.array(y)), pa.array(part.column("n").to_numpy()[y])], ["word", "other", "other_n"])
        return [out] if len(x) else [], rows.slice(end)

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= ROWS:
            out, rest = done(pa.Table.from_batches(held), False)
            yield from out
            held, count = rest.to_batches(), rest.num_rows
    if count:
        yield from done(pa.Table.from_batches(held), True)[0]
    released()


def near(found: DataFrame) -> DataFrame:
    """(word, other, other_n) for every two words (word, n) that differ by one inserted, deleted or replaced letter, both ways round.

    Words must be distinct, in lower case and of `[a-z\\u00C0-\\u00FF]`. A table without such pairs gives an empty one."""
    small_batches(found.sparkSession)
    rows, _ = tiled(blocks(found))
    return rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_compared, _SCHEMA)


# --- forms ------------------------------------------------------------------------------------


def followed(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) for a table (word, form): where the chain of forms that begins at each word ends.

    Each round looks up the root of the root, so chains of any length 2**k take k rounds. Chains must not be circles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = after
        if after.filter("moved").isEmpty():
            return now.select("word", "root")
    raise ValueError("forms go in a circle")


def grouped(found: DataFrame, more: int = MORE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (word, n).

    form: the near word of largest n (ties: smallest in code-point order) if its n is at least `more` times the word's,
    else null; root: the last of the chain of forms. A form is more frequent than its word, so chains end."""
    best = near(found).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    is_form: Column = -F.col("best.n") >= more * F.col("n")
    told = stored(found.join(best, "word", "left").select("word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    roots = followed(told.filter("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """`grouped` over the words of documents (doc_id, text)."""
    return grouped(stored(words(docs), "words"))
