"""Words and verses an edit or two apart, for whole batches at once: numpy tables, no loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: When a word is a typing error apart: letters of the longer one at least, lengths at most apart, distance, from so many letters on.
NEAR_LETTERS, NEAR_LENGTHS, NEAR_DISTANCE, LONG_DISTANCE, LONG = 4, 2, 1, 2, 7
#: Fixed value: edits of a verse.
VERSE_EDITS = 2
#: Cells of the tables that a task holds at once.
CELLS = 1 << 21
_FAR = 99


def _chunks(size: np.ndarray) -> list[np.ndarray]:
    """Row numbers in parts of about CELLS cells, rows of like size together."""
    order = np.argsort(size, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(np.cumsum(np.maximum(size[order], 1)) // CELLS)) + 1)


class _Lists:
    """Lists of whole numbers as one array: `padded` gives some of them as a matrix."""

    def __init__(self, values: np.ndarray, size: np.ndarray):
        self.values, self.size = values, size
        self.start = np.cumsum(size) - size

    def padded(self, rows: np.ndarray, fill: int) -> np.ndarray:
        width = int(self.size[rows].max(initial=0))
        step = np.arange(width)
        at = np.minimum(self.start[rows][:, None] + step, max(0, len(self.values) - 1))
        return np.where(step < self.size[rows][:, None], self.values[at] if len(self.values) else fill, fill)


def _letters(words: list[str]) -> _Lists:
    text = "".join(words)
    return _Lists(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.array([len(w) for w in words], np.int64))


def near_words(words: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (numbers of words) are a typing error apart; a banded edit distance, all pairs letter by letter."""
    letters = _letters(words)
    out = np.zeros(len(a), bool)
    la, lb = letters.size[a], letters.size[b]
    longer = np.maximum(la, lb)
    may = np.flatnonzero((longer >= NEAR_LETTERS) & (np.abs(la - lb) <= NEAR_LENGTHS))
    for part in _chunks(longer[may]):
        rows = may[part]
        if not len(rows):
            continue
        x, y = letters.padded(a[rows], -1), letters.padded(b[rows], -2)
        n, m = la[rows], lb[rows]
        y = np.pad(y, ((0, 0), (3, max(0, x.shape[1] - y.shape[1]) + 3)), constant_values=-2)
        band = np.full((len(rows), 7), _FAR)  # offsets -3 .. 3 of the second word's place; the outer two stay far
        band[:, 3:6] = np.arange(3)
        found = np.where(n == 0, m, _FAR)
        for i in range(1, x.shape[1] + 1):
            now = np.full_like(band, _FAR)
            for k in range(1, 6):
                j = i + k - 3
                if j >= 0:
                    same = band[:, k] + (x[:, i - 1] != y[:, j + 2]) if j else _FAR
                    now[:, k] = np.minimum(np.minimum(same, band[:, k + 1] + 1), now[:, k - 1] + 1) if j else i
            band = now
            ends = n == i
            found[ends] = band[ends, np.clip(m[ends] - i + 3, 0, 6)]
        out[rows] = found <= np.where(longer[rows] >= LONG, LONG_DISTANCE, NEAR_DISTANCE)
    return out


def alignments(words: pa.Array, verses: pa.Array, most: int = VERSE_EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(edits, words used) of the best alignment of each verse with the first words of its row; -1 where edits pass `most`.

    A word may be missing, be too much, or be a typing error apart. Fewest edits, then most words; one word at least.
    """
    flat = pa.concat_arrays([words.flatten().cast(pa.string()), verses.flatten().cast(pa.string())])
    coded = flat.dictionary_encode()
    code, names = np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()
    size = lambda x: np.diff(np.asarray(x.offsets, np.int64))
    n = int(size(words).sum())
    q, v = _Lists(code[:n], size(words)), _Lists(code[n:], size(verses))
    edits, used = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
    for rows in _chunks(np.maximum(q.size, 1) * np.maximum(v.size, 1)):
        if not len(rows):
            continue
        x, y = q.padded(rows, -1), v.padded(rows, -2)
        width, tall = x.shape[1], y.shape[1]
        # words that stand at most two places apart can be typing errors of each other
        left, right = [], []
        for off in range(-most, most + 1):
            i0, i1 = max(0, -off), min(width, tall - off)
            if i0 < i1:
                a, b = x[:, i0:i1], y[:, i0 + off : i1 + off]
                some = (a >= 0) & (b >= 0) & (a != b)
                left.append(a[some])
                right.append(b[some])
        pairs = np.unique(np.concatenate(left) * len(names) + np.concatenate(right)) if left else np.zeros(0, np.int64)
        near = pairs[near_words(names, pairs // max(1, len(names)), pairs % max(1, len(names)))] if len(pairs) else pairs
        step = np.arange(width + 1)
        cost = np.repeat(np.minimum(step, _FAR)[None], len(rows), 0)
        final = cost.copy()
        for j in range(tall):
            b = y[:, j : j + 1]
            swap = np.where(x == b, 0, _FAR)
            if len(near):
                pair = x * len(names) + b
                at = np.minimum(np.searchsorted(near, pair), len(near) - 1)
                swap = np.where((x >= 0) & (b >= 0) & (near[at] == pair), np.minimum(swap, 1), swap)
            now = np.empty_like(cost)
            now[:, 0] = cost[:, 0] + 1
            now[:, 1:] = np.minimum(cost[:, :-1] + swap, cost[:, 1:] + 1)
            cost = np.minimum.accumulate(now - step, axis=1) + step
            ends = v.size[rows] == j + 1
            final[ends] = cost[ends]
        final[:, 0] = _FAR
        final[step[None] > q.size[rows][:, None]] = _FAR
        best = final.min(1)
        last = width - (final[:, ::-1] == best[:, None]).argmax(1)
        ok = (best <= most) & (v.size[rows] > 0)
        edits[rows[ok]], used[rows[ok]] = best[ok], last[ok]
    return edits, used


def alignable(cands: DataFrame, corpus: DataFrame, pairs: DataFrame, most: int = VERSE_EDITS) -> DataFrame:
    """Of pairs (id, pos, v_idx) those that may align: with chapter, verse, the words from pos on (q) and the verse's (v).

    Each word of the verse that the text lacks there takes an edit, whether it is missing or mistyped.
    """
    verses = corpus.select("v_idx", "chapter", "verse", F.col("tokens").alias("v"))
    rows = pairs.join(cands.select("id", "tokens"), "id").join(verses, "v_idx").filter(F.size("v") > 1)
    rows = rows.select("id", "pos", "v_idx", "chapter", "verse", F.slice("tokens", F.col("pos") + 1, F.size("v") + most).alias("q"), "v")
    return rows.filter((F.size("v") - F.size("q") <= most) & (F.size(F.array_except("v", "q")) <= most))


def aligned(cands: DataFrame, corpus: DataFrame, pairs: DataFrame, most: int = VERSE_EDITS) -> DataFrame:
    """For pairs (id, pos, v_idx): the verse aligned with the words from pos on; id, pos, v_idx, chapter, verse, size (words used), errors."""
    rows = alignable(cands, corpus, pairs, most)
    names = ["id", "pos", "v_idx", "chapter", "verse"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, used = alignments(batch.column(5), batch.column(6), most)
            at = pa.array(np.flatnonzero(edits >= 0))
            out = [batch.column(i).take(at) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(used, pa.int32()).take(at), pa.array(edits, pa.int32()).take(at)], [*names, "size", "errors"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(align, f"{kinds}, size int, errors int")


def word_edits(words: list[str], verse: list[str], most: int = VERSE_EDITS) -> tuple[int, int] | None:
    """`alignments` of one pair, or None."""
    edits, used = alignments(pa.array([words], pa.list_(pa.string())), pa.array([verse], pa.list_(pa.string())), most)
    return (int(edits[0]), int(used[0])) if edits[0] >= 0 else None
