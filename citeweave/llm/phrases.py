"""Collocations: phrases of two and three words whose parts seldom stand apart, counted in tiles of ranked word ids.

Each pass reads all whole texts. Words are counted, and the most frequent get ranks. Pairs of ranked words are counted by
address: rank and rank make a cell of a tile; tiles that are full are counted in dense arrays, the others as sorted
(cell, count) lists, and pairs beyond the ranks as sorted lists of hashes. Then the frequent pairs are ranked as new
ids, and pair and next word are counted in the same way. What tasks count is summed by Spark; the ranks, and the filters
that drop what can't be frequent, decide about speed only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, byte_set, key_filter, mix, passes, prefix_hash, ragged, released, slices, small_batches, span_hash, stored

#: Fixed values of the contract: occurrences of a phrase, share of a longer phrase that takes it in (in hundredths), phrases of a language.
LEAST, TAKEN_IN, BEST, SCALE = 10, 50, 2000, 1_000_000
#: Words, and pairs, that get ranks: as many cells a tile has on each side, times the tiles of a side.
SIDE, RANKS = 256, 1 << 16
#: Pairs of a slice that make a tile dense, dense tiles that a task holds at once, and entries of its lists before they are summed and sent.
FULL, DENSE, HELD = 4096, 64, 1 << 20
#: Text bytes of a slice.
SLICE = 1 << 21

_BREAK = byte_set(b".,;:!?\n\x0b\x0c\r")
#: Bytes of `[^\x20\x09]` outside of breaks.
_WORD = ~byte_set(b" \t") & ~_BREAK


# --- inside tasks -----------------------------------------------------------------------------


def _lang_hash(column: pa.Array) -> np.ndarray:
    t = Texts(column)
    return span_hash(prefix_hash(t.buf), t.start, t.end)


class _Tokens:
    """Words of a slice: the hash of each with its language, and whether the one behind it stands in the same piece."""

    def __init__(self, part: pa.RecordBatch, seed: int):
        self.texts = t = Texts(part.column("text"), lower=True)
        self.start, self.end, row = t.words(_WORD)
        lang = mix(_lang_hash(part.column("lang")) + np.uint64(seed))
        with np.errstate(over="ignore"):
            self.hash = mix(span_hash(prefix_hash(t.buf), self.start, self.end) + lang[row] * np.uint64(3))
        self.row = row
        breaks = np.zeros(len(t.buf) + 1, np.int32)  # the line feed behind each text is a break as well
        np.cumsum(_BREAK[t.buf], out=breaks[1:])
        self.joined = breaks[self.start[1:]] == breaks[self.end[:-1]] if len(self.start) else np.zeros(0, bool)


def _summed(keys: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal keys next to each other, added up. Several keys are sorted by a hash of them, so that equal hashes of
    unequal keys may leave a key in two rows, which are summed later."""
    order = np.argsort(keys[0] if len(keys) == 1 else functools.reduce(lambda a, b: mix(a + b), keys))
    keys, count = [k[order] for k in keys], count[order]
    new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])) if len(order) else np.zeros(0, np.int64)
    return [k[new] for k in keys], np.add.reduceat(count, new) if len(new) else count


class _Lists:
    """Counts of keys as sorted lists that are merged as they grow."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = width, [], 0

    def add(self, keys: list[np.ndarray], count: np.ndarray | None = None) -> None:
        if len(keys[0]):
            self.parts.append(_summed(keys, np.ones(len(keys[0]), np.int64) if count is None else count))
            self.size += len(self.parts[-1][1])

    def merged(self) -> None:
        if len(self.parts) > 1:
            keys = [np.concatenate([p[0][i] for p in self.parts]) for i in range(self.width)]
            self.parts = [_summed(keys, np.concatenate([p[1] for p in self.parts]))]
            self.size = len(self.parts[0][1])

    def full(self) -> bool:
        if self.size > 2 * HELD:
            self.merged()
        return self.size > HELD

    def taken(self) -> tuple[list[np.ndarray], np.ndarray]:
        self.merged()
        out = self.parts[0] if self.parts else ([np.zeros(0, np.uint64)] * self.width, np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


class _Tiles:
    """Counts of (left rank, right rank) by address."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.sparse = _Lists(1)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        tile = (left // SIDE * (RANKS // SIDE) + right // SIDE).astype(np.int64)
        cell = (left % SIDE * SIDE + right % SIDE).astype(np.int64)
        size = np.bincount(tile, minlength=1)
        for k in np.flatnonzero(size >= FULL):
            if len(self.dense) < DENSE:
                self.dense.setdefault(int(k), np.zeros(SIDE * SIDE, np.int64))
        held = np.zeros(len(size), bool)
        held[[k for k in self.dense if k < len(size)]] = True
        on = held[tile]
        if on.any():
            order = np.argsort(tile[on], kind="stable")
            t, c = tile[on][order], cell[on][order]
            cuts = np.flatnonzero(np.diff(t)) + 1
            for k, part in zip(t[np.concatenate([[0], cuts])], np.split(c, cuts)):
                self.dense[int(k)] += np.bincount(part, minlength=SIDE * SIDE)
        self.sparse.add([(tile[~on] * (SIDE * SIDE) + cell[~on]).astype(np.uint64)])

    def full(self) -> bool:
        return self.sparse.full()

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (code,), count = self.sparse.taken()
        codes, counts = [code.astype(np.int64)], [count]
        for k, cells in self.dense.items():
            at = np.flatnonzero(cells)
            codes.append(k * (SIDE * SIDE) + at)
            counts.append(cells[at])
        self.dense = {}
        code, count = np.concatenate(codes), np.concatenate(counts)
        tile, cell = code // (SIDE * SIDE), code % (SIDE * SIDE)
        return tile // (RANKS // SIDE) * SIDE + cell // SIDE, tile % (RANKS // SIDE) * SIDE + cell % SIDE, count


class _Ranks:
    """Hashes in order of rank; rank_of gives -1 where a hash has none."""

    def __init__(self, by_rank: np.ndarray):
        self.by_rank = by_rank
        self.order = np.argsort(by_rank)
        self.sorted = by_rank[self.order]

    def rank_of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(5) + mix(b))


def _counted(batches: Iterator[pa.RecordBatch], names: list[str], look: Callable[[_Tokens], tuple[list[np.ndarray], np.ndarray, np.ndarray]], undo: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], seed: int) -> Iterator[pa.RecordBatch]:
    """Counts of what `look` finds in each slice: keys, left and right ranks. Where both have one, the tiles count them."""
    tiles, lists = _Tiles(), _Lists(len(names))

    def sent(keys: list[np.ndarray], count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(count), 1 << 16):
            yield pa.RecordBatch.from_arrays([*(pa.array(k[a : a + (1 << 16)].view(np.int64)) for k in keys), pa.array(count[a : a + (1 << 16)])], [*names, "c"])

    def from_tiles() -> Iterator[pa.RecordBatch]:
        left, right, count = tiles.taken()
        yield from sent(undo(left, right), count)

    for part in slices(batches, "text", SLICE):
        keys, left, right = look(_Tokens(part, seed))
        ranked = (left >= 0) & (right >= 0)
        tiles.add(left[ranked], right[ranked])
        lists.add([k[~ranked] for k in keys])
        if tiles.full():
            yield from from_tiles()
        if lists.full():
            yield from sent(*lists.taken())
    yield from from_tiles()
    yield from sent(*lists.taken())
    released()


# --- Spark ------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, f, clash): occurrences of every word of every language, by a hash of both; clash: others share the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["h", "lang", "word"]).aggregate([("c", "sum")]).rename_columns(["h", "lang", "word", "c"])

        for part in slices(batches, "text", SLICE):
            t = _Tokens(part, seed)
            h, first, back = np.unique(t.hash, return_index=True, return_inverse=True)
            count = np.bincount(back, minlength=len(h)).astype(np.int64)
            odd = np.flatnonzero(~_same_words(t, first[back], part.column("lang")))
            first, h, count = np.append(first, odd), np.append(h, t.hash[odd]), np.append(count, np.ones(len(odd), np.int64))
            data = t.texts.buf.tobytes()
            word = pa.array([data[a:b] for a, b in zip(t.start[first].tolist(), t.end[first].tolist())], pa.binary()).cast(pa.string())
            held.append(pa.table({"h": pa.array(h.view(np.int64)), "lang": part.column("lang").take(pa.array(t.row[first])), "word": word, "c": pa.array(count)}))
            rows += len(first)
            if rows > HELD:
                held = [summed()]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from summed().to_batches()
        released()

    found = texts.mapInArrow(run, "h long, lang string, word string, c long").groupBy("h").agg(F.sum("c").alias("f"), F.min(F.struct("lang", "word")).alias("least"), F.max(F.struct("lang", "word")).alias("most"))
    return found.select("h", "least.lang", "least.word", "f", (F.col("least") != F.col("most")).alias("clash"))


def _same_words(t: _Tokens, other: np.ndarray, lang: pa.Array) -> np.ndarray:
    """Which tokens have the language and the bytes of another one, each."""
    size = t.end - t.start
    code = np.asarray(lang.dictionary_encode().indices)[t.row]
    same = (code == code[other]) & (size == size[other])
    at = np.flatnonzero(same & (size > 0))
    differ = t.texts.buf[ragged(t.start[at], size[at])] != t.texts.buf[ragged(t.start[other[at]], size[at])]
    if len(at):
        same[at] = np.add.reduceat(differ, np.cumsum(size[at]) - size[at]) == 0
    return same


def _ranked(found: DataFrame, *columns: str) -> list[np.ndarray]:
    """The columns of the RANKS most frequent rows, in order of rank: a bounded number, whatever the table."""
    rows = found.orderBy(F.desc("f"), *columns).limit(RANKS).select(*columns).toArrow()
    return [rows.column(c).to_numpy().view(np.uint64) for c in columns]


def pair_counts(texts: DataFrame, words: DataFrame, seed: int) -> DataFrame:
    """(a, b, f): neighbouring words of one piece, by their hashes, of at least LEAST occurrences. words: the frequent ones."""
    ranks, bits = _Ranks(_ranked(words, "h")[0]), key_filter(words, "h")

    def look(t: _Tokens) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        may = passes(bits, t.hash)
        at = np.flatnonzero(t.joined & may[1:] & may[:-1])
        rank = ranks.rank_of(t.hash)
        return [t.hash[at], t.hash[at + 1]], rank[at], rank[at + 1]

    def undo(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        return [ranks.by_rank[left], ranks.by_rank[right]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, ["a", "b"], look, undo, seed)

    return texts.mapInArrow(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("f")).filter(F.col("f") >= LEAST)


def triple_counts(texts: DataFrame, words: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """(a, b, d, f): three words in a row, as above: a frequent pair, as one new id, and its next word."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (x.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(a, b).view(np.int64))], ["p"])

    word, bits = _Ranks(_ranked(words, "h")[0]), key_filter(pairs.select("a", "b").mapInArrow(hashed, "p long"), "p")
    first, second = _ranked(pairs, "a", "b")
    pair = _Ranks(pair_hash(first, second))

    def look(t: _Tokens) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        p = pair_hash(t.hash[:-1], t.hash[1:])
        may = t.joined & passes(bits, p)
        at = np.flatnonzero(may[:-1] & may[1:])
        left = pair.rank_of(p[at])
        if len(first):
            left[(first[left] != t.hash[at]) | (second[left] != t.hash[at + 1])] = -1
        return [t.hash[at], t.hash[at + 1], t.hash[at + 2]], left, word.rank_of(t.hash[at + 2])

    def undo(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        return [first[left], second[left], word.by_rank[right]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, ["a", "b", "d"], look, undo, seed)

    return texts.mapInArrow(run, "a long, b long, d long, c long").groupBy("a", "b", "d").agg(F.sum("c").alias("f")).filter(F.col("f") >= LEAST)


def _score(l: str, r: str) -> str:  # noqa: E741
    """The score of a cut, exact: Spark's decimals hold 38 digits, and the quotient is at most SCALE."""
    wide = "cast({} as decimal(18,0))"
    return f"cast({SCALE} as decimal(7,0)) * cast({wide.format('a')} * {wide.format('a')} as decimal(31,0)) div ({wide.format(l)} * {wide.format(r)})"


def collocations(docs: DataFrame, best: int = BEST) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a (occurrences), l and r (of the parts), n (words of the language), score.

    A-Z are lower-cased; texts are cut in pieces at `[.,;:!?\\x0A-\\x0D]` and these in words `[^\\x20\\x09]+`. A phrase has
    two or three words of one piece and at least LEAST occurrences. Its score is that of its lowest cut (the first of equal
    ones). Phrases that stand in a longer one with at least half their occurrences are left out. A null text is empty, a null
    lang is `und`; repeated rows count each; other columns are ignored. Counts up to 10**12 are exact.
    """
    small_batches(docs.sparkSession)
    texts = _texts(docs)
    for seed in range(1, 17):
        every = stored(word_counts(texts, seed), "words")
        if every.filter("clash").isEmpty():
            break
    else:
        raise ValueError("words share 64-bit hashes under every seed")
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(every.filter(F.col("f") >= LEAST).select("h", "lang", "word", "f"), "frequent-words")
    pairs = stored(pair_counts(texts, words, seed), "pairs")
    triples = stored(triple_counts(texts, words, pairs, seed), "triples")

    def word(key: str, text: str, f: str, *more: str) -> DataFrame:
        return words.select(F.col("h").alias(key), F.col("word").alias(text), F.col("f").alias(f), *more)

    def pair(a: str, b: str, f: str) -> DataFrame:
        return pairs.select(F.col("a").alias(a), F.col("b").alias(b), F.col("f").alias(f))

    longer = triples.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("d").alias("b")))).alias("p"), "f").groupBy("p.a", "p.b").agg(F.max("f").alias("longer"))
    two = pairs.join(longer, ["a", "b"], "left").filter(f"longer is null or 100 * longer < {TAKEN_IN} * f").withColumnRenamed("f", "n_a")
    two = two.join(word("a", "w1", "l", "lang"), "a").join(word("b", "w2", "r"), "b").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n_a").alias("a"), "l", "r")
    two = two.withColumn("score", F.expr(_score("l", "r")))
    three = triples.withColumnRenamed("f", "n_a").join(pair("a", "b", "f12"), ["a", "b"]).join(pair("b", "d", "f23"), ["b", "d"])
    three = three.join(word("a", "w1", "f1", "lang"), "a").join(word("b", "w2", "f2"), "b").join(word("d", "w3", "f3"), "d")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n_a").alias("a"), "f1", "f23", "f12", "f3").withColumn("s1", F.expr(_score("f1", "f23"))).withColumn("s2", F.expr(_score("f12", "f3")))
    second = F.col("s2") < F.col("s1")
    three = three.select("lang", "phrase", "a", F.when(second, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(second, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first the best of each part of a language, so that no task orders a whole one
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = two.unionByName(three).withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= best)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
