"""Operator 6, LM scoring: a causal self-attention model on subword ids.

Texts are cut into words and words into subwords of a public vocabulary, once, in a stored table. All training texts are
read whole by every step below.

* Counts of all training words give the base score. Words are told apart by a 64-bit hash of their subwords.
* Counts of what stands beside each subword put the subwords into classes, those that begin a word apart from the others.
  Counts of the class behind each subword give its features and the logits that the model starts from.
* The attention model sees the subword ids up to a place and gives the class of the next subword. It is trained on every
  window of every training text, so on every place once, in numpy: texts are dealt to groups by a hash of what they hold, each group trains a copy
  in the order of that hash, and the copies are averaged by their numbers of subwords, in rounds over different texts. So
  the result doesn't depend on how Spark splits the table. A group has about GROUP subwords at any size of the input.
* A word is scored as the class of its first subword, by the model, times its share among the known words of that class
  (Good and Turing's estimate leaves room for unknown ones). An unknown word is spelled: its first subword's share among
  words seen once, then class and share of each further subword, and the stop, all by the model. The shares add up to one.

Every place of a text is scored once, in overlapping windows. Frequent words (a bounded table) go to all tasks; all other
words meet their counts in a join, so base score and score are exact for any number of words.

Nulls: a null text is empty and is scored as its end alone; a null doc_id counts as the empty string for the fold.
Repeated rows learn and are scored each. With no training texts at all, every token has the probability of an unknown.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import HALF, Attention
from .common import NOT_SPACE, Texts, mix, prefix_hash, ragged, released, slices, span_hash, stored
from .pieces import MODEL, Characters, Encoder, Vocabulary, shipped

#: Words that go to all tasks at most; classes of subwords that begin a word (the end of a text is one) and of the others.
WORDS, STARTS, INNER = 1 << 18, 48, 48
#: Subwords of a training group, rounds, windows of a training step and of a scoring step.
GROUP, ROUNDS, STEP, BATCH = 4_000_000, 2, 64, 128
RATE = 0.006
#: Buckets of the subwords beside a subword; where those stand, with the group they are counted in; features of a subword.
NEAR, BESIDE, FEATURES = 32, ((1, 0), (-1, 1), (9, 2), (-9, 2)), 24
#: Weight of a share within a class over all places against its share behind one class.
BACK = 20.0
#: Counts that a task keeps before it sums them up.
HELD = 1 << 20


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2


@dataclass
class Alphabet:
    """The ids of a vocabulary, the end of a text as one more, and which of them begin a word."""

    size: int
    begins: np.ndarray

    @staticmethod
    def of(vocabulary: Vocabulary) -> Alphabet:
        if "▁" not in vocabulary.lookup:
            raise ValueError("no piece for the start of a word")
        return Alphabet(len(vocabulary.pieces) + 1, np.array([x and p.startswith("▁") for p, x in zip(vocabulary.pieces, vocabulary.normal)] + [True]))

    @property
    def end(self) -> int:
        return self.size - 1


# --- tasks ------------------------------------------------------------------------------------


def _coded(vocabulary, end_id: int):
    """ids of each text as 32-bit numbers in a row, the end included; row numbers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(vocabulary.value, spaced=True), TaskContext.get().partitionId() << 40
        for part in slices(batches, "_text"):
            t = Texts(part.column(part.schema.get_field_index("_text")), lower=True)
            start, end, doc = t.words(NOT_SPACE)
            hashes, where, back = np.unique(span_hash(prefix_hash(t.buf), start, end), return_index=True, return_inverse=True)
            number = encoder.words(hashes, Characters(t), start[where], end[where])[back] if len(start) else np.zeros(0, np.int64)
            size = encoder.size[number]
            total = np.bincount(doc, weights=size, minlength=t.n).astype(np.int64) + 1
            edges = np.concatenate([[0], np.cumsum(total)])
            flat = np.full(edges[-1], end_id, np.uint16 if end_id < 1 << 16 else np.uint32)
            flat[ragged(edges[:-1], total - 1)] = encoder.ids[ragged(encoder.at[number], size)]
            data, step = flat.tobytes(), flat.itemsize
            keep = {c: part.column(part.schema.get_field_index(c)) for c in ("doc_id", "held_out", "mark")}
            ids = pa.array([data[a * step : b * step] for a, b in zip(edges.tolist(), edges[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(t.n)), *keep.values(), pa.array(total), ids], names=["row", *keep, "n_ids", "ids"])
            row += t.n

    return run


def flat_ids(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch of coded texts, and where each text begins and the last ends."""
    column = batch.column("ids").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(kind).astype(np.int32), (at - at[0]) // kind.itemsize


def words_of(ids: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, place behind and hash of each word and each end of a text."""
    first = np.flatnonzero(alphabet.begins[ids])
    behind = np.append(first[1:], len(ids))
    return first, behind, span_hash(prefix_hash(ids), first, behind)


def _counted(alphabet: Alphabet):
    """hash, first subword and count of the words of each task, the end left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def summed() -> None:
            h, f, c = (np.concatenate(x) for x in zip(*held))
            hashes, where, back = np.unique(h, return_index=True, return_inverse=True)
            held[:] = [(hashes, f[where], np.bincount(back, weights=c).astype(np.int64))]

        def out() -> pa.RecordBatch:
            summed()
            (h, f, c), held[:] = held[0], []
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f, pa.int32()), pa.array(c)], names=["hash", "first", "c"])

        for batch in batches:
            ids, _ = flat_ids(batch, alphabet.size)
            first, _, h = words_of(ids, alphabet)
            some = ids[first] != alphabet.end
            hashes, where, c = np.unique(h[some], return_index=True, return_counts=True)
            held.append((hashes, ids[first[some][where]], c))
            if sum(len(x[0]) for x in held) > HELD:
                summed()
                if len(held[0][0]) > HELD // 2:
                    yield out()
        if held:
            yield out()
        released()

    return run


#: Pieces that a sum is cut into, and groups of tasks that are summed first.
CHUNKS, PARTS = 32, 4


def packed(x: np.ndarray) -> bytes:
    """What isn't zero: how many, their places, their values, in 32 bits where they fit."""
    at = np.flatnonzero(x)
    v = x[at]
    if v.dtype == np.int64 and (not len(v) or np.abs(v).max() < 1 << 31):
        v = v.astype(np.int32)
    return np.array([len(at), v.dtype.itemsize], np.int32).tobytes() + at.astype(np.int32).tobytes() + v.tobytes()


def unpacked(data: bytes, kind: np.dtype, out: np.ndarray) -> None:
    """Add to out what packed made."""
    n, width = np.frombuffer(data, np.int32, 2)
    own = np.int32 if width == 4 else kind
    out[np.frombuffer(data, np.int32, n, 8)] += np.frombuffer(data[8 + 4 * n :], own)


def totals(df: DataFrame, work: Callable, shape: tuple[int, ...], kind=np.int64) -> np.ndarray:
    """The sum of an array that each task makes of its batches; summed in groups of tasks, each by chunks of the array.

    The array's shape doesn't depend on the input, so that it may come to the driver.
    """
    size = math.prod(shape)
    cuts = [size * i // CHUNKS for i in range(CHUNKS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(shape, kind)
        work(batches, own)
        if own.any():
            flat = own.ravel()
            part = TaskContext.get().partitionId() % PARTS
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.array([packed(flat[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["chunk", "part", "data"])
        released()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        both = np.zeros(cuts[chunk + 1] - cuts[chunk], kind)
        for x in pdf["data"]:
            unpacked(x, kind, both)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "data": [packed(both)]})

    some = df.mapInArrow(run, "chunk int, part int, data binary").groupBy("chunk", "part").applyInPandas(add, "chunk int, data binary")
    out = np.zeros(size, kind)
    for r in some.groupBy("chunk").applyInPandas(add, "chunk int, data binary").collect():
        unpacked(r.data, kind, out[cuts[r.chunk] : cuts[r.chunk + 1]])
    return out.reshape(shape)


def neighbours(ids: np.ndarray, edges: np.ndarray, own: np.ndarray, size: int) -> None:
    """Add to own how often each id stands; then, for each group of BESIDE, how often each id has one of each bucket there."""
    bucket = (mix(np.arange(1, size + 1).astype(np.uint64)) % np.uint64(NEAR)).astype(np.int32)
    text = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
    own[:size] += np.bincount(ids, minlength=size)
    key, near = ids * np.int32(NEAR), bucket[ids]
    for by, group in BESIDE:
        k = abs(by)
        a, b = (slice(None, -k), slice(k, None)) if by > 0 else (slice(k, None), slice(None, -k))
        same = text[:-k] == text[k:]
        first = size + group * size * NEAR
        own[first : first + size * NEAR] += np.bincount((key[a] + near[b])[same], minlength=size * NEAR)


def _parts(ids: np.ndarray, edges: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about so many ids; a longer text makes one of its own."""
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _neighbours(alphabet: Alphabet):
    def work(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        for batch in batches:
            neighbours(*flat_ids(batch, alphabet.size), own, alphabet.size)

    return work


def _followers(alphabet: Alphabet, class_of):
    """How often each class stands behind each id; the last row is for the start of a text."""

    def work(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        for batch in batches:
            ids, edges = flat_ids(batch, alphabet.size)
            before = np.concatenate([[alphabet.size], ids[:-1]])
            before[edges[:-1]] = alphabet.size
            own.ravel()[:] += np.bincount(before.astype(np.int64) * own.shape[1] + class_of.value[ids], minlength=own.size)

    return work


def _insides(alphabet: Alphabet, class_of):
    """How often each id stands within a word behind each class."""

    def work(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        for batch in batches:
            ids, _ = flat_ids(batch, alphabet.size)
            at = np.flatnonzero(~alphabet.begins[ids])
            own.ravel()[:] += np.bincount(class_of.value[ids[at - 1]] * alphabet.size + ids[at], minlength=own.size)

    return work


def _trained(alphabet: Alphabet, model, class_of):
    """Rows come by group, in order of their mark. The copies' parameters times their subwords, and the subwords."""

    def work(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        m, rate = model.value
        copy, group, n, waiting = Attention(m.features, m.last, m.width), None, 0, []

        def learn(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal n
            copy.train(x, y, rate)
            n += int((y >= 0).sum())

        def done() -> None:
            nonlocal n
            if waiting:
                learn(*waiting.pop())
            if n:
                own[:-1] += copy.vector().astype(np.float64) * n
                own[-1] += n
            n = 0

        for batch in batches:
            all_ids, all_edges = flat_ids(batch, alphabet.size)
            groups = batch.column("group").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)] if len(groups) else []
            for lo, hi in zip(bounds, bounds[1:]):
                if groups[lo] != group:
                    done()
                    group = groups[lo]
                    copy.load(m.vector()).reset()
                for i, j in _parts(all_ids, all_edges[lo : hi + 1]):
                    edges = all_edges[lo + i : lo + j + 1]
                    ids, edges = all_ids[edges[0] : edges[-1]], edges - edges[0]
                    x, at = copy.windows(ids, edges)
                    y = np.full(len(x) * HALF, -1)
                    y[at] = class_of.value[ids]
                    y = y.reshape(-1, HALF)
                    if waiting:
                        a, b = waiting.pop()
                        x, y = np.concatenate([a, x]), np.concatenate([b.reshape(-1, HALF), y])
                    for a in range(0, len(x) - STEP + 1, STEP):
                        learn(x[a : a + STEP], y[a : a + STEP].ravel())
                    if len(x) % STEP:
                        a = len(x) - len(x) % STEP
                        waiting.append((x[a:], y[a:].ravel()))
        done()

    return work


def place_scores(model: Attention, ids: np.ndarray, edges: np.ndarray, places: np.ndarray, stops: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """At some places of texts, given in order: the natural logarithm of the model's probability of the id there; where
    stops says so, also that of the stop of the word before it.

    Where a word begins, the former is given that one does; elsewhere it includes that the word goes on.
    """
    x, at = model.windows(ids, edges)
    own, stop, k = np.zeros(len(places)), np.zeros(len(places)), m["class_of"][ids[places]]
    where, begins = at[places], m["class_of"][ids[places]] < STARTS
    window = where // HALF
    many = np.bincount(window, minlength=len(x))
    head = np.cumsum(many) - many
    by = np.argsort(many, kind="stable")  # windows with about as many places go together
    by = by[many[by] > 0]
    for a in range(0, len(by), BATCH):
        some = by[a : a + BATCH]
        i = ragged(head[some], many[some])
        last, c = model.found(x[some], np.repeat(np.arange(len(some)), many[some]) * HALF + where[i] % HALF)
        # where only the beginnings of words compete, the other classes aren't needed
        only = begins[i] & ~stops[i]
        few, rest = np.flatnonzero(only), np.flatnonzero(~only)
        z = model.logits(last[few], c[few], STARTS)
        hit = z[np.arange(len(few)), k[i[few]]]
        own[i[few]] = hit - np.log(np.exp(z, out=z).sum(axis=1))
        if len(rest):
            z = model.logits(last[rest], c[rest])
            hit, r = z[np.arange(len(rest)), k[i[rest]]], i[rest]
            np.exp(z, out=z)
            start, every = np.log(z[:, :STARTS].sum(axis=1)), np.log(z.sum(axis=1))
            own[r], stop[r] = hit - np.where(begins[r], start, every), start - every
    return own, stop


def _score(tables):
    """A row for each text with its sums over frequent words, and one for each word of a text that isn't in the table.

    n, x, y of the former: its tokens, base score but for the denominator, and score. Of the latter: how often it stands
    there, its score if it is known but for its count, and its score if it is unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = tables.value
        alphabet, model = m["alphabet"], m["model"]
        for batch in batches:
            all_ids, all_edges = flat_ids(batch, alphabet.size)
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi in _parts(all_ids, all_edges):
                ids, edges = all_ids[all_edges[lo] : all_edges[hi]], all_edges[lo : hi + 1] - all_edges[lo]
                n = hi - lo
                first, behind, h = words_of(ids, alphabet)
                doc = np.searchsorted(edges, first, side="right") - 1
                ends = ids[first] == alphabet.end
                c = np.where(ends, m["ends"], _found(m["hashes"], m["counts"], h))
                rare = np.flatnonzero((c == 0) & ~ends)
                # words that may be unknown are spelled too: those of training texts are known
                spelled = rare[held[lo:hi][doc[rare]]]
                inner = ragged(first[spelled] + 1, behind[spelled] - first[spelled] - 1)
                places = np.concatenate([first, inner])
                stops = np.zeros(len(places), bool)
                stops[spelled + 1] = True  # the beginning of what follows, at the latest the end
                order = np.argsort(places, kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                own, stop = (x[back] for x in place_scores(model, ids, edges, places[order], stops[order], m))
                begin = own[: len(first)]
                spell = np.zeros(len(first))
                if len(spelled):
                    share = own[len(first) :] + m["inner_share"][m["class_of"][ids[inner - 1]], ids[inner]]
                    size = behind[spelled] - first[spelled] - 1
                    sums = np.concatenate([[0], np.cumsum(share)])
                    cut = np.cumsum(size)
                    spell[spelled] = m["new_share"][ids[first[spelled]]] + sums[cut] - sums[cut - size] + stop[: len(first)][spelled + 1]
                unit = m["unit"][ids[first]]
                known = np.where(ends, 0.0, unit + np.log(np.maximum(c, 1)))
                score = np.where(c > 0, begin + known, 0)
                score = np.bincount(doc, weights=score, minlength=n)
                base = np.bincount(doc, weights=np.log10(c + 1.0), minlength=n)
                n_known = np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64)
                n_words = np.bincount(doc, minlength=n)
                # equal rare words of a text as one row
                key = mix(h[rare] + mix(doc[rare].astype(np.uint64)))
                _, where, back = np.unique(key, return_index=True, return_inverse=True)
                r = rare[where]
                times, begin, spell = np.bincount(back, minlength=len(r)), *(np.bincount(back, weights=x[rare], minlength=len(r)) for x in (begin, begin + spell))
                rows = batch.column("row").to_numpy()[lo:hi]
                mine = mix(rows.astype(np.uint64) ^ np.uint64(0x5BF03635))  # spread over the join; it has no count there
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([rows, rows[doc[r]]])), pa.array(np.concatenate([np.zeros(n, np.int8), np.ones(len(r), np.int8)])), pa.array(np.concatenate([mine, h[r]]).view(np.int64)), *(pa.array(np.concatenate([x, y])) for x, y in ((n_words, times), (n_known, np.zeros(len(r), np.int64)), (base, (begin + times * unit[r]) / np.log(10)), (score / np.log(10), spell / np.log(10))))],
                    names=["row", "is_word", "hash", "n", "n_known", "x", "y"],
                )
        released()

    return run


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


# --- fitting ----------------------------------------------------------------------------------


def grouped(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm from the heaviest points."""
    centre = x[np.argsort(-weight, kind="stable")[:k]].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(15):
        near = ((centre**2).sum(axis=1)[None, :] - 2 * x @ centre.T).argmin(axis=1)
        total = np.bincount(near, weights=weight, minlength=len(centre))
        for j in np.flatnonzero(total > 0):
            own = near == j
            centre[j] = weight[own] @ x[own] / total[j]
    return near


def classes_of(sums: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """The class of each id by what stands beside it. The end has the last of the STARTS classes for itself."""
    n, out = sums[: alphabet.size].astype(np.float64), np.zeros(alphabet.size, np.int64)
    beside = sums[alphabet.size :].reshape(-1, alphabet.size, NEAR)
    for begins, first, k in ((True, 0, STARTS - 1), (False, STARTS, INNER)):
        some = np.flatnonzero(alphabet.begins == begins)
        some = some[some != alphabet.end]
        parts = []
        for x in beside[:, some].astype(np.float64):
            mean = x.sum(axis=0) / max(x.sum(), 1)
            parts.append(np.sqrt((x + 6 * mean) / (x.sum(axis=1) + 6)[:, None]))
        out[some] = first + grouped(np.concatenate(parts, axis=1), n[some] ** 0.75, k)
    out[alphabet.end] = STARTS - 1
    return out


def started(followers: np.ndarray, width: int = 12) -> Attention:
    """A model whose logits are what the counts say of the class behind each id, and whose features sum them up."""
    n = followers.sum(axis=1, keepdims=True).astype(np.float64)
    p = followers.sum(axis=0) + 0.5
    p = p / p.sum()
    share = (followers + 10 * p) / (n + 10)
    ratio = np.log(share / p) * np.sqrt(p)
    _, v = np.linalg.eigh((ratio * n).T @ ratio)
    f = ratio @ v[:, ::-1][:, :FEATURES]
    f /= np.sqrt((n * f**2).sum(axis=0) / max(n.sum(), 1)) + 1e-3
    return Attention(np.concatenate([f, np.zeros((1, f.shape[1]))]), np.log(share), width)


def shares(first_counts: np.ndarray, once: np.ndarray, insides: np.ndarray, class_of: np.ndarray, alphabet: Alphabet) -> dict:
    """Natural logarithms of the shares within classes.

    unit: by first subword, of a known word of one count; new_share: of a first subword, that the word is unknown
    included; inner_share: of a subword within a word, by the class before it.
    """
    k = STARTS + INNER
    total, single = (np.bincount(class_of, weights=x, minlength=k) for x in (first_counts, once))
    known = (total - single + 0.5) / (total + 1)
    unit = np.log(known / np.maximum(total, 1))[class_of]
    begins = alphabet.begins.copy()
    begins[alphabet.end] = False
    new = np.where(begins, once + 0.5, 0)
    new_share = np.full(alphabet.size, 0.0)
    new_share[begins] = (np.log(new[begins]) - np.log(np.bincount(class_of, weights=new, minlength=k)[class_of[begins]])) + np.log(1 - known)[class_of[begins]]
    inside, own = ~alphabet.begins, class_of[~alphabet.begins]
    inner = insides[:, inside].sum(axis=0) + 0.5
    overall = inner / np.bincount(own, weights=inner, minlength=k)[own]
    inner_share = np.zeros((k, alphabet.size), np.float32)
    for before in range(k):
        n = insides[before, inside].astype(np.float64)
        inner_share[before, inside] = np.log((n + BACK * overall) / (np.bincount(own, weights=n, minlength=k)[own] + BACK))
    return {"unit": unit, "new_share": new_share, "inner_share": inner_share}


# --- Spark ------------------------------------------------------------------------------------


def coded(docs: DataFrame, path: str = MODEL) -> tuple[DataFrame, Alphabet]:
    """row, doc_id, held_out, mark (a hash of id and text), n_ids and ids of each document, stored."""
    vocabulary = shipped(docs.sparkSession, path)
    alphabet = Alphabet.of(vocabulary.value)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), F.xxhash64("doc_id", "text").alias("mark"), F.col("text").alias("_text"))
    return stored(rows.mapInArrow(_coded(vocabulary, alphabet.end), f"row long, doc_id {kind}, held_out boolean, mark long, n_ids long, ids binary"), "coded"), alphabet


def _top(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the largest counts: those over a power of 2**(1/4), so that `most` rows are left at most."""
    level = F.floor(F.log2("c") * 4)
    rows, least = 0, 0
    for lv, n in sorted(counts.groupBy(level.alias("lv")).count().collect(), reverse=True):  # a few hundred rows at most
        rows += n
        if rows > most:
            least = lv + 1
            break
    return counts.filter(level >= least)


def fit(texts: DataFrame, alphabet: Alphabet) -> tuple[DataFrame, dict]:
    """The table of word counts, and all that goes to the scoring tasks: its size is bounded by the constants above."""
    context = texts.sparkSession.sparkContext
    train = texts.filter("not held_out")
    ids = train.select("ids")
    counts = stored(ids.mapInArrow(_counted(alphabet), "hash long, first int, c long").groupBy("hash").agg(F.min("first").alias("first"), F.sum("c").alias("c")), "words")
    by_first = counts.groupBy("first").agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once"), F.count("*").alias("n")).toArrow()  # as many rows as pieces, at most
    first_counts, once = np.zeros(alphabet.size), np.zeros(alphabet.size)
    at = by_first.column("first").to_numpy()
    first_counts[at], once[at] = by_first.column("c").to_numpy(), by_first.column("once").to_numpy()
    ends, subwords = train.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    words, distinct = int(first_counts.sum()), int(by_first.column("n").to_numpy().sum())
    often = _top(counts, WORDS).select("hash", "c").toArrow()
    hashes, c = often.column("hash").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(hashes)
    m = {"alphabet": alphabet, "ends": ends, "hashes": hashes[order], "counts": c[order], "train_tokens": words + ends, "distinct": distinct + (ends > 0)}

    sums = totals(ids, _neighbours(alphabet), (alphabet.size * (1 + (1 + max(g for _, g in BESIDE)) * NEAR),))
    m["class_of"] = classes_of(sums, alphabet)
    shared = context.broadcast(m["class_of"])
    followers = totals(ids, _followers(alphabet, shared), (alphabet.size + 1, STARTS + INNER))
    first_counts[alphabet.end] = ends
    insides = totals(ids, _insides(alphabet, shared), (STARTS + INNER, alphabet.size))
    m |= shares(first_counts, once, insides, m["class_of"], alphabet)

    model = started(followers)
    groups = max(1, -(-subwords // GROUP))
    dealt = train.select("ids", "mark", F.pmod(F.xxhash64("mark"), F.lit(groups)).alias("group"), F.pmod("mark", F.lit(ROUNDS)).alias("turn"))
    for turn in range(ROUNDS):
        state = context.broadcast((model, RATE / (1 + turn)))
        some = dealt.filter(F.col("turn") == turn).drop("turn").repartition("group").sortWithinPartitions("group", "mark")
        got = totals(some, _trained(alphabet, state, shared), (len(model.vector()) + 1,), np.float64)
        if got[-1]:
            model.load(got[:-1] / got[-1])
    m["model"] = model
    return counts, m


def scores(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; both also over known words.

    The base gives every unknown word the probability of a single one. The model spells it, so that all words together
    have a probability of one; where many words are unknown, its score can lie below the base for that alone.
    """
    texts, alphabet = coded(docs, path)
    counts, m = fit(texts, alphabet)
    rows = texts.select("row", "held_out", "ids").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(m)), "row long, is_word byte, hash long, n long, n_known long, x double, y double")
    c = F.coalesce("c", F.lit(0))
    word = F.col("is_word") == 1
    met = rows.join(counts.select("hash", "c"), "hash", "left")
    known = F.when(~word, F.col("y")).when(c > 0, F.col("x") + F.col("n") * F.log10(c.cast("double")))
    base = F.when(~word, F.col("x")).when(c > 0, F.col("n") * F.log10(c + 1.0))
    out = met.groupBy("row").agg(
        F.sum(F.when(~word, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(~word, F.col("n_known")).when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(base).alias("base"),
        F.sum(F.coalesce(known, F.col("y"))).alias("score"),
        F.sum(known).alias("known_score"),
    )
    whole = float(np.log10(m["train_tokens"] + m["distinct"] + 1.0))
    out = texts.select("row", "doc_id", "held_out").join(out, "row")
    by = lambda n: F.col("base") - F.col(n) * whole  # noqa: E731  # an unknown word adds nothing else to the base score
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m["train_tokens"]).cast("long").alias("train_tokens"), by("n_tokens").alias("base_score"), "score", by("n_known").alias("known_base_score"), "known_score")
