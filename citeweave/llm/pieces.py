"""Operator 4, SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is cut before each run of spaces; as no piece goes over such a place, each part ("word") is encoded on its own,
and equal words once. Words of equal length advance together, character by character: hashes of the substrings that end
there probe the sorted keys of the pieces, and vectorised maxima over the pieces' scores store backpointers. Of equal
sums the longer last piece wins. A character without a piece goes as the bytes of its UTF-8.

The public vocabulary at hand holds a BPE model, whose scores are the negated ranks of its merges, no probabilities. A
piece's rank is read as its rank by frequency, and its score is the logarithm of a Zipf-Mandelbrot probability of that
rank; nothing is trained. The best sum isn't always what merging in order gives, so ids can differ from those of the
sentencepiece library (figures are in the README); decoding gives the text back exactly in any case. A vocabulary whose
scores aren't ranks keeps them.

Nulls: a null text is empty; an empty text has no ids. Repeated rows are encoded each. Spaces are all kept, and so is a
literal U+2581 (as bytes). An empty table gives no rows. Other columns stay where `keep` asks for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, prefix_hash, ragged, released, slices, small_batches, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a space within pieces, and of a literal U+2581, which no piece has.
SPACE, LITERAL = 0x2581, 0x110000
#: Offset of the ranks in the Zipf-Mandelbrot law.
OFFSET = 60
#: Longest word that is advanced with others, words that a task keeps encoded, and the score of a byte over the least of a piece.
BATCHED, CACHED, BYTE = 64, 300_000, -10.0
#: First bits of a hash by which the first key with them is known.
SEEN = 18
SEEN_SHIFT = np.uint64(64 - SEEN)
_MULT = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULT, pow(_MULT, -1, 1 << 64)):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def log_probabilities(scores: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Scores that are negated ranks as logarithms of Zipf-Mandelbrot probabilities; others as they are."""
    rank = -scores[normal]
    if not len(rank) or (rank < 0).any() or (rank != np.floor(rank)).any():
        return scores
    out = scores.copy()
    out[normal] = -np.log(rank + OFFSET) - np.log((1 / (rank + OFFSET)).sum())
    return out


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model; its size is fixed, so it goes to all tasks."""

    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        own = Vocabulary(pieces, log_probabilities(np.array([sp.get_score(i) for i in range(n)], np.float64), normal), normal, byte_ids)
        if any("▁" in p.lstrip("▁") for p, x in zip(pieces, normal) if x):
            raise ValueError("a piece goes over the start of a word")
        by_length: dict[int, list[int]] = {}
        for i in np.flatnonzero(normal).tolist():
            by_length.setdefault(len(pieces[i]), []).append(i)
        for size, ids in by_length.items():
            points = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(len(ids), size)
            keys = own._hash(points, 0, size)
            order = np.argsort(keys)
            keys = keys[order]
            slot = np.full(1 << SEEN, -1, np.int16 if len(keys) < 1 << 15 else np.int32)
            slot[keys[::-1] >> SEEN_SHIFT] = np.arange(len(keys))[::-1]
            own.tables[size] = (keys, np.array(ids, np.int32)[order], slot)
        return own

    @staticmethod
    def _hash(points: np.ndarray, a: int, b: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((points[:, a:b].astype(np.uint64) + np.uint64(1)) * _powers(points.shape[1] + 1)[0][: b - a]).sum(axis=1, dtype=np.uint64)

    def __post_init__(self):
        self.longest = max((len(p) for p, x in zip(self.pieces, self.normal) if x), default=1)
        self.byte_score = float(self.scores[self.normal].min() + BYTE) if self.normal.any() else BYTE
        is_byte = {int(i): b for b, i in enumerate(self.byte_ids)}
        data = [bytes([is_byte[i]]) if i in is_byte else p.replace("▁", " ").encode() if self.normal[i] else b"" for i, p in enumerate(self.pieces)]
        self.size = np.array([len(x) for x in data], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(data), np.uint8)
        self.lookup = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}

    # --- encoding

    def _batch(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of one length, one word after another, and each word's number of tokens.

        A character without a piece is given as -1 - its code point.
        """
        n, length = points.shape
        with np.errstate(over="ignore"):
            power, inverse = _powers(length + 1)
            sums = np.zeros((length + 1, n), np.uint64)
            np.cumsum((points.T.astype(np.uint64) + np.uint64(1)) * power[:length, None], axis=0, out=sums[1:])
            # all pieces of one length that stand somewhere, in order of the place where they end
            stands = []
            for size in range(min(length, self.longest), 0, -1):
                if size not in self.tables:
                    continue
                keys, ids, slot = self.tables[size]
                h = ((sums[size:] - sums[:-size]) * inverse[: length - size + 1, None]).ravel()
                at = slot[h >> SEEN_SHIFT]
                hit = np.flatnonzero(at >= 0)
                if not len(hit):
                    continue
                h, at = h[hit], at[hit]
                same = keys[at] == h
                if not same.all():  # another key with the same first bits, if it is there
                    other = np.flatnonzero(~same)
                    at[other] = np.minimum(np.searchsorted(keys, h[other]), len(keys) - 1)
                    same[other] = keys[at[other]] == h[other]
                    hit, at = hit[same], at[same]
                found = ids[at]
                stands.append((size, hit % n, found, self.scores[found], np.searchsorted(hit, np.arange(length - size + 2) * n).tolist()))
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, token = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.int64)
        octets = 1 + (points > 0x7F) + (points > 0x7FF) + ((points > 0xFFFF) & (points != LITERAL))
        for j in range(1, length + 1):
            now = best[j]
            for size, word, found, score, edge in stands:  # longer ones first
                if size > j or edge[j - size] == edge[j - size + 1]:
                    continue
                own = slice(edge[j - size], edge[j - size + 1])
                w = word[own]
                total = best[j - size][w] + score[own]
                better = total > now[w]
                w = w[better]
                now[w], back[j, w], token[j, w] = total[better], size, found[own][better]
            total = best[j - 1] + self.byte_score * octets[:, j - 1]
            better = np.flatnonzero(total > now)
            now[better], back[j, better], token[j, better] = total[better], 1, -1 - points[better, j - 1].astype(np.int64)
        out, count, at, who = np.zeros((n, length), np.int64), np.zeros(n, np.int64), np.full(n, length), np.arange(n)
        while len(who):
            out[who, length - 1 - count[who]] = token[at[who], who]
            count[who] += 1
            at[who] -= back[at[who], who]
            who = who[at[who] > 0]
        return out[np.arange(length) >= length - count[:, None]], count

    def _long(self, points: list[int]) -> np.ndarray:
        """The same for one long word."""
        n, chars = len(points), [chr(c) if c != LITERAL else "\0\0" for c in points]
        best, back, token = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for size in range(min(j, self.longest), 0, -1):
                i = self.lookup.get("".join(chars[j - size : j]))
                if i is not None and (total := best[j - size] + self.scores[i]) > best[j]:
                    best[j], back[j], token[j] = total, size, i
            c = points[j - 1]
            octets = 3 if c == LITERAL else 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            if (total := best[j - 1] + self.byte_score * octets) > best[j]:
                best[j], back[j], token[j] = total, 1, -1 - c
        out, j = [], n
        while j:
            out.append(token[j])
            j -= back[j]
        return np.array(out[::-1], np.int64)

    def _bytes(self, tokens: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the tokens of their bytes."""
        missing = np.flatnonzero(tokens < 0)
        if not len(missing):
            return tokens, count
        codes, which = np.unique(-1 - tokens[missing], return_inverse=True)
        data = [("▁" if c == LITERAL else chr(c)).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        times = np.ones(len(tokens), np.int64)
        times[missing] = np.array([len(x) for x in data])[which]
        out = np.repeat(tokens, times)
        first = (np.cumsum(times) - times)[missing]
        for k, x in enumerate(data):
            for j, i in enumerate(self.byte_ids[list(x)].tolist()):
                out[first[which == k] + j] = i
        return out, np.bincount(np.repeat(np.arange(len(count)), count), weights=times, minlength=len(count)).astype(np.int64)

    def encode_points(self, points: np.ndarray, start: np.ndarray, length: np.ndarray, spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as stretches of code points, one word after another, and each word's number of ids.

        spaced: with a space in front of each.
        """
        points = points.astype(np.uint32)
        points[points == SPACE] = LITERAL
        points[points == 32] = SPACE
        order, parts = np.argsort(length, kind="stable"), []
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, edges) if len(order) else []:
            n = int(length[rows[0]])
            if n + spaced > BATCHED:
                for r in rows.tolist():
                    own = self._long([SPACE] * spaced + points[start[r] : start[r] + n].tolist())
                    parts.append((np.array([r]), *self._bytes(own, np.array([len(own)]))))
                continue
            if not n + spaced:
                continue
            step = max(1, 200_000 // (n + spaced))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                grid = points[start[some][:, None] + np.arange(n)]
                if spaced:
                    grid = np.concatenate([np.full((len(some), 1), SPACE, np.uint32), grid], axis=1)
                parts.append((some, *self._bytes(*self._batch(grid))))
        size = np.zeros(len(start), np.int64)
        for rows, _, count in parts:
            size[rows] = count
        at, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.int32)
        for rows, ids, count in parts:
            out[ragged(at[rows], count)] = ids
        return out, size

    def encode_words(self, words: list[bytes], spaced: bool = False) -> list[np.ndarray]:
        """Ids of each word (its UTF-8, with spaces as they are)."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, size = self.encode_points(points, np.cumsum(length) - length, length, spaced)
        return np.split(ids, np.cumsum(size)[:-1]) if words else []


class Characters:
    """Code points of a slice of texts, and which of them begins at or behind each byte."""

    def __init__(self, t: Texts):
        self.points = np.frombuffer(t.buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.zeros(len(t.buf) + 1, np.int64)
        np.cumsum((t.buf & 0xC0) != 0x80, out=self.at[1:])


class Encoder:
    """Encodes words by their hashes; keeps those seen in sorted arrays, up to a bound, those met again longest."""

    def __init__(self, vocabulary: Vocabulary, spaced: bool = False):
        self.vocabulary, self.spaced = vocabulary, spaced
        self.hashes, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again, self.flat = np.zeros(0, bool), np.zeros(0, np.int32)

    def words(self, hashes: np.ndarray, chars: Characters, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word (distinct hashes in order, with a place of each in bytes), valid until the next call.

        ids[at[number]: at[number] + size[number]] are its ids.
        """
        if len(self.hashes):
            spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            new = np.flatnonzero(self.hashes[spot] != hashes)
            self.again[spot[self.hashes[spot] == hashes]] = True
        else:
            new = np.arange(len(hashes))
        if len(new):
            if len(self.hashes) + len(new) > CACHED:
                self._keep(self.again if self.again.sum() <= CACHED // 2 else np.isin(self.hashes, hashes, assume_unique=True))
            low = chars.at[start[new]]
            flat, size = self.vocabulary.encode_points(chars.points, low, chars.at[end[new]] - low, self.spaced)
            both = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(both, kind="stable")
            self.hashes = both[order]
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])[order]
            self.count = np.concatenate([self.count, size])[order]
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])[order]
            self.flat = np.concatenate([self.flat, flat])
        return np.searchsorted(self.hashes, hashes)

    def _keep(self, some: np.ndarray) -> None:
        """Only these words; the ones of the slice at hand are always among them."""
        self.flat = self.flat[ragged(self.first[some], self.count[some])]
        self.hashes, self.count = self.hashes[some], self.count[some]
        self.first, self.again = np.cumsum(self.count) - self.count, np.zeros(len(self.hashes), bool)

    @property
    def ids(self) -> np.ndarray:
        return self.flat

    @property
    def at(self) -> np.ndarray:
        return self.first

    @property
    def size(self) -> np.ndarray:
        return self.count


def shipped(spark: SparkSession, path: str = MODEL) -> Broadcast:
    small_batches(spark)
    return spark.sparkContext.broadcast(Vocabulary.load(path))


def _spaced(column: pa.Array) -> pa.Array:
    """A space before each text; the dummy prefix of the model."""
    import pyarrow.compute as pc

    text = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar(" ", pa.large_string()))


def _encode(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for part in slices(batches, "_text"):
            t = Texts(_spaced(part.column(part.schema.get_field_index("_text"))))
            space = t.buf == 32
            new = space.copy()
            new[1:] &= ~space[:-1]
            new[t.start] = True
            start = np.flatnonzero(new)
            doc = np.searchsorted(t.end, start)
            end = np.minimum(np.append(start[1:], len(t.buf)), t.end[doc])
            full = (t.end - t.start > 1)[doc]  # an empty text has no ids
            start, end, doc = start[full], end[full], doc[full]
            hashes, where, back = np.unique(span_hash(prefix_hash(t.buf), start, end), return_index=True, return_inverse=True)
            number = encoder.words(hashes, Characters(t), start[where], end[where])[back]
            size = encoder.size[number]
            ids = encoder.ids[ragged(encoder.at[number], size)]
            count = np.bincount(doc, weights=size, minlength=t.n).astype(np.int64)
            crc = [zlib.crc32(t.buf[a + 1 : b]) for a, b in zip(t.start.tolist(), t.end.tolist())]
            keep = [(part.column(i), f.name) for i, f in enumerate(part.schema) if f.name != "_text"]
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(c for c, _ in keep), pa.array(count), listed, pa.array(crc, pa.int64())], names=[*(n for _, n in keep), "n_tokens", "ids", "text_crc32"])

    return run


def _decode(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                listed = part.column(part.schema.get_field_index("ids"))
                ids = listed.flatten().to_numpy().astype(np.int64)
                edges = listed.offsets.to_numpy().astype(np.int64)
                edges = edges - edges[0]
                size = v.size[ids]
                flat = v.flat[ragged(v.at[ids], size)]
                total = np.concatenate([[0], np.cumsum(size)])[edges]
                data = flat.tobytes()
                texts = [data[x + 1 : y].decode("utf-8", "replace") for x, y in pairwise(total.tolist())]  # without the dummy prefix
                keep = [(part.column(i), f.name) for i, f in enumerate(part.schema) if f.name != "ids"]
                yield pa.RecordBatch.from_arrays([*(c for c, _ in keep), listed, pa.array(texts, pa.string())], names=[*(n for _, n in keep), "ids", "decoded"])
        released()

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and text_crc32 (of the text that was read) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    df = docs.select("doc_id", F.col("text").alias("_text"))
    return df.mapInArrow(_encode(shipped(docs.sparkSession, path)), f"doc_id {kind}, n_tokens long, ids array<int>, text_crc32 long")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """The columns of encoded with `decoded`, the text that its ids stand for."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"]
    return encoded.mapInArrow(_decode(shipped(encoded.sparkSession, path)), ", ".join([*columns, "ids array<int>", "decoded string"]))
