"""Operator 3, benchmark decontamination by pigeonhole edit matching.

Texts and items are sequences of lower-cased words. An item of n words may be found with at most e = floor(n / 5) words
added, lost or changed. It is split into e + 1 pieces: e edits can touch e of them, so one piece stands unchanged in any
text that holds the item. Exact piece hits are found by joining hashes of word runs with the pieces; each hit says where
the item would stand, and the words there are compared with the item by Myers' bit-parallel edit distance, one word of
the text a step, on bit vectors as long as the item.

Neither the number of items nor their length is assumed small: what goes to all tasks is a bitmap of fixed size, which
drops most runs that are no piece; all others meet the pieces in an equi-join, as slim rows. Words are fetched for what has
met, as far as the item itself may reach: documents with hits are cut in blocks, which meet the places in another equi-join.

Nulls: null texts and items are empty and match nothing, as do items without words. An item of under five words has no
budget and must stand exactly. Repeated items and documents are matched each. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Texts, counts, gram_hash, key_filter, passes, prefix_hash, ragged, slices, span_hash, stored

#: One word in so many may be edited: similarity 0.8.
SHARE = 5
#: Words of a block in which documents with hits are cut.
BLOCK = 64


def pieces_of(n: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of an item of n words."""
    parts = n // SHARE + 1
    edges = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each item, with its words."""
    for part in slices(batches, "_text"):
        t = Texts(part.column(part.schema.get_field_index("_text")), lower=True)
        start, end, doc = t.words(ALNUM)
        word = span_hash(prefix_hash(t.buf), start, end)
        bounds = np.searchsorted(doc, np.arange(t.n + 1)).tolist()
        ids = part.column(part.schema.get_field_index("item_id")).to_pylist()
        rows = []
        for i in range(t.n):
            a, b = bounds[i], bounds[i + 1]
            for at, size in pieces_of(b - a) if b > a else []:
                rows.append((int(gram_hash(word[a + at : a + at + size], size).view(np.int64)[0]), size, ids[i], at, word[a:b].view(np.int64).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int32(), part.schema.field("item_id").type, pa.int32(), pa.list_(pa.int64())))], names=["hash", "size", "item_id", "at", "words"])


def pieces(items: DataFrame) -> DataFrame:
    """hash, size, item_id, at and the item's word hashes, a row for each piece."""
    return items.select("item_id", F.col("text").alias("_text")).mapInArrow(_items, f"hash long, size int, item_id {items.schema['item_id'].dataType.simpleString()}, at int, words array<long>")


def _hits(bitmap, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for part in slices(batches, "_text"):
            t = Texts(part.column(part.schema.get_field_index("_text")), lower=True)
            start, end, doc = t.words(ALNUM)
            word = span_hash(prefix_hash(t.buf), start, end)
            first = np.searchsorted(doc, np.arange(t.n + 1))
            at, hashes, size = [], [], []
            for k in sizes:
                h = gram_hash(word, k)
                hit = np.flatnonzero(passes(bits, h) & (doc[: len(h)] == doc[len(doc) - len(h) :]))
                at.append(hit)
                hashes.append(h[hit])
                size.append(np.full(len(hit), k, np.int32))
            if not sum(map(len, at)):
                continue
            at = np.concatenate(at)
            own = doc[at]
            ids = part.column(part.schema.get_field_index("doc_id"))
            key = part.column(part.schema.get_field_index("key"))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), key.take(pa.array(own)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(size)), pa.array((at - first[own]).astype(np.int64))], names=["doc_id", "key", "hash", "size", "pos"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of texts, as hashes, in blocks."""
    for part in slices(batches, "_text"):
        t = Texts(part.column(part.schema.get_field_index("_text")), lower=True)
        start, end, doc = t.words(ALNUM)
        word = span_hash(prefix_hash(t.buf), start, end)
        first, size = np.searchsorted(doc, np.arange(t.n)), counts(doc, t.n)
        own = np.repeat(np.arange(t.n), -(-size // BLOCK))
        block = ragged(np.zeros(t.n, np.int64), -(-size // BLOCK))
        edges = np.append(first[own] + block * BLOCK, len(word)).astype(np.int32)
        for a in range(0, len(own), 10_000):  # a very long text makes many blocks
            i = slice(a, min(a + 10_000, len(own)))
            e = edges[a : i.stop + 1]
            words = pa.ListArray.from_arrays(pa.array(e - e[0]), pa.array(word[e[0] : e[-1]].view(np.int64)))
            ids, key = (part.column(part.schema.get_field_index(c)).take(pa.array(own[i])) for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays([ids, key, pa.array(block[i]), words], names=["doc_id", "key", "block", "part"])


def myers(item: list[int], text: list[int], limit: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best place of item within text, if within limit; ties: the first end, then the longest span.

    Myers' algorithm in Hyyro's form: the two bit vectors hold the vertical differences of the distance table.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i

    def ends(text: list[int], at: dict[int, int], free: bool):
        up, down, score = full, 0, m
        for j, w in enumerate(text):
            eq = at.get(w, 0)
            d0 = (((eq & up) + up) ^ up) | eq | down
            hp = down | (full & ~(d0 | up))
            hn = up & d0
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1 | (0 if free else 1)) & full
            hn = hn << 1 & full
            up = hn | (full & ~(d0 | hp))
            down = hp & d0
            yield j, score

    best = min(((s, j) for j, s in ends(text, at, True)), default=(limit + 1, 0))
    if best[0] > limit:
        return None
    # the start: the reversed item from the end on, now with text words before it not free
    back: dict[int, int] = {}
    for i, w in enumerate(reversed(item)):
        back[w] = back.get(w, 0) | 1 << i
    j = max((j for j, s in ends(text[best[1] :: -1][: m + limit], back, False) if s == best[0]), default=0)
    return best[0], best[1] - j, best[1] + 1


def _verified(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        out = []
        for item, parts, low, place in zip(pdf["words"], pdf["parts"], pdf["low"], pdf["place"]):
            n = len(item)
            limit = n // SHARE
            around = np.concatenate(list(parts))
            a, b = max(0, place - limit - low), max(0, place + n + limit - low)
            found = myers(item.tolist(), around[a:b].tolist(), limit)
            out.append((found[0], low + a + found[1], low + a + found[2]) if found else (-1, 0, 0))
        got = pd.DataFrame(out, columns=["distance", "first_word", "end_word"], index=pdf.index)
        pdf = pdf[["doc_id", "key", "item_id"]].assign(n_words=pdf["words"].map(len)).join(got)
        yield pdf[pdf["distance"] >= 0]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best place of each item in each document that holds it: doc_id, key, item_id, n_words, distance, first_word, end_word."""
    spark = docs.sparkSession
    parts = stored(pieces(items).withColumn("item", F.xxhash64("words")), "pieces")  # items of one id may differ
    sizes = sorted(parts.agg(F.collect_set("size")).first()[0])
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"), F.col("text").alias("_text"))
    bitmap = spark.sparkContext.broadcast(key_filter(parts, "hash"))
    hits = texts.mapInArrow(_hits(bitmap, sizes), f"doc_id {kind}, key long, hash long, size int, pos long")
    near = hits.join(parts.select("hash", "size", "item_id", "item", "at", F.size("words").alias("n")), ["hash", "size"])
    # hits of one item at one place are verified once
    near = stored(near.select("doc_id", "key", "item_id", "item", "n", (F.col("pos") - F.col("at")).alias("place")).distinct(), "places")
    held = near.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    blocks = texts.join(held, same, "left_semi").mapInArrow(_cut, f"doc_id {kind}, key long, block long, part array<long>")
    blocks = blocks.dropDuplicates(["doc_id", "key", "block"]).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("block").alias("_block"), "part")
    slack = F.floor(F.col("n") / SHARE)
    low, high = F.floor(F.greatest(F.col("place") - slack, F.lit(0)) / BLOCK), F.floor(F.greatest(F.col("place") + F.col("n") + slack, F.lit(0)) / BLOCK)
    wanted = near.withColumn("block", F.explode(F.sequence(low, high)))
    fetched = wanted.join(blocks, same & (F.col("block") == F.col("_block")))
    spans = fetched.groupBy("doc_id", "key", "item_id", "item", "place").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("x"))  # as many blocks as an item reaches
    spans = spans.select("doc_id", "key", "item_id", "item", "place", (F.col("x")[0]["block"] * BLOCK).alias("low"), F.col("x.part").alias("parts"))
    whole = parts.select(F.col("item_id").alias("_item_id"), F.col("item").alias("_item"), "words").dropDuplicates(["_item_id", "_item"])
    spans = spans.join(whole, F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item") == F.col("_item"))).select("doc_id", "key", "item_id", "place", "low", "parts", "words")
    item = items.schema["item_id"].dataType.simpleString()
    good = spans.mapInPandas(_verified, f"doc_id {kind}, key long, item_id {item}, n_words long, distance long, first_word long, end_word long")
    best = good.groupBy("doc_id", "key", "item_id", "n_words").agg(F.min(F.struct("distance", "first_word", "end_word")).alias("x"))
    return best.select("doc_id", "key", "item_id", "n_words", "x.*")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    bad = matches(docs, items).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_key"))
    return rows.join(bad, rows["_id"].eqNullSafe(bad["_id"]) & (rows["_key"] == bad["_key"]), "left_anti").select("row.*")
