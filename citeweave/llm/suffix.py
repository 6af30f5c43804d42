"""Operator 10, suffix-array dedup: every byte under a string of `width` bytes that starts at two places or more goes.

1. Windows of `width` bytes are put together by the least hash of their 50-byte strings: equal windows have equal least
   hashes, so windows whose least hash stands at one place of the corpus only are unique and are dropped at this
   point. Neighbouring windows with the least hash at the same place make a segment. A segment is known by a hash of its bytes; equal segments (copies)
   are counted, and one of them stands for all.
2. Where different segments meet under one hash, their bytes are cut out of the texts and dealt to shards by that hash.
   A shard's suffix array is refined by Larsson and Sadakane's method in numpy: suffixes are ranked by their first bytes
   and, where ranks tie, by the rank of the suffix that many bytes further on. Common prefixes of neighbours carry over
   from one suffix to the next as in Kasai's algorithm. Neighbours that share `width` bytes are repeats.
3. A hash under which very many bytes meet is split over several shards. Each hands on its sorted windows cut into
   ranges, as many as keep a range's windows within a bound, and for each range the shards' lists are merged by binary
   search. What is compared there are 64-bit hashes of whole windows.
4. Repeats are mapped back to all places of their segments and united per document. Both sides of that join are stored
   tables, so Spark splits it where very many places have one segment.

Nulls: a null text is empty; a null doc_id stays. Repeated rows repeat each other, so their long strings go in each. A
text shorter than `width` keeps all. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, prefix_hash, released, slices, sliding_min, span_hash, stored

WIDTH, SEED_BYTES = 400, 50
#: Bytes of a shard's suffix array, and bytes under one hash from which they are split over shards.
SHARD_BYTES, CROWD_BYTES = 1 << 20, 8 << 20
#: Window bytes of a split hash that are merged in one group: the more bytes meet, the more ranges they are cut into.
BAND_BYTES = 1 << 20
#: Bits of a hash that give way to its place where hashes are compared.
LOW = np.uint64((1 << 32) - 1)


# --- numpy ------------------------------------------------------------------------------------


def suffix_array(buf: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes."""
    n = len(buf)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = buf
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank, known = np.zeros(n + 1, np.int64), 8

    def ranked(spot: np.ndarray, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank suffixes, sorted by keys, that stand at these spots of the order; returns the spots where they tie."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(keys)))
        rank[places] = np.repeat(spot[head] + 1, size)  # the spot of a group's first; 0 is behind the end
        return spot[np.repeat(size > 1, size)]

    bits = int(n + 1).bit_length()
    step = 3 if 3 * bits <= 63 else 2  # ranks that fit in one number
    spot = ranked(np.arange(n), order, key[order])
    while known < depth and len(spot):
        at = order[spot]
        keys = rank[at]
        for j in range(1, step):
            keys = keys << bits | rank[np.minimum(at + j * known, n)]
        by = np.argsort(keys, kind="stable")
        order[spot] = at[by]
        spot = ranked(spot, at[by], keys[by])
        known *= step
    return order


def common_prefixes(buf: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, the bytes it shares with the one before it in order, exact up to `most`.

    Kasai's carry: if suffix i follows suffix j, and i + 1 follows j + 1, their common prefix is one shorter. So only
    the ends of such runs are compared byte by byte.
    """
    n = len(buf)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    differs = np.ones(n, bool)
    has = before >= 0
    differs[has] = buf[i[has]] != buf[before[has]]
    last = np.ones(n, bool)  # of a run
    last[:-1] = before[1:] != before[:-1] + 1
    stop = np.flatnonzero(differs | last)
    at = stop[np.searchsorted(stop, i)]
    # behind a run that ends without a difference
    open_ = stop[~differs[stop]]
    more = np.zeros(n, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = buf
    a, b, who = open_ + 1, before[open_] + 1, open_
    while len(a):
        live = (a < n) & (b < n) & (more[who] < most)
        a, b, who = a[live], b[live], who[live]
        same = np.ones(len(a), bool)
        for _ in range(8):
            same &= (a < n) & (b < n)
            same[same] = padded[a[same]] == padded[b[same]]
            more[who[same]] += 1
            a, b = a + same, b + same
        a, b, who = a[same], b[same], who[same]
    return np.where(differs[at], at - i, at - i + 1 + more[at]) * has


def repeated(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment, which of its windows are in the segments twice."""
    size = np.array([len(s) for s in segments], np.int64)
    buf = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no byte of UTF-8
    end = np.cumsum(size + 1) - 1
    left = np.repeat(end, size + 1) - np.arange(len(buf))
    order = suffix_array(buf, width)
    shared = np.zeros(len(buf), np.int64)
    shared[:] = common_prefixes(buf, order, width)
    before = np.zeros(len(buf), np.int64)
    before[order[1:]] = order[:-1]
    hit = np.flatnonzero((np.minimum(shared, np.minimum(left, left[before])) >= width) & (np.arange(len(buf)) != order[0]))
    flag = np.zeros(len(buf), bool)
    flag[hit] = True
    flag[before[hit]] = True
    return [flag[e - s : e - s + max(0, s - width + 1)] for e, s in zip(end.tolist(), size.tolist())]


def runs_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    start = np.flatnonzero(step == 1)
    return start, np.flatnonzero(step == -1) - start


# --- tasks ------------------------------------------------------------------------------------


def _segments(width: int, seed_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            t = Texts(part.column(part.schema.get_field_index("_text")))
            n = len(t.buf)
            if n < width:
                continue
            sums = prefix_hash(t.buf)
            i = np.arange(n - seed_bytes + 1)
            h = span_hash(sums, i, i + seed_bytes)
            # the first place of the least hash in each window
            least = (sliding_min((h & ~LOW) | i.astype(np.uint64), width - seed_bytes + 1) & LOW).astype(np.int64)
            valid = np.zeros(len(least) + 1, np.int32)
            long = t.end - t.start >= width
            np.add.at(valid, t.start[long], 1)
            np.add.at(valid, t.end[long] - width + 1, -1)
            valid = np.cumsum(valid)[:-1] > 0
            new = valid.copy()
            new[1:] &= (~valid[:-1]) | (least[1:] != least[:-1])
            new[t.start[long]] = True
            start = np.flatnonzero(new)
            if not len(start):
                continue
            doc = np.searchsorted(t.end, start)
            stop = np.minimum(np.append(start[1:], n), t.end[doc] - width + 1)
            ids = [part.column(part.schema.get_field_index(c)).take(pa.array(doc)) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(start - t.start[doc]), pa.array(stop - start), pa.array(h[least[start]].view(np.int64)), pa.array(span_hash(sums, start, stop + width - 1).view(np.int64))], names=["k1", "k2", "start", "n", "h", "seg"])

    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text, want = part.column(part.schema.get_field_index("text")), part.column(part.schema.get_field_index("want"))
            which = np.repeat(np.arange(len(text)), np.diff(want.offsets.to_numpy()))
            x = want.flatten()
            start, n = x.field("start").to_numpy(), x.field("n").to_numpy()
            data = text.cast(pa.binary()).to_pylist()
            for a in range(0, len(which), 4096):
                rows = slice(a, a + 4096)
                cut = [data[w][s : s + k + width - 1] for w, s, k in zip(which[rows].tolist(), start[rows].tolist(), n[rows].tolist())]
                y = x.slice(a, 4096)
                yield pa.RecordBatch.from_arrays([*(y.field(c) for c in ("h", "sub", "bands", "seg", "n")), pa.array(cut, pa.binary())], names=["h", "sub", "bands", "seg", "n", "bytes"])

    return run


_FOUND = "h long, seg long, n long, off long, len long, band int, hashes array<long>, segs array<long>, ns array<long>, offs array<long>"
_FOUND_TYPES = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int64())] * 4


def _shard(width: int, shard_bytes: int):
    """Rows come sorted by (h, sub). Repeats as (h, seg, n, off, len); for a split h also its sorted windows by band."""

    def search(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        flags = repeated([r[5] for r in rows], width)
        for (h, _, _, seg, n, _), flag in zip(rows, flags):
            for off, size in zip(*(x.tolist() for x in runs_of(flag))):
                out.append((h, seg, n, off, size, None, None, None, None, None))
        split: dict[tuple, list[tuple[tuple, np.ndarray]]] = {}
        for r, flag in zip(rows, flags):
            if r[1] >= 0:
                split.setdefault(r[:3], []).append((r, flag))
        for (h, _, bands), own in split.items():
            at, hashes = [], []
            for j, (r, _) in enumerate(own):
                sums = prefix_hash(np.frombuffer(r[5], np.uint8))
                i = np.arange(r[4])
                hashes.append(span_hash(sums, i, i + width))
                at.append(np.stack([np.full(r[4], j), i], axis=1))
            hashes, at = np.concatenate(hashes), np.concatenate(at)
            by = np.argsort(hashes, kind="stable")
            hashes, at = hashes[by], at[by]
            edges = np.searchsorted(hashes, np.array([(b << 64) // bands for b in range(1, bands)], np.uint64)).tolist()
            segs, ns = np.array([r[3] for r, _ in own], np.int64), np.array([r[4] for r, _ in own], np.int64)
            for band, (a, b) in enumerate(zip([0, *edges], [*edges, len(hashes)])):
                if b > a:
                    j = at[a:b, 0]
                    out.append((h, None, None, None, None, band, hashes[a:b].view(np.int64).tolist(), segs[j].tolist(), ns[j].tolist(), at[a:b, 1].tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _FOUND_TYPES)], names=[x.split()[0] for x in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_bytes and rows and rows[-1][:2] != r[:2]:
                    yield from search(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield from search(rows)
        released()

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sorted lists of one h and band: windows of one shard that a binary search finds in the list of another."""
    lists = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["hashes"]]
    # each list's own windows once, so that what stands twice here stands in two lists
    every = np.sort(np.concatenate([np.unique(x) for x in lists]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for own, r in zip(lists, pdf.itertuples()):
        if len(twice):
            k = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own)
            out.append(pd.DataFrame({"h": r.h, "seg": np.asarray(r.segs)[k], "n": np.asarray(r.ns)[k], "off": np.asarray(r.offs)[k], "len": 1}))
    return pd.concat(out).astype("int64") if out else pd.DataFrame(columns=["h", "seg", "n", "off", "len"], dtype="int64")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each segment, overlapping and touching ones as one; a segment has fewer windows than one is wide."""
    for batch in batches:
        rows = []
        for own in batch.column("runs").to_pylist():
            new = []
            for a, size in sorted((x["off"], x["len"]) for x in own):
                if new and a <= new[-1]["off"] + new[-1]["len"]:
                    new[-1]["len"] = max(new[-1]["len"], a + size - new[-1]["off"])
                else:
                    new.append({"off": a, "len": size})
            rows.append(new)
        kind = pa.list_(pa.struct([("off", pa.int64()), ("len", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("seg"), batch.column("n"), pa.array(rows, kind)], names=["h", "seg", "n", "runs"])


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, text, spans = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "text", "spans"))
            rows = []
            for data, own in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist()):
                data, removed, n, at, kept = data or b"", 0, 0, 0, []
                end = -1
                for a, size in sorted((x["a"], x["size"]) for x in own or []):
                    b = a + size + width - 1
                    if a > end:
                        n += 1
                    if b > end:
                        kept.append(data[at : max(a, at)])
                        removed += b - max(a, at)
                        at = end = b
                kept.append(data[at:])
                rows.append((len(data), removed, n, b"".join(kept)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


# --- Spark ------------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), with two hashes that name a row, its repetitions included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.hash(text).alias("k2"), text.alias("text"))


def removals(docs: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES, crowd_bytes: int = CROWD_BYTES) -> DataFrame:
    """k1, k2 and the runs of repeated windows (a: first start, size: number of starts) of each text that has some."""
    seed = min(SEED_BYTES, width)
    names = keyed(docs).filter(F.octet_length("text") >= width)
    found = stored(names.select("k1", "k2", F.col("text").alias("_text")).mapInArrow(_segments(width, seed), "k1 long, k2 int, start long, n long, h long, seg long"), "segments")
    # stored, so that both sides of the join are exchanges that Spark can split where a hash is hot
    often = stored(found.groupBy("h").count().filter("count > 1").select("h"), "often")
    places = stored(found.join(often, "h"), "places")
    distinct = stored(places.groupBy("h", "seg", "n").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "start")).alias("x")), "distinct")
    meet = distinct.groupBy("h").agg(F.count("*").alias("d"), F.sum(F.col("n") + width - 1).alias("bytes")).filter("d > 1")
    mixed = distinct.join(stored(meet, "meet"), "h")
    sub = F.when(F.col("bytes") <= crowd_bytes, -1).otherwise(F.pmod(F.xxhash64("seg"), F.ceil(F.col("bytes") / crowd_bytes))).cast("int")
    bands = F.ceil(F.col("bytes") / BAND_BYTES).cast("int")
    want = mixed.select("x.*", "h", sub.alias("sub"), bands.alias("bands"), "seg", "n").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "h", "sub", "bands", "seg")).alias("want"))  # bounded by the text
    total = mixed.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    cut = keyed(docs).join(want.hint("shuffle_hash"), ["k1", "k2"]).select("text", "want").mapInArrow(_cut(width), "h long, sub int, bands int, seg long, n long, bytes binary")
    shards = max(1, -(-total // (4 * shard_bytes)))
    dealt = cut.repartition(shards, "h", "sub").sortWithinPartitions("h", "sub", "seg", "n")
    hits = stored(dealt.mapInArrow(_shard(width, shard_bytes), _FOUND), "repeats")
    merged = hits.filter("band is not null").groupBy("h", "band").applyInPandas(_merge, "h long, seg long, n long, off long, len long")
    runs = hits.filter("band is null").select("h", "seg", "n", "off", "len").union(merged)
    # a segment that comes twice is a repeat from end to end
    copies = distinct.filter("c > 1").select("h", "seg", "n", F.lit(0).cast("long").alias("off"), F.col("n").alias("len"))
    runs = runs.union(copies).groupBy("h", "seg", "n").agg(F.collect_set(F.struct("off", "len")).alias("runs"))  # bounded by the segment
    runs = stored(runs.mapInArrow(_joined, "h long, seg long, n long, runs array<struct<off: long, len: long>>"), "runs")
    at = places.join(runs, ["h", "seg", "n"]).select("k1", "k2", "start", F.explode("runs").alias("r")).select("k1", "k2", (F.col("start") + F.col("r.off")).alias("a"), F.col("r.len").alias("size"))
    return at.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "size")).alias("spans"))  # bounded by the text


def without_repeats(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = keyed(docs).join(removals(docs, width, **limits).hint("shuffle_hash"), ["k1", "k2"], "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_kept(width), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
