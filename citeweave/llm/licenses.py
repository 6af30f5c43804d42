"""Operator 2, license scans by diagonal voting.

Texts and license templates are sequences of words. All rolling word k-grams of a text are hashed and joined with the
positions of equal k-grams in the templates. A hit at text word p and template word q votes for the diagonal p - q: a
template that stands in a text unchanged puts all its votes on one diagonal, and words added or lost in between shift
the votes to neighbouring ones. Votes are summed per diagonal; one with all of the template is a place as it stands, the
other neighbouring diagonals are merged, and the merged span is
verified: its k-grams are compared as text with the template's, and enough of the template has to be covered.

The templates are a fixed list, so their k-grams are broadcast; a k-gram of a text that no template has is dropped in
the task that hashed it, before the join. Short phrases need all of their votes on one diagonal.

Nulls: a null text counts as empty and has no words; a null doc_id stays. Repeated rows get a result each. An empty
table gives no rows. Columns of the input beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, Texts, counts, gram_hash, prefix_hash, slices, span_hash

# Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Notices of common licenses, as their authors ask to put them.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
]

#: Words of a k-gram for phrases and for notices, the share of a notice's words to be found, how far diagonals are merged.
K_PHRASE, K_NOTICE, COVER, SHIFT = 2, 3, 0.75, 3


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def templates() -> list[tuple[int, bool, str, int, list[str]]]:
    """(number, whether a phrase, label, k, words)"""
    both = [(True, label, K_PHRASE, split_words(x)) for x, label in PHRASES] + [(False, label, K_NOTICE, split_words(x)) for label, x in NOTICES]
    return [(i, *x) for i, x in enumerate(both)]


def _hashes(words: list[str], k: int) -> np.ndarray:
    t = Texts(pa.array([" ".join(words)]))
    start, end, _ = t.words(ALNUM)
    return gram_hash(span_hash(prefix_hash(t.buf), start, end), k)


def template_grams(spark: SparkSession) -> DataFrame:
    """k-grams of the templates: hash, gram, template, tpos."""
    rows = [(int(h), " ".join(words[q : q + k]), i, q) for i, _, _, k, words in templates() for q, h in enumerate(_hashes(words, k).view(np.int64))]
    return spark.createDataFrame(rows, "hash long, gram string, template int, tpos int")


def _grams(known: dict[int, np.ndarray]):
    """A head row (pos -1) for each text, and a row for each k-gram that a template may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, "_text"):
            t = Texts(part.column(part.schema.get_field_index("_text")), lower=True)
            start, end, doc = t.words(ALNUM)
            word = span_hash(prefix_hash(t.buf), start, end)
            own, pos, hashes, grams = [np.arange(t.n)], [np.full(t.n, -1)], [np.zeros(t.n, np.uint64)], [None] * t.n
            first = np.searchsorted(doc, np.arange(t.n + 1))
            for k, keys in known.items():
                h = gram_hash(word, k)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == h) & (doc[: len(h)] == doc[len(doc) - len(h) :]))
                own.append(doc[hit])
                pos.append(hit - first[doc[hit]])
                hashes.append(h[hit])
                grams += [b" ".join(t.buf[start[i + j] : end[i + j]].tobytes() for j in range(k)).decode(errors="replace") for i in hit.tolist()]
            own = np.concatenate(own)
            ids = part.column(part.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + own), ids.take(pa.array(own)), pa.array(counts(doc, t.n)[own]), pa.array(np.concatenate(pos).astype(np.int64)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(grams, pa.string())],
                names=["row", "doc_id", "n_words", "pos", "hash", "gram"],
            )
            row += t.n

    return run


def votes(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words of each text, with template, diagonal, the template positions hit, and template null where none is."""
    known = {k: np.unique(np.concatenate([_hashes(w, k) for _, _, _, kk, w in templates() if kk == k])) for k in (K_PHRASE, K_NOTICE)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    grams = docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(_grams(known), f"row long, doc_id {kind}, n_words long, pos long, hash long, gram string")
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession)), ["hash", "gram"], "left").filter("pos < 0 or template is not null")
    # one exchange by row serves all that follows; a row's votes are bounded by its text
    return hits.repartition("row").groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("tpos")).alias("hit"))


def spans(docs: DataFrame) -> DataFrame:
    """Verified places of templates: row, doc_id, n_words, template, first and last word, cover. template null: the text has none."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, phrase, label, k, len(w)) for i, phrase, label, k, w in templates()], "template int, phrase boolean, label string, k int, length int")
    seen = votes(docs).join(F.broadcast(known), "template", "left")
    # a diagonal that has all of the template is a place of its own, and no part of a cluster
    seen = seen.withColumn("full", F.coalesce(F.size("hit") == F.col("length") - F.col("k") + 1, F.lit(False)))
    by = Window.partitionBy("row", "template", "full").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(by) <= F.least(F.lit(SHIFT), F.col("length") - 1)
    gap = F.when(F.col("phrase") | F.col("full"), 1).otherwise(F.when(near, 0).otherwise(1))
    merged = seen.withColumn("gap", F.coalesce(gap, F.lit(1))).withColumn("cluster", F.sum("gap").over(by))
    size = F.col("length")
    found = merged.groupBy("row", "template", "full", "cluster").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "n_words", "phrase", "label", "k", "length")),
        F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.min(F.col("diagonal") + F.col("hit")[0]).alias("first"),
        F.max(F.col("diagonal") + F.element_at("hit", -1) + F.col("k") - 1).alias("last"),
    )
    # words of the template under the k-grams that were hit
    covered = F.size(F.array_distinct(F.flatten(F.transform("hit", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    found = found.withColumn("cover", covered / size)
    good = F.when(F.col("phrase"), F.col("cover") == 1).otherwise((F.col("cover") >= COVER) & (F.col("last") - F.col("first") + 1 <= 1.5 * size))
    return found.withColumn("good", F.coalesce(good, F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: what the phrases and the notices say."""
    base, any_ = F.col("good") & F.col("phrase"), F.col("good")
    join = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans(docs).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        join(base).alias("base_labels"),
        join(any_).alias("labels"),
        F.coalesce(F.max(F.when(any_, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.count(F.when(any_ & ~F.col("phrase"), 1)).alias("n_notices"),
    ).drop("row")
