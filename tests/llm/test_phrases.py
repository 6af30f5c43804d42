import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeweave.llm import phrases as P


def _expected(rows, best=P.BEST):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    taken = Counter()
    for (lang, *w), c in f.items():
        if len(w) == 3 and c >= 10:
            for part in ((lang, *w[:2]), (lang, *w[1:])):
                taken[part] = max(taken[part], c)
    out = []
    for lang in n:
        rows = []
        for (of, *w), a in f.items():
            if of == lang and len(w) > 1 and a >= 10 and not (taken[(lang, *w)] and 100 * taken[(lang, *w)] >= 50 * a):
                cuts = []
                for k in range(1, len(w)):
                    left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
                    cuts.append((1_000_000 * a * a // (left * right), k, left, right))
                score, _, left, right = min(cuts)
                rows.append((score, a, " ".join(w), left, right))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(rows[:best])]
    return sorted(out)


def _got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def _invented(seed, docs=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß", "The"]
    rows = []
    for _ in range(docs):
        words = []
        while len(words) < 120:
            words += r.choice([["new", "york"], ["new", "york", "city"], ["of", "the"], [r.choice(vocabulary)], [r.choice(vocabulary[:5])], ["a" + r.choice([".", ",", "!", "\n", "\t", ""])]])
        rows.append((r.choice(["en", "de", None]), r.choice([" ", "\t", "  "]).join(words)))
    return rows


def _docs(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumn("a", F.lit("clash")).withColumn("n", F.lit(1))


def test_equals_brute_force(spark):
    rows = _invented(1)
    got = _got(P.collocations(_docs(spark, rows)))
    assert got == _expected(rows) and len(got) > 50


def test_words_and_pairs_beyond_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(P, "_ranked", lambda found, *columns, real=P._ranked: [x[:6] for x in real(found, *columns)])
    rows = _invented(2)
    assert _got(P.collocations(_docs(spark, rows), best=40)) == _expected(rows, 40)


def test_dense_tiles_and_lists_that_are_sent_early(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    left, right = r.integers(0, 300, 40_000), r.integers(0, 300, 40_000)
    tiles = P._Tiles()
    for i in range(0, 40_000, 10_000):
        tiles.add(left[i : i + 10_000], right[i : i + 10_000])
    assert tiles.dense
    a, b, c = tiles.taken()
    got = Counter()
    for x, y, k in zip(a.tolist(), b.tolist(), c.tolist()):
        got[x, y] += k
    assert got == Counter(zip(left.tolist(), right.tolist()))
    monkeypatch.setattr(P, "HELD", 50)
    monkeypatch.setattr(P, "SLICE", 2000)
    rows = _invented(3)
    assert _got(P.collocations(_docs(spark, rows))) == _expected(rows)


def test_words_are_compared_with_their_bytes_and_language():
    part = P.pa.RecordBatch.from_pydict({"lang": ["a", "a", "b"], "text": ["xx yy xx", "xx x", "xx"]})
    t = P._Tokens(part, 1)
    assert P._same_words(t, P.np.zeros(6, P.np.int64), part.column("lang")).tolist() == [True, False, True, True, False, False]


def test_shared_hashes_are_counted_anew(spark, monkeypatch):
    real, seeds = P.word_counts, []

    def counted(texts, seed):
        seeds.append(seed)
        return real(texts, seed).withColumn("clash", F.lit(seed < 3))

    monkeypatch.setattr(P, "word_counts", counted)
    rows = _invented(4, 9)
    assert _got(P.collocations(_docs(spark, rows))) == _expected(rows) and seeds == [1, 2, 3]
    monkeypatch.setattr(P, "word_counts", lambda texts, seed: real(texts, seed).withColumn("clash", F.lit(True)))
    with pytest.raises(ValueError, match="hashes"):
        P.collocations(_docs(spark, rows))


def test_nulls_empties_ties_and_long_texts(spark):
    rows = [(None, None), ("", ""), ("en", " \t "), ("en", ".,;"), ("en", "x y z " * 30_000), ("en", "long" * 5000 + " word. "), ("und", "p q\n" * 12), (None, "p q r. " * 12), ("x", "b b b b b b b b b b b b")]
    assert _got(P.collocations(_docs(spark, rows))) == _expected(rows)
    assert P.collocations(_docs(spark, rows).limit(0)).count() == 0
