import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from citeweave.llm import variants as V


def _words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _grouped(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and _near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(None).cast("int"))


def _invented(seed, most=220):
    r = random.Random(seed)
    stems = ["".join(r.choices("abcdéß", k=r.randint(6, 9))) for _ in range(30)]
    rows = []
    for i in range(200):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            if r.random() < 0.25:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", r.choice("abcdé"), w[k] + r.choice("abz")]) + w[k + 1 :]
            words.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        rows.append((i, " ".join(words)))
    return rows


def test_equals_brute_force(spark):
    rows = _invented(1)
    n = _words(rows)
    got = _got(V.spelling_variants(_docs(spark, rows)))
    assert got == _grouped(n) and any(r[1] for r in got)


def test_large_blocks_are_cut_in_tiles(spark, monkeypatch):
    rows = _invented(2)
    monkeypatch.setattr(V, "TILE", 5)
    assert _got(V.spelling_variants(_docs(spark, rows))) == _grouped(_words(rows))


def test_chains_of_forms_end_at_the_root(spark):
    n = {"abcdefg": 1000, "abcdefx": 100, "abcdeyx": 10, "abczeyx": 1, "zzzzzzzz": 3}
    found = spark.createDataFrame(list(n.items()), "word string, n long")
    assert _got(V.grouped(found)) == _grouped(n)
    assert {r.word: r.root for r in V.grouped(found).collect()}["abczeyx"] == "abcdefg"


def test_ties_go_to_the_smallest_word(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 40, "aaaaaac": 40, "éaaaaaa": 40}
    assert {r.word: r.form for r in V.grouped(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}["aaaaaaa"] == "aaaaaab"


def test_long_words_nulls_and_empties(spark):
    long = "ab" * 15_000
    rows = [(1, f"{long} {long}x {long} {long}x"), (None, f"{long[:-1]}a zzzzzzzz zzzzzzz ÀÉÎõü÷×ÿ"), (2, f"{long[:-1]}a zzzzzzzz ÀÉÎõü÷×ÿ"), (3, None), (4, ""), (1, "zzzzzzz zzzzzzz"), (1, "zzzzzzz zzzzzzz")]
    assert _got(V.spelling_variants(_docs(spark, rows))) == _grouped(_words(rows))
    assert V.spelling_variants(_docs(spark, rows).limit(0)).count() == 0
