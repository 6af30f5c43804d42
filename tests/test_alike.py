"""Near words, fuzzy windows and gapped runs against searches that try everything."""

import random

from citeweave.functions.text import LATIN
from citeweave.operators import alike, gapped, match
from citeweave.operators import corpus as C

from test_chain import near


def corpus_of(spark, verses):
    return C.from_records(spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(verses)], "sura int, aya int, ayahImlai string"), LATIN).cache()


def cands_of(spark, texts):
    return match.candidates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), LATIN)


def test_near_words_equal_all_pairs(spark):
    r = random.Random(5)
    words = list({"".join(r.choices("abcé", k=r.randint(1, 9))) for _ in range(250)})
    df = spark.createDataFrame([(w,) for w in words + words[:20]] + [(None,), ("",)], "word string")
    got = {(x.word, x.near) for x in alike.near_words(df, df).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and near(a, b)} and len(got) > 40
    assert alike.near_words(df.limit(0), df).count() == 0


def test_windows_are_few_and_lose_nothing(spark):
    r = random.Random(9)
    common = ["the", "and", "of", "to"]
    verses = [" ".join(r.choice(common) if r.random() < 0.5 else f"word{r.randint(0, 400)}" for _ in range(12)) for _ in range(150)]
    texts = []
    for v in verses[:40]:
        w = v.split()[3:11]
        k = max(range(8), key=lambda i: len(w[i]))
        w[k] = w[k][:-1] + "x"
        texts.append(" ".join(w))
    corpus, cands = corpus_of(spark, verses), cands_of(spark, texts)
    every = len(texts) * sum(len(v.split()) - 8 + 1 for v in verses)
    met = alike.windows(cands, corpus)
    assert met.count() < every / 10
    got = {(x.id, x.v_idx, x.start) for x in alike.scored_windows(cands, corpus).collect()}
    met = {(x.id, x.v_idx, x.start) for x in met.collect()}
    assert got <= met and {(i, i, 3) for i in range(40)} <= got


def walk(verse, words, first):
    at = [first]
    for w in words[1:]:
        nxt = next((p for p in range(at[-1] + 1, len(verse)) if verse[p] == w), None)
        if nxt is None:
            break
        at.append(nxt)
    return at


def test_runs_with_a_word_between_equal_all_splits(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(3, 7))) for _ in range(14)]
    verses = [" ".join(r.choice(vocabulary) for _ in range(r.randint(4, 10))) for _ in range(40)]
    texts = []
    for v in verses:
        w = [x for x in v.split() if r.random() > 0.2]
        if r.random() < 0.5 and len(w) > 3:
            w[r.randrange(1, len(w) - 1)] = r.choice(vocabulary)[:-1] + "q"
        texts.append(" ".join(w) or "abc")
    corpus, cands = corpus_of(spark, verses), cands_of(spark, texts)

    def ratio(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    for mistaken in (False, True):
        want, skip = {}, int(mistaken)
        for i, t in enumerate(texts):
            q = t.split()
            for k in range(1, len(q) - skip):
                best = None
                for v, text in enumerate(verses):
                    w = text.split()
                    for first in (p for p, x in enumerate(w) if x == q[0]):
                        left = walk(w, q[:k], first)
                        on = left[-1] + 2
                        rest = q[k + skip :]
                        if len(left) < k or on >= len(w) or w[on] != rest[0] or len(right := walk(w, rest, on)) < len(rest):
                            continue
                        score = (k / (left[-1] - first + 1) + len(rest) / (right[-1] - on + 1)) / 2
                        if best is None or (-score, v, first) < best[:3]:
                            best = (-score, v, first, right[-1] - first + 1, k, w[on - 1])
                if best and (not mistaken or ratio(q[k], best[5]) >= 0.5):
                    want[i] = best
                    break
        got = {x.id: (x.v_idx, x.start, x["size"], x["at"], x.word) for x in gapped.one_word_between(cands, corpus, mistaken).collect()}
        assert got == {i: (b[1], b[2], b[3], b[4], b[5]) for i, b in want.items()} and len(got) > 5
    for backward in (False, True):
        got = {(x.id, x.v_idx, x["first"], x["last"]) for x in gapped.sequences(cands, corpus, backward).collect()}
        want = set()
        for i, t in enumerate(texts):
            for v, text in enumerate(verses):
                q, w = t.split(), text.split()
                for first in (p for p, x in enumerate(w) if x == q[0]):
                    at = walk(w, q, first)
                    if len(at) == len(q) and (first > 0 if backward else at[-1] + 1 < len(w)):
                        want.add((i, v, first, at[-1]))
        assert got == want and got


def test_a_run_of_the_other_spelling(spark):
    rows = spark.createDataFrame([(1, 1, "one two three four five", "one too three for five"), (1, 2, "six seven eight", None)], "sura int, aya int, ayahImlai string, ayahNotashkil string")
    corpus = C.from_records(rows, LATIN).cache()
    cands = cands_of(spark, ["too three for", "two three", "twe thre", "seven eight", "too seven"])
    got = {r.id: (r.verse, r.start, r.confidence) for r in match.contiguous(cands, corpus).collect()}
    assert got == {0: (1, 1, 100), 1: (1, 1, 100), 2: (1, 1, 97), 3: (2, 1, 100)}
