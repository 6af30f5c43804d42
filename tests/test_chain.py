"""Texts read as verses end to end, against a search that tries everything."""

import random

import pytest
from pyspark.sql import functions as F

from citeweave.functions.text import LATIN
from citeweave.operators import align, chain, match
from citeweave.operators import corpus as C
from citeweave.plans import engine
from citeweave.plans.store import kept


def near(a, b):
    longer = max(len(a), len(b))
    if longer < 4 or abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= (2 if longer >= 7 else 1)


def edits(words, verse):
    """The best (edits, words used), by the whole table."""
    cost = list(range(len(words) + 1))
    for v in verse:
        before, cost = cost, [cost[0] + 1]
        for j, w in enumerate(words, 1):
            cost.append(min(before[j - 1] + (0 if w == v else 1 if near(w, v) else 99), before[j] + 1, cost[j - 1] + 1))
    best = min(cost[1:], default=99)
    return (best, max(j for j, c in enumerate(cost) if j and c == best)) if best <= 2 else None


def reading(words, verses, repair, hint=None):
    """The least (edits, breaks, verses, away, steps) of all readings. verses: {(chapter, verse): words}."""
    seen = {}

    def search(pos, last):
        if pos == len(words):
            return (0, 0, 0, 0, ())
        if (pos, last) in seen:
            return seen[pos, last]
        best = None
        for (c, v), w in verses.items():
            follows = last is not None and (c, v - 1) == last
            ways = [(0, len(w))] if words[pos : pos + len(w)] == w else []
            if repair and len(w) > 1 and (e := edits(words[pos : pos + len(w) + 2], w)) and e[0]:
                # two words with two edits and neither left as it is are tried behind the verse before only
                if len(w) > 2 or follows or set(w) & set(words[pos : pos + 4]):
                    ways.append(e)
            n = len(words) - pos
            if follows and n < len(w):
                wrong = sum(0 if a == b else 1 if near(a, b) else 99 for a, b in zip(words[pos:], w))
                if wrong == 0 or repair and n >= 2 and wrong <= 2:
                    ways.append((wrong, n))
            for wrong, used in ways:
                rest = search(pos + used, (c, v))
                if rest is not None:
                    away = 0 if hint is None else int(c != hint)
                    new = (wrong + rest[0], rest[1] + (last is not None and not follows), 1 + rest[2], away + rest[3], ((c, v), *rest[4]))
                    if best is None or new < best:
                        best = new
        seen[pos, last] = best
        return best

    out = search(0, None)
    return out if out and out[0] <= 3 else None


def table(spark, verses):
    return kept(C.from_records(spark.createDataFrame([(c, v, " ".join(w)) for (c, v), w in verses.items()], "sura int, aya int, ayahImlai string"), LATIN), "corpus")


def read(spark, verses, texts, repair, hints=None):
    v = table(spark, verses)
    rows = [(i, " ".join(t), (hints or {}).get(i)) for i, t in enumerate(texts)]
    cands = kept(match.candidates(spark.createDataFrame(rows, "id long, text string, h int"), LATIN, chapter="h"), "cands")
    out = chain.linked(cands, v, kept(match.verse_runs(cands, v), "runs"), kept, repair=repair).collect()
    return {r.id: (r.edits, r.breaks, tuple((s.chapter, s.verse) for s in r.steps)) for r in out}


@pytest.mark.parametrize("repair", [False, True])
def test_equals_the_search_of_everything(spark, repair):
    r = random.Random(7)
    vocabulary = ["bdfg", "kltrs", "mnpqrstb", "zxcvd", "bdfh", "wq", "kltrz", "sdfghjk"]
    verses = {(c, v): [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 6]))] for c in range(1, 6) for v in range(1, 7)}
    texts = []
    for _ in range(90):
        words = []
        for _ in range(r.randint(1, 3)):
            c, v = r.choice(list(verses))
            for k in range(r.randint(1, 3)):
                words += verses.get((c, v + k), [])
        for _ in range(r.randint(0, 3) if repair else 0):
            k, z = r.randrange(len(words)), r.random()
            if len(words) < 2:
                break
            words = words[:k] + ([] if z < 0.4 else [words[k][:-1] + "y"] if z < 0.7 else [words[k], "qqqqq"]) + words[k + 1 :]
        if r.random() < 0.3:
            words = words[: -r.randint(1, 2)]
        texts.append(words or ["bdfg"])
    hints = {i: r.randint(1, 5) for i in range(0, 90, 3)}
    got, n = read(spark, verses, texts, repair, hints), 0
    for i, words in enumerate(texts):
        want = reading(words, verses, repair, hints.get(i))
        assert (i in got) == (want is not None), (words, want, got.get(i))
        if want:
            assert got[i][:2] == want[:2] and len(got[i][2]) == want[2], (words, want, got[i])
            n += want[0] > 0 if repair else want[1] > 0
    assert n >= 10


def test_long_chains_with_edits_and_three_repaired_verses(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("bcdfghklmnpqrst", k=r.randint(4, 8)))
    verses = {(1, v): [word() for _ in range(12)] for v in range(1, 61)}
    cat = lambda a, b: sum((verses[1, v] for v in range(a, b)), [])
    lost = lambda words, k: words[:k] + words[k + 1 :]
    texts = [
        lost(cat(1, 5), 17),  # four verses, 47 words, one lost
        lost(lost(lost(cat(1, 4), 30), 17), 5),  # three verses in a row with a word lost each
        lost(cat(1, 61), 400),  # sixty verses
        lost(cat(1, 4), 3) + cat(20, 22) + lost(cat(40, 42), 13),  # three places, two edits
        lost(lost(lost(lost(cat(1, 5), 40), 30), 17), 5),  # four edits are too many
    ]
    got = read(spark, verses, texts, True)
    assert [(got[i][0], got[i][1], len(got[i][2])) for i in range(4)] == [(1, 0, 4), (3, 0, 3), (1, 0, 60), (2, 2, 7)] and 4 not in got
    v = table(spark, verses)
    cands = match.candidates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string"), LATIN)
    out = {x.id: x for x in engine.resolved(cands, v, engine.Config(profile=LATIN)).collect()}
    assert [out[i].kind for i in range(4)] == ["repaired"] * 4 and out[0].confidence == 98


def test_both_first_words_mistyped_and_a_begun_verse_with_an_error(spark):
    verses = {(1, 1): "kingdom mountain river valley".split(), (1, 2): "desert garden flower meadow stone".split(), (2, 1): "kingdom other words here".split()}
    texts = ["kingdon montain river valley desert garden flower meadow stone".split(), "kingdom mountain river valley desert gardan".split()]
    got = read(spark, verses, texts, True)
    assert got[0] == (2, 0, ((1, 1), (1, 2))) and got[1] == (1, 0, ((1, 1), (1, 2)))


def test_verses_that_all_begin_alike_meet_on_rare_pairs(spark):
    verses = {(1, v): ["and", "then", f"word{v}", f"next{v}"] for v in range(1, 200)}
    v = table(spark, verses)
    cands = match.candidates(spark.createDataFrame([(1, "and then " * 150 + "and then word7 next7")], "id long, text string"), LATIN)
    met = C.places(cands).join(C.rare_keys(v), "key")
    assert met.count() == 1 and [(r.verse, r.pos) for r in match.verse_runs(cands, v).collect()] == [(7, 300)]


def test_empty_tables(spark):
    v = table(spark, {(1, 1): ["one", "two"]})
    none = match.candidates(spark.createDataFrame([], "id long, text string"), LATIN)
    assert chain.linked(none, v, match.verse_runs(none, v), kept, repair=True).count() == 0
    some = match.candidates(spark.createDataFrame([(1, "x y")], "id long, text string"), LATIN)
    assert chain.linked(some, v.limit(0), match.verse_runs(some, v.limit(0)), kept, repair=True).count() == 0
    assert F.col("x") is not None


def test_alignment_of_batches():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdé", k=r.randint(1, 9))) for _ in range(40)]
    pairs = [([r.choice(vocabulary) for _ in range(r.randint(0, 7))], [r.choice(vocabulary) for _ in range(r.randint(1, 5))]) for _ in range(300)]
    pairs += [(v[: r.randint(0, 4)] + v[r.randint(0, 4) :], v) for _, v in pairs]
    import pyarrow as pa

    got = align.alignments(*(pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1)))
    assert [(int(a), int(b)) if a >= 0 else None for a, b in zip(*got)] == [edits(q, v) for q, v in pairs]
