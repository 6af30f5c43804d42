"""What a text lacks of a verse is counted before the two are aligned or walked."""

import random

from pyspark.sql import functions as F

from citeweave.operators import align, gapped


def test_pairs_that_lack_more_words_than_edits_are_not_aligned(spark):
    rng = random.Random(5)
    verses = [[f"word{rng.randrange(60)}" for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    texts = [[f"word{rng.randrange(60)}" for _ in range(12)] for _ in range(30)]
    for k in range(0, 60, 2):  # a verse with two edits begins every text
        edited = [w + "x" if i == 1 else w for i, w in enumerate(verses[k])][: max(2, len(verses[k]) - 1)]
        texts[k // 2][: len(edited)] = edited
    cands = spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>")
    corpus = spark.createDataFrame([(i, 1, i, v) for i, v in enumerate(verses)], "v_idx int, chapter int, verse int, tokens array<string>")
    pairs = cands.select("id", F.lit(0).alias("pos")).crossJoin(corpus.select("v_idx"))
    want = {(i, j): r for i, q in enumerate(texts) for j, v in enumerate(verses) if (r := align.word_edits(q[: len(v) + align.VERSE_EDITS], v))}
    got = {(r.id, r.v_idx): (r.errors, r.size) for r in align.aligned(cands, corpus, pairs).collect()}
    assert got == want and len(want) > 30
    assert align.alignable(cands, corpus, pairs).count() < len(texts) * len(verses) / 2


def test_verses_that_lack_a_word_are_not_walked(spark):
    tokens = ["a", "b", "c", "d"]
    cands = spark.createDataFrame([(1, tokens, None)], "id long, tokens array<string>, hint_chapter int")
    verses = [["a", "b", "x", "c", "d"], ["a", "b", "y", "z", "d"], ["a", "x", "y", "z", "d"]]
    corpus = spark.createDataFrame([(i, 1, i, v, None) for i, v in enumerate(verses)], "v_idx int, chapter int, verse int, tokens array<string>, alias string")
    met = lambda probes: {r.v_idx for r in gapped._verses(cands, corpus, probes).collect()}
    assert met(1) == {0} and met(2) == {0, 1}
