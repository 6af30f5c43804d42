"""Texts and words that are nearly the same, found by keys that near pairs must share: no pool is compared as a whole.

Windows of verses meet a text on the rare words that a window of enough likeness can't do without (a prefix filter), and
are scored only where lengths and shared words leave it possible. Words meet on what is left of them without a letter or
two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T

from .align import LONG, NEAR_LETTERS
from .corpus import canonical_frequency, positions, ranked_candidates

#: Least score of a window, verses that are looked at for a text, how much lengths may differ, what two letters' distance adds.
FUZZY, FUZZY_POOL, LENGTHS, CLOSE, BONUS = 85, 300, 0.4, 2, 10


def least_shared(size: Column, least: float) -> Column:
    """How many of a text's distinct words a window of that score shares: half the score is the Jaccard similarity, and
    the bonus needs a distance of two letters, which touches two words at most."""
    plain, close = 2 * least / 100 - 1, 2 * (least - BONUS) / 100 - 1
    return F.greatest(F.lit(1), F.least(F.ceil(size * plain - 1e-9), F.greatest(F.ceil(size * close - 1e-9), size - CLOSE)))


def windows(cands: DataFrame, corpus: DataFrame, least: float = FUZZY) -> DataFrame:
    """The windows (id, v_idx, start) of as many words as the text, that could reach the score: each holds one of the
    text's rarest words, as many of which are tried as a window of that score can't all lack."""
    some = cands.filter(F.size("tokens") >= 2).select("id", F.size("tokens").alias("n"), F.array_distinct("tokens").alias("set"))
    at = positions(corpus)
    df = canonical_frequency(corpus)
    words = some.select("id", "n", F.size("set").alias("size"), F.explode("set").alias("token")).join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    probes = words.withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - least_shared(F.col("size"), least) + 1).filter("df > 0").select("id", "n", "token")
    met = probes.join(at.select("token", "v_idx", "pos"), "token").join(corpus.select("v_idx", F.size("tokens").alias("long")), "v_idx").filter("long >= n")
    return met.select("id", "v_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("n") + 1), F.least("pos", F.col("long") - F.col("n")))).alias("start")).distinct()


def scored_windows(cands: DataFrame, corpus: DataFrame, least: float = FUZZY) -> DataFrame:
    """All windows of the score: id, v_idx, chapter, verse, start, size, score, hint_chapter. Distances are taken only where a bound allows the score."""
    texts = cands.select("id", F.col("norm").alias("q"), F.array_distinct("tokens").alias("set"), F.size("tokens").alias("n"), "hint_chapter")
    spot = windows(cands, corpus, least).join(corpus.select("v_idx", "chapter", "verse", "tokens"), "v_idx").join(texts, "id")
    # a hinted chapter is all that is looked at
    spot = spot.filter(F.col("hint_chapter").isNull() | (F.col("hint_chapter") == F.col("chapter")))
    spot = spot.select("id", "v_idx", "chapter", "verse", "start", "n", "q", "set", "hint_chapter", F.expr("slice(tokens, start + 1, n)").alias("words")).withColumn("w", F.array_join("words", " "))
    longer, apart = F.greatest(F.length("w"), F.length("q")), F.abs(F.length("w") - F.length("q"))
    shared = F.size(F.array_intersect("set", "words"))
    jaccard = shared / (F.size("set") + F.size(F.array_distinct("words")) - shared)
    bound = 100 * (0.5 * jaccard + 0.5 * (1 - apart / longer)) + F.when(apart <= CLOSE, BONUS).otherwise(0)
    spot = spot.filter((apart <= LENGTHS * longer) & (bound >= least - 1e-9))
    score = 100 * T.similarity(F.col("q"), F.col("w")) + F.when(T.edit_distance(F.col("q"), F.col("w"), CLOSE) <= CLOSE, BONUS).otherwise(0)
    return spot.withColumn("score", T.clamp(score, 0, 100)).filter(F.col("score") >= least).select("id", "v_idx", "chapter", "verse", "start", F.col("n").alias("size"), "score", "hint_chapter")


def fuzzy(cands: DataFrame, corpus: DataFrame, least: float = FUZZY, pool: int = FUZZY_POOL) -> DataFrame:
    """The most alike window of as many words in a verse, from `least` on: id, v_idx, chapter, verse, start, size, score, confidence.

    Verses of the hinted chapter count, or else the `pool` that share the most of the text's rarest words; the pool is
    ranked only for texts that have a window at all.
    """
    scored = scored_windows(cands, corpus, least)
    free = scored.filter("hint_chapter is null")
    texts = cands.select("id", "tokens").join(free.select("id").distinct(), "id", "left_semi")
    ranked = ranked_candidates(texts, corpus, pool).select("id", "v_idx")
    found = scored.filter("hint_chapter is not null").unionByName(free.join(ranked, ["id", "v_idx"], "left_semi"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "v_idx", "start")
    return found.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place", "hint_chapter").withColumn("confidence", T.rounded(F.col("score")))


# --- words ------------------------------------------------------------------------------------


def deletions(words: DataFrame, word: str = "word") -> DataFrame:
    """The columns of words and `rest`: the word itself, without one letter, and from LONG letters on without two."""
    one = F.expr(f"transform(sequence(1, length({word})), i -> substring({word}, 1, i - 1) || substring({word}, i + 1))")
    two = F.flatten(F.transform(one, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
    rest = F.concat(F.array(word), one, F.when(F.length(word) >= LONG, two).otherwise(F.array().cast("array<string>")))
    return words.select("*", F.explode(F.array_distinct(rest)).alias("rest"))


def near_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, near) for every word (word) and every other known word (word) a typing error apart, by `functions.text.near_token`.

    Two words at distance one share a string that is left without a letter of each; at distance two, without two. So
    words meet in an equi-join on what is left, and the distance is taken only there. Null and short words have none."""
    some = lambda df: df.filter(F.length("word") >= NEAR_LETTERS - 1).select("word").distinct()
    index = deletions(some(known)).select(F.col("word").alias("near"), "rest")
    met = deletions(some(words)).join(index, "rest").select("word", "near").filter("word <> near").distinct()
    return met.filter(T.near_token(F.col("word"), F.col("near")))
