"""Words of a text that stand in a verse in order, with gaps, and texts that lack or mistake one word between two such runs.

A run goes from a place of its first word to the leftmost next place of each word behind it. All prefixes of a run come
from one walk over the verse, and the run behind a lost word is walked only where its first word stands two places on, so
no split of a text is searched for apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T

from .corpus import document_frequency, postings

#: Fixed value: how alike a mistaken word and the verse's have to be.
WORD_ALIKE = 0.5


def _walk(verse: Column, words: Column, first: Column) -> Column:
    """Places of words in the verse: the first at `first`, each other one leftmost behind the one before; as far as they go."""
    tail = F.slice(verse, first + 1, F.size(verse))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = F.aggregate(tail, zero, lambda s, w: F.struct((s["at"] + 1).alias("at"), F.when(F.get(words, F.size(s["found"])) == w, F.concat(s["found"], F.array(first + s["at"]))).otherwise(s["found"]).alias("found")))
    return step["found"]


def _verses(cands: DataFrame, corpus: DataFrame, probes: int) -> DataFrame:
    """Texts with verses that hold their first word and all their distinct words, or all but one with two `probes`: id, v_idx,
    q, v, first. They meet on the `probes` rarest words."""
    df = document_frequency(corpus)
    some = cands.filter(F.size("tokens") >= 1).select("id", F.col("tokens").alias("q"), "hint_chapter")
    words = some.select("id", F.explode(F.array_distinct("q")).alias("token")).join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = words.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))).filter(F.col("rank") <= probes).filter("df > 0").select("id", "token")
    met = rare.join(postings(corpus).select("token", "v_idx"), "token").select("id", "v_idx").distinct()
    rows = met.join(some, "id").join(corpus.select("v_idx", "chapter", "verse", F.col("tokens").alias("v")), "v_idx")
    rows = rows.filter(F.col("hint_chapter").isNull() | (F.col("hint_chapter") == F.col("chapter")))
    rows = rows.filter(F.size(F.array_except("q", "v")) < probes)  # before any verse is walked
    starts = F.filter(F.transform("v", lambda w, i: F.when(w == F.col("q")[0], i)), lambda i: i.isNotNull())
    return rows.withColumn("first", F.explode(starts))


def sequences(cands: DataFrame, corpus: DataFrame, backward: bool = False) -> DataFrame:
    """Every run of a candidate's words in a verse, gaps allowed: id, v_idx, chapter, verse, first, last, coverage.

    Each place of the first word begins a run, if all other words follow. Forward, a word of the verse must follow the
    run; backward, one must go before it. A hinted chapter is the only one looked at. coverage: words by the run's length."""
    rows = _verses(cands, corpus, 1).withColumn("at", _walk(F.col("v"), F.col("q"), F.col("first"))).filter(F.size("at") == F.size("q"))
    rows = rows.withColumn("last", F.element_at("at", -1)).filter(F.col("first") > 0 if backward else F.col("last") + 1 < F.size("v"))
    return rows.select("id", "v_idx", "chapter", "verse", "first", "last", (F.size("q") / (F.col("last") - F.col("first") + 1)).alias("coverage"))


def one_word_between(cands: DataFrame, corpus: DataFrame, mistaken: bool = False) -> DataFrame:
    """Candidates in two runs with exactly one word of the verse between: id, v_idx, chapter, verse, start, size (words of the
    verse from first to last), at (words before the gap), word (the verse's), score (mean coverage of the runs).

    A word is lost there, or with `mistaken` the candidate has another one, half alike at least. Of all splits of a
    candidate the first that is found counts, of its places the one of the best score, then the first in the corpus."""
    n, skip = F.size("q"), 1 if mistaken else 0
    rows = _verses(cands.filter(F.size("tokens") >= 2 + skip), corpus, 1 + skip).withColumn("left", _walk(F.col("v"), F.col("q"), F.col("first")))
    most = F.least(F.size("left"), n - 1 - skip)
    spot = rows.filter(most >= 1).withColumn("at", F.explode(F.sequence(F.lit(1), most))).withColumn("on", F.expr("left[at - 1] + 2"))
    spot = spot.filter(F.expr(f"get(v, on) = q[at + {skip}]")).withColumn("rest", F.expr(f"slice(q, at + 1 + {skip}, size(q))"))
    spot = spot.withColumn("right", _walk(F.col("v"), F.col("rest"), F.col("on"))).filter(F.size("right") == F.size("rest"))
    last = F.element_at("right", -1)
    score = (F.col("at") / (F.col("on") - 1 - F.col("first")) + F.size("rest") / (last - F.col("on") + 1)) / 2
    spot = spot.withColumn("score", score).withColumn("word", F.expr("v[on - 1]"))
    best = Window.partitionBy("id", "at").orderBy(F.desc("score"), "v_idx", "first")
    spot = spot.withColumn("place", F.row_number().over(best)).filter("place = 1")
    if mistaken:
        spot = spot.filter(T.edit_ratio(F.expr("q[at]"), F.col("word")) >= WORD_ALIKE)
    split = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return spot.withColumn("place", split).filter("place = 1").select("id", "v_idx", "chapter", "verse", F.col("first").alias("start"), (last - F.col("first") + 1).alias("size"), "at", "word", "score")
