"""Texts read as verses from end to end: a search that joins a stored frontier with verses until it is empty.

A state says that a text is read up to a word and which verse came last, with the fewest edits and changes of place that
lead there. Each round joins the states found in the round before with verses: whole runs of verses as they stand, the
next verse with edits, any verse with edits, the next verse as far as the text goes. Only states better than all known
ones of their place are kept, as a table, for the next round. Verses that stand one behind another are one step, so the
rounds are as many as the breaks and edits of a text, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T

from .align import VERSE_EDITS, aligned
from .corpus import places, third_keys

#: Edits of a whole text, confidences of a verse with edits (less for each, but at least), completed, and begun with a typing error.
RUN_EDITS, REPAIRED, PER_EDIT, LEAST_REPAIRED, UNIQUE, COMPLETED, BEGUN_TYPO = 3, 95, 4, 85, 100, 95, 85

STEPS = "array<struct<chapter:int,verse:int,confidence:int,begun:boolean>>"
_PATH = "array<struct<chapter:int,verse:int,end_verse:int,errors:int,begun:boolean>>"
_KEY = ["id", "pos", "chapter", "verse"]
_TEXT = ["n", "hint_chapter"]


def stretches(runs: DataFrame, corpus: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verses that stand in texts (runs: id, pos, chapter, verse, size) as islands of neighbours: where one may be entered, and left.

    Entered at each verse: id, pos, chapter, verse, origin, island. Left (origin, island, end_verse, end, n_verses from the
    island's first) at its last verse, at the text's end, and where another verse begins as well."""
    before = Window.partitionBy("chapter").orderBy("verse").rowsBetween(Window.unboundedPreceding, -1)
    shift = corpus.select("v_idx", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)).alias("words_before"))
    own = Window.partitionBy("id", "chapter", "origin").orderBy("verse")
    r = runs.join(shift, "v_idx").withColumn("origin", F.col("pos") - F.col("words_before")).withColumn("island", F.col("verse") - F.row_number().over(own)).withColumn("end", F.col("pos") + F.col("size"))
    r = r.withColumn("last", F.col("verse") == F.max("verse").over(Window.partitionBy("id", "chapter", "origin", "island")))
    crowd = runs.groupBy("id", F.col("pos").alias("end")).agg(F.count("*").alias("others"))
    entered = r.select("id", "pos", "chapter", "verse", "origin", "island")
    left = r.join(crowd, ["id", "end"], "left").join(cands.select("id", F.size("tokens").alias("n")), "id").filter("last or end = n or others > 1")
    return entered, left.select("id", "chapter", "origin", "island", F.col("verse").alias("end_verse"), "end")


def meetings(cands: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, v_idx, at: about where a verse with two edits at most may begin in a text, by its keys that stand there."""
    keys = third_keys(corpus)
    return places(cands, "tokens").join(keys, "key").select("id", "v_idx", (F.col("pos") - F.col("offset")).alias("at")).distinct()


def _cost(edits, breaks, verses, away, step) -> F.Column:
    """What is compared: edits, breaks, number of verses, verses outside the hinted chapter, then the steps themselves."""
    old = F.col("cost")
    return F.struct((old["edits"] + edits).cast("int").alias("edits"), (old["breaks"] + breaks).cast("int").alias("breaks"), (old["verses"] + verses).cast("int").alias("verses"), (old["away"] + away).cast("int").alias("away"), F.concat(old["path"], F.array(step)).cast(_PATH).alias("path"))


def _step(chapter, verse, end_verse, errors, begun) -> F.Column:
    return F.struct(chapter.cast("int").alias("chapter"), verse.cast("int").alias("verse"), end_verse.cast("int").alias("end_verse"), errors.cast("int").alias("errors"), F.lit(begun).alias("begun"))


def _extended(front: DataFrame, cands: DataFrame, corpus: DataFrame, entered: DataFrame, left: DataFrame, met: DataFrame | None) -> DataFrame:
    """All states that follow from those of the frontier by one step; n and hint_chapter of the text go along."""
    front = front.filter("pos < n")
    away = lambda c, k: F.when(c == F.col("hint_chapter"), 0).otherwise(F.when(F.col("hint_chapter").isNull(), 0).otherwise(k))
    next_verses = corpus.select("v_idx", F.col("chapter").alias("chapter"), (F.col("verse") - 1).alias("verse"), F.col("tokens").alias("next"))
    # a step to a verse elsewhere doesn't ask what came before, so the best state of a place speaks for all
    best = front.withColumn("place", F.row_number().over(Window.partitionBy("id", "pos").orderBy("cost"))).filter("place = 1").drop("place")
    e = entered.withColumnsRenamed({"chapter": "to_chapter", "verse": "from"})
    follows = F.coalesce((F.col("to_chapter") == F.col("chapter")) & (F.col("from") == F.col("verse") + 1), F.lit(False))
    elsewhere = F.when(F.col("chapter").isNull(), 0).otherwise(1)
    slim = ["id", *_TEXT, "cost", "to_chapter", "from", "origin", "island"]
    anywhere = best.join(e, ["id", "pos"]).filter(~follows).select(*slim, elsewhere.alias("breaks"))
    # behind a verse with edits, the next one as it stands is no break
    mended = F.element_at("cost.path", -1)["errors"] > 0
    behind = front.filter((F.size("cost.path") > 0) & mended).join(e, ["id", "pos"]).filter(follows).select(*slim, F.lit(0).alias("breaks"))
    runs = anywhere.union(behind).withColumnRenamed("to_chapter", "chapter").join(left, ["id", "chapter", "origin", "island"]).filter(F.col("end_verse") >= F.col("from"))
    many = F.col("end_verse") - F.col("from") + 1
    out = [runs.select("id", *_TEXT, F.col("end").alias("pos"), "chapter", F.col("end_verse").alias("verse"), _cost(F.lit(0), F.col("breaks"), many, away(F.col("chapter"), many), _step(F.col("chapter"), F.col("from"), F.col("end_verse"), F.lit(0), False)).alias("cost"))]
    # the next verse, of which the text has only the beginning
    words = cands.select("id", "tokens")
    rest = F.expr("slice(tokens, pos + 1, n)")
    ends = front.filter("chapter is not null").join(next_verses, ["chapter", "verse"]).filter(F.size("next") > F.col("n") - F.col("pos")).join(words, "id")
    wrong = F.when(rest == F.expr("slice(next, 1, n - pos)"), 0)
    if met is not None:
        near = F.aggregate(F.zip_with(rest, F.expr("slice(next, 1, n - pos)"), lambda a, b: F.when(a == b, 0).when(T.near_token(a, b), 1).otherwise(99)), F.lit(0), lambda s, k: s + k)
        wrong = wrong.when((F.col("n") - F.col("pos") >= 2), near)
    ends = ends.withColumn("errors", wrong).filter((F.col("errors") <= VERSE_EDITS) & (F.col("errors") + F.col("cost.edits") <= RUN_EDITS))
    out.append(ends.select("id", *_TEXT, F.col("n").alias("pos"), "chapter", (F.col("verse") + 1).alias("verse"), _cost(F.col("errors"), F.lit(0), F.lit(1), away(F.col("chapter"), 1), _step(F.col("chapter"), F.col("verse") + 1, F.col("verse") + 1, F.col("errors"), True)).alias("cost")))
    if met is not None:
        # verses with edits: the next one, and those that have a key near by
        open_ = front.filter(F.col("cost.edits") < RUN_EDITS)
        pairs = open_.join(met, "id").filter(F.abs(F.col("pos") - F.col("at")) <= VERSE_EDITS).select("id", "pos", "v_idx")
        nexts = open_.filter("chapter is not null").join(next_verses, ["chapter", "verse"]).select("id", "pos", "v_idx")
        found = aligned(cands, corpus, pairs.union(nexts).distinct()).filter("errors > 0").withColumnsRenamed({"chapter": "to_chapter", "verse": "from"})
        both = open_.join(found, ["id", "pos"]).filter(F.col("cost.edits") + F.col("errors") <= RUN_EDITS).withColumn("follows", follows)
        first = F.row_number().over(Window.partitionBy("id", "pos", "v_idx", "follows").orderBy("cost"))
        both = both.withColumn("first", first).filter("follows or first = 1")
        cost = _cost(F.col("errors"), F.when(F.col("follows"), 0).otherwise(elsewhere), F.lit(1), away(F.col("to_chapter"), 1), _step(F.col("to_chapter"), F.col("from"), F.col("from"), F.col("errors"), False))
        out.append(both.select("id", *_TEXT, (F.col("pos") + F.col("size")).alias("pos"), F.col("to_chapter").alias("chapter"), F.col("from").alias("verse"), cost.alias("cost")))
    kinds = lambda df: df.select("id", *_TEXT, F.col("pos").cast("int").alias("pos"), F.col("chapter").cast("int").alias("chapter"), F.col("verse").cast("int").alias("verse"), "cost")
    return reduce(DataFrame.union, [kinds(df) for df in out])


def linked(cands: DataFrame, corpus: DataFrame, runs: DataFrame, keep: Callable[[DataFrame, str], DataFrame], repair: bool = False, correct: bool = True, met: DataFrame | None = None) -> DataFrame:
    """Candidates that are verses from end to end, of one chapter or several: id, steps, confidence, completed.

    runs: verses as they stand (`match.verse_runs`). With repair, verses may have two edits each and three in all: words
    lost, added or mistyped. The reading of fewest edits, then breaks, then verses, then verses outside the hinted chapter
    is taken, then the first in the corpus. A last verse that is only begun is completed (confidence 95), or given as far
    as it goes where the candidate ends in dots; a completed one counts only with `correct`. keep: stores a table. met: stored
    `meetings` of these candidates and others, if there are any.
    """
    met = (keep(meetings(cands, corpus), "meetings") if met is None else met) if repair else None
    entered, left = (keep(df, "stretches") for df in stretches(runs, corpus, cands))
    nothing = F.struct(*(F.lit(0).alias(c) for c in ("edits", "breaks", "verses", "away")), F.array().cast(_PATH).alias("path"))
    front = cands.select("id", F.size("tokens").alias("n"), "hint_chapter", F.lit(0).alias("pos"), F.lit(None).cast("int").alias("chapter"), F.lit(None).cast("int").alias("verse"), nothing.alias("cost"))
    found: list[DataFrame] = []
    ended = F.when(F.col("pos") == F.col("n"), F.struct("cost.edits", "cost.breaks"))
    open_ = True
    while open_:
        new = _extended(front, cands, corpus, entered, left, met).groupBy(*_KEY).agg(*(F.first(c).alias(c) for c in _TEXT), F.min("cost").alias("cost"))
        new = new.withColumn("done", F.min(ended).over(Window.partitionBy("id")))
        if found:
            old = reduce(DataFrame.union, found)
            known = old.groupBy(*_KEY).agg(F.min("cost").alias("known"))
            done = old.groupBy("id").agg(F.min(ended).alias("done_before"))
            new = new.join(known, _KEY, "left").filter("known is null or cost < known").join(done, "id", "left").withColumn("done", F.least("done", "done_before"))
        # what is dearer than a reading of the whole text can't become a better one
        new = new.filter(F.col("done").isNull() | (F.struct("cost.edits", "cost.breaks") <= F.col("done")))
        front = keep(new.select("id", *_TEXT, "pos", "chapter", "verse", "cost"), "frontier")
        found.append(front)
        open_ = not front.filter("pos < n").isEmpty()
    return _readings(reduce(DataFrame.union, found).filter("pos = n"), cands, correct)


def _readings(ends: DataFrame, cands: DataFrame, correct: bool) -> DataFrame:
    """The best end of each candidate as steps, one for each verse."""
    best = ends.groupBy("id").agg(F.min("cost").alias("cost")).join(cands.select("id", F.col("raw").rlike(r"\.{2,}|…").alias("dots")), "id")
    out = best.withColumn("completed", F.exists("cost.path", lambda s: s["begun"]) & ~F.col("dots"))
    one = lambda s: F.when(s["begun"] & (s["errors"] > 0), BEGUN_TYPO).when(s["begun"], F.when(F.col("completed"), COMPLETED).otherwise(UNIQUE)).when(s["errors"] == 0, UNIQUE).otherwise(F.greatest(F.lit(LEAST_REPAIRED), REPAIRED - PER_EDIT * s["errors"]))
    each = lambda s: F.transform(F.sequence(s["verse"], s["end_verse"]), lambda v: F.struct(s["chapter"].alias("chapter"), v.alias("verse"), one(s).cast("int").alias("confidence"), s["begun"].alias("begun")))
    out = out.withColumn("steps", F.flatten(F.transform("cost.path", each)).cast(STEPS))
    out = out.withColumn("confidence", T.rounded(F.aggregate("steps", F.lit(0), lambda x, s: x + s["confidence"]) / F.size("steps")))
    out = out.select("id", "steps", "confidence", "completed", F.col("cost.edits").alias("edits"), F.col("cost.breaks").alias("breaks"))
    return out if correct else out.filter("not completed")
