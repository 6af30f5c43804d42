"""Matching candidates with verses: each strategy is a join, each choice a window.

A candidate is a row (id, norm, tokens, unjoined, skeleton, skeleton_tokens, hint_chapter, hint_verse); see `candidates`. Every
strategy returns hits (id, v_idx, chapter, verse, confidence, ...). Text is compared through equi-joins on a key or a
token, with the exact test as a residual, so no strategy is a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T

from .corpus import exact_keys, pair_frequency, places, postings, rare_keys, third_keys, word_pairs

#: Confidences and limits of the strategies.
UNIQUE, AMBIGUOUS, SKELETON, COMPLETED, TYPO, PARTIAL, PARTIAL_TYPO = 100, 92, 97, 95, 88, 90, 85
REPEATS, NEAR_VERSES, ALTERNATIVES, CHAPTER_BONUS = 60, 3, 8, 6


def recast(df: DataFrame, profile: T.ScriptProfile) -> DataFrame:
    """Candidates (id, tokens, ...) whose words were changed: the columns made of the words, anew."""
    out = df.withColumn("norm", F.array_join("tokens", " ")).withColumn("unjoined", F.col("tokens"))
    return out.withColumn("skeleton", T.skeleton_of(F.col("norm"), profile)).withColumn("skeleton_tokens", F.transform("tokens", lambda t: T.skeleton_of(t, profile)))


def candidates(df: DataFrame, profile: T.ScriptProfile, text: str = "text", ident: str = "id", chapter: str | None = None, verse: str | None = None) -> DataFrame:
    """Candidates from a table of texts; hints of 0 or no number are none."""
    hint = lambda c: F.expr(f"nullif(try_cast(trim(cast(`{c}` as string)) as int), 0)") if c else F.lit(None).cast("int")
    out = df.select(F.col(ident).alias("id"), F.col(text).alias("raw"), T.normalized(F.col(text), profile).alias("norm"), hint(chapter).alias("hint_chapter"), hint(verse).alias("hint_verse"))
    return worded(out, profile)


def worded(df: DataFrame, profile: T.ScriptProfile) -> DataFrame:
    """Candidates (id, raw, norm, ...) with the columns made of raw and norm."""
    out = df.withColumn("tokens", T.tokens_of(F.col("norm"))).withColumn("unjoined", T.tokens(F.col("raw"), profile, False) if profile.prefix_join else F.col("tokens"))
    return out.withColumn("skeleton", T.skeleton_of(F.col("norm"), profile)).withColumn("skeleton_tokens", F.transform("tokens", lambda t: T.skeleton_of(t, profile)))


def picked(hits: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    """One hit a candidate, with occurrences, ambiguous, resolved and up to eight alternatives.

    Hits in the hinted chapter go first and alone, if there are any; of these, one at most three verses from the hinted
    verse; else the first in the corpus. `extra`: keys that go before all others. A hit counts as resolved if a hint
    decided; the verse hint counts in another chapter too.
    """
    own = Window.partitionBy("id")
    near = F.abs(F.col("verse") - F.col("hint_verse"))
    h = hits.withColumn("preferred", F.coalesce(F.col("chapter") == F.col("hint_chapter"), F.lit(False)))
    h = h.withColumn("any_preferred", F.max("preferred").over(own)).withColumn("occurrences", F.count("*").over(own))
    h = h.withColumn("pool", ~F.col("any_preferred") | F.col("preferred"))
    h = h.withColumn("nearest", F.min(F.when(F.col("pool"), near)).over(own)).withColumn("n_pool", F.sum(F.col("pool").cast("int")).over(own))
    close = (F.col("n_pool") > 1) & F.coalesce(F.col("nearest") <= NEAR_VERSES, F.lit(False))
    h = h.withColumn("resolved", F.col("any_preferred") | close).withColumn("distance", F.when(close, near).otherwise(0))
    best = Window.partitionBy("id").orderBy(F.desc("pool"), *extra, "distance", "v_idx")
    h = h.withColumn("alternatives", F.slice(F.array_sort(F.collect_set(F.format_string("%d:%d", "chapter", "verse")).over(own)), 1, ALTERNATIVES))
    return h.withColumn("place", F.row_number().over(best)).filter("place = 1").withColumn("ambiguous", F.col("occurrences") > 1).drop("preferred", "any_preferred", "pool", "nearest", "n_pool", "distance", "place")


def lowered(confidence: Column) -> Column:
    """At most 92 for a repeated verse that no hint decided."""
    return F.when(F.col("ambiguous") & ~F.col("resolved"), F.least(confidence, F.lit(AMBIGUOUS))).otherwise(confidence)


_HINTS = ("hint_chapter", "hint_verse")


def exact(cands: DataFrame, corpus: DataFrame) -> DataFrame:
    """The whole text is a verse."""
    hits = cands.select("id", "norm", *_HINTS).join(exact_keys(corpus), F.col("norm") == F.col("key"))
    return picked(hits).withColumn("confidence", lowered(F.lit(UNIQUE))).withColumn("partial", F.lit(False))


def prefix(cands: DataFrame, corpus: DataFrame) -> DataFrame:
    """The text begins a longer verse."""
    # met on the first two words, or the only one
    head = F.array_join(F.slice("tokens", 1, 2), " ")
    verses = corpus.select("v_idx", "chapter", "verse", F.col("norm").alias("v_norm"), F.explode(F.array_distinct(F.array(F.col("tokens")[0], head))).alias("head"))
    hits = cands.filter(F.size("tokens") > 0).select("id", "norm", *_HINTS, head.alias("head")).join(verses, "head").filter(F.col("v_norm").startswith(F.concat("norm", F.lit(" "))))
    ratio = F.length("norm") / F.length("v_norm")
    score = F.when(ratio >= 0.6, 85).when(ratio >= 0.4, 75).otherwise(70) + F.when(F.col("chapter") == F.col("hint_chapter"), CHAPTER_BONUS).otherwise(0)
    hits = hits.withColumn("score", F.max(score).over(Window.partitionBy("id")))
    return picked(hits).withColumn("confidence", lowered(F.col("score"))).withColumn("partial", F.lit(True))


def by_skeleton(cands: DataFrame, corpus: DataFrame) -> DataFrame:
    """The text is a verse but for weak letters."""
    hits = cands.filter(F.length("skeleton") >= 4).select("id", "skeleton", *_HINTS).join(corpus.select("skeleton", "v_idx", "chapter", "verse"), "skeleton")
    return picked(hits).withColumn("confidence", lowered(F.lit(SKELETON))).withColumn("partial", F.lit(False))


def run_hits(cands: DataFrame, corpus: DataFrame, skeletons: bool = False) -> DataFrame:
    """All verses that hold the candidate's words one after another: id, v_idx, chapter, verse, start (word), size.

    All pairs of neighbouring words must be known; the rarest one is the key of the join, and tells the place."""
    words = "skeleton_tokens" if skeletons else "tokens"
    some = cands.filter(F.size("tokens") >= 2)
    if skeletons:
        some = some.filter((F.length("skeleton") >= 4) & F.forall(words, lambda t: t != ""))
    at = word_pairs(corpus, words)
    df = pair_frequency(corpus, words)
    known = word_pairs(some, words, "id").join(df, "key").groupBy("id").agg(F.count("*").alias("n_known"), F.min(F.struct("df", "key", "pos")).alias("x"))
    keyed = some.join(known, "id").filter(F.col("n_known") == F.size("tokens") - 1).select("id", F.col(words).alias("q"), *_HINTS, F.col("x.key").alias("key"), F.col("x.pos").alias("offset"))
    met = keyed.join(at, "key").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0").join(corpus.select("v_idx", "chapter", "verse", F.col(words).alias("v")), "v_idx")
    hits = met.filter(F.slice("v", F.col("start") + 1, F.size("q")) == F.col("q"))
    first = hits.groupBy("id", "v_idx").agg(F.min("start").alias("start"), *(F.first(c).alias(c) for c in ("chapter", "verse", "q", "v", *_HINTS)))
    return first.select("id", "v_idx", "chapter", "verse", "start", F.size("q").alias("size"), (F.size("v") > F.size("q")).alias("partial"), *_HINTS)


def contiguous(cands: DataFrame, corpus: DataFrame) -> DataFrame:
    """The text is a run of words of a verse; where no verse has it, of a verse's other spelling, as written without joined
    particles; where none has that, by skeletons."""
    plain = run_hits(cands, corpus).withColumn("score", F.lit(UNIQUE))
    rest = cands.join(plain.select("id").distinct(), "id", "left_anti")
    spelled = corpus.filter("alias is not null").withColumn("tokens", T.tokens_of(F.col("alias")))
    other = run_hits(rest.withColumn("tokens", F.col("unjoined")), spelled).withColumn("score", F.lit(UNIQUE))
    rest = rest.join(other.select("id").distinct(), "id", "left_anti")
    hits = plain.unionByName(other).unionByName(run_hits(rest, corpus, skeletons=True).withColumn("score", F.lit(SKELETON)))
    return picked(hits).withColumn("confidence", lowered(F.col("score")))


def repeated_runs(cands: DataFrame, corpus: DataFrame, limit: int = REPEATS) -> DataFrame:
    """The first `limit` verses that hold the candidate's words: id, v_idx, place."""
    order = Window.partitionBy("id").orderBy("v_idx")
    return run_hits(cands, corpus).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def verses_in(texts: DataFrame, corpus: DataFrame, ident: str, text: str, profile: T.ScriptProfile) -> DataFrame:
    """Every verse that stands in a text word for word: ident, v_idx, chapter, verse, start (word), size.

    Places and verses meet on their first two words, as slim rows; only texts with such a place are cut into words again
    to compare the whole verse.
    """
    verses = corpus.select("v_idx", "chapter", "verse", "tokens", F.size("tokens").alias("size"))
    words = texts.select(ident, T.tokens(F.col(text), profile).alias("_w"))
    # an outer explode, so that no filter makes the words a second time
    at = words.select(ident, F.posexplode_outer(F.arrays_zip("_w", F.expr("slice(_w, 2, size(_w))").alias("n"))).alias("start", "_x")).filter("_x._w is not null")
    one = at.select(ident, "start", F.col("_x._w").alias("key")).join(verses.filter("size = 1").select(F.col("tokens")[0].alias("key"), "v_idx"), "key")
    two = at.select(ident, "start", F.concat_ws(" ", "_x._w", "_x.n").alias("key")).join(verses.filter("size > 1").select(F.concat_ws(" ", F.col("tokens")[0], F.col("tokens")[1]).alias("key"), "v_idx"), "key")
    met = one.union(two).select(ident, "v_idx", "start").distinct().join(verses, "v_idx")
    listed = met.groupBy(F.col(ident).alias("_id")).agg(F.collect_list(F.struct("v_idx", "chapter", "verse", "start", "size", "tokens")).alias("_met"))  # bounded by the text
    again = texts.join(listed, F.col(ident) == F.col("_id")).select(ident, "_met", T.tokens(F.col(text), profile).alias("_w"))
    same = F.filter("_met", lambda m: F.slice("_w", m["start"] + 1, m["size"]) == m["tokens"])
    return again.select(ident, F.explode(same).alias("_m")).select(ident, *(F.col(f"_m.{c}").alias(c) for c in ("v_idx", "chapter", "verse", "start", "size")))


def verse_runs(cands: DataFrame, corpus: DataFrame, typos: int = 0) -> DataFrame:
    """Every whole verse that stands in a candidate: id, pos, v_idx, chapter, verse, size, errors.

    Words may differ by skeleton; with typos, up to so many words (two at most) may be a typing error apart. Places and
    verses meet as slim rows on each verse's rarest pair of words, so verses that begin alike cost nothing; words are
    fetched for those that meet.
    """
    verses = corpus.select("v_idx", "chapter", "verse", F.col("tokens").alias("v"), F.col("skeleton_tokens").alias("s"), F.size("tokens").alias("size"))
    meet = lambda words, keys: places(cands, words).join(keys, "key").select("id", (F.col("pos") - F.col("offset")).alias("pos"), "v_idx").filter("pos >= 0")
    met = meet("skeleton_tokens", rare_keys(corpus))
    if typos:
        met = met.union(meet("tokens", third_keys(corpus)))
    hits = met.distinct().join(cands.select("id", "tokens", "skeleton_tokens"), "id").join(verses, "v_idx").filter(F.col("pos") + F.col("size") <= F.size("tokens"))
    q, qs = F.slice("tokens", F.col("pos") + 1, F.col("size")), F.slice("skeleton_tokens", F.col("pos") + 1, F.col("size"))
    same = (q == F.col("v")) | ((qs == F.col("s")) & F.forall("s", lambda t: t != ""))
    errors = F.when(same, 0)
    if typos:
        wrong = F.aggregate(F.zip_with(q, "v", lambda a, b: F.when(a == b, 0).when(T.near_token(a, b), 1).otherwise(99)), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(99)))
        errors = F.when(same, 0).otherwise(wrong)
    return hits.withColumn("errors", errors).filter(F.col("errors") <= typos).select("id", "pos", "v_idx", "chapter", "verse", "size", "errors")


def chains(cands: DataFrame, corpus: DataFrame, typos: int = 0, runs: DataFrame | None = None) -> DataFrame:
    """Runs of consecutive verses in a candidate: id, chapter, first_verse, last_verse, n_verses, pos, end, errors.

    Where verse v of a chapter begins at word p, the chapter itself would begin at p less the words of the verses
    before v. Verses of one chain agree on that, so chains are islands of verse numbers, and no recursion is needed.
    """
    before = Window.partitionBy("chapter").orderBy("verse").rowsBetween(Window.unboundedPreceding, -1)
    shift = corpus.select("v_idx", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)).alias("words_before"))
    runs = (verse_runs(cands, corpus, typos) if runs is None else runs).join(shift, "v_idx").withColumn("origin", F.col("pos") - F.col("words_before"))
    own = Window.partitionBy("id", "chapter", "origin").orderBy("verse")
    runs = runs.withColumn("island", F.col("verse") - F.row_number().over(own))
    return runs.groupBy("id", "chapter", "origin", "island").agg(F.min("verse").alias("first_verse"), F.max("verse").alias("last_verse"), F.count("*").alias("n_verses"), F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("size")).alias("end"), F.sum("errors").alias("errors")).drop("origin", "island")


def whole_chains(cands: DataFrame, corpus: DataFrame, correct: bool = True, typos: int = 0) -> DataFrame:
    """The chain that takes up all of a candidate's words: as `chains`, with `rest` (verses behind it begun) and confidence.

    What is left behind the last verse has to begin the next one. That one is then completed (confidence 95), or given
    as far as it goes where the candidate ends in dots; a completed chain counts only with correction.
    """
    sized = cands.select("id", F.col("tokens").alias("q"), F.size("tokens").alias("n"), F.col("raw").rlike(r"\.{2,}|…").alias("dots"), *_HINTS)
    found = chains(cands, corpus, typos).filter("pos = 0").join(sized, "id")
    nxt = corpus.select(F.col("chapter").alias("c2"), (F.col("verse") - 1).alias("v2"), F.col("tokens").alias("nt"))
    found = found.join(nxt, (F.col("chapter") == F.col("c2")) & (F.col("last_verse") == F.col("v2")), "left")
    rest = F.expr("slice(q, end + 1, greatest(n - end, 0))")
    begun = F.coalesce((F.col("n") > F.col("end")) & (F.size("nt") > F.col("n") - F.col("end")) & (rest == F.expr("slice(nt, 1, greatest(n - end, 0))")), F.lit(False))
    found = found.withColumn("begun", begun).filter((F.col("end") == F.col("n")) | F.col("begun"))
    found = found.withColumn("completed", F.col("begun") & ~F.col("dots"))
    if not correct:
        found = found.filter("not completed")
    best = Window.partitionBy("id").orderBy(F.desc(F.coalesce(F.col("chapter") == F.col("hint_chapter"), F.lit(False))), F.desc("n_verses"), "errors", "chapter", "first_verse")
    full = F.when(F.col("errors") > 0, TYPO).otherwise(UNIQUE) * F.col("n_verses")
    total = full + F.when(F.col("completed"), COMPLETED).when(F.col("begun"), UNIQUE).otherwise(0)
    out = found.withColumn("place", F.row_number().over(best)).withColumn("tied", F.count("*").over(Window.partitionBy("id", "n_verses"))).filter("place = 1")
    return out.withColumn("confidence", T.rounded(total / (F.col("n_verses") + F.col("begun").cast("int")))).withColumn("ambiguous", F.col("tied") > 1).drop("q", "nt", "c2", "v2", "place", "tied")


# --- readings of several verses ---------------------------------------------------------------


def groups(steps: DataFrame) -> DataFrame:
    """Steps of `chain.linked` as runs of neighbouring verses: id, g (from 0), chapter, verse, end_verse, cut (the last is only begun), and the steps' other columns."""
    s = steps.select(*[c for c in steps.columns if c != "steps"], F.posexplode("steps").alias("p", "s"))
    by = Window.partitionBy("id").orderBy("p")
    same = (F.col("s.chapter") == F.lag("s.chapter").over(by)) & (F.col("s.verse") == F.lag("s.verse").over(by) + 1)
    s = s.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("g", F.sum("new").over(by) - 1)
    keep = [c for c in steps.columns if c not in ("id", "steps")]
    return s.groupBy("id", "g").agg(F.first("s.chapter").alias("chapter"), F.min("s.verse").alias("verse"), F.max("s.verse").alias("end_verse"), F.max("s.begun").alias("begun"), *(F.first(c).alias(c) for c in keep))


def one_missing(cands: DataFrame, corpus: DataFrame) -> DataFrame:
    """A word left out: the words before and behind a gap stand in one verse with exactly one word between.

    id, v_idx, chapter, verse, start, gap (words before it), missing.
    """
    cut = cands.filter(F.size("tokens") >= 3).select("id", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("gap"))
    keyed = cut.withColumn("key", F.concat_ws(" ", F.expr("tokens[gap - 1]"), F.expr("tokens[gap]")))
    skips = corpus.select("v_idx", "chapter", "verse", F.col("tokens").alias("v"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 3, F.lit(0)))).alias("p")).filter(F.size("v") >= 3)
    skips = skips.withColumn("key", F.concat_ws(" ", F.expr("v[p]"), F.expr("v[p + 2]")))
    hits = keyed.join(skips, "key").withColumn("start", F.col("p") - F.col("gap") + 1).filter("start >= 0 and start + size(tokens) + 1 <= size(v)")
    ok = (F.expr("slice(v, start + 1, gap)") == F.expr("slice(tokens, 1, gap)")) & (F.expr("slice(v, start + gap + 2, size(tokens) - gap)") == F.expr("slice(tokens, gap + 1, size(tokens) - gap)"))
    return hits.filter(ok).select("id", "v_idx", "chapter", "verse", "start", "gap", F.expr("v[start + gap]").alias("missing"))


def one_substituted(cands: DataFrame, corpus: DataFrame, least: float = 0.5) -> DataFrame:
    """An inner word is another one than the verse's, half alike at least: id, v_idx, chapter, verse, start, at, word."""
    cut = cands.filter(F.size("tokens") >= 3).select("id", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 2)).alias("at"))
    keyed = cut.withColumn("key", F.concat_ws(" ", F.expr("tokens[at - 1]"), F.expr("tokens[at + 1]")))
    gaps = corpus.filter(F.size("tokens") >= 3).select("v_idx", "chapter", "verse", F.col("tokens").alias("v"), F.explode(F.sequence(F.lit(0), F.size("tokens") - 3)).alias("p"))
    gaps = gaps.withColumn("key", F.concat_ws(" ", F.expr("v[p]"), F.expr("v[p + 2]")))
    hits = keyed.join(gaps, "key").withColumn("start", F.col("p") - F.col("at") + 1).filter("start >= 0 and start + size(tokens) <= size(v)")
    ok = (F.expr("slice(v, start + 1, at)") == F.expr("slice(tokens, 1, at)")) & (F.expr("slice(v, start + at + 2, size(tokens) - at - 1)") == F.expr("slice(tokens, at + 2, size(tokens) - at - 1)"))
    word = F.expr("v[start + at]")
    return hits.filter(ok & (F.expr("tokens[at]") != word) & (T.edit_ratio(F.expr("tokens[at]"), word) >= least)).select("id", "v_idx", "chapter", "verse", "start", "at", word.alias("word"))


def rejoined(cands: DataFrame, corpus: DataFrame) -> DataFrame:
    """Variants of a candidate with two neighbouring words written as one, where the corpus has that word: id, at, tokens."""
    known = postings(corpus).select("token").distinct()
    pair = cands.filter(F.size("tokens") >= 2).select("id", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 2)).alias("at")).withColumn("token", F.expr("concat(tokens[at], tokens[at + 1])"))
    return pair.join(known, "token").select("id", "at", F.concat(F.expr("slice(tokens, 1, at)"), F.array("token"), F.expr("slice(tokens, at + 3, size(tokens))")).alias("tokens"))


def unglued(cands: DataFrame, corpus: DataFrame, least: int = 5) -> DataFrame:
    """Variants with a word of `least` letters or more cut in two that the corpus has: id, at, cut, tokens."""
    known = postings(corpus).select("token").distinct()
    cut = cands.select("id", "tokens", F.posexplode("tokens").alias("at", "word")).filter(F.length("word") >= least).withColumn("cut", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    halves = cut.withColumn("token", F.expr("substring(word, 1, cut)")).join(known, "token").withColumnRenamed("token", "left").withColumn("token", F.expr("substring(word, cut + 1)")).join(known, "token")
    return halves.select("id", "at", "cut", F.concat(F.expr("slice(tokens, 1, at)"), F.array("left", "token"), F.expr("slice(tokens, at + 2, size(tokens))")).alias("tokens"))
