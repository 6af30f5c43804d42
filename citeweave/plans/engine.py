"""From texts to replacements: extract, match by a cascade of joins, choose, render, vote, splice.

The cascade is a union of strategies, the late ones only over the candidates that earlier ones left; a window picks per
candidate. Candidates are matched once for each distinct normalised text and hint, and joined back. Candidates, corpus
and what each stage finds are stored tables (`store.kept`), so each stage is planned from scans.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import corpus as C
from citeweave.operators import alike, chain, extract, gapped, match, render, review
from citeweave.operators.numbering import numbered
from citeweave.plans.store import kept, shared_folder, slots


@dataclass(frozen=True)
class Config:
    """correct: complete begun verses and allow errors. script: render the other script of the corpus."""

    profile: T.ScriptProfile = T.ARABIC
    correct: bool = True
    script: bool = False
    names: dict[int, str] = field(default_factory=dict)
    longest_fuzzy: int = 40


FACTS = ["row_index", "start", "end", "original", "formatted", "confidence", "chapter", "chapter_name", "page", "verse", "end_verse", "verse_count", "is_consecutive", "needs_review", "ambiguous", "occurrences", "alternatives", "correction_type"]


def quotations(rows: DataFrame, cfg: Config, ident: str, text: str, chapter: str | None, verse: str | None) -> DataFrame:
    """Candidates with their places: row_index, source, start, end, cleaned text and hints."""
    keep = rows.select(F.col(ident).alias("row_index"), F.col(text).alias("source"), *(F.col(c).alias(n) if c else F.lit(None).alias(n) for c, n in ((chapter, "chapter_hint"), (verse, "verse_hint"))))
    found = extract.quotations(keep, "row_index", "source", cfg.profile)
    # dots just behind the closer belong to the quotation
    dots = F.regexp_extract(F.substring(F.col("source"), F.col("end") + 1, F.lit(12)), r"^\s*(\.{2,}|…)", 0)
    found = found.withColumn("end", F.col("end") + F.length(dots)).withColumn("quote", F.when(dots != "", F.concat("quote", F.lit(" ..."))).otherwise(F.col("quote")))
    plain = T.without_brackets(F.col("quote"))
    # short Latin words are noise in Arabic text only
    return found.withColumn("cleaned", T.without_noise(plain) if cfg.profile.name == "arabic" else plain)


_HIT = ["id", "ord", "kind", "chapter", "verse", "end_verse", "w_start", "w_size", "confidence", "ambiguous", "occurrences", "alternatives", "partial", "steps"]


def _hits(df: DataFrame, order: int, kind: str) -> DataFrame:
    """The hits of a strategy in the columns that all have: a window of words (w_start, w_size; null: all) or steps."""
    have = set(df.columns)
    col = lambda c, d: F.col(c) if c in have else d
    none = F.lit(None)
    return df.select(
        "id", F.lit(order).alias("ord"), F.lit(kind).alias("kind"), col("chapter", none).cast("int").alias("chapter"), col("verse", none).cast("int").alias("verse"),
        col("end_verse", col("verse", none)).cast("int").alias("end_verse"), col("start", none).cast("int").alias("w_start"), col("size", none).cast("int").alias("w_size"),
        F.col("confidence").cast("int").alias("confidence"), col("ambiguous", F.lit(False)).alias("ambiguous"), col("occurrences", F.lit(1)).cast("int").alias("occurrences"),
        col("alternatives", F.array().cast("array<string>")).alias("alternatives"), col("partial", F.lit(False)).alias("partial"), col("steps", none.cast(chain.STEPS)).alias("steps"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def variants(cands: DataFrame, corpus: DataFrame, profile: T.ScriptProfile) -> DataFrame:
    """Candidates with a word cut in two or two written as one; id is the variant's own, of the candidate's."""
    hints = cands.select("id", "hint_chapter", "hint_verse")
    # a form is found where all its words are known, and it is made of one word or of two
    unknown = cands.select("id", F.explode("tokens").alias("token")).join(C.document_frequency(corpus).select("token"), "token", "left_anti").groupBy("id").agg(F.count("*").alias("n")).filter("n > 2")
    cands = cands.join(unknown.select("id"), "id", "left_anti")
    made = match.unglued(cands, corpus).select("id", "tokens").union(match.rejoined(cands, corpus).select("id", "tokens")).distinct()
    made = made.join(hints, "id").withColumn("of", F.col("id")).withColumn("id", F.xxhash64("of", "tokens"))
    return match.recast(made, profile)


def reachable(cands: DataFrame, corpus: DataFrame, cfg: Config) -> DataFrame:
    """What the words of each candidate allow: id and known, edited, spelled, alike. Those that no strategy can link are left out.

    known: every word is one of the corpus but for weak letters, as all readings without correction ask. With correction
    also edited: as many words are unknown as a reading of verses may have edits; spelled: two words at most may be glued
    or cut; alike: a word is lost or replaced, or so many are shared as the most alike window must. Words are counted
    beside their ids only, so the texts of all others go no further.
    """
    kinds = [("tokens", F.col("skeleton_tokens"))]
    if cfg.profile.prefix_join:
        kinds.append(("unjoined", F.transform("unjoined", lambda w: T.skeleton_of(w, cfg.profile))))
    listed = lambda k, c, s: F.array_distinct(F.zip_with(c, s, lambda w, x: F.struct(F.lit(k).alias("kind"), w.alias("token"), x.alias("word"))))
    words = F.concat(*(listed(k, c, s) for k, (c, s) in enumerate(kinds)))
    met = cands.select("id", F.size("tokens").alias("n"), F.explode(words).alias("x")).select("id", "n", "x.*")
    met = met.join(C.vocabulary(corpus, cfg.profile).withColumn("near", F.lit(True)), "word", "left").join(C.document_frequency(corpus), "token", "left")
    of = lambda k, what: F.sum(((F.col("kind") == k) & what).cast("int"))
    new = F.col("near").isNull() & (F.col("word") != "")
    seen = met.groupBy("id").agg(F.max("n").alias("n"), of(0, F.lit(True)).alias("size"), of(0, new).alias("new"), of(1, new).alias("new_apart"), of(0, F.col("df").isNotNull()).alias("shared"))
    apart = F.col("new_apart") == 0 if len(kinds) > 1 else F.lit(False)
    late = F.lit(cfg.correct) & (F.col("n") <= cfg.longest_fuzzy)
    missing = F.col("size") - F.col("shared")
    seen = seen.select("id", ((F.col("new") == 0) | apart).alias("known"), (F.lit(cfg.correct) & (F.col("new") <= chain.RUN_EDITS)).alias("edited"), (late & (missing <= 2)).alias("spelled"), (late & ((missing <= 1) | (F.col("shared") >= alike.least_shared(F.col("size"), alike.FUZZY)))).alias("alike"))
    return seen.filter("known or edited or spelled or alike")


def resolved(cands: DataFrame, corpus: DataFrame, cfg: Config) -> DataFrame:
    """The best reading of each candidate: id, kind, chapter, verse, end_verse, words, confidence, ..., steps.

    In order: verses end to end, a whole verse, a verse but for weak letters, a run of words, a beginning. With correction
    also: verses end to end with words lost, added or mistyped; a word glued, cut, lost or replaced; the most alike window.
    corpus: a table that is read many times, so best a stored one.
    The first to reach confidence 100 wins; of the others the surest, then the earlier.
    """
    corpus = C.indexed(corpus, kept)
    # all texts are stored once and slim; each strategy gets those that its words allow
    some = kept(cands.filter(F.size("tokens") >= 2).select("id", "raw", "norm", "hint_chapter", "hint_verse"), "candidates")
    some = match.worded(some, cfg.profile)
    seen = kept(reachable(some, corpus, cfg), "reachable")
    of = lambda ids: some.join(ids.select("id"), "id", "left_semi")
    known = kept(of(seen.filter("known")), "known")
    wide = of(seen.filter("known or edited")) if cfg.correct else known
    runs = kept(match.verse_runs(wide, corpus), "runs")
    tied = match.chains(known, corpus, runs=runs).join(known.select("id", F.size("tokens").alias("n")), "id").filter("pos = 0 and end = n").groupBy("id").agg((F.count("*") > 1).alias("ambiguous"))
    walks = chain.linked(known, corpus, runs, kept, correct=cfg.correct).filter(F.size("steps") > 1).join(tied, "id", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    parts = [(walks, "chain"), (match.exact(known, corpus), "exact"), (match.by_skeleton(known, corpus), "skeleton"), (match.contiguous(known, corpus), "run"), (match.prefix(known, corpus), "prefix")]
    sure = kept(_union([_hits(df, i, kind) for i, (df, kind) in enumerate(parts)]), "sure")
    if cfg.correct:
        left = kept(seen.join(sure.select("id").distinct(), "id", "left_anti"), "left")
        if not left.isEmpty():
            # a reading with edits begins with a verse as it stands, or with one of whose keys stands about there
            met = kept(chain.meetings(of(left.filter("edited")), corpus), "meetings")
            begun = met.filter(F.abs("at") <= chain.VERSE_EDITS).select("id").union(runs.filter("pos = 0").select("id")).distinct()
            begun = kept(of(left.filter("edited").join(begun, "id", "left_semi")), "begun")
            fixed = chain.linked(begun, corpus, runs.join(begun.select("id"), "id", "left_semi"), kept, repair=True, met=met)
            # the other corrections are for short quotations
            rest = kept(of(left.filter("alike")), "rest")
            n = rest.select("id", F.size("tokens").alias("n"), "hint_chapter", "hint_verse")
            forms = kept(variants(kept(of(left.filter("spelled")).select("id", "tokens", "hint_chapter", "hint_verse"), "spelled"), corpus, cfg.profile), "variants")
            back = lambda df: match.picked(df.drop("occurrences", "alternatives", "ambiguous", "resolved").join(forms.select("id", "of", "hint_chapter", "hint_verse"), "id").withColumn("id", F.col("of")).drop("of"), (F.desc("score"),))
            form = match.exact(forms, corpus).select("id", "v_idx", "chapter", "verse", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), "partial", F.least("confidence", F.lit(match.COMPLETED)).alias("score"))
            lost = gapped.one_word_between(forms, corpus).select("id", "v_idx", "chapter", "verse", "start", "size", F.lit(True).alias("partial"), T.rounded(match.COMPLETED * F.col("score")).alias("score"))
            form = back(form.union(lost).union(match.contiguous(forms, corpus).select("id", "v_idx", "chapter", "verse", "start", "size", "partial", F.least("confidence", F.lit(match.COMPLETED)).alias("score")))).withColumn("confidence", F.col("score"))
            between = lambda df, words: df.join(n, "id").withColumn("confidence", T.rounded(100 * words * F.col("score"))).withColumn("partial", F.lit(True))
            gap = between(gapped.one_word_between(rest, corpus), F.col("n") / (F.col("n") + 1))
            other = between(gapped.one_word_between(rest, corpus, mistaken=True), (F.col("n") - 1) / F.col("n"))
            fuzzy = alike.fuzzy(rest, corpus).withColumn("partial", F.lit(True))
            late = [(fixed, "repaired"), (form, "form"), (gap, "missing"), (other, "substituted"), (fuzzy, "fuzzy")]
            late = kept(_union([_hits(df, 5 + i, kind) for i, (df, kind) in enumerate(late)]), "late")
            sure = sure.unionByName(late.filter("confidence >= 85 or kind = 'missing'"))
    best = Window.partitionBy("id").orderBy(F.desc(F.col("confidence") == 100), F.when(F.col("confidence") == 100, F.col("ord")), F.desc("confidence"), "ord")
    return kept(sure.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place"), "resolved")


def rendered(hits: DataFrame, corpus: DataFrame, cfg: Config) -> DataFrame:
    """Adds `formatted`, chapter_name, page and verse_count; drops what has no substance.

    A reading of several runs of verses has one reference for each, with a line feed between; chapter and verses are those
    of the first. Substance: two words in all, and a verse that has two.
    """
    words = corpus.select(F.col("chapter").alias("c_"), F.col("verse").alias("v_"), F.split(F.trim("script" if cfg.script else "text"), r"\s+").alias("words"), "page")
    plain = hits.filter("steps is null").select("id", F.lit(0).cast("long").alias("g"), "chapter", "verse", "end_verse", F.lit(False).alias("cut"))
    walks = match.groups(hits.filter("steps is not null").select("id", "steps", (F.col("confidence") == match.UNIQUE).alias("whole")))
    # a verse only begun is given as far as it goes if it wasn't completed, which the confidence tells
    walks = walks.select("id", F.col("g").cast("long").alias("g"), "chapter", "verse", "end_verse", (F.col("begun") & F.col("whole")).alias("cut"))
    window = hits.select("id", "partial", "w_start", "w_size")
    runs = plain.unionByName(walks).join(window, "id")
    span = runs.withColumn("v", F.explode(F.sequence("verse", "end_verse"))).join(words, (F.col("chapter") == F.col("c_")) & (F.col("v") == F.col("v_")))
    cut = F.when(F.col("partial") & F.col("w_start").isNotNull(), F.expr("slice(words, w_start + 1, w_size)")).otherwise(F.col("words"))
    span = span.withColumn("shown", F.concat(F.array_join(cut, " "), F.when(F.col("cut") & (F.col("v") == F.col("end_verse")), F.lit(" ...")).otherwise(F.lit(""))))
    parts = span.groupBy("id", "g").agg(*(F.first(c).alias(c) for c in ("chapter", "verse", "end_verse")), F.array_sort(F.collect_list(F.struct("v", "shown"))).alias("p"), F.min_by("page", "v").alias("page"), F.sum(F.size(cut)).alias("n_words"), F.max(F.size(cut)).alias("longest"))
    name = render.chapter_name(cfg.names, F.col("chapter"))
    pieces = F.transform("p", lambda x: F.struct(x["shown"].alias("text"), x["v"].alias("verse")))
    parts = parts.withColumn("chapter_name", name).withColumn("verse_count", F.size("p")).withColumn("formatted", render.reference(pieces, name, F.col("verse"), F.col("end_verse")))
    one = parts.groupBy("id").agg(F.min(F.struct("g", "chapter", "verse", "end_verse", "chapter_name", "page")).alias("x"), F.array_sort(F.collect_list(F.struct("g", "formatted"))).alias("f"), F.sum("verse_count").cast("int").alias("verse_count"), F.sum("n_words").alias("n_words"), F.max("longest").alias("longest"))
    one = one.filter("n_words >= 2 and longest >= 2").select("id", "x.chapter", "x.verse", "x.end_verse", "x.chapter_name", "x.page", "verse_count", F.array_join(F.transform("f", lambda y: y["formatted"]), "\n").alias("formatted"))
    return one.join(hits.drop("chapter", "verse", "end_verse", "steps", "w_start", "w_size", "partial"), "id")


def replacements(rows: DataFrame, corpus: DataFrame, cfg: Config = Config(), ident: str = "id", text: str = "text", chapter: str | None = None, verse: str | None = None, stored: bool = False) -> DataFrame:
    """The fact table: a row for each quotation that is linked and would change.

    Quotations that aren't sure and stand among others that name one chapter are read again with that chapter as the
    hint; the new reading counts if it is surer.
    """
    corpus = C.indexed(corpus if stored else kept(corpus, "corpus"), kept)
    quotes = kept(quotations(rows, cfg, ident, text, chapter, verse), "quotations")

    def read(keyed: DataFrame) -> DataFrame:
        distinct = keyed.select("id", "cleaned", F.col("chapter_hint").cast("string").alias("chapter_hint"), F.col("verse_hint").cast("string").alias("verse_hint")).distinct()
        cands = match.candidates(distinct, cfg.profile, "cleaned", "id", "chapter_hint", "verse_hint")
        return keyed.join(rendered(resolved(cands, corpus, cfg), corpus, cfg), "id")

    own = lambda df: df.withColumn("id", F.xxhash64("cleaned", F.col("chapter_hint").cast("string"), F.col("verse_hint").cast("string")))
    out = kept(read(own(quotes)), "read")
    placed = review.clusters(out)
    votes = review.cluster_votes(out).select("row_index", "cluster", F.col("chapter").alias("dominant"))
    doubtful = kept(placed.filter("confidence < 100").join(votes, ["row_index", "cluster"]).filter("chapter <> dominant").select("row_index", "start", "end", "dominant", F.col("confidence").alias("before")), "doubtful")
    if not doubtful.isEmpty():
        again = quotes.join(doubtful, ["row_index", "start", "end"]).withColumn("chapter_hint", F.col("dominant").cast("string")).withColumn("verse_hint", F.lit(None).cast("string"))
        better = kept(read(own(again)).filter("confidence > before"), "better")
        keys = ["row_index", "start", "end"]
        out = out.withColumns({c: F.col(c).cast("string") for c in ("chapter_hint", "verse_hint")}).join(better.select(*keys), keys, "left_anti").unionByName(better.drop("dominant", "before"))
    # a reference tag behind the quotation that names the same verses is taken in
    tag = render.tag_after(F.col("source"), F.col("end"))
    cites = render.tag_cites(T.normalized(tag, cfg.profile), T.normalized(F.col("chapter_name"), cfg.profile), F.col("verse"), F.col("end_verse"))
    out = out.withColumn("end", F.col("end") + F.when((tag != "") & cites, F.length(tag)).otherwise(0))
    out = out.withColumn("original", F.substring(F.col("source"), F.col("start") + 1, F.col("end") - F.col("start"))).filter("original <> formatted")
    out = out.withColumn("needs_review", (F.col("confidence") < review.LOW) | F.col("ambiguous")).withColumn("is_consecutive", F.col("verse_count") > 1)
    out = out.withColumn("correction_type", F.when(F.col("kind").isin("repaired", "form", "missing", "substituted", "fuzzy"), "correct").otherwise("format"))
    return out.select(*FACTS)


def process(rows: DataFrame, corpus: DataFrame, cfg: Config = Config(), ident: str = "id", text: str = "text", stored: bool = False, **hints) -> DataFrame:
    """The rows with `modified_text`, `n_replacements`, `total_verses`, `low_confidence`, `ambiguous` and `average_confidence`.

    stored: the corpus is a stored table already."""
    facts = replacements(rows, corpus, cfg, ident, text, stored=stored, **hints)
    reps = facts.groupBy(F.col("row_index").alias(ident)).agg(
        F.collect_list(F.struct("start", "end", "formatted")).alias("_reps"),
        F.sum("verse_count").alias("total_verses"),
        F.sum((F.col("confidence") < review.LOW).cast("int")).alias("low_confidence"),
        F.sum(F.col("ambiguous").cast("int")).alias("ambiguous"),
        T.rounded(F.avg("confidence")).alias("average_confidence"),
    )
    out = rows.join(reps, ident, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total_verses", "low_confidence", "ambiguous", "average_confidence")}
    return out.withColumn("modified_text", F.when(F.col("_reps").isNull(), F.col(text)).otherwise(render.spliced(F.col(text), F.col("_reps")))).withColumn("n_replacements", F.coalesce(F.size("_reps"), F.lit(0))).withColumns(zero).drop("_reps")


def report_rows(facts: DataFrame, source: str | None = None) -> DataFrame:
    """The facts as rows of a report: `id` from 1 in order of row and place, and where they come from."""
    return numbered(facts.withColumn("source", F.lit(source)), ["row_index", "start", "end"], "id", kept).select("id", "source", *facts.columns)


def process_stream(stream: DataFrame, corpus: DataFrame, path: str, checkpoint: str, cfg: Config = Config(), trigger: dict | None = None, **names):
    """A streaming query that runs the same batch transform over each micro-batch and writes Parquet to path.

    A batch is written to a folder of its own (`batch_id=<n>`), so one that is run again after a failure takes the place of
    what it left: each row comes out once. The corpus is stored once, and the tables of a batch take the places of those of
    the batch before. All jobs carry the tag `citeweave-<path>`, by which `cancel_stream` ends them.
    """
    spark = corpus.sparkSession
    corpus = C.indexed(kept(corpus, "corpus"), kept)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def batch(df: DataFrame, number: int) -> None:
        spark.sparkContext.addJobTag(stream_tag(path))
        with slots(folder):
            out = process(df, C.indexed(corpus.select("*"), kept), cfg, **names, stored=True)
            out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={number}")

    out = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"}))
    return out.foreachBatch(batch).start()


def stream_tag(path: str) -> str:
    return "citeweave-" + path.replace(",", "_")


def cancel_stream(spark: SparkSession, query, path: str) -> None:
    """End a query of `process_stream` and the jobs that it runs; the batch that was cut short is run again by the next start."""
    spark.sparkContext.cancelJobsWithTag(stream_tag(path))
    query.stop()


def format_text(text: str, corpus: DataFrame, cfg: Config = Config()) -> str:
    """One text with its quotations rewritten, apart from any table."""
    rows = corpus.sparkSession.createDataFrame([(0, text)], "id int, text string")
    return process(rows, corpus, cfg).first().modified_text
