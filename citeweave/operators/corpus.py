"""The reference corpus: chapters of numbered verses, as a dimension table, and the index tables made from it.

Columns of a corpus: v_idx (order), chapter, verse, text (display form), norm, tokens, skeleton, alias (another spelling
of norm, or null), page. Everything else joins these tables; which join Spark takes follows from their size.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T

from .numbering import numbered

# Names under which a field of a corpus record may come.
FIELDS = {"chapter": ["surah_num", "surahNum", "sura"], "verse": ["ayah_num", "ayahNum", "aya"], "plain": ["ayah_imlai", "ayahImlai"], "script": ["ayah_uthmani", "ayahUthmani"], "bare": ["ayah_notashkil", "ayahNotashkil"], "page": ["page_num", "pageNum"], "id": ["ID", "id"]}

#: Numbers that the verses of a chapter have room for where the place of a verse is made of chapter and verse.
PER_CHAPTER = 1_000_000


def _any(df: DataFrame, names: list[str], kind: str) -> Column:
    found = [F.col(f"`{n}`").cast(kind) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def from_records(df: DataFrame, profile: T.ScriptProfile = T.ARABIC, order: str | None = None, keep=None) -> DataFrame:
    """A corpus from raw records. Records without text, chapter or verse are dropped; a corpus without any is an error.

    keep: stores a table; with it verses are numbered by many tasks, without it by one."""
    raw = df.select(*(_any(df, names, "int" if k in ("chapter", "verse", "page") else "string").alias(k) for k, names in FIELDS.items()), *([F.col(order).alias("_order")] if order else []))
    main = F.coalesce(F.nullif("plain", F.lit("")), F.nullif("script", F.lit("")))
    norm = T.normalized(main, profile)
    norm = F.when(norm == "", T.normalized(F.col("bare"), profile)).otherwise(norm)
    out = raw.filter(main.isNotNull() & (F.coalesce("chapter", F.lit(0)) != 0) & (F.coalesce("verse", F.lit(0)) != 0)).withColumn("norm", norm).filter("norm <> ''")
    alias = T.normalized(F.col("bare"), profile, join_prefixes=False)
    out = out.withColumn("alias", F.when((alias != "") & (alias != F.col("norm")), alias)).withColumn("script_norm", T.normalized(F.col("script"), profile))
    by = [*([F.col("_order")] if order else []), F.col("chapter"), F.col("verse")]
    if keep:
        out = numbered(out, by, "v_idx", keep).withColumn("v_idx", F.col("v_idx") - 1)
    else:  # a corpus of thousands of rows
        out = out.withColumn("v_idx", F.row_number().over(Window.orderBy(*by)) - 1)
    out = out.select("v_idx", "chapter", "verse", main.alias("text"), F.coalesce("script", main).alias("script"), "norm", "alias", "script_norm", "page")
    return finished(out, profile)


def finished(verses: DataFrame, profile: T.ScriptProfile) -> DataFrame:
    """Adds tokens, skeleton and skeleton tokens."""
    return verses.withColumn("tokens", T.tokens_of(F.col("norm"))).withColumn("skeleton", T.skeleton_of(F.col("norm"), profile)).withColumn("skeleton_tokens", F.transform("tokens", lambda t: T.skeleton_of(t, profile)))


def from_json(spark: SparkSession, path: str, profile: T.ScriptProfile = T.ARABIC) -> DataFrame:
    """A corpus file: an array of records, an object with `verses` or `data`, or one record."""
    df = spark.read.option("multiLine", True).json(path)
    for wrapper in ("verses", "data"):
        if wrapper in df.columns:
            df = df.select(F.posexplode(wrapper).alias("_pos", "x")).select("_pos", "x.*")
            break
    else:
        df = df.withColumn("_pos", F.monotonically_increasing_id())
    corpus = from_records(df, profile, order="_pos")
    if corpus.isEmpty():
        raise ValueError("the corpus has no valid verse")
    return corpus


def auto_load(spark: SparkSession, paths: list[str], profile: T.ScriptProfile = T.ARABIC) -> tuple[str, DataFrame] | None:
    """The first of some places that holds a valid corpus, and the corpus; None with a warning if none does."""
    for path in paths:
        try:
            return path, from_json(spark, path, profile)
        except (AnalysisException, ValueError):  # not there, not readable as records, or without a valid verse
            continue
    warnings.warn(f"no corpus under {', '.join(paths)}", stacklevel=2)
    return None


def from_passages(df: DataFrame, chapter: str, text: str, profile: T.ScriptProfile = T.LATIN, least: int = 12) -> DataFrame:
    """A corpus from texts: each is a chapter, its sentences of more than `least` characters are the verses."""
    parts = df.select(F.col(chapter).alias("chapter"), F.posexplode(F.split(text, r"[.\n]+")).alias("pos", "text")).withColumn("text", F.trim("text")).filter(F.length("text") > least)
    own = Window.partitionBy("chapter").orderBy("pos")
    verses = parts.withColumn("verse", F.row_number().over(own)).withColumn("norm", T.normalized(F.col("text"), profile)).filter("norm <> ''")
    verses = verses.select((F.col("chapter") * PER_CHAPTER + F.col("verse")).alias("v_idx"), "chapter", "verse", "text", F.col("text").alias("script"), "norm", F.lit(None).cast("string").alias("alias"), F.col("norm").alias("script_norm"), F.lit(None).cast("int").alias("page"))
    return finished(verses, profile)


class _Index:
    def __init__(self, keep):
        self.keep, self.tables = keep, {}


def indexed(corpus: DataFrame, keep) -> DataFrame:
    """The corpus with index tables that are made once, when first asked for, and stored by keep(table, name)."""
    if getattr(corpus, "_index_tables", None) is None:
        corpus._index_tables = _Index(keep)
    return corpus


def _once(corpus: DataFrame, name: str, make) -> DataFrame:
    """An index table: the stored one of an `indexed` corpus, or else made in place. A stored one has a known size, so that
    Spark can send a small one to all tasks instead of shuffling the texts."""
    index = getattr(corpus, "_index_tables", None)
    if index is None:
        return make()
    if name not in index.tables:
        index.tables[name] = index.keep(make(), name)
    return index.tables[name]


def exact_keys(corpus: DataFrame) -> DataFrame:
    """key, v_idx: every text under which a verse is found as a whole."""
    keys = F.array_distinct(F.filter(F.array("norm", "alias", "script_norm"), lambda k: k.isNotNull() & (k != "")))
    return corpus.select(F.explode(keys).alias("key"), "v_idx", "chapter", "verse")


def postings(corpus: DataFrame, skeletons: bool = False) -> DataFrame:
    """token, v_idx: which verses have a token; of skeletons without empty ones."""
    words = F.col("skeleton_tokens") if skeletons else F.concat("tokens", F.coalesce(T.tokens_of(F.col("alias")), F.array().cast("array<string>")))
    return _once(corpus, f"postings-{skeletons}", lambda: corpus.select(F.explode(F.array_distinct(words)).alias("token"), "v_idx", "chapter", "verse").filter("token <> ''"))


def document_frequency(corpus: DataFrame, skeletons: bool = False) -> DataFrame:
    return _once(corpus, f"token-df-{skeletons}", lambda: postings(corpus, skeletons).groupBy("token").agg(F.count("*").alias("df")))


def vocabulary(corpus: DataFrame, profile: T.ScriptProfile) -> DataFrame:
    """word: the skeletons of all words in any spelling of a verse."""
    spelled = lambda c: F.transform(F.coalesce(T.tokens_of(F.col(c)), F.array().cast("array<string>")), lambda w: T.skeleton_of(w, profile))
    words = F.concat("skeleton_tokens", spelled("alias"), spelled("script_norm"))
    return _once(corpus, "vocabulary", lambda: corpus.select(F.explode(words).alias("word")).filter("word <> ''").distinct())


def canonical_frequency(corpus: DataFrame) -> DataFrame:
    """token, df: in how many verses a canonical token stands."""
    return _once(corpus, "canonical-df", lambda: positions(corpus).select("v_idx", "token").distinct().groupBy("token").agg(F.count("*").alias("df")))


def positions(corpus: DataFrame) -> DataFrame:
    """token, v_idx, pos (from 0) of the canonical tokens."""
    return corpus.select("v_idx", "chapter", "verse", F.posexplode("tokens").alias("pos", "token"))


def following(df: DataFrame, group: str, number: str, carry: list[str]) -> DataFrame:
    """Each row with the row of the next number in its group (a gap: nulls), as next_<column>; a join on (group, number)."""
    nxt = df.select(F.col(group).alias("_g"), (F.col(number) - 1).alias("_n"), *(F.col(c).alias(f"next_{c}") for c in carry))
    return df.join(nxt, (F.col(group) == F.col("_g")) & (F.col(number) == F.col("_n")), "left").drop("_g", "_n")


def by_key(corpus: DataFrame) -> DataFrame:
    """One verse for each (chapter, verse): the last where the key comes twice."""
    return corpus.groupBy("chapter", "verse").agg(F.max_by(F.struct(*[c for c in corpus.columns if c not in ("chapter", "verse")]), "v_idx").alias("x")).select("chapter", "verse", "x.*")


def stats(corpus: DataFrame) -> DataFrame:
    words = postings(corpus).agg(F.countDistinct("token").alias("unique_tokens")).withColumn("one", F.lit(1))
    head = corpus.agg(F.count("*").alias("verses"), F.countDistinct("chapter").alias("chapters"), F.max(F.size("tokens")).cast("long").alias("max_tokens")).withColumn("one", F.lit(1))
    return head.join(words, "one").select("verses", "chapters", "unique_tokens", "max_tokens")


def ranked_candidates(queries: DataFrame, corpus: DataFrame, limit: int = 400, probes: int = 6, common: int = 1500) -> DataFrame:
    """The verses most alike to each query (id, tokens): id, v_idx, score.

    The rarest known tokens are probed, common ones skipped; a verse scores one for each. If all are common, the rarest
    one's verses are taken. Ties go to the verse met first: by its rarest token, then corpus order.
    """
    df = document_frequency(corpus)
    known = queries.select("id", F.explode(F.array_distinct("tokens")).alias("token")).join(df, "token")
    rare = Window.partitionBy("id").orderBy("df", "token")
    probed = known.withColumn("rank", F.row_number().over(rare)).filter(F.col("rank") <= probes).withColumn("usable", (F.col("df") <= common) | ((F.col("rank") == 1) & (F.min("df").over(Window.partitionBy("id")) > common))).filter("usable")
    hits = probed.join(postings(corpus).select("token", "v_idx"), "token").groupBy("id", "v_idx").agg(F.count("*").alias("score"), F.min("rank").alias("first"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "first", "v_idx")
    return hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).select("id", "v_idx", "score", "place")


def pair_frequency(corpus: DataFrame, words: str = "skeleton_tokens") -> DataFrame:
    """key, df: in how many verses two neighbouring words stand."""
    return _once(corpus, f"pair-df-{words}", lambda: corpus.select("v_idx", F.explode(F.array_distinct(_pairs(words))).alias("key")).groupBy("key").agg(F.count("*").alias("df")))


def _pairs(words: str) -> Column:
    return F.expr(f"transform(slice({words}, 2, greatest(size({words}) - 1, 0)), (w, i) -> {words}[i] || ' ' || w)")


def rare_keys(corpus: DataFrame, words: str = "skeleton_tokens") -> DataFrame:
    """v_idx, key, offset, size: each verse with its rarest pair of neighbouring words and where that stands in it.

    A verse of one word has the word. Frequent openings don't make frequent keys, so what meets on a key grows with the
    places of rare pairs."""
    at = corpus.select("v_idx", F.size(words).alias("size"), F.posexplode(F.when(F.size(words) > 1, _pairs(words)).otherwise(F.col(words))).alias("offset", "key"))
    rarest = at.join(pair_frequency(corpus, words), "key", "left").groupBy("v_idx").agg(F.first("size").alias("size"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "key")).alias("x"))
    return _once(corpus, f"rare-keys-{words}", lambda: rarest.select("v_idx", "x.key", "x.offset", "size"))


def third_keys(corpus: DataFrame, words: str = "tokens") -> DataFrame:
    """v_idx, key, offset: three keys of each verse, one for each third of its words: the third's rarest pair, or its one word.

    Two edits leave one third as it is, so where a verse stands with two edits at most, one of its keys stands too, at
    most two words from its place. A verse of two words has two keys (one edit); one of one word has one."""
    third = F.expr(f"transform(sequence(0, 2), k -> struct(int(floor(k * size({words}) / 3)) as a, int(floor((k + 1) * size({words}) / 3)) as b))")
    at = corpus.select("v_idx", F.col(words).alias("w"), F.explode(third).alias("t")).filter("t.b > t.a")
    keys = F.expr("transform(sequence(t.a, greatest(t.b - 2, t.a)), i -> struct(i as offset, if(t.b - t.a > 1, w[i] || ' ' || w[i + 1], w[i]) as key))")
    one = at.select("v_idx", "t.a", F.explode(keys).alias("x")).select("v_idx", "a", "x.key", "x.offset")
    rarest = one.join(pair_frequency(corpus, words), "key", "left").groupBy("v_idx", "a").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "key")).alias("x"))
    return _once(corpus, f"third-keys-{words}", lambda: rarest.select("v_idx", "x.key", "x.offset"))


def word_pairs(df: DataFrame, words: str, ident: str = "v_idx") -> DataFrame:
    """ident, pos, key: the pairs of neighbouring words and where they stand."""
    return _once(df, f"pairs-{words}", lambda: df.select(ident, F.posexplode(_pairs(words)).alias("pos", "key")))


def places(cands: DataFrame, words: str = "skeleton_tokens") -> DataFrame:
    """id, pos, key: the words and the pairs of neighbouring words of texts, as keys and where they begin."""
    both = F.concat(F.expr(f"transform({words}, (w, i) -> struct(i as pos, w as key))"), F.transform(_pairs(words), lambda w, i: F.struct(i.alias("pos"), w.alias("key"))))
    return cands.select("id", F.explode(both).alias("x")).select("id", "x.pos", "x.key")
