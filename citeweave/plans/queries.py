"""The registered queries over the given tables, each beside the SQL that returns the same rows.

`benchmark` is the reference corpus: an item is a chapter, its sentences are the verses. `documents` hold the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import sql as sql_functions_of
from citeweave.functions import text as T
from citeweave.operators import corpus as C
from citeweave.operators.numbering import numbered
from citeweave.operators import alike, chain, extract, gapped, match, render, review
from citeweave.plans import engine
from citeweave.plans.store import kept, shared_folder
from citeweave.sources import documents as docs_io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- pieces of SQL ----------------------------------------------------------------------------

NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SKEL = "trim(regexp_replace(translate({}, 'aeiou', ''), ' +', ' ', 'g'))"
VERSES = rf"""verses AS (
  SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY pos) AS verse, text, {NORM.format('text')} AS norm
  FROM (SELECT item_id AS chapter, pos, trim(s) AS text FROM (
    SELECT item_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT item_id, string_split_regex(text, '[.\n]+') AS l FROM benchmark)))
  WHERE length(text) > 12),
corpus AS (SELECT chapter * 1000000 + verse AS v_idx, chapter, verse, text, norm, string_split(norm, ' ') AS tokens, {SKEL.format('norm')} AS skeleton FROM verses WHERE norm <> '')"""
SENTENCES = rf"""sentences AS (
  SELECT doc_id, pos, text, {NORM.format('text')} AS norm FROM (
    SELECT doc_id, pos, trim(s) AS text FROM (
      SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split_regex(text, '[.\n]+') AS l FROM documents)))
  WHERE length(text) > 12)"""


NEAR_SQL = "(greatest(length({0}), length({1})) >= 4 AND abs(length({0}) - length({1})) <= 2 AND levenshtein({0}, {1}) <= CASE WHEN greatest(length({0}), length({1})) >= 7 THEN 2 ELSE 1 END)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return C.from_passages(table(spark, sf, "benchmark"), "item_id", "text")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, pos, text, norm of every sentence of more than 12 characters."""
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"[.\n]+")).alias("pos", "text")).withColumn("text", F.trim("text")).filter(F.length("text") > 12)
    return s.withColumn("norm", T.normalized(F.col("text"), T.LATIN))


def verse_candidates(spark: SparkSession, sf: str, text=None) -> DataFrame:
    """Candidates made of the corpus's own verses, changed by `text`; id is the verse's v_idx."""
    v = corpus(spark, sf)
    made = v.select(F.col("v_idx").alias("id"), (text(F.col("text"), F.col("tokens")) if text else F.col("text")).alias("text"))
    return match.candidates(made, T.LATIN)


def found_verses(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, v_idx, chapter, verse, start, size: every verse that stands in a document."""
    return match.verses_in(table(spark, sf, "documents"), corpus(spark, sf), "doc_id", "text", T.LATIN)


FOUND = rf"""doc_words AS (SELECT doc_id, string_split({NORM.format('text')}, ' ') AS w FROM documents),
found AS (SELECT doc_id, v_idx, chapter, verse, pos - 1 AS start, len(tokens) AS size FROM (
    SELECT doc_id, w, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM doc_words) d
  JOIN corpus c ON d.token = c.tokens[1] AND list_slice(d.w, d.pos, d.pos + len(c.tokens) - 1) = c.tokens)"""


# --- text -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5, length({NORM.format('text')}) AS norm_length FROM documents")
def normalize_text(spark, sf):
    n = T.normalized(F.col("text"), T.LATIN)
    return table(spark, sf, "documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("norm_length"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '') AS t FROM documents)")
def tokenize(spark, sf):
    t = T.tokens(F.col("text"), T.LATIN)
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, md5({SKEL.format(NORM.format('text'))}) AS skeleton_md5 FROM documents")
def skeleton(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.skeleton(F.col("text"), T.LATIN)).alias("skeleton_md5"))


@query("SELECT doc_id, translate(n_chars::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits, md5(translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩')) AS text_md5 FROM documents")
def digits_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.arabic_digits(F.col("n_chars")).alias("digits"), F.md5(T.arabic_digits(F.col("text"))).alias("text_md5"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), '`', '&#96;')) AS escaped_md5 FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.escaped_html(F.col("html"))).alias("escaped_md5"))


@query(r"""SELECT doc_id, md5(coalesce(nullif(array_to_string(list_filter(string_split_regex(trim(text), '[ \t\n\r\f\x0b]+'), lambda t: regexp_replace(t, '[^\p{L}\p{N}\p{M}…]+', '', 'g') <> ''
  AND NOT regexp_full_match(regexp_replace(t, '[^\p{L}\p{N}\p{M}…]+', '', 'g'), '[0-9٠-٩۰-۹]+') AND NOT regexp_full_match(regexp_replace(t, '[^\p{L}\p{N}\p{M}…]+', '', 'g'), '[A-Za-z]{1,3}')), ' '), ''), text)) AS kept_md5 FROM documents""")
def noise_strip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.without_noise(F.col("text"))).alias("kept_md5"))


@query("SELECT event_id, CASE WHEN h > 0 THEN h::VARCHAR || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') ELSE lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') END AS clock FROM (SELECT event_id, x // 3600 AS h, x % 3600 // 60 AS m, x % 60 AS s FROM (SELECT event_id, floor(greatest(value * 60, 0))::BIGINT AS x FROM events))")
def clock_format(spark, sf):
    return table(spark, sf, "events").select("event_id", T.clock(F.col("value") * 60).alias("clock"))


# --- corpus -----------------------------------------------------------------------------------


@query(f"WITH {VERSES} SELECT chapter, verse, text, norm, skeleton, len(tokens)::BIGINT AS n_tokens FROM corpus")
def corpus_verses(spark, sf):
    return corpus(spark, sf).select("chapter", F.col("verse").cast("long").alias("verse"), "text", "norm", "skeleton", F.size("tokens").cast("long").alias("n_tokens"))


@query(f"WITH {VERSES} SELECT count(*) AS verses, count(DISTINCT chapter) AS chapters, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM corpus)) AS unique_tokens, max(len(tokens))::BIGINT AS max_tokens FROM corpus")
def corpus_stats(spark, sf):
    return C.stats(corpus(spark, sf))


@query(f"WITH {VERSES} SELECT t AS token, count(*) AS df FROM (SELECT DISTINCT v_idx, unnest(tokens) AS t FROM corpus) GROUP BY t")
def token_df(spark, sf):
    return C.document_frequency(corpus(spark, sf))


@query(f"WITH {VERSES} SELECT chapter, verse, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM corpus")
def token_positions(spark, sf):
    return C.positions(corpus(spark, sf)).select("chapter", F.col("verse").cast("long").alias("verse"), "token", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {VERSES} SELECT s AS token, count(*) AS df FROM (SELECT DISTINCT v_idx, {SKEL.format('t')} AS s FROM (SELECT v_idx, unnest(tokens) AS t FROM corpus)) WHERE s <> '' GROUP BY s")
def skeleton_postings(spark, sf):
    return C.document_frequency(corpus(spark, sf), skeletons=True)


@query(f"WITH {SENTENCES} SELECT norm AS key, count(*) AS n, count(DISTINCT doc_id) AS docs FROM sentences GROUP BY norm HAVING count(*) > 1")
def exact_key_dupes(spark, sf):
    return sentences(spark, sf).groupBy(F.col("norm").alias("key")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).filter("n > 1")


@query(f"WITH {VERSES} SELECT a.chapter, a.verse, b.norm AS next_norm FROM corpus a LEFT JOIN corpus b ON a.chapter = b.chapter AND b.verse = a.verse + 1")
def next_verse(spark, sf):
    return C.following(corpus(spark, sf), "chapter", "verse", ["norm"]).select("chapter", F.col("verse").cast("long").alias("verse"), "next_norm")


@query("SELECT a.conv_id, a.turn, a.role, b.role AS next_role, length(b.text) AS next_length FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def next_turn(spark, sf):
    return C.following(table(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"]).select("conv_id", "turn", "role", "next_role", F.length("next_text").cast("long").alias("next_length"))


# --- matching ---------------------------------------------------------------------------------


@query(f"WITH {VERSES}, {SENTENCES} SELECT doc_id, pos, chapter, verse, count(*) OVER (PARTITION BY doc_id, pos) AS occurrences FROM sentences JOIN corpus USING (norm)")
def exact_match(spark, sf):
    keys = C.exact_keys(corpus(spark, sf))
    hits = sentences(spark, sf).join(keys, F.col("norm") == F.col("key"))
    return hits.select("doc_id", F.col("pos").cast("long").alias("pos"), "chapter", F.col("verse").cast("long").alias("verse"), F.count("*").over(Window.partitionBy("doc_id", "pos")).alias("occurrences"))


@query(f"WITH {VERSES}, {FOUND} SELECT doc_id, chapter, verse, start, size FROM found")
def verses_in_documents(spark, sf):
    return found_verses(spark, sf).select("doc_id", "chapter", F.col("verse").cast("long").alias("verse"), F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))


@query(f"WITH {VERSES}, {SENTENCES} SELECT doc_id, pos, chapter, verse FROM (SELECT doc_id, pos, {SKEL.format('norm')} AS skeleton FROM sentences) JOIN corpus USING (skeleton) WHERE length(skeleton) >= 4")
def skeleton_match(spark, sf):
    s = sentences(spark, sf).select("doc_id", "pos", T.skeleton_of(F.col("norm"), T.LATIN).alias("skeleton")).filter(F.length("skeleton") >= 4)
    return s.join(corpus(spark, sf).select("skeleton", "chapter", "verse"), "skeleton").select("doc_id", F.col("pos").cast("long").alias("pos"), "chapter", F.col("verse").cast("long").alias("verse"))


HALF = "array_to_string(list_slice(tokens, 1, (len(tokens) + 1) // 2), ' ')"


@query(f"""WITH {VERSES}, q AS (SELECT v_idx AS id, {HALF} AS q FROM corpus WHERE len(tokens) >= 2),
h AS (SELECT id, chapter, verse, v_idx, CASE WHEN length(q) / length(norm) >= 0.6 THEN 85 WHEN length(q) / length(norm) >= 0.4 THEN 75 ELSE 70 END AS s FROM q JOIN corpus ON starts_with(norm, q || ' '))
SELECT id, arg_min(chapter, v_idx) AS chapter, arg_min(verse, v_idx) AS verse, count(*) AS occurrences, CASE WHEN count(*) > 1 THEN least(max(s), 92) ELSE max(s) END::BIGINT AS confidence FROM h GROUP BY id""")
def prefix_match(spark, sf):
    half = lambda text, toks: F.when(F.size(toks) >= 2, F.array_join(F.slice(toks, F.lit(1), F.floor((F.size(toks) + 1) / 2).cast("int")), " ")).otherwise("")
    hits = match.prefix(verse_candidates(spark, sf, half).filter(F.size("tokens") > 0), corpus(spark, sf))
    return hits.select("id", "chapter", F.col("verse").cast("long").alias("verse"), "occurrences", F.col("confidence").cast("long").alias("confidence"))


INNER = "array_to_string(list_slice(tokens, 2, len(tokens) - 1), ' ')"


@query(f"""WITH {VERSES}, q AS (SELECT v_idx AS id, {INNER} AS q FROM corpus WHERE len(tokens) >= 4)
SELECT id, chapter, verse, len(string_split(substr(' ' || norm || ' ', 1, instr(' ' || norm || ' ', ' ' || q || ' ')), ' ')) - 2 AS start FROM q JOIN corpus ON contains(' ' || norm || ' ', ' ' || q || ' ')""")
def substring_match(spark, sf):
    inner = lambda text, toks: F.when(F.size(toks) >= 4, F.array_join(F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 2, F.lit(0))), " ")).otherwise("")
    hits = match.run_hits(verse_candidates(spark, sf, inner), corpus(spark, sf))
    return hits.select("id", "chapter", F.col("verse").cast("long").alias("verse"), F.col("start").cast("long").alias("start"))


@query(f"""WITH {SENTENCES}, g AS (SELECT norm, doc_id, pos, row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) AS place, count(*) OVER (PARTITION BY norm) AS occurrences FROM sentences)
SELECT doc_id, pos, place, occurrences FROM g WHERE occurrences > 1 AND place <= 60""")
def repeated_runs(spark, sf):
    own = Window.partitionBy("norm").orderBy("doc_id", "pos")
    n = sentences(spark, sf).groupBy("norm").agg(F.count("*").alias("occurrences")).filter("occurrences > 1")
    g = sentences(spark, sf).join(n, "norm").withColumn("place", F.row_number().over(own)).filter("place <= 60")
    return g.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("place").cast("long").alias("place"), "occurrences")


@query(f"""WITH {SENTENCES}, n AS (SELECT norm, count(*) AS occurrences, min(doc_id) AS first_doc FROM sentences GROUP BY norm)
SELECT doc_id, count(*) AS sentences, sum((occurrences > 1)::INT)::BIGINT AS ambiguous, sum((doc_id <> first_doc)::INT)::BIGINT AS seen_before FROM sentences JOIN n USING (norm) GROUP BY doc_id""")
def ambiguity_flags(spark, sf):
    s = sentences(spark, sf).select("doc_id", "norm")
    n = s.groupBy("norm").agg(F.count("*").alias("occurrences"), F.min("doc_id").alias("first_doc"))
    j = s.join(n, "norm")
    return j.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum((F.col("occurrences") > 1).cast("int")).alias("ambiguous"), F.sum((F.col("doc_id") != F.col("first_doc")).cast("int")).alias("seen_before"))


PICK = f"""WITH {VERSES}, q AS (SELECT c.v_idx AS id, c.tokens[1] AS token, c.chapter + 1 AS hint_chapter, c.verse + 2 AS hint_verse FROM corpus c),
h AS (SELECT id, chapter, verse, v_idx, hint_verse, chapter = hint_chapter AS own FROM q JOIN (SELECT DISTINCT v_idx, chapter, verse, unnest(tokens) AS token FROM corpus) USING (token)),
a AS (SELECT *, bool_or(own) OVER (PARTITION BY id) AS any_own, count(*) OVER (PARTITION BY id) AS occurrences FROM h),
p AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, min(abs(verse - hint_verse)) OVER (PARTITION BY id) AS nearest FROM a WHERE NOT any_own OR own),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN n > 1 AND nearest <= 3 THEN abs(verse - hint_verse) ELSE 0 END, v_idx) AS place FROM p)
SELECT id, chapter, verse, occurrences, (any_own OR (n > 1 AND nearest <= 3)) AS resolved FROM r WHERE place = 1"""


@query(PICK)
def occurrence_pick(spark, sf):
    v = corpus(spark, sf)
    q = v.select(F.col("v_idx").alias("id"), F.col("tokens")[0].alias("token"), (F.col("chapter") + 1).alias("hint_chapter"), (F.col("verse") + 2).alias("hint_verse"))
    return match.picked(q.join(C.postings(v), "token")).select("id", "chapter", F.col("verse").cast("long").alias("verse"), "occurrences", "resolved")


@query(f"""WITH {VERSES}, p AS (SELECT DISTINCT v_idx, unnest(tokens) AS token FROM corpus), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
k AS (SELECT p.v_idx AS id, token, df, row_number() OVER (PARTITION BY p.v_idx ORDER BY df, token) AS rank FROM p JOIN d USING (token)),
h AS (SELECT id, p.v_idx, count(*) AS score, min(rank) AS first FROM k JOIN p USING (token) WHERE rank <= 6 AND df <= 1500 GROUP BY id, p.v_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first, v_idx) AS place FROM h)
SELECT id, v_idx, score, place FROM r WHERE place <= 400""")
def rarest_token_candidates(spark, sf):
    v = corpus(spark, sf)
    out = C.ranked_candidates(v.select(F.col("v_idx").alias("id"), "tokens"), v)
    return out.select("id", "v_idx", "score", F.col("place").cast("long").alias("place"))


WORDS = "words AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part)"


@query(f"""WITH {WORDS}, e AS (SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w) AS d FROM words a JOIN words b ON left(a.w, 1) = left(b.w, 1) AND a.w < b.w)
SELECT a, b, d::BIGINT AS distance, (greatest(length(a), length(b)) >= 4 AND abs(length(a) - length(b)) <= 2 AND d <= CASE WHEN greatest(length(a), length(b)) >= 7 THEN 2 ELSE 1 END) AS near FROM e""")
def token_similarity(spark, sf):
    w = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct().withColumn("k", F.substring("w", 1, 1))
    a, b = w.select(F.col("w").alias("a"), "k"), w.select(F.col("w").alias("b"), "k")
    return a.join(b, "k").filter("a < b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), T.near_token(F.col("a"), F.col("b")).alias("near"))


@query("""WITH n AS (SELECT lower(p_name) AS p, min(p_partkey) AS k FROM part GROUP BY 1), t AS (SELECT p, unnest(list_distinct(string_split(p, ' '))) AS w FROM n),
e AS (SELECT DISTINCT a.p AS a, b.p AS b FROM t a JOIN t b USING (w) WHERE a.p < b.p)
SELECT a, b, round(0.5 * len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) + 0.5 * (1 - levenshtein(a, b) / greatest(length(a), length(b))), 6) AS similarity FROM e""")
def blended_similarity(spark, sf):
    n = table(spark, sf, "part").select(F.lower("p_name").alias("p")).distinct()
    t = n.select("p", F.explode(F.array_distinct(F.split("p", " "))).alias("w"))
    e = t.select(F.col("p").alias("a"), "w").join(t.select(F.col("p").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()
    return e.select("a", "b", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


# --- the picks of single strategies ---------------------------------------------------------------


def sentence_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of the documents as a candidate; id is doc_id * 1000000 + pos."""
    return match.candidates(sentences(spark, sf).select((F.col("doc_id") * 1000000 + F.col("pos")).alias("id"), "text"), T.LATIN)


def _pick(hits: DataFrame) -> DataFrame:
    return hits.select("id", "chapter", F.col("verse").cast("long").alias("verse"), "occurrences", F.col("confidence").cast("long").alias("confidence"))


PICKED = "SELECT id, arg_min(chapter, v_idx) AS chapter, arg_min(verse, v_idx) AS verse, count(*) AS occurrences, CASE WHEN count(*) > 1 THEN 92 ELSE {} END::BIGINT AS confidence FROM h GROUP BY id"


@query(f"WITH {VERSES}, {SENTENCES}, h AS (SELECT doc_id * 1000000 + pos AS id, chapter, verse, v_idx FROM sentences JOIN corpus USING (norm)) {PICKED.format(100)}")
def exact_pick(spark, sf):
    return _pick(match.exact(sentence_candidates(spark, sf), corpus(spark, sf)))


@query(f"WITH {VERSES}, {SENTENCES}, s AS (SELECT doc_id * 1000000 + pos AS id, {SKEL.format('norm')} AS skeleton FROM sentences), h AS (SELECT id, chapter, verse, v_idx FROM s JOIN corpus USING (skeleton) WHERE length(skeleton) >= 4) {PICKED.format(97)}")
def skeleton_pick(spark, sf):
    return _pick(match.by_skeleton(sentence_candidates(spark, sf), corpus(spark, sf)))


@query(f"""WITH {VERSES}, q AS (SELECT v_idx AS id, {INNER} AS q FROM corpus WHERE len(tokens) >= 4),
h AS (SELECT id, chapter, verse, v_idx FROM q JOIN corpus ON contains(' ' || norm || ' ', ' ' || q || ' ')) {PICKED.format(100)}""")
def contiguous_pick(spark, sf):
    inner = lambda text, toks: F.when(F.size(toks) >= 4, F.array_join(F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 2, F.lit(0))), " ")).otherwise("")
    return _pick(match.contiguous(verse_candidates(spark, sf, inner), corpus(spark, sf)))


@query(f"""WITH {VERSES}, q AS (SELECT v_idx AS id, tokens[1] || ' ' || tokens[2] AS q FROM corpus WHERE len(tokens) >= 2),
h AS (SELECT id, v_idx, row_number() OVER (PARTITION BY id ORDER BY v_idx) AS place FROM q JOIN corpus ON contains(' ' || norm || ' ', ' ' || q || ' ')) SELECT id, v_idx, place FROM h WHERE place <= 60""")
def repeated_run_hits(spark, sf):
    two = lambda text, toks: F.when(F.size(toks) >= 2, F.array_join(F.slice(toks, 1, 2), " ")).otherwise("")
    return match.repeated_runs(verse_candidates(spark, sf, two), corpus(spark, sf)).select("id", "v_idx", F.col("place").cast("long").alias("place"))


SKELS = f"list_transform({{}}, lambda t: {SKEL.format('t')})"


@query(f"""WITH {VERSES}, {SENTENCES}, w AS (SELECT doc_id * 1000000 + pos AS id, string_split(norm, ' ') AS w FROM sentences WHERE norm <> ''),
a AS (SELECT id, w, sw, unnest(range(1, len(w) + 1)) AS p FROM (SELECT id, w, {SKELS.format('w')} AS sw FROM w)), c AS (SELECT chapter, verse, tokens, {SKELS.format('tokens')} AS s FROM corpus)
SELECT id, p - 1 AS pos, chapter, verse, len(tokens)::BIGINT AS size FROM a JOIN c ON a.sw[a.p] = c.s[1] AND (list_slice(w, p, p + len(tokens) - 1) = tokens OR (list_slice(sw, p, p + len(s) - 1) = s AND NOT list_contains(s, '')))""")
def verse_runs(spark, sf):
    """Verses, by words or by skeletons, within the sentences of the documents."""
    out = match.verse_runs(sentence_candidates(spark, sf), corpus(spark, sf))
    return out.select("id", F.col("pos").cast("long").alias("pos"), "chapter", F.col("verse").cast("long").alias("verse"), F.col("size").cast("long").alias("size"))


@query(f"WITH {VERSES} SELECT chapter, verse, norm FROM corpus")
def corpus_by_key(spark, sf):
    return C.by_key(corpus(spark, sf)).select("chapter", F.col("verse").cast("long").alias("verse"), "norm")


@query(f"""WITH {VERSES}, q AS (SELECT v_idx AS id, list_concat(list_slice(tokens, 1, 2), [tokens[3] || 'x'], list_slice(tokens, 4, len(tokens))) AS q FROM corpus WHERE len(tokens) >= 5),
g AS (SELECT id, q, unnest(range(1, len(q) - 1)) AS spot FROM q), s AS (SELECT v_idx, chapter, verse, tokens, unnest(range(0, len(tokens) - 2)) AS p FROM corpus WHERE len(tokens) >= 3)
SELECT id, chapter, verse, p - spot + 1 AS start, spot AS place, tokens[p + 2] AS word FROM g JOIN s ON q[spot] = tokens[p + 1] AND q[spot + 2] = tokens[p + 3]
WHERE p - spot + 1 >= 0 AND p - spot + 1 + len(q) <= len(tokens) AND list_slice(tokens, p - spot + 2, p + 1) = list_slice(q, 1, spot) AND list_slice(tokens, p + 3, p - spot + 1 + len(q)) = list_slice(q, spot + 2, len(q))
  AND q[spot + 1] <> tokens[p + 2] AND 1 - levenshtein(q[spot + 1], tokens[p + 2]) / greatest(length(q[spot + 1]), length(tokens[p + 2])) >= 0.5""")
def substituted_word(spark, sf):
    other = lambda text, toks: F.when(F.size(toks) >= 5, F.array_join(F.transform(toks, lambda t, i: F.when(i == 2, F.concat(t, F.lit("x"))).otherwise(t)), " ")).otherwise("")
    hits = match.one_substituted(verse_candidates(spark, sf, other), corpus(spark, sf))
    return hits.select("id", "chapter", F.col("verse").cast("long").alias("verse"), F.col("start").cast("long").alias("start"), F.col("at").cast("long").alias("place"), "word")




@query(f"""WITH RECURSIVE {VERSES},
l AS (SELECT chapter, verse, list_concat(list_slice(tokens, 1, 2), CASE WHEN len(tokens) >= 5 THEN list_slice(tokens, 4, len(tokens)) ELSE list_slice(tokens, 3, len(tokens)) END) AS lost,
  CASE WHEN len(tokens) >= 5 AND regexp_matches(tokens[2], '^...+[a-z]$') THEN list_concat(list_concat([tokens[1]], [left(tokens[2], length(tokens[2]) - 1) || 'q']), list_slice(tokens, 3, len(tokens))) ELSE tokens END AS typed FROM corpus),
q AS (SELECT a.chapter * 1000000 + a.verse AS id, list_concat(list_concat(a.lost, b.typed), c.lost) AS q FROM l a JOIN l b ON b.chapter = a.chapter AND b.verse = a.verse + 1 JOIN l c ON c.chapter = a.chapter AND c.verse = a.verse + 2),
forms AS (SELECT chapter, verse, tokens AS w, 0 AS e FROM corpus UNION ALL
  SELECT chapter, verse, list_concat(list_slice(tokens, 1, k - 1), list_slice(tokens, k + 1, len(tokens))), 1 FROM (SELECT chapter, verse, tokens, unnest(range(1, len(tokens) + 1)) AS k FROM corpus WHERE len(tokens) > 1)),
state AS (
  SELECT id, 0 AS pos, 0 AS chapter, 0::BIGINT AS verse, 0 AS edits, 0 AS breaks, 0 AS verses, 0 AS first_chapter, 0::BIGINT AS first_verse FROM q
  UNION
  SELECT id, pos + len(w), chapter, verse, edits + t, breaks + CASE WHEN verses = 0 OR follows THEN 0 ELSE 1 END, verses + 1, CASE WHEN verses = 0 THEN chapter ELSE first_chapter END, CASE WHEN verses = 0 THEN verse ELSE first_verse END
  FROM (SELECT s.id, s.pos, f.w, f.chapter, f.verse, s.edits, s.breaks, s.verses, s.first_chapter, s.first_verse, f.chapter = s.chapter AND f.verse = s.verse + 1 AS follows,
      f.e + list_sum(list_transform(range(1, len(f.w) + 1), lambda i: CASE WHEN f.w[i] = q.q[s.pos + i] THEN 0 WHEN {NEAR_SQL.format('f.w[i]', 'q.q[s.pos + i]')} THEN 1 ELSE 99 END)) AS t
    FROM state s JOIN q ON q.id = s.id JOIN forms f ON f.w[1] = q.q[s.pos + 1] AND len(f.w) <= len(q.q) - s.pos) x
  WHERE t <= 2 AND edits + t <= 3),
ends AS (SELECT s.* FROM state s JOIN q ON q.id = s.id WHERE s.pos = len(q.q))
SELECT id, edits, breaks, verses, first_chapter AS chapter, first_verse FROM ends QUALIFY row_number() OVER (PARTITION BY id ORDER BY edits, breaks, verses, first_chapter, first_verse) = 1""")
def repaired_chains(spark, sf):
    """Three neighbouring verses as one quotation, the third word of the first and last lost and a typing error in the second one's second word."""
    v = kept(corpus(spark, sf), "corpus")
    lost = F.when(F.size("tokens") >= 5, F.filter("tokens", lambda t, i: i != 2)).otherwise(F.col("tokens"))
    typed = F.when((F.size("tokens") >= 5) & F.col("tokens")[1].rlike("^...+[a-z]$"), F.transform("tokens", lambda t, i: F.when(i == 1, F.concat(F.expr("substring(tokens[1], 1, length(tokens[1]) - 1)"), F.lit("q"))).otherwise(t))).otherwise(F.col("tokens"))
    made = v.withColumn("lost", F.array_join(lost, " ")).withColumn("typed", F.array_join(typed, " "))
    three = C.following(C.following(made, "chapter", "verse", ["lost", "typed"]), "chapter", "verse", ["next_lost"]).filter("next_typed is not null and next_next_lost is not null")
    quotes = three.select(F.col("v_idx").alias("id"), F.concat_ws(" ", "lost", "next_typed", "next_next_lost").alias("text"))
    cands = kept(match.candidates(quotes, T.LATIN), "candidates")
    out = chain.linked(cands, v, kept(match.verse_runs(cands, v), "runs"), kept, repair=True)
    first = F.col("steps")[0]
    return out.select("id", "edits", "breaks", F.size("steps").alias("verses"), first["chapter"].alias("chapter"), first["verse"].cast("long").alias("first_verse"))


def _swapped(text, toks):
    """The second word reversed."""
    return F.when(F.size(toks) >= 4, F.array_join(F.transform(toks, lambda t, i: F.when(i == 1, F.reverse(t)).otherwise(t)), " ")).otherwise("")


#: Letters of one byte each, as DuckDB's distance counts bytes.
ONE_BYTE = "translate({}, 'ßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()')"


@query(f"""WITH {VERSES}, q AS (SELECT v_idx AS id, list_concat(list_concat([tokens[1]], [reverse(tokens[2])]), list_slice(tokens, 3, len(tokens))) AS q FROM corpus WHERE len(tokens) >= 4),
p AS (SELECT DISTINCT v_idx, unnest(tokens) AS token FROM corpus), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
k AS (SELECT id, token, df, row_number() OVER (PARTITION BY id ORDER BY df, token) AS rank, min(df) OVER (PARTITION BY id) AS least FROM (SELECT DISTINCT id, unnest(q) AS token FROM q) JOIN d USING (token)),
h AS (SELECT id, p.v_idx, count(*) AS score, min(rank) AS first FROM k JOIN p USING (token) WHERE rank <= 6 AND (df <= 1500 OR rank = 1 AND least > 1500) GROUP BY id, p.v_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first, v_idx) AS place FROM h),
w AS (SELECT r.id, v_idx, chapter, verse, q, start, list_slice(tokens, start + 1, start + len(q)) AS w FROM (SELECT r.id, r.v_idx, c.chapter, c.verse, c.tokens, q.q, unnest(range(0, len(c.tokens) - len(q.q) + 1)) AS start FROM r JOIN q USING (id) JOIN corpus c ON c.v_idx = r.v_idx WHERE place <= 300) r),
t AS (SELECT id, v_idx, chapter, verse, start, q, w, {ONE_BYTE.format("array_to_string(q, ' ')")} AS a, {ONE_BYTE.format("array_to_string(w, ' ')")} AS b FROM w),
l AS (SELECT *, levenshtein(a, b) AS dist, len(list_intersect(list_distinct(q), list_distinct(w))) AS shared, greatest(length(a), length(b)) AS longer FROM t WHERE abs(length(a) - length(b)) <= 0.4 * greatest(length(a), length(b))),
s AS (SELECT id, v_idx, chapter, verse, start, least(100, 100 * (CASE WHEN a = b THEN 1 ELSE 0.5::DOUBLE * (shared / (len(list_distinct(q)) + len(list_distinct(w)) - shared)) + 0.5::DOUBLE * (1 - dist / longer) END) + CASE WHEN dist <= 2 THEN 10 ELSE 0 END) AS score FROM l)
SELECT id, v_idx, chapter, verse, start, floor(score + 0.5)::BIGINT AS confidence FROM s WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, v_idx, start) = 1""")
def fuzzy_window(spark, sf):
    hits = alike.fuzzy(verse_candidates(spark, sf, _swapped), corpus(spark, sf))
    return hits.select("id", "v_idx", "chapter", F.col("verse").cast("long").alias("verse"), F.col("start").cast("long").alias("start"), F.col("confidence").cast("long").alias("confidence"))


@query(f"""WITH {VERSES}, {SENTENCES}, k AS (SELECT DISTINCT unnest(tokens) AS near FROM corpus),
w AS (SELECT DISTINCT x[2] AS word FROM (SELECT string_split(norm, ' ') AS x FROM sentences) WHERE len(x) >= 2)
SELECT word, near FROM (SELECT word, near, {ONE_BYTE.format('word')} AS a, {ONE_BYTE.format('near')} AS b FROM w JOIN k ON word <> near AND abs(length(word) - length(near)) <= 2 AND greatest(length(word), length(near)) >= 4)
WHERE {NEAR_SQL.format('a', 'b')}""")
def near_words(spark, sf):
    """Second words of the documents' sentences and the corpus's words a typing error apart."""
    words = sentences(spark, sf).select(F.split("norm", " ").alias("x")).filter(F.size("x") >= 2).select(F.col("x")[1].alias("word"))
    return alike.near_words(words, corpus(spark, sf).select(F.explode("tokens").alias("word")))


def _without_third(text, toks):
    return F.when(F.size(toks) >= 5, F.array_join(F.filter(toks, lambda t, i: i != 2), " ")).otherwise("")


@query(f"""WITH {VERSES}, q AS (SELECT v_idx AS id, list_concat(list_slice(tokens, 1, 2), list_slice(tokens, 4, len(tokens))) AS q FROM corpus WHERE len(tokens) >= 5),
g AS (SELECT id, q, unnest(range(1, len(q))) AS gap FROM q),
s AS (SELECT v_idx, chapter, verse, tokens, unnest(range(0, len(tokens) - 2)) AS p FROM corpus WHERE len(tokens) >= 3)
SELECT id, chapter, verse, p - gap + 1 AS start, gap, tokens[p + 2] AS missing FROM g JOIN s ON q[gap] = tokens[p + 1] AND q[gap + 1] = tokens[p + 3]
WHERE p - gap + 1 >= 0 AND p - gap + 1 + len(q) + 1 <= len(tokens) AND list_slice(tokens, p - gap + 2, p + 1) = list_slice(q, 1, gap) AND list_slice(tokens, p + 3, p - gap + 2 + len(q)) = list_slice(q, gap + 1, len(q))""")
def missing_word(spark, sf):
    hits = match.one_missing(verse_candidates(spark, sf, _without_third), corpus(spark, sf))
    return hits.select("id", "chapter", F.col("verse").cast("long").alias("verse"), F.col("start").cast("long").alias("start"), F.col("gap").cast("long").alias("gap"), "missing")


#: Recursive walks: `run` takes each place of a first word to the leftmost next place of each word behind it.
GAPPED = """run AS (
  SELECT id, q, c.v_idx, c.chapter, c.verse, c.tokens, s AS first, 1 AS k, s AS last FROM q JOIN (SELECT *, unnest(tokens) AS token, unnest(range(len(tokens))) AS s FROM corpus) c ON c.token = q.q[1]
  UNION ALL
  SELECT id, q, v_idx, chapter, verse, tokens, first, k + 1, last + list_position(list_slice(tokens, last + 2, len(tokens)), q[k + 1]) FROM run WHERE k < len(q) AND list_contains(list_slice(tokens, last + 2, len(tokens)), q[k + 1])),
behind AS (
  SELECT id, q, v_idx, chapter, verse, tokens, first, k AS gap, last AS before, k + 1 + {skip} AS k, last + 2 AS last FROM run WHERE k + 1 + {skip} <= len(q) AND tokens[last + 3] = q[k + 1 + {skip}]
  UNION ALL
  SELECT id, q, v_idx, chapter, verse, tokens, first, gap, before, k + 1, last + list_position(list_slice(tokens, last + 2, len(tokens)), q[k + 1]) FROM behind WHERE k < len(q) AND list_contains(list_slice(tokens, last + 2, len(tokens)), q[k + 1])),
hit AS (SELECT id, q, v_idx, chapter, verse, first AS start, last - first + 1 AS size, gap, tokens[before + 2] AS word, (gap / (before - first + 1) + (len(q) - gap - {skip}) / (last - before - 1)) / 2 AS score FROM behind WHERE k = len(q)),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY id, gap ORDER BY score DESC, v_idx, start) = 1)"""


@query(f"""WITH RECURSIVE {VERSES}, q AS (SELECT v_idx AS id, list_concat(list_concat(list_slice(tokens, 1, 2), list_slice(tokens, 4, 5)), list_slice(tokens, 7, len(tokens))) AS q FROM corpus WHERE len(tokens) >= 7),
{GAPPED.format(skip=0)}
SELECT id, chapter, verse, start, size::BIGINT AS size, gap::BIGINT AS gap, word, floor(score * 1000000 + 0.5)::BIGINT AS millionths FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap) = 1""")
def gapped_missing(spark, sf):
    """Verses without their third and sixth word: two runs with one word between, and a gap in one of them."""
    toks = corpus(spark, sf).filter(F.size("tokens") >= 7).select(F.col("v_idx").alias("id"), F.array_join(F.filter("tokens", lambda t, i: (i != 2) & (i != 5)), " ").alias("text"))
    hits = gapped.one_word_between(match.candidates(toks, T.LATIN), corpus(spark, sf))
    return _gapped_columns(hits)


@query(f"""WITH RECURSIVE {VERSES}, q AS (SELECT v_idx AS id, list_concat(list_concat(list_slice(tokens, 1, 2), [left(tokens[3], length(tokens[3]) - 1) || 'q']), list_concat(list_slice(tokens, 4, 4), list_slice(tokens, 6, len(tokens)))) AS q FROM corpus WHERE len(tokens) >= 7),
{GAPPED.format(skip=1)}
SELECT id, chapter, verse, start, size::BIGINT AS size, gap::BIGINT AS gap, word, floor(score * 1000000 + 0.5)::BIGINT AS millionths FROM best
WHERE 1 - levenshtein({ONE_BYTE.format('q[gap + 1]')}, {ONE_BYTE.format('word')}) / greatest(length(q[gap + 1]), length(word)) >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap) = 1""")
def gapped_substituted(spark, sf):
    """Verses with a typing error in the third word and without the fifth."""
    toks = F.transform(F.filter("tokens", lambda t, i: i != 4), lambda t, i: F.when(i == 2, F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("q"))).otherwise(t))
    made = corpus(spark, sf).filter(F.size("tokens") >= 7).select(F.col("v_idx").alias("id"), F.array_join(toks, " ").alias("text"))
    return _gapped_columns(gapped.one_word_between(match.candidates(made, T.LATIN), corpus(spark, sf), mistaken=True))


def _gapped_columns(hits: DataFrame) -> DataFrame:
    return hits.select("id", "chapter", *(F.col(c).cast("long").alias(c) for c in ("verse", "start", "size")), F.col("at").cast("long").alias("gap"), "word", F.floor(F.col("score") * 1000000 + 0.5).alias("millionths"))


@query(f"""WITH RECURSIVE {VERSES}, q AS (SELECT v_idx AS id, list_filter(list_transform(tokens, lambda t, i: CASE WHEN i % 2 = 0 THEN t END), lambda t: t IS NOT NULL) AS q FROM corpus WHERE len(tokens) >= 4),
{GAPPED.format(skip=0)}
SELECT id, chapter, verse, first, last, floor(1000000 * k / (last - first + 1) + 0.5)::BIGINT AS millionths FROM run WHERE k = len(q) AND first > 0""")
def gapped_sequences(spark, sf):
    """Every second word of a verse, as a run with gaps behind at least one word."""
    made = corpus(spark, sf).filter(F.size("tokens") >= 4).select(F.col("v_idx").alias("id"), F.array_join(F.filter("tokens", lambda t, i: i % 2 == 1), " ").alias("text"))
    hits = gapped.sequences(match.candidates(made, T.LATIN), corpus(spark, sf), backward=True)
    return hits.select("id", "chapter", *(F.col(c).cast("long").alias(c) for c in ("verse", "first", "last")), F.floor(F.col("coverage") * 1000000 + 0.5).alias("millionths"))


@query(f"""WITH {VERSES}, k AS (SELECT DISTINCT unnest(tokens) AS token FROM corpus), w AS (SELECT v_idx AS id, unnest(tokens) AS word, unnest(range(len(tokens))) AS p FROM corpus),
c AS (SELECT id, p, word, unnest(range(1, length(word))) AS cut FROM w WHERE length(word) >= 5)
SELECT id, p AS place, cut, left(word, cut) || ' ' || substr(word, cut + 1) AS pair FROM c WHERE left(word, cut) IN (SELECT token FROM k) AND substr(word, cut + 1) IN (SELECT token FROM k)""")
def glued_word(spark, sf):
    hits = match.unglued(verse_candidates(spark, sf), corpus(spark, sf))
    return hits.select("id", F.col("at").cast("long").alias("place"), F.col("cut").cast("long").alias("cut"), F.expr("concat(tokens[at], ' ', tokens[at + 1])").alias("pair"))


@query(f"""WITH {VERSES}, k AS (SELECT DISTINCT unnest(tokens) AS token FROM corpus), p AS (SELECT v_idx AS id, tokens, unnest(range(0, len(tokens) - 1)) AS i FROM corpus WHERE len(tokens) >= 2)
SELECT id, i AS place, tokens[i + 1] || tokens[i + 2] AS word FROM p WHERE tokens[i + 1] || tokens[i + 2] IN (SELECT token FROM k)""")
def split_word(spark, sf):
    hits = match.rejoined(verse_candidates(spark, sf), corpus(spark, sf))
    return hits.select("id", F.col("at").cast("long").alias("place"), F.expr("tokens[at]").alias("word"))


@query(f"""WITH {VERSES}, {FOUND}, s AS (SELECT *, start - coalesce((SELECT sum(len(x.tokens)) FROM corpus x WHERE x.chapter = found.chapter AND x.verse < found.verse), 0) AS origin FROM found),
i AS (SELECT *, verse - row_number() OVER (PARTITION BY doc_id, chapter, origin ORDER BY verse) AS island FROM s)
SELECT doc_id, chapter, min(verse) AS first_verse, max(verse) AS last_verse, count(*) AS n_verses, min(start) AS start FROM i GROUP BY doc_id, chapter, origin, island""")
def chain_runs(spark, sf):
    runs = found_verses(spark, sf).select(F.col("doc_id").alias("id"), F.col("start").alias("pos"), "v_idx", "chapter", "verse", "size", F.lit(0).alias("errors"))
    out = match.chains(None, corpus(spark, sf), runs=runs)
    return out.select(F.col("id").alias("doc_id"), "chapter", F.col("first_verse").cast("long").alias("first_verse"), F.col("last_verse").cast("long").alias("last_verse"), "n_verses", F.col("pos").cast("long").alias("start"))


@query(f"""WITH {VERSES}, n AS (SELECT a.v_idx AS id, a.chapter, a.verse FROM corpus a JOIN corpus b ON a.chapter = b.chapter AND b.verse = a.verse + 1)
SELECT id, chapter, verse AS first_verse, verse + 1 AS last_verse, 2::BIGINT AS n_verses, 100::BIGINT AS confidence FROM n""")
def chain_pairs(spark, sf):
    """Two neighbouring verses written as one quotation are read as that chain."""
    v = C.following(corpus(spark, sf), "chapter", "verse", ["text"]).filter("next_text is not null")
    cands = match.candidates(v.select(F.col("v_idx").alias("id"), F.concat_ws(" ", "text", "next_text").alias("text"), "chapter"), T.LATIN, chapter="chapter")
    out = match.whole_chains(cands, corpus(spark, sf)).filter("n_verses = 2 and not begun")
    return out.select("id", "chapter", F.col("first_verse").cast("long").alias("first_verse"), F.col("last_verse").cast("long").alias("last_verse"), "n_verses", F.col("confidence").cast("long").alias("confidence"))


@query(f"""WITH {VERSES}, {FOUND}, c AS (SELECT *, sum(CASE WHEN gap <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS cluster FROM (
  SELECT doc_id, chapter, start, start + size AS stop, start - lag(start + size) OVER (PARTITION BY doc_id ORDER BY start, start + size) AS gap FROM found)),
v AS (SELECT doc_id, cluster, chapter, count(*) AS votes, min(start) AS first FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY votes DESC, first) AS place FROM v)
SELECT doc_id, cluster::BIGINT AS cluster, chapter, votes FROM r WHERE place = 1 AND votes >= 2""")
def session_vote(spark, sf):
    facts = found_verses(spark, sf).select(F.col("doc_id").alias("row_index"), "chapter", "start", (F.col("start") + F.col("size")).alias("end"), F.lit(100).alias("confidence"))
    return review.cluster_votes(facts, 40).select(F.col("row_index").alias("doc_id"), "cluster", "chapter", "votes")


# --- extraction, rendering --------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, text FROM documents), s AS (
  SELECT doc_id, 0 AS kind, regexp_extract_all(text, '﴿([^﴿﴾]*)﴾', 1) AS l FROM t UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '«([^«»]*)»', 1) FROM t UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '<<([^<>]*)>>', 1) FROM t
  UNION ALL SELECT doc_id, 3, regexp_extract_all(text, '\{([^{}]*)\}', 1) FROM t UNION ALL SELECT doc_id, 4, regexp_extract_all(text, '\(([^()]*)\)', 1) FROM t)
SELECT doc_id, kind, n, trim(q) AS quote FROM (SELECT doc_id, kind, unnest(l) AS q, unnest(range(len(l))) AS n FROM s) WHERE length(trim(q)) > 1""")
def bracket_candidates(spark, sf):
    out = extract.flat_quotations(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "kind", F.col("n").cast("long").alias("n"), "quote")


@query(f"""WITH {VERSES}, {FOUND}, b AS (SELECT doc_id, start, start + size AS stop, max(start + size) OVER (PARTITION BY doc_id ORDER BY start, start + size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found),
i AS (SELECT *, sum(CASE WHEN start < before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT doc_id, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY doc_id, island""")
def overlap_merge(spark, sf):
    spans = found_verses(spark, sf).select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("stop"))
    return extract.islands(spans, ["doc_id"], "start", "stop")


@query(f"""WITH {VERSES} SELECT chapter, verse, '﴿' || text || '﴾ [سورة ' || chapter || ': ' || translate(verse::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ']' AS formatted FROM corpus""")
def render_reference(spark, sf):
    parts = F.array(F.struct("text", "verse"))
    return corpus(spark, sf).select("chapter", F.col("verse").cast("long").alias("verse"), render.reference(parts, render.chapter_name(None, F.col("chapter")), F.col("verse"), F.col("verse")).alias("formatted"))


def _sentence_facts(spark, sf) -> DataFrame:
    """A replacement for each document sentence that is a verse, as offsets of its first place in the text."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("source"))
    v = C.exact_keys(corpus(spark, sf)).groupBy("key").agg(F.min_by(F.struct("chapter", "verse"), "v_idx").alias("v"), F.count("*").alias("occurrences"))
    hits = sentences(spark, sf).join(v, F.col("norm") == F.col("key")).groupBy("doc_id", "text").agg(F.first("v").alias("v"), F.first("occurrences").alias("occurrences")).join(docs, "doc_id")
    at = F.instr("source", F.col("text")) - 1
    return hits.select(F.col("doc_id").alias("row_index"), at.alias("start"), (at + F.length("text")).alias("end"), F.col("text").alias("original"), F.concat(F.lit("﴿"), "text", F.lit("﴾")).alias("formatted"), F.col("v.chapter").alias("chapter"), F.col("v.verse").alias("verse"), F.when(F.col("occurrences") > 1, 92).otherwise(100).alias("confidence"), F.lit(1).alias("verse_count"), (F.col("occurrences") > 1).alias("ambiguous"), F.lit("format").alias("correction_type"))


FACTS = f"""{VERSES}, {SENTENCES}, k AS (SELECT norm, arg_min(chapter, v_idx) AS chapter, arg_min(verse, v_idx) AS verse, count(*) AS occurrences FROM corpus GROUP BY norm),
facts AS (SELECT DISTINCT s.doc_id AS row_index, instr(d.text, s.text) - 1 AS start, instr(d.text, s.text) - 1 + length(s.text) AS stop, s.text AS original, '﴿' || s.text || '﴾' AS formatted, chapter, verse, CASE WHEN occurrences > 1 THEN 92 ELSE 100 END AS confidence, occurrences > 1 AS ambiguous FROM sentences s JOIN k USING (norm) JOIN documents d ON d.doc_id = s.doc_id)"""


@query(f"WITH {FACTS} SELECT row_index, start, stop, original, formatted, chapter, verse, confidence::BIGINT AS confidence, ambiguous FROM facts")
def replacement_facts(spark, sf):
    return _sentence_facts(spark, sf).select("row_index", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "original", "formatted", "chapter", F.col("verse").cast("long").alias("verse"), F.col("confidence").cast("long").alias("confidence"), "ambiguous")


@query(f"WITH {FACTS} SELECT d.doc_id, (length(d.text) + 2 * coalesce(n, 0))::BIGINT AS new_length, coalesce(n, 0) AS n_applied FROM documents d LEFT JOIN (SELECT row_index, count(*) AS n FROM facts GROUP BY 1) f ON d.doc_id = f.row_index")
def splice_replacements(spark, sf):
    facts = _sentence_facts(spark, sf).withColumnRenamed("row_index", "doc_id")
    out = render.apply_replacements(table(spark, sf, "documents"), facts, "doc_id", "text")
    return out.select("doc_id", F.length("new_text").cast("long").alias("new_length"), F.col("n_applied").cast("long").alias("n_applied"))


# --- review -----------------------------------------------------------------------------------


@query(f"WITH {FACTS} SELECT count(DISTINCT row_index) AS modified_rows, count(*) AS replacements, count(*) AS verses, count(*) AS single, 0::BIGINT AS multi, coalesce(sum((confidence < 80)::INT), 0)::BIGINT AS low, coalesce(sum(ambiguous::INT), 0)::BIGINT AS ambiguous, coalesce(floor(avg(confidence) + 0.5), 0)::BIGINT AS average_confidence FROM facts")
def report_stats(spark, sf):
    return review.statistics(_sentence_facts(spark, sf))


@query(f"WITH {FACTS} SELECT row_index, original FROM facts WHERE contains(lower(original), 'the') OR contains(lower(formatted), 'the')")
def report_search(spark, sf):
    found = review.searched(review.filtered(_sentence_facts(spark, sf), "changed"), "the", T.LATIN)
    return found.filter(F.lower("original").contains("the")).select("row_index", "original")


@query(f"WITH {FACTS} SELECT row_index, start, original FROM facts ORDER BY row_index, start, original LIMIT 20 OFFSET 20")
def report_page(spark, sf):
    index = review.page_index(_sentence_facts(spark, sf), [F.col("row_index"), F.col("start"), F.col("original")], f"{shared_folder(spark)}/page-index-{uuid.uuid4().hex}", kept)
    return review.page_of(index, 2, 20).select("row_index", F.col("start").cast("long").alias("start"), "original")


@query(f"WITH {FACTS}, r AS (SELECT * FROM facts WHERE length(original) % 3 = 0) SELECT row_index, original FROM facts WHERE {NORM.format('original')} NOT IN (SELECT {NORM.format('original')} FROM r)")
def approval_filter(spark, sf):
    facts = _sentence_facts(spark, sf)
    return review.approved(facts, facts.filter(F.length("original") % 3 == 0)).select("row_index", "original")


CELL = """'"' || replace(CASE WHEN regexp_matches({0}, '^[=+@\\t\\r-]') THEN '''' || {0} ELSE {0} END, '"', '""') || '"'"""


@query(f"SELECT {CELL.format('(doc_id::VARCHAR)')} || ',' || {CELL.format('lang')} || ',' || {CELL.format('text')} AS line FROM documents")
def csv_cells(spark, sf):
    return review.csv_lines(table(spark, sf, "documents"), ["doc_id", "lang", "text"])


@query(f"""WITH {FACTS}, r AS (SELECT * FROM facts WHERE length(original) % 3 = 0), good AS (SELECT * FROM facts WHERE {NORM.format('original')} NOT IN (SELECT {NORM.format('original')} FROM r))
SELECT 1 AS part, row_index AS r, start AS s, {CELL.format('original')} || ',' || {CELL.format('(confidence::VARCHAR)')} AS line FROM good UNION ALL SELECT 0, NULL, NULL, chr(65279) || '"original","confidence"'""")
def approved_csv(spark, sf):
    """The lines of the CSV export: header, then the rows that aren't rejected by place or by their text."""
    facts = _sentence_facts(spark, sf)
    return review.csv_report(review.approved(facts, facts.filter(F.length("original") % 3 == 0)), ["original", "confidence"])


@query(f"WITH {FACTS}, c AS (SELECT chapter, count(*) AS n, count(DISTINCT row_index) AS docs FROM facts GROUP BY chapter) SELECT chapter, n, docs, rank() OVER (ORDER BY n DESC, chapter) AS place FROM c")
def chapter_report(spark, sf):
    c = _sentence_facts(spark, sf).groupBy("chapter").agg(F.count("*").alias("n"), F.countDistinct("row_index").alias("docs"))
    return c.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "chapter")).cast("long"))  # one row a chapter


@query(f"""WITH {FACTS} SELECT quality, count(DISTINCT l.doc_id) AS docs, count(row_index) AS replacements FROM labels l LEFT JOIN facts f ON l.doc_id = f.row_index GROUP BY quality""")
def quality_report(spark, sf):
    f = _sentence_facts(spark, sf).select("row_index")
    labels = table(spark, sf, "labels")
    return labels.join(f, labels["doc_id"] == f["row_index"], "left").groupBy("quality").agg(F.countDistinct("doc_id").alias("docs"), F.count("row_index").alias("replacements"))


@query(f"""WITH {FACTS} SELECT 1 AS part, row_index AS r, start AS s, '<tr><td>' || replace(replace(replace(replace(replace(replace(original, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;'), '`', '&#96;') || '</td><td>' || confidence || '</td></tr>' AS line FROM facts""")
def html_rows(spark, sf):
    out = review.html_report(_sentence_facts(spark, sf), ["original", "confidence"])
    return out.filter("part = 1")


@query(f"""WITH {FACTS} SELECT 1 AS part, row_index AS r, start AS s, '{{"chapter":' || chapter || ',"confidence":' || confidence || ',"ambiguous":' || ambiguous || '}}' AS line FROM facts""")
def json_rows(spark, sf):
    return review.json_report(_sentence_facts(spark, sf), ["chapter", "confidence", "ambiguous"]).filter("part = 1")


# --- documents --------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS t, unnest(range(len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))))) AS line FROM documents),
p AS (SELECT doc_id, trim(t) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS paragraph FROM l WHERE trim(t) <> '')
SELECT doc_id, ceil(paragraph / 45)::INT AS page, paragraph::INT AS paragraph, md5(text) AS text_md5 FROM p""")
def text_paragraphs(spark, sf):
    out = docs_io.text_paragraphs(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "page", "paragraph", F.md5("text").alias("text_md5"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x) + 1) AS c FROM documents),
r AS (SELECT doc_id, c, 1 AS i, 1 AS page, c[1] AS used FROM p WHERE len(c) > 0
  UNION ALL SELECT doc_id, c, i + 1, CASE WHEN used > 0 AND used + c[i + 1] > 1800 THEN page + 1 ELSE page END, CASE WHEN used > 0 AND used + c[i + 1] > 1800 THEN c[i + 1] ELSE used + c[i + 1] END FROM r WHERE i < len(c))
SELECT p.doc_id, len(p.c)::INT AS n_parts, coalesce(max(r.page), 0)::INT AS n_pages FROM p LEFT JOIN r ON p.doc_id = r.doc_id GROUP BY p.doc_id, len(p.c)""")
def page_estimate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "").alias("parts"))
    return docs.select("doc_id", docs_io.estimated_pages(F.col("parts")).alias("pages")).select("doc_id", F.size("pages").alias("n_parts"), F.coalesce(F.array_max("pages"), F.lit(0)).alias("n_pages"))


def quoted_rows(spark, sf) -> DataFrame:
    """Rows of prose with quotations: each verse in brackets of one kind or another, the hint of its chapter beside it."""
    v = corpus(spark, sf)
    kind = F.col("v_idx") % 4
    opened, closed = (F.when(kind == 0, a).when(kind == 1, b).when(kind == 2, c).otherwise(d) for a, b, c, d in (("«", "{", "﴿", "("), ("»", "}", "﴾", ")")))
    return v.select(F.col("v_idx").alias("id"), "chapter", "verse", F.concat(F.lit("See "), opened, "text", closed, F.lit(" and on.")).alias("text"))


@query(f"""WITH {VERSES} SELECT v_idx AS id, 'See ﴿' || regexp_replace(text, '\\s+', ' ', 'g') || '﴾ [سورة ' || chapter || ': ' || translate(verse::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') || '] and on.' AS modified_text,
1 AS n_replacements, 1::BIGINT AS total_verses, 100 AS average_confidence FROM corpus""")
def process_rows(spark, sf):
    """The whole engine over quoted verses."""
    cfg = engine.Config(profile=T.LATIN)
    out = engine.process(quoted_rows(spark, sf), corpus(spark, sf), cfg, chapter="chapter", verse="verse")
    return out.select("id", "modified_text", "n_replacements", F.col("total_verses").cast("long").alias("total_verses"), "average_confidence")


@query(f"""WITH {VERSES}, q AS (SELECT v_idx, chapter, verse, CASE v_idx % 4 WHEN 0 THEN '«' WHEN 1 THEN '{{' WHEN 2 THEN '﴿' ELSE '(' END || text || CASE v_idx % 4 WHEN 0 THEN '»' WHEN 1 THEN '}}' WHEN 2 THEN '﴾' ELSE ')' END AS original,
  '﴿' || regexp_replace(text, '\\s+', ' ', 'g') || '﴾ [سورة ' || chapter || ': ' || translate(verse::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ']' AS formatted FROM corpus)
SELECT row_number() OVER (ORDER BY v_idx) AS id, 'benchmark' AS source, v_idx AS row_index, 4::BIGINT AS start, original, formatted, chapter, verse, 100::BIGINT AS confidence FROM q""")
def report_rows(spark, sf):
    """The engine's facts over quoted verses, as numbered rows of a report."""
    facts = engine.replacements(quoted_rows(spark, sf), corpus(spark, sf), engine.Config(profile=T.LATIN), chapter="chapter", verse="verse")
    out = engine.report_rows(facts, "benchmark")
    return out.select("id", "source", "row_index", F.col("start").cast("long").alias("start"), "original", "formatted", F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), F.col("confidence").cast("long").alias("confidence"))


@query(f"WITH {SENTENCES} SELECT doc_id, pos, norm, {SKEL.format('norm')} AS skeleton, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END::BIGINT AS n_tokens FROM sentences")
def sql_functions(spark, sf):
    """Sentences through the functions that are registered for SQL."""
    sql_functions_of.register(spark, T.LATIN)
    table(spark, sf, "documents").createOrReplaceTempView("citeweave_documents")
    return spark.sql(r"""
      SELECT doc_id, cast(pos AS long) AS pos, citeweave_normalized(text) AS norm, citeweave_skeleton(text) AS skeleton, cast(size(citeweave_tokens(text)) AS long) AS n_tokens
      FROM (SELECT doc_id, pos, trim(s) AS text FROM citeweave_documents LATERAL VIEW posexplode(split(text, '[.\n]+')) AS pos, s) WHERE length(text) > 12""")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def dense_numbers(spark, sf):
    """Orders numbered by price, over many tasks."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return numbered(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], "place", kept)


@query()
def cascade_best(spark, sf):
    """The reading that the cascade picks for each verse with a word reversed, a word left out, or cut short."""
    v, cfg = kept(corpus(spark, sf), "corpus"), engine.Config(profile=T.LATIN)
    toks = F.col("tokens")
    cut = F.array_join(F.slice(toks, F.lit(1), F.floor((F.size(toks) + 1) / 2).cast("int")), " ")
    made = v.select(F.explode(F.array(*(F.struct((F.col("v_idx") * 10 + i).alias("id"), x.alias("text")) for i, x in enumerate((F.col("text"), _swapped(None, toks), _without_third(None, toks), cut))))).alias("x")).select("x.*")
    out = engine.resolved(match.candidates(made, T.LATIN), v, cfg)
    return out.select("id", "kind", "chapter", "verse", "end_verse", "confidence", "ambiguous")


@query()
def cascade_documents(spark, sf):
    """The cascade without correction over every sentence of the documents, equal ones once."""
    made = sentences(spark, sf).groupBy(F.xxhash64("norm").alias("id")).agg(F.min("text").alias("text"))
    out = engine.resolved(match.candidates(made, T.LATIN), kept(corpus(spark, sf), "corpus"), engine.Config(profile=T.LATIN, correct=False))
    return out.select("id", "kind", "chapter", "verse", "end_verse", "confidence", "ambiguous")


@query()
def cascade_corrected(spark, sf):
    """The cascade with correction over every sentence of the documents, equal ones once: what it links besides `cascade_documents` has edits."""
    made = sentences(spark, sf).groupBy(F.xxhash64("norm").alias("id")).agg(F.min("text").alias("text"))
    out = engine.resolved(match.candidates(made, T.LATIN), kept(corpus(spark, sf), "corpus"), engine.Config(profile=T.LATIN))
    return out.select("id", "kind", "chapter", "verse", "end_verse", "confidence", "ambiguous")
