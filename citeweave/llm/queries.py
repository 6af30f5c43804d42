"""The queries of this subpackage, as the driver calls them: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extraction, licenses, lm, passages, phrases, pieces, quality, sharding, simhash, suffix, variants, warc
from .common import new_path, stored, table

SHARDS = 24


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that a document shares with another."""
    return passages.passages(table(spark, sf_dir, "documents")).drop("key")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the best place."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the text that was read."""
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", "ids", (F.crc32(F.encode("decoded", "UTF-8")) == F.col("text_crc32")).alias("decoded_ok"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, by version 1 of a stored slot map."""
    records = stored(sharding.sized(table(spark, sf_dir, "documents")), "records")
    path = new_path(spark, "slot-map")
    sharding.write_map(sharding.first_map(sharding.slot_totals(records), SHARDS), path)
    out = sharding.assign(records, sharding.read_map(spark, path))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document."""
    return lm.scores(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata and a conversion record for every page."""
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    measures = stored(quality.measured(table(spark, sf_dir, "documents")), "measures")
    out = quality.judged(measures, quality.fitted(measures, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document under 400-byte strings that come twice."""
    out = suffix.without_repeats(table(spark, sf_dir, "documents"))
    # a cut can fall within a character, so the text is read with a replacement sign there; the hash is over the bytes
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"), (F.col("n_removed") > 0).alias("found"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, the root of its forms and its near words."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_sharding": op5_sharding,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_html_extraction": op11_html_extraction,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAM = "unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: list_slice(w, i, i + {k} - 1)))"
_CRC32 = "xor(list_reduce(list_concat([4294967295], {}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
_BYTES = "flatten(list_transform(regexp_extract_all({}, '.'), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 | (unicode(ch) >> 6), 128 | (unicode(ch) & 63)] END))"
ORACLE_SQL: dict[str, str] = {
    "op12_spelling_variants": rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table),
runs AS (
  SELECT d, run, count(*) AS c FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, {_CRC32.format(_BYTES.format("d || ':' || run"))} AS h FROM runs, crc),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
without AS (SELECT word, n, p, substring(word, 1, p - 1) || substring(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
told AS (
  SELECT word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM told UNION ALL
  SELECT w.word, t.form FROM walk w JOIN told t ON t.word = w.at WHERE t.form IS NOT NULL),
roots AS (SELECT w.word, w.at AS root FROM walk w JOIN told t ON t.word = w.at WHERE t.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN roots USING (word)""",
    "op13_collocations": rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\n\x0b\x0c\r]')) AS p FROM documents)),
one AS (SELECT lang, g[1] AS w1, count(*) AS f FROM (SELECT lang, {_GRAM.format(k=1)} AS g FROM pieces) GROUP BY ALL),
two AS (SELECT lang, g[1] AS w1, g[2] AS w2, count(*) AS f FROM (SELECT lang, {_GRAM.format(k=2)} AS g FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, count(*) AS f FROM (SELECT lang, {_GRAM.format(k=3)} AS g FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN longer g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2 WHERE g.f IS NULL OR 100 * g.f < 50 * t.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang) USING (lang) WHERE rank <= 2000""",
}
