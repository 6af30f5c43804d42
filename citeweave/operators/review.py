"""Review of replacements: filters, search, sorting, pages, approval, statistics, and votes among neighbours."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeweave.functions import text as T
from citeweave.sources.single_file import write_lines

from .numbering import numbered

LOW = 80
#: Code points between two quotations of one cluster, and the votes that a chapter needs in it.
REACH, VOTES, SURE = 200, 2, 90


def filtered(facts: DataFrame, name: str = "all") -> DataFrame:
    """all, changed, lowConf (under 80), corrected, multi (several verses) or ambiguous."""
    tests = {
        "all": lambda: F.lit(True),
        "changed": lambda: F.col("original") != F.col("formatted"),
        "lowConf": lambda: F.col("confidence") < LOW,
        "corrected": lambda: F.col("correction_type") == "correct",
        "multi": lambda: F.col("verse_count") > 1,
        "ambiguous": lambda: F.col("ambiguous"),
    }
    return facts.filter(tests[name]())


def searched(facts: DataFrame, word: str, profile: T.ScriptProfile = T.ARABIC) -> DataFrame:
    """Rows whose texts hold the word, in lower case or normalised, or whose chapter name holds it."""
    low, norm = F.lit(word.lower()), T.normalized(F.lit(word), profile)
    hit = F.lower("original").contains(low) | F.lower("formatted").contains(low)
    if "chapter_name" in facts.columns:
        hit = hit | F.col("chapter_name").contains(word)
    return facts.filter(hit | ((norm != "") & (T.normalized(F.col("original"), profile).contains(norm) | T.normalized(F.col("formatted"), profile).contains(norm))))


def paged(facts: DataFrame, page: int, order: list[Column], size: int = 200) -> DataFrame:
    """One page of the sorted rows."""
    return facts.orderBy(*order).offset(max(page - 1, 0) * size).limit(size)


#: Rows of a block of a page index at least, and blocks at most.
BLOCK_ROWS, BLOCKS = 1000, 1000


def page_index(facts: DataFrame, order: list[Column], path: str, keep) -> DataFrame:
    """The rows in an order, stored once under `path` in blocks of neighbouring places (`place` from 1, folders by `block`), for `page_of`.

    The order is made by `numbering.numbered`, so no task sees all rows; blocks grow with the rows, their number doesn't."""
    placed = numbered(facts, order, "place", keep)
    rows = max(BLOCK_ROWS, -(-placed.count() // BLOCKS))
    blocks = placed.withColumn("block", F.floor((F.col("place") - 1) / rows).cast("int"))
    blocks.repartition("block").sortWithinPartitions("block", "place").write.mode("overwrite").partitionBy("block").parquet(path)
    out = facts.sparkSession.read.schema(blocks.schema).parquet(path)
    out._block_rows = rows
    return out


def page_of(index: DataFrame, page: int, size: int = 200) -> DataFrame:
    """One page (from 1) of a page index, in order: only the blocks that hold it are read."""
    first = max(page - 1, 0) * size + 1
    last = first + size - 1
    rows = index._block_rows
    return index.filter(F.col("block").between((first - 1) // rows, (last - 1) // rows)).filter(F.col("place").between(first, last)).orderBy("place").drop("block")


#: Keys that rows may be sorted by, and the columns behind them.
KEYS = {"id": "row_index", "before": "original", "after": "formatted", "confidence": "confidence", "page": "page", "surah": "chapter_name", "ayahRange": "verse", "count": "verse_count", "correctionType": "correction_type"}


def order_by(facts: DataFrame, key: str, descending: bool = False) -> list[Column]:
    """The order for a key: numbers as numbers, text as an Arabic reader would; ties by place."""
    c = F.col(KEYS[key])
    c = c if not isinstance(facts.schema[KEYS[key]].dataType, StringType) else F.collate(c, "AR")
    return [c.desc() if descending else c.asc(), F.col("row_index"), F.col("start")]


REJECTED = ["row_index", "start", "end", "original"]


def rejected_all(facts: DataFrame, rejected: DataFrame | None, name: str = "all", word: str | None = None, profile: T.ScriptProfile = T.ARABIC) -> DataFrame:
    """The rejections with all rows that a filter and a search leave in sight added; approving all is an empty table of them."""
    seen = filtered(facts, name)
    seen = (searched(seen, word, profile) if word else seen).select(*REJECTED)
    return (seen if rejected is None else rejected.select(*REJECTED).union(seen)).distinct()


def approval_counts(facts: DataFrame, rejected: DataFrame, profile: T.ScriptProfile = T.LATIN, skip_identical: bool = True) -> DataFrame:
    """One row: n_approved of n_total."""
    good = approved(facts, rejected, profile, skip_identical).agg(F.count("*").alias("n_approved")).withColumn("one", F.lit(1))
    return facts.agg(F.count("*").alias("n_total")).withColumn("one", F.lit(1)).join(good, "one").select("n_approved", "n_total")


def approved(facts: DataFrame, rejected: DataFrame, profile: T.ScriptProfile = T.LATIN, skip_identical: bool = True) -> DataFrame:
    """The rows that aren't rejected by place (row_index, start, end, original); nor, with skip_identical, by their text."""
    places = rejected.select(*(F.col(c).alias(f"_{c}") for c in REJECTED)).distinct()
    out = facts.join(places, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REJECTED)), "left_anti")
    if skip_identical:
        texts = rejected.select(T.normalized(F.col("original"), profile).alias("_norm")).distinct()
        out = out.withColumn("_norm", T.normalized(F.col("original"), profile)).join(texts, "_norm", "left_anti").drop("_norm")
    return out


def statistics(facts: DataFrame) -> DataFrame:
    """One row: rows with replacements, replacements, verses, single, multi, low, ambiguous and mean confidence."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return facts.agg(
        F.countDistinct("row_index").alias("modified_rows"),
        F.count("*").alias("replacements"),
        F.coalesce(F.sum("verse_count"), F.lit(0)).cast("long").alias("verses"),
        one(F.col("verse_count") == 1).alias("single"),
        one(F.col("verse_count") > 1).alias("multi"),
        one(F.col("confidence") < LOW).alias("low"),
        one(F.col("ambiguous")).alias("ambiguous"),
        F.coalesce(F.floor(F.avg("confidence") + 0.5), F.lit(0)).cast("long").alias("average_confidence"),
    )


def clusters(facts: DataFrame, reach: int = REACH) -> DataFrame:
    """Quotations of a row at most `reach` apart, as numbered clusters."""
    by = Window.partitionBy("row_index").orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(by)
    return facts.withColumn("cluster", F.sum(F.when(gap <= reach, 0).otherwise(1)).over(by))


def cluster_votes(facts: DataFrame, reach: int = REACH) -> DataFrame:
    """The chapter that the sure quotations of each cluster name most: row_index, cluster, chapter, votes.

    Ties go to the chapter seen first; a chapter needs two votes.
    """
    sure = clusters(facts, reach).filter(F.col("confidence") > SURE).groupBy("row_index", "cluster", "chapter").agg(F.count("*").alias("votes"), F.min("start").alias("first"))
    best = Window.partitionBy("row_index", "cluster").orderBy(F.desc("votes"), "first")
    return sure.withColumn("place", F.row_number().over(best)).filter((F.col("place") == 1) & (F.col("votes") >= VOTES)).select("row_index", "cluster", "chapter", "votes")


def csv_lines(facts: DataFrame, columns: list[str]) -> DataFrame:
    """line: the quoted cells of each row."""
    return facts.select(F.concat_ws(",", *(T.csv_cell(F.col(c)) for c in columns)).alias("line"))


# --- reports as lines: (part, place, line); sorted by the first two they are the file -----------------------------------

REPORT = ["original", "formatted", "confidence", "page", "chapter_name", "verse", "verse_count", "correction_type", "needs_review"]


def csv_report(facts: DataFrame, columns: list[str] = REPORT) -> DataFrame:
    """Header, then the rows; every cell quoted. The file begins with a byte order mark and has CRLF between lines."""
    rows = facts.select(F.lit(1).alias("part"), F.col("row_index").alias("r"), F.col("start").cast("long").alias("s"), F.concat_ws(",", *(T.csv_cell(F.col(c)) for c in columns)).alias("line"))
    head = facts.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(facts.schema["row_index"].dataType).alias("r"), F.lit(None).cast("long").alias("s"), F.lit("﻿" + ",".join(f'"{c}"' for c in columns)).alias("line"))
    return head.unionByName(rows)


def json_report(facts: DataFrame, columns: list[str] = REPORT) -> DataFrame:
    """A summary object, then one object a row."""
    rows = facts.select(F.lit(1).alias("part"), F.col("row_index").alias("r"), F.col("start").cast("long").alias("s"), F.to_json(F.struct(*columns)).alias("line"))
    total = statistics(facts).select(F.lit(0).alias("part"), F.lit(None).cast(facts.schema["row_index"].dataType).alias("r"), F.lit(None).cast("long").alias("s"), F.to_json(F.struct("replacements", "verses", F.col("average_confidence").alias("averageConfidence"), F.col("low").alias("lowConfidence"))).alias("line"))
    return total.unionByName(rows)


def html_report(facts: DataFrame, columns: list[str] = REPORT[:7], title: str = "Report") -> DataFrame:
    """A page of its own, written from right to left, with all cells escaped."""
    rows = facts.select(F.lit(1).alias("part"), F.col("row_index").alias("r"), F.col("start").cast("long").alias("s"), F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), T.escaped_html(F.col(c).cast("string")), F.lit("</td>")) for c in columns), F.lit("</tr>")).alias("line"))
    spark, none = facts.sparkSession, [F.lit(None).cast(facts.schema["row_index"].dataType).alias("r"), F.lit(None).cast("long").alias("s")]
    head = f'<!DOCTYPE html><html dir="rtl"><head><meta charset="utf-8"><title>{title}</title></head><body><table><tr>{"".join(f"<th>{c}</th>" for c in columns)}</tr>'
    ends = spark.range(1).select(F.lit(0).alias("part"), *none, F.lit(head).alias("line")).unionByName(spark.range(1).select(F.lit(2).alias("part"), *none, F.lit("</table></body></html>").alias("line")))
    return ends.unionByName(rows)


def write_report(lines: DataFrame, path: str, separator: str = "\n") -> None:
    """One text file in order: a report is one document, so its last step is one sorted task."""
    lines.orderBy("part", "r", "s").select("line").coalesce(1).write.option("lineSep", separator).text(path)


def write_document(lines: DataFrame, path: str, separator: str = "\n") -> None:
    """One file with the separator between the lines and none behind the last, written by many tasks."""
    write_lines(lines, ["part", "r", "s"], path, separator)


def write_json_document(facts: DataFrame, path: str, generated_at: str, meta: dict | None = None, columns: list[str] = REPORT) -> None:
    """The report as one JSON document: generatedAt, summary (meta first) and rows, written by many tasks."""
    lines = json_report(facts, columns)
    summary = (meta or {}) | json.loads(lines.filter("part = 0").first().line)
    head = f'{{"generatedAt": {json.dumps(generated_at)}, "summary": {json.dumps(summary, ensure_ascii=False)}, "rows": ['
    write_lines(lines.filter("part = 1"), ["r", "s"], path, ",\n", head, "\n", "\n]}")


def write_approved(facts: DataFrame, rejected: DataFrame, path: str, form: str, generated_at: str = "", meta: dict | None = None, columns: list[str] = REPORT, profile: T.ScriptProfile = T.LATIN, skip_identical: bool = True) -> int:
    """The approved rows as one csv, json or html file; returns how many. Where nothing is approved it is a ValueError, and
    a file that stands there stays as it was. Summaries are those of the approved rows."""
    good = approved(facts, rejected, profile, skip_identical)
    n = good.count()
    if not n:
        raise ValueError("nothing is approved")
    if form == "json":
        write_json_document(good, path, generated_at, meta, columns)
    elif form == "csv":
        write_document(csv_report(good, columns), path, "\r\n")
    elif form == "html":
        write_document(html_report(good, columns), path)
    else:
        raise ValueError(f"no report format {form}")
    return n
