"""Documents as rows of paragraphs: plain text and DOCX, and back."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES, CHARS = 45, 1800
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PART = "word/document.xml"
PARAGRAPHS = "array<struct<page:int,index:int,p_index:int,text:string>>"


def text_paragraphs(df: DataFrame, ident: str, text: str, lines: int = LINES) -> DataFrame:
    """Non-blank lines as paragraphs: ident, page, paragraph (from 1), text.

    A line with form feeds begins a new page, one for all of them; otherwise a page has `lines` paragraphs. Each stretch
    between form feeds is paged on its own, so windows suffice.
    """
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    rows = df.select(F.col(ident), F.posexplode(F.split(flat, "\n")).alias("line", "raw"))
    own = Window.partitionBy(ident).orderBy("line")
    rows = rows.withColumn("feed", F.sum(F.when(F.contains("raw", F.lit("\f")), 1).otherwise(0)).over(own)).withColumn("text", F.trim(F.replace("raw", F.lit("\f"), F.lit("")))).filter("text <> ''")
    rows = rows.withColumn("paragraph", F.row_number().over(own)).withColumn("in_feed", F.row_number().over(Window.partitionBy(ident, "feed").orderBy("line")))
    sheets = rows.groupBy(ident, "feed").agg(F.ceil(F.count("*") / lines).alias("n"))
    before = Window.partitionBy(ident).orderBy("feed").rowsBetween(Window.unboundedPreceding, -1)
    sheets = sheets.withColumn("extra", F.coalesce(F.sum(F.col("n") - 1).over(before), F.lit(0)))
    return rows.join(sheets.select(ident, "feed", "extra"), [ident, "feed"]).select(ident, (F.col("feed") + F.col("extra") + F.ceil(F.col("in_feed") / lines)).cast("int").alias("page"), "paragraph", "text")


def estimated_pages(texts: Column, chars: int = CHARS) -> Column:
    """The page of each text of an array: filled in order, each costs its length and one, a page holds one at least."""
    start = F.struct(F.lit(1).alias("page"), F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("pages"))

    def put(acc: Column, t: Column) -> Column:
        cost = F.length(t) + 1
        new = (acc["used"] > 0) & (acc["used"] + cost > chars)
        page = F.when(new, acc["page"] + 1).otherwise(acc["page"])
        return F.struct(page.alias("page"), F.when(new, cost).otherwise(acc["used"] + cost).alias("used"), F.concat(acc["pages"], F.array(page)).alias("pages"))

    return F.aggregate(texts, start, put, lambda acc: acc["pages"])


def docx_paragraphs(data: bytes) -> list[dict]:
    """Paragraphs of a DOCX: breaks before a paragraph's text turn the page; blanks collapse; empty ones only count."""
    try:
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read(PART))
    except (zipfile.BadZipFile, KeyError) as e:
        raise ValueError(f"not a DOCX document: {e}") from e
    page, out, marked = 1, [], False
    for i, p in enumerate(root.iter(W + "p")):
        turns, parts = 0, []
        for x in p.iter():
            if x.tag == W + "lastRenderedPageBreak" or (x.tag == W + "br" and x.get(W + "type") == "page"):
                turns += 1
            elif x.tag == W + "sectPr":
                kind = x.find(W + "type")
                turns += kind is None or kind.get(W + "val") in ("nextPage", "oddPage", "evenPage")
            elif x.tag == W + "t":
                parts.append(x.text or "")
            elif x.tag in (W + "tab", W + "br"):
                parts.append(" ")
        page += turns
        marked |= turns > 0
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        if text:
            out.append({"page": page, "index": len(out), "p_index": i, "text": text})
    if not marked:
        page, used = 1, 0
        for x in out:
            cost = len(x["text"]) + 1
            if used and used + cost > CHARS:
                page, used = page + 1, 0
            used += cost
            x["page"] = page
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, page, paragraph (from 1), p_index, text of all DOCX files under a path."""

    @F.pandas_udf(PARAGRAPHS)
    def parse(data: pd.Series) -> pd.Series:
        return data.map(docx_paragraphs)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.explode(parse("content")).alias("x")).select("path", "x.page", (F.col("x.index") + 1).alias("paragraph"), "x.p_index", "x.text")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """path, page, paragraph, p_index and text of text and DOCX files: .txt, .md and .csv are text; of others, those that
    begin like a ZIP archive are DOCX. p_index is null for text."""
    files = spark.read.format("binaryFile").load(path)
    plain = F.lower("path").rlike(r"\.(txt|md|csv)$") | (F.substring("content", 1, 2) != F.lit(b"PK"))

    @F.pandas_udf(PARAGRAPHS)
    def parse(data: pd.Series) -> pd.Series:
        return data.map(docx_paragraphs)

    docx = files.filter(~plain).select("path", F.explode(parse("content")).alias("x")).select("path", "x.page", (F.col("x.index") + 1).alias("paragraph"), F.col("x.p_index").alias("p_index"), "x.text")
    text = files.filter(plain).select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("text"))
    text = text_paragraphs(text, "path", "text").select("path", "page", "paragraph", F.lit(None).cast("int").alias("p_index"), "text")
    return docx.unionByName(text)


def as_table(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs in the columns of a table of texts; their place is kept beside."""
    return paragraphs.select(F.col("page").alias("ص"), F.col("paragraph").alias("الفقرة"), F.col("text").alias("AyahText"), "path", "p_index")


def save_documents(spark: SparkSession, path: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """path and content of the documents with their new texts; before, after: (path, paragraph, p_index, text).

    DOCX files get the paragraphs that differ put in; text files are their paragraphs with blank lines between and a byte
    order mark in front.
    """
    keys = ["path", "paragraph"]
    changed = after.join(before.select(*keys, F.col("text").alias("_old")), keys).filter("text <> _old and p_index is not null").select("path", "p_index", "text")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    docx = after.filter("p_index is not null").select("path").distinct()
    text = plain_text(after.filter("p_index is null"), "path", "paragraph", "text")
    return docx_with_edits(files.join(docx, "path", "left_semi"), changed).union(text.select("path", F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-8")))


def edited_docx(data: bytes, edits: dict[int, str]) -> bytes:
    """The document with new text for some paragraphs (by p_index); all other parts as they were."""
    source = zipfile.ZipFile(io.BytesIO(data))
    root = ET.fromstring(source.read(PART))
    for i, p in enumerate(root.iter(W + "p")):
        if i not in edits:
            continue
        own = list(p.iter(W + "t"))
        if not own:
            own = [ET.SubElement(ET.SubElement(p, W + "r"), W + "t")]
        for t in own:
            t.text = ""
        own[0].text = edits[i]
        own[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info in source.infolist():
            z.writestr(zipfile.ZipInfo(info.filename), ET.tostring(root, "utf-8", xml_declaration=True) if info.filename == PART else source.read(info), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx_with_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path and content of DOCX files (path, content) with edits (path, p_index, text) applied."""
    listed = edits.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_index").cast("int"), "text"))).alias("edits"))

    @F.pandas_udf("binary")
    def apply(data: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([edited_docx(d, dict(e or {})) for d, e in zip(data, edits)])

    return files.join(listed, "path", "left").select("path", F.when(F.col("edits").isNull(), F.col("content")).otherwise(apply("content", "edits")).alias("content"))


def plain_text(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Paragraphs of each group joined by blank lines."""
    listed = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x"))
    return listed.select(group, F.array_join(F.transform("x", lambda p: p[text]), "\n\n").alias("text"))
