"""Finding quotations: bracketed spans of a text, as rows (start, end, text) with half-open code point offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import ARABIC, ScriptProfile

# Brackets, by priority.
PAIRS = [("﴿", "﴾"), ("«", "»"), ("<<", ">>"), ("{", "}"), ("(", ")")]
SPAN = "array<struct<start:int,end:int,text:string>>"
_NUMBER = re.compile(r"[(\[]\s*[\d٠-٩۰-۹]{1,3}\s*[)\]]")


def bracketed(text: str | None, script: re.Pattern) -> list[dict]:
    """Spans in brackets, nearest opener first; a closer discards openers above its own, an unmatched closer is skipped.

    An opener without a closer reaches to the line's end or the first character that is neither of the script nor a
    blank; numbers in brackets are stepped over. Only spans with two characters or more, one of the script, count.
    """
    found: list[dict] = []
    if not text:
        return found

    def keep(start: int, end: int, inner: str) -> None:
        inner = inner.strip()
        if len(inner) > 1 and script.search(inner):
            found.append({"start": start, "end": end, "text": inner})

    stack: list[tuple[int, int]] = []
    i = 0
    while i < len(text):
        step = 1
        for k, (o, c) in enumerate(PAIRS):
            if text.startswith(o, i):
                stack.append((k, i))
                step = len(o)
                break
            if text.startswith(c, i):
                own = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == k), None)
                if own is not None:
                    start = stack[own][1]
                    keep(start, i + len(c), text[start + len(o) : i])
                    del stack[own:]
                step = len(c)
                break
        i += step
    for k, start in reversed(stack):
        j = begin = start + len(PAIRS[k][0])
        while j < len(text) and text[j] not in "\r\n":
            if text[j] in "([" and (m := _NUMBER.match(text, j)):
                j = m.end()
            elif text[j].isspace() or text[j] in ".…" or script.match(text[j]):
                j += 1
            else:
                break
        keep(start, j, text[begin:j])
    return merged(found, text)


def merged(spans: list[dict], text: str) -> list[dict]:
    """Contained spans swallowed, overlapping ones united (their text is then cut from the source)."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if out and s["start"] < out[-1]["end"]:
            if s["end"] > out[-1]["end"]:
                out[-1] = {"start": out[-1]["start"], "end": s["end"], "text": text[out[-1]["start"] : s["end"]]}
        else:
            out.append(s)
    return out


def spans_of(text: Column, profile: ScriptProfile = ARABIC) -> Column:
    """The bracketed spans of each text; nesting needs a stack, so this is an Arrow function."""
    script = re.compile(r"[؀-ۿ]" if profile.name == "arabic" else r"[^\W\d_]")

    @F.pandas_udf(SPAN)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bracketed(t, script))

    return scan(text)


def quotations(df: DataFrame, ident: str, text: str, profile: ScriptProfile = ARABIC) -> DataFrame:
    """A row for each span: the columns of df, q (number within the text), start, end, quote."""
    out = df.withColumn("_spans", spans_of(F.col(text), profile))
    return out.select(*df.columns, F.posexplode("_spans").alias("q", "_s")).select(*df.columns, "q", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.col("_s.text").alias("quote"))


def flat_quotations(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Spans of one kind of bracket without nesting, by built-in functions only: ident, kind, n, quote."""
    one = None
    for k, (o, c) in enumerate(PAIRS):
        pattern = rf"{re.escape(o)}([^{re.escape(o[0])}{re.escape(c[0])}]*){re.escape(c)}"
        part = df.select(ident, F.lit(k).alias("kind"), F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("n", "quote"))
        one = part if one is None else one.union(part)
    return one.withColumn("quote", F.trim("quote")).filter(F.length("quote") > 1)


def islands(spans: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping spans of a group as one: group, start, end, n."""
    by = Window.partitionBy(*group).orderBy(start, F.desc(end))
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.when(F.col(start) < before, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")
