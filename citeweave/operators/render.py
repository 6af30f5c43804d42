"""Writing references and putting them into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.text import arabic_digits

# The brackets of a rendered quotation, and the name of a chapter that has none.
OPEN, CLOSE, UNNAMED = "﴿", "﴾", "سورة "


def chapter_name(names: dict[int, str] | None, chapter: Column) -> Column:
    """The name of a chapter from a table of names, which is a parameter; else a name made of its number."""
    plain = F.concat(F.lit(UNNAMED), chapter.cast("string"))
    if not names:
        return plain
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in names.items() for x in (int(k), v))), chapter), plain)


def reference(parts: Column, name: Column, first: Column, last: Column) -> Column:
    """One verse: ﴿text﴾ [name: n]. Several: ﴿t1 (n1) t2 (n2)﴾ [name: first-last]. parts: array of (text, verse)."""
    several = F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.lit(" ("), arabic_digits(p["verse"]), F.lit(")"))), " ")
    body = F.when(F.size(parts) > 1, several).otherwise(parts[0]["text"])
    tag = F.when(F.size(parts) > 1, F.concat(arabic_digits(first), F.lit("-"), arabic_digits(last))).otherwise(arabic_digits(first))
    return F.concat(F.lit(OPEN), body, F.lit(f"{CLOSE} ["), name, F.lit(": "), tag, F.lit("]"))


def spliced(text: Column, replacements: Column) -> Column:
    """The text with each span (start, end, formatted) replaced, from the back; spans out of range are skipped."""
    ordered = F.reverse(F.array_sort(F.filter(replacements, lambda r: (r["start"] >= 0) & (r["end"] > r["start"]) & (r["end"] <= F.length(text)))))
    return F.aggregate(ordered, text, lambda t, r: F.concat(F.substring(t, F.lit(1), r["start"]), r["formatted"], F.substring(t, r["end"] + 1, F.length(t))))


def apply_replacements(rows: DataFrame, facts: DataFrame, ident: str, text: str, out: str = "new_text") -> DataFrame:
    """Rows with their replacements (ident, start, end, formatted) put in; a row without any is as it was."""
    mine = facts.groupBy(ident).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "formatted")).alias("_reps"))  # bounded by the text
    joined = rows.join(mine, ident, "left")
    return joined.withColumn(out, F.when(F.col("_reps").isNull(), F.col(text)).otherwise(spliced(F.col(text), F.col("_reps")))).withColumn("n_applied", F.coalesce(F.size("_reps"), F.lit(0))).drop("_reps")


def tag_after(text: Column, end: Column) -> Column:
    """A reference tag that follows a quotation within two line breaks, or the empty string."""
    return F.regexp_extract(F.substring(text, end + 1, F.lit(80)), r"^[ \t]*(?:\r?\n[ \t]*){0,2}\[[^\]\n]{1,60}\]", 0)


def tag_cites(tag: Column, name: Column, first: Column, last: Column) -> Column:
    """Whether a (normalised) tag names the chapter, and no number or one within the verses."""
    numbers = F.transform(F.regexp_extract_all(tag, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    return tag.contains(name) & ((F.size(numbers) == 0) | F.exists(numbers, lambda n: (n >= first) & (n <= last)))
