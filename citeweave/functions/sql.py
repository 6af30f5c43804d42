"""The text functions by name in SQL: temporary SQL functions of the session, inlined by the planner like built-ins."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T


def _quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, profile: T.ScriptProfile = T.ARABIC, prefix: str = "citeweave") -> list[str]:
    """Create <prefix>_normalized, _tokens, _skeleton (of texts), _near_token and _similarity (of two); returns their names.

    They return what the functions of `functions.text` return for the profile; null counts as an empty text."""
    source, target = profile.variants
    norm = "coalesce(x, '')"
    if profile.lower:
        norm = f"lower({norm})"
    if profile.marks or source:
        norm = f"translate({norm}, {_quoted(source + profile.marks)}, {_quoted(target)})"
    norm = f"trim(regexp_replace({norm}, {_quoted(profile.split)}, ' '))"
    for pattern, put in (*profile.joins, *([profile.prefix_join] if profile.prefix_join else [])):
        norm = f"regexp_replace({norm}, {_quoted(pattern)}, {_quoted(put)})"
    words = lambda x: f"filter(split({x}, ' '), w -> w <> '')"
    ratio = "if(greatest(length(a), length(b)) = 0, 1D, 1D - levenshtein(a, b) / greatest(length(a), length(b)))"
    jaccard = f"size(array_intersect({words('a')}, {words('b')})) / greatest(size(array_union({words('a')}, {words('b')})), 1)"
    longer = "greatest(length(a), length(b))"
    bodies = {
        "normalized(x STRING) RETURNS STRING": norm,
        "tokens(x STRING) RETURNS ARRAY<STRING>": words(norm),
        "skeleton(x STRING) RETURNS STRING": f"trim(regexp_replace(translate({norm}, {_quoted(profile.weak)}, ''), ' +', ' '))",
        "near_token(a STRING, b STRING) RETURNS BOOLEAN": f"{longer} >= 4 AND abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= if({longer} >= 7, 2, 1)",
        "similarity(a STRING, b STRING) RETURNS DOUBLE": f"if(a = b, 1D, 0.5D * ({jaccard}) + 0.5D * ({ratio}))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{head} RETURN {body}")
    return [f"{prefix}_{head.split('(')[0]}" for head in bodies]
