"""Text functions as Column expressions: normalising, tokens, skeletons, digits, escapes, noise.

A ScriptProfile says what counts as a mark, a letter variant and punctuation; ARABIC and LATIN are given. All functions
take and return Columns, stay inside code generation where Spark has built-ins, and map null to the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


# Character classes of Arabic text.
ARABIC_MARKS = _chars((0x0617, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED), (0x0640, 0x0640), (0x200C, 0x200F), (0xFEFF, 0xFEFF))
ARABIC_PUNCTUATION = "،؛؟!:.-—–()[]{}\"'«»‹›`´*/\\|_=+؞٪٫٬۔﴿﴾<>#@~"
ARABIC_INDIC, EXTENDED_INDIC, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
ARABIC_WEAK = "اويىء"
ARABIC_BLOCK = "؀-ۿ"
PARTICLES = "وفبلك"


@dataclass(frozen=True)
class ScriptProfile:
    """marks are deleted, variants[0] is folded to variants[1], runs of `split` (a regex class) become one space,
    weak letters are deleted for the skeleton; joins are (pattern, replacement) pairs applied in order."""

    name: str
    marks: str
    variants: tuple[str, str]
    split: str
    weak: str
    lower: bool = False
    joins: tuple[tuple[str, str], ...] = ()
    prefix_join: tuple[str, str] | None = None
    script: str = r"\p{L}"


ARABIC = ScriptProfile(
    name="arabic",
    marks=ARABIC_MARKS,
    variants=("إأٱآىؤئة" + ARABIC_INDIC + EXTENDED_INDIC, "اااا" + "ي" + "و" + "ي" + "ه" + ASCII_DIGITS * 2),
    split="[ \\t\\n\\r" + "".join("\\" + c if c in "[]\\-^&" else c for c in ARABIC_PUNCTUATION) + "]+",
    weak=ARABIC_WEAK,
    joins=((rf"(^| )يا (?=[{ARABIC_BLOCK}])", "$1يا"), (r"(^| )لو ما(?= |$)", "$1لوما")),
    prefix_join=(rf"(^| )([{PARTICLES}]) (?=[{ARABIC_BLOCK}])", "$1$2"),
    script=f"[{ARABIC_BLOCK}]",
)
LATIN = ScriptProfile(name="latin", marks="", variants=("", ""), split=r"[^\p{L}\p{N}]+", weak="aeiou", lower=True)


def normalized(text: Column, profile: ScriptProfile = ARABIC, join_prefixes: bool = True) -> Column:
    """Marks dropped, punctuation and blanks to single spaces, letter variants and digits folded, particles joined."""
    x = F.coalesce(text, F.lit(""))
    x = F.lower(x) if profile.lower else x
    source, target = profile.variants
    if profile.marks or source:
        # characters of the first string that have none beside them in the second are deleted
        x = F.translate(x, source + profile.marks, target)
    x = F.trim(F.regexp_replace(x, profile.split, " "))
    for pattern, put in profile.joins:
        x = F.regexp_replace(x, pattern, put)
    if join_prefixes and profile.prefix_join:
        x = F.regexp_replace(x, *profile.prefix_join)
    return x


def tokens_of(norm: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(norm, " "), lambda x: x != "")


def tokens(text: Column, profile: ScriptProfile = ARABIC, join_prefixes: bool = True) -> Column:
    return tokens_of(normalized(text, profile, join_prefixes))


def skeleton_of(norm: Column, profile: ScriptProfile = ARABIC) -> Column:
    """A normalised text without weak letters; spellings that differ in those only are equal."""
    return F.trim(F.regexp_replace(F.translate(norm, profile.weak, ""), " +", " "))


def skeleton(text: Column, profile: ScriptProfile = ARABIC) -> Column:
    return skeleton_of(normalized(text, profile), profile)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer; two empty strings are equal."""
    size = F.greatest(F.length(a), F.length(b))
    return F.when(size == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / size)


def similarity(a: Column, b: Column) -> Column:
    """Half the Jaccard similarity of the token sets, half the edit ratio; 1 for equal texts."""
    x, y = tokens_of(a), tokens_of(b)
    jaccard = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when(a == b, 1.0).otherwise(0.5 * jaccard + 0.5 * edit_ratio(a, b))


def near_token(a: Column, b: Column) -> Column:
    """A typing error apart: 4 letters or more, lengths at most 2 apart, distance 1, or 2 from 7 letters on."""
    longer = F.greatest(F.length(a), F.length(b))
    allowed = F.when(longer >= 7, 2).otherwise(1)
    return (longer >= 4) & (F.abs(F.length(a) - F.length(b)) <= 2) & (edit_distance(a, b, 2) <= allowed)


def arabic_digits(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), ASCII_DIGITS, ARABIC_INDIC)


def clock(seconds: Column) -> Column:
    """mm:ss, with hours in front from one hour on; null, negative: 00:00."""
    s = F.floor(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0))).cast("long")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), pad(m), pad(s % 60))).otherwise(F.concat_ws(":", pad(m), pad(s % 60)))


def escaped_html(text: Column) -> Column:
    x = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("`", "&#96;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def csv_cell(value: Column) -> Column:
    """A quoted cell; what a spreadsheet would take as a formula gets an apostrophe."""
    x = F.coalesce(value.cast("string"), F.lit(""))
    x = F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def trailing_dots(text: Column) -> Column:
    return text.rlike(r"(\.{2,}|…)\s*$")


DIGITS = "0-9٠-٩"


def without_brackets(text: Column) -> Column:
    """Bracketed numbers and anything in round brackets dropped, blanks collapsed."""
    x = F.regexp_replace(text, rf"[(\[]\s*[{DIGITS}]{{1,3}}\s*[)\]]", " ")
    x = F.regexp_replace(x, r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def without_noise(text: Column) -> Column:
    """Tokens that are only punctuation, digits or one to three Latin letters dropped; if none is left, the text as it was."""
    def noise(token: Column) -> Column:
        core = F.regexp_replace(token, r"[^\p{L}\p{N}\p{M}…]+", "")
        return (core == "") | core.rlike(rf"^[{DIGITS}۰-۹]+$") | core.rlike(r"^[A-Za-z]{1,3}$")

    text = F.coalesce(text, F.lit(""))
    kept = F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda t: ~noise(t)), " ")
    return F.coalesce(F.nullif(kept, F.lit("")), text)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column) -> Column:
    """Half up; all values here are 0 or more."""
    return F.floor(x + 0.5).cast("int")
