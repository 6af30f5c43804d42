"""Operator 9, quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff. Labelled documents that pass the base rules are dealt to two
folds by a hash of their id. On the first, a path of ever stricter filters is laid for each stratum (language): step by
step, the cutoff that rejects most bad documents for the good ones it costs. On the second, the holdout, an exact
binomial test asks of each filter of the path, taken as a whole, whether its rate of false rejection can be said to lie
under the allowed risk. The path is walked while the tests succeed: a fixed sequence, which needs no correction, and as
whole filters are tested, none among rules either. Bonferroni shares the error among the strata. The last proven filter
is used, or none.

A stratum whose holdout is too small to prove anything is pooled with the others of that kind, and so are languages
beyond MOST and those without labels: all of them are one stratum, with one filter.

Nulls: a null text has no words (base rules reject it), a null language is a stratum of its own, a null label and
labels of unknown documents are ignored. Without labels nothing is proven, and only the base rules act. Repeated rows
get a verdict each. Columns of the input are kept or dropped as a whole; none of them clashes with the measures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Texts, byte_set, counts, gram_hash, mix, prefix_hash, slices, span_hash, stored

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_distinct_words", "n_digits"]
SYMBOLS, UPPER, MARKS, DIGITS = byte_set(b"#*$%&|<>"), byte_set(bytes(range(65, 91))), byte_set(b"!?.,;:"), byte_set(b"0123456789")
WINDOW = 8

#: Largest share of good documents that all rules together may reject in a stratum, and the error allowed for saying so.
RISK, ERROR = 0.05, 0.05
#: One of so many labelled documents lays the path, the others prove it. Strata of their own at most; the rest is pooled.
FOLDS, MOST = 5, 256
#: Labelled good documents that one rejected bad document may cost.
COST = 0.2


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: name: (measure, rejects above the cutoff (1) or below (-1), cutoffs from the loosest).
RULES: dict[str, tuple[Column, int, list[float]]] = {}


def rules() -> dict[str, tuple[Column, int, list[float]]]:
    if not RULES:
        down = [x / 100 for x in (90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 18, 16, 14, 12, 10, 8, 6, 5, 4, 3, 2, 1)]
        up = [x / 100 for x in range(2, 80, 3)]
        RULES.update(
            symbols=(_ratio("n_symbols", "word_chars"), 1, down),
            dup_lines=(_ratio("n_dup_lines", "n_lines"), 1, down),
            repeats=(_ratio("n_repeat_words", "n_words"), 1, down),
            upper=(_ratio("n_upper", "word_chars"), 1, down),
            marks=(_ratio("n_marks", "n_words"), 1, [x / 100 for x in range(200, 20, -10)]),
            digits=(_ratio("n_digits", "word_chars"), 1, down),
            distinct=(_ratio("n_distinct_words", "n_words"), -1, up),
            long_words=(_ratio("word_chars", "n_words"), 1, [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0]),
        )
    return RULES


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        t = Texts(part.column(part.schema.get_field_index("_text")))
        start, end, doc = t.words(NOT_SPACE)
        sums = prefix_hash(t.buf)
        word = span_hash(sums, start, end)
        out = {"n_words": counts(doc, t.n)}
        in_word = NOT_SPACE[t.buf]
        out["word_chars"] = t.per_text(in_word & ((t.buf & 0xC0) != 0x80))
        for name, chars in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_marks", MARKS), ("n_digits", DIGITS)):
            out[name] = t.per_text(chars[t.buf])
        own = mix(doc.astype(np.uint64))
        # lines that have a word
        line_end = np.flatnonzero(t.buf == 10)
        line_start = np.concatenate([[0], line_end[:-1] + 1]).astype(np.int64)
        sum_words = np.zeros(len(t.buf) + 1, np.int32)
        np.cumsum(in_word, out=sum_words[1:], dtype=np.int32)
        full = sum_words[line_end] > sum_words[line_start]
        line_start, line_end = line_start[full], line_end[full]
        line_doc = np.searchsorted(t.end, line_start).astype(np.int64)
        out["n_lines"] = counts(line_doc, t.n)
        with np.errstate(over="ignore"):
            _, first = np.unique(span_hash(sums, line_start, line_end) + mix(line_doc.astype(np.uint64)), return_index=True)
            out["n_dup_lines"] = out["n_lines"] - counts(line_doc[first], t.n)
            _, first = np.unique(word + own, return_index=True)
            out["n_distinct_words"] = counts(doc[first], t.n)
            # windows of eight words that come twice
            covered = np.zeros(len(word) + 1, np.int32)
            if len(word) >= WINDOW:
                window = gram_hash(word, WINDOW) + own[: len(word) - WINDOW + 1]
                inside = np.flatnonzero(doc[: len(window)] == doc[WINDOW - 1 :])
                _, where, times = np.unique(window[inside], return_inverse=True, return_counts=True)
                twice = inside[times[where] > 1]
                covered[twice] += 1
                covered[twice + WINDOW] -= 1
        out["n_repeat_words"] = counts(doc[np.cumsum(covered)[:-1] > 0], t.n)
        keep = [part.column(i) for i, f in enumerate(part.schema) if f.name != "_text"]
        names = [f.name for f in part.schema if f.name != "_text"]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(out[k]) for k in [*COUNTS, *MORE])], names=[*names, *COUNTS, *MORE])


def measured(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """id, stratum and the measures of each document; with keep_rows also the whole input row as column `row`."""
    kept = [F.struct("*").alias("row")] if keep_rows else []
    stratum = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    df = docs.select(*kept, F.col("doc_id").alias("id"), stratum.alias("stratum"), F.col("text").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in ("_text", "row"))
    row = f"row {_ddl(df.schema['row'].dataType)}, " if keep_rows else ""
    return df.mapInArrow(_measure, row + schema + "".join(f", {k} long" for k in [*COUNTS, *MORE]))


def _ddl(kind) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kind) + ">"


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def at_most(k: int, n: int, p: float) -> float:
    """Exact P(X <= k) of a binomial X."""
    if k >= n:
        return 1.0
    ln = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    mode = min(k, int(n * p))
    top, terms = ln(mode), []
    for i in range(k, -1, -1):
        terms.append(math.exp(ln(i) - top))
        if i <= mode and terms[-1] < 1e-20:
            break  # what is left below is smaller still
    return min(1.0, math.exp(top) * math.fsum(terms))


def least_needed(risk: float, level: float) -> int:
    """Good documents without one rejection that prove the risk."""
    return math.ceil(math.log(level) / math.log1p(-risk))


@dataclass
class Cutoffs:
    """For each stratum of its own, and for the rest, rule: cutoff. MOST strata at most."""

    own: dict[str, dict[str, float]] = field(default_factory=dict)
    rest: dict[str, float] = field(default_factory=dict)


def _steps() -> Column:
    """For each rule the first step of its ladder that rejects the document (the ladder's length: none)."""
    steps = []
    for name, (value, side, cuts) in rules().items():
        # cutoffs that don't reject come first on the ladder; so their number is the first step that does
        steps.append(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: (value <= c) if side > 0 else (value >= c))).alias(name))
    return F.struct(*steps)


def _rejects(filters: dict[str, dict[str, int]]) -> Column:
    """Whether the filter of the row's stratum (rule: step) rejects it."""
    out = F.lit(False)
    for stratum, steps in filters.items():
        for rule, step in steps.items():
            out = out | ((F.col("stratum") == stratum) & (F.col(f"steps.{rule}") <= step))
    return out


def _laid(seen: DataFrame) -> dict[str, list[dict[str, int]]]:
    """The path of filters of each stratum, on the first fold. A job for each step; strata x rules x steps rows come back."""
    ladder, path, now = {k: len(v[2]) for k, v in rules().items()}, {}, {}
    for _ in ladder:
        left = seen.filter("first").filter(~_rejects(now))
        listed = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"steps.{k}").alias("step")) for k in ladder))).alias("x")
        found = left.select("stratum", "quality", listed).groupBy("stratum", "x.rule", "x.step").agg(F.sum("quality").alias("good"), F.count("*").alias("n")).collect()
        marks: dict[tuple[str, str], np.ndarray] = {}
        for stratum, rule, step, good, n in found:
            if step < ladder[rule]:
                marks.setdefault((stratum, rule), np.zeros((2, ladder[rule]), np.int64))[:, step] = good, n - good
        best: dict[str, tuple] = {}
        for (stratum, rule), m in sorted(marks.items()):
            if rule in now.get(stratum, {}):
                continue  # each rule is set once
            lost, caught = m.cumsum(axis=1)
            gain = COST * caught - lost
            top = np.flatnonzero(gain == gain.max())
            run = top[: int(np.argmax(np.append(np.diff(top) > 1, True))) + 1]  # the first stretch of equal cutoffs: its middle
            if gain.max() > best.get(stratum, (0,))[0]:
                best[stratum] = (gain.max(), rule, int(run[len(run) // 2]))
        if not best:
            break
        for stratum, (_, rule, step) in best.items():
            now[stratum] = now.get(stratum, {}) | {rule: step}
            path.setdefault(stratum, []).append(now[stratum])
    return path


def fitted(measures: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> Cutoffs:
    """The proven cutoffs, from measures (stored: they are read again for each step of the path) and labels."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    first = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(FOLDS)) == 0
    seen = measures.join(known, "id").filter(~base_failed()).select("stratum", "quality", first.alias("first"), _steps().alias("steps"))
    seen = stored(seen, "labelled")
    # strata that could prove something if each of the largest were tested, with one more for the rest
    sizes = seen.filter("not first and quality = 1").groupBy("stratum").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stratum").limit(MOST).collect()
    own: list[str] = []
    for stratum, n in sizes:
        if n >= least_needed(risk, error / (len(own) + 2)):
            own.append(stratum)
    level = error / (len(own) + 1)
    rest = "\0"  # no language
    seen = seen.withColumn("stratum", F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(rest))
    path = _laid(seen)
    longest = max(map(len, path.values()), default=0)
    tests = [_rejects({s: p[i] for s, p in path.items() if i < len(p)}).cast("long") for i in range(longest)]
    got = seen.filter("not first and quality = 1").groupBy("stratum").agg(F.count("*").alias("n"), F.array(*map(F.sum, tests)).alias("lost")).collect() if tests else []
    out = Cutoffs({s: {} for s in own})
    for stratum, n, lost in got:
        proven: dict[str, int] = {}
        for steps, k in zip(path.get(stratum, []), lost):
            if k > n * risk or at_most(k, n, risk) > level:
                break  # the sequence ends at the first filter that isn't proven
            proven = steps
        cuts = {rule: rules()[rule][2][step] for rule, step in proven.items()}
        if stratum == rest:
            out.rest = cuts
        else:
            out.own[stratum] = cuts
    return out


def judged(measures: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """The measures with base_failed and kept."""
    names = list(rules())
    kind = "stratum string, cut struct<" + ", ".join(f"{k}: double" for k in names) + ">"
    listed = [(s, tuple(cuts.get(k) for k in names)) for s, cuts in cutoffs.own.items()]
    own = measures.sparkSession.createDataFrame(listed, kind).withColumn("is_own", F.lit(True))  # MOST rows at most
    bad = F.lit(False)
    for name, (value, side, _) in rules().items():
        cut = F.when(F.col("is_own"), F.col(f"cut.{name}")).otherwise(F.lit(cutoffs.rest.get(name)).cast("double"))
        bad = bad | F.coalesce(value > cut if side > 0 else value < cut, F.lit(False))
    return measures.join(F.broadcast(own), "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the quality rules keep, with their own columns."""
    cutoffs = fitted(stored(measured(docs), "measures"), labels)
    return judged(measured(docs, keep_rows=True), cutoffs).filter("kept").select("row.*")
