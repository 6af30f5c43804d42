"""The whole engine on verses quoted in the public descriptions of this task, and the invariants of its results."""

import pytest
from pyspark.sql import functions as F

from citeweave.functions.text import LATIN
from citeweave.operators import corpus as C
from citeweave.operators import align, alike, extract, match, render, review
from citeweave.plans import engine

VERSES = [(1, 2, "الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ"), (1, 3, "الرَّحْمَنِ الرَّحِيمِ"), (1, 4, "مالك يوم الدين"), (1, 5, "اياك نعبد واياك نستعين"), (2, 1, "الم"), (43, 1, "حم"), (43, 2, "وَالْكِتَابِ الْمُبِينِ"), (44, 1, "حم"), (55, 13, "فَبِأَيِّ آلَاءِ رَبِّكُمَا تُكَذِّبَانِ"), (55, 47, "فَبِأَيِّ آلَاءِ رَبِّكُمَا تُكَذِّبَانِ"), (6, 84, "وَوَهَبْنَا لَهُ إِسْحَاقَ وَيَعْقُوبَ")]
ROWS = [
    ("G1", "قال (الحمد لله رب العالمين) ثم", None, None),
    ("G3", "(و وهبنا له اسحاق ويعقوب)", None, None),
    ("G4", "(الحمد لله رب العالمين الرحمن )", None, None),
    ("G9", "(مالك يوم الدين اياك نعبد)", None, None),
    ("G2", "(الحمد رب العالمين الرحمن )", None, None),
    ("G10", "(مالك يوم اياك نعبد)", None, None),
    ("groups", "(مالك يوم الدين والكتاب المبين)", None, None),
    ("glued", "(الحمدلله رب العالمين)", None, None),
    ("G15", "(الحمد)", None, None),
    ("G16", "(حم والكتاب المبين)", None, None),
    ("G17", "(فبأي آلاء ربكما تكذبان)", "55", "47"),
    ("G18", "(فبأي آلاء ربكما تكذبان)", None, "x"),
    ("G21", "(سبحان الله وبحمده) (2 3 4) (abc def)", None, None),
    ("G23", "(الحمد لله رب العلمين الرحمن الرحيم)", None, None),
    ("G24", "(الحمد لله رب العالمين) [الفاتحة: ٢]", None, None),
    ("G25", "(الحمد لله رب العالمين) [الفاتحة: ٧]", None, None),
    ("bare", "الحمد لله رب العالمين", None, None),
    ("null", None, None, None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return C.from_records(spark.createDataFrame(VERSES, "surah_num int, ayah_num int, ayah_imlai string")).cache()


def run(spark, corpus, rows):
    df = spark.createDataFrame(rows, "id string, text string, s string, a string")
    return {r.id: r for r in engine.process(df, corpus, engine.Config(names={1: "الفاتحة"}), chapter="s", verse="a").collect()}


def test_golden_cases(spark, corpus):
    got = run(spark, corpus, ROWS)
    one = "﴿الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ﴾ [الفاتحة: ٢]"
    two = "﴿الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ (٢) الرَّحْمَنِ الرَّحِيمِ (٣)﴾ [الفاتحة: ٢-٣]"
    assert got["G1"].modified_text == f"قال {one} ثم" and got["G1"].average_confidence == 100
    assert got["G3"].modified_text.startswith("﴿وَوَهَبْنَا")
    assert got["G4"].modified_text == two and got["G4"].average_confidence == 98
    assert got["G9"].modified_text.endswith("[الفاتحة: ٤-٥]")
    assert got["G2"].modified_text == two and got["G2"].average_confidence == 93
    assert got["G10"].modified_text == "﴿مالك يوم الدين (٤) اياك نعبد واياك نستعين (٥)﴾ [الفاتحة: ٤-٥]"
    assert got["groups"].modified_text == "﴿مالك يوم الدين﴾ [الفاتحة: ٤]\n﴿وَالْكِتَابِ الْمُبِينِ﴾ [سورة 43: ٢]" and got["groups"].total_verses == 2
    assert got["glued"].modified_text == one and got["glued"].average_confidence == 95
    assert got["G16"].modified_text.endswith("[سورة 43: ١-٢]")
    assert got["G17"].modified_text.endswith("٤٧]") and got["G17"].ambiguous == 1 and got["G17"].average_confidence == 100
    assert got["G18"].modified_text.endswith("١٣]") and got["G18"].average_confidence == 92
    assert got["G23"].modified_text == two
    assert got["G24"].modified_text == one
    assert got["G25"].modified_text == f"{one} [الفاتحة: ٧]"
    for k in ("G15", "G21", "bare", "null"):
        assert got[k].modified_text == dict((r[0], r[1]) for r in ROWS)[k] and got[k].n_replacements == 0
    again = run(spark, corpus, [(k, r.modified_text, None, None) for k, r in got.items() if k not in ("G17",)])
    assert all(again[k].modified_text == got[k].modified_text for k in again)
    assert engine.format_text("(الحمد لله رب العالمين)", corpus, engine.Config(names={1: "الفاتحة"})) == one


def test_alignment():
    """Word edits against brute force over which words are left out."""
    import itertools
    import random

    rng = random.Random(3)

    def brute(words, verse, most):
        best = None
        for n in range(len(words) + 1):
            # lost words of the verse and words too many within words[:n], the rest equal
            for lost in range(most + 1):
                for v in itertools.combinations(range(len(verse)), len(verse) - lost):
                    left = [verse[i] for i in v]
                    for w in itertools.combinations(range(n), len(left)) if n - len(left) + lost <= most and n >= len(left) else ():
                        if [words[i] for i in w] == left and (best is None or (lost + n - len(left), -n) < best):
                            best = (lost + n - len(left), -n)
        return best and (best[0], -best[1])

    for _ in range(200):
        verse = [rng.choice("abcd") for _ in range(rng.randint(2, 6))]
        words = [w for w in verse if rng.random() > 0.15]
        words[rng.randint(0, len(words)) :] = [rng.choice("abcd") for _ in range(rng.randint(0, 3))]
        want = brute(words, verse, 2)
        assert align.word_edits(words, verse) == (want if want and want[1] else None)
    assert align.word_edits(["one", "tvelve", "two"], ["one", "twelve", "two"]) == (1, 3)


def test_fuzzy_and_gaps_against_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(25)]
    verses = [(1, i + 1, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 9)))) for i in range(30)]
    corpus = C.from_records(spark.createDataFrame(verses, "sura int, aya int, ayahImlai string"), LATIN).cache()
    texts = []
    for i, (_, _, t) in enumerate(verses):
        w = t.split()[: rng.randint(3, 6)]
        w[1] = w[1][:-1] + "z"
        texts.append((i, " ".join(w)))
    cands = match.candidates(spark.createDataFrame(texts, "id long, text string"), LATIN)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for i, q in texts:
        n, best = len(q.split()), None
        for v, (_, a, t) in enumerate(verses):
            for s in range(len(t.split()) - n + 1):
                w = " ".join(t.split()[s : s + n])
                x, y, d = set(q.split()), set(w.split()), distance(q, w)
                score = min(100, 100 * (1 if q == w else 0.5 * len(x & y) / len(x | y) + 0.5 * (1 - d / max(len(q), len(w)))) + (10 if d <= 2 else 0))
                if x & y and score >= 85 and (best is None or (-score, v, s) < best):
                    best = (-score, v, s)
        if best:
            want[i] = (best[1] + 1, best[2])
    got = {r.id: (r.verse, r.start) for r in alike.fuzzy(cands, corpus).collect()}
    assert got == want and len(want) > 10


def test_empty_corpus_and_bad_records(spark):
    df = spark.createDataFrame([(0, 1, "x"), (1, 0, "x"), (1, 1, None), (1, 2, "...")], "sura int, aya int, ayahImlai string")
    assert C.from_records(df).count() == 0


def test_brackets():
    import re

    script = re.compile("[؀-ۿ]")
    spans = lambda t: [(s["start"], s["end"], s["text"]) for s in extract.bracketed(t, script)]
    assert spans("a (قال) b") == [(2, 7, "قال")]
    assert spans("(ا) (قا «بر» ل)") == [(4, 15, "قا «بر» ل")]
    assert spans("no ) closer") == [] and spans("") == [] and spans(None) == []
    assert spans("﴿قال (١) قيل\nx") == [(0, 12, "قال (١) قيل")]


def test_splice_keeps_the_rest(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2, "XX"), (4, 6, ""), (5, 99, "no")])], "t string, r array<struct<start:int,end:int,formatted:string>>")
    assert df.select(render.spliced(F.col("t"), F.col("r"))).first()[0] == "aXXcd"


def test_review(spark):
    rows = [(1, 0, 5, "Abc d", "x", 100, 1, 2, False, "format"), (1, 20, 25, "efg h", "efg h", 70, 1, 1, True, "correct"), (2, 0, 5, "abc D!", "y", 95, 2, 1, False, "format")]
    f = spark.createDataFrame(rows, "row_index int, start int, end int, original string, formatted string, confidence int, chapter int, verse_count int, ambiguous boolean, correction_type string")
    n = lambda k: review.filtered(f, k).count()
    assert [n(k) for k in ("all", "changed", "lowConf", "corrected", "multi", "ambiguous")] == [3, 2, 1, 1, 1, 1]
    from citeweave.functions.text import LATIN

    assert review.approved(f, f.filter("row_index = 1 and start = 0"), LATIN).count() == 1
    assert review.approved(f, f.filter("row_index = 1 and start = 0"), LATIN, skip_identical=False).count() == 2
    s = review.statistics(f).first()
    assert (s.modified_rows, s.replacements, s.verses, s.single, s.multi, s.low, s.ambiguous, s.average_confidence) == (2, 3, 4, 2, 1, 1, 1, 88)
    assert review.paged(f, 2, [F.col("row_index"), F.col("start")], 2).count() == 1


def test_review_of_many(spark):
    rows = [(1, 0, 5, "ب", "x", 100, "ب"), (1, 9, 12, "ا", "y", 70, "ا"), (2, 0, 5, "ت", "ت", 9, "ت")]
    f = spark.createDataFrame(rows, "row_index int, start int, end int, original string, formatted string, confidence int, chapter_name string")
    assert [r.original for r in f.orderBy(*review.order_by(f, "before")).collect()] == ["ا", "ب", "ت"]
    assert [r.confidence for r in f.orderBy(*review.order_by(f, "confidence", True)).collect()] == [100, 70, 9]
    gone = review.rejected_all(f, None, "lowConf")
    assert gone.count() == 2 and review.rejected_all(f, gone, "all").count() == 3
    assert tuple(review.approval_counts(f, gone).first()) == (1, 3)
    assert f.select(F.col("confidence")).count() == 3 and [r[0] for r in f.select(text_clamp()).collect()] == [80, 70, 20]


def text_clamp():
    from citeweave.functions.text import clamp

    return clamp(F.col("confidence"), 20, 80)


def test_votes_of_neighbours(spark, corpus):
    """A doubtful quotation is read again with the chapter that its sure neighbours name."""
    got = run(spark, corpus, [("v", "(والكتاب المبين) (حم والكتاب المبين) (حم والكتاب)", None, None)])["v"]
    assert "[سورة 43: ٢]" in got.modified_text and "44" not in got.modified_text


def test_documents_of_reports(spark, tmp_path):
    import json

    f = spark.createDataFrame([(1, 0, "a", 90), (1, 5, '"', 70)], "row_index int, start int, original string, confidence int").withColumns({"verse_count": F.lit(1), "ambiguous": F.lit(False)})
    review.write_document(review.csv_report(f, ["original"]), str(tmp_path / "c.csv"), "\r\n")
    assert (tmp_path / "c.csv").read_bytes().decode() == '\ufeff"original"\r\n"a"\r\n""""'
    review.write_json_document(f, str(tmp_path / "r.json"), "2026-01-01T00:00:00Z", {"source": "s"}, ["original"])
    got = json.load(open(tmp_path / "r.json"))
    assert got["generatedAt"].startswith("2026") and got["summary"]["source"] == "s" and got["summary"]["replacements"] == 2 and got["rows"] == [{"original": "a"}, {"original": '"'}]


def test_approved_exports(spark, tmp_path):
    import json

    rows = [(1, 0, 1, "a", 90), (1, 5, 6, "b", 70), (2, 0, 1, "B", 80), (3, 0, 1, None, 60)]
    f = spark.createDataFrame(rows, "row_index int, start int, end int, original string, confidence int").withColumns({"verse_count": F.lit(1), "ambiguous": F.lit(False)})
    no, path = f.filter("original = 'b'"), str(tmp_path / "out")
    assert review.write_approved(f, no, path, "csv", columns=["original"]) == 2
    assert open(path, "rb").read().decode() == '\ufeff"original"\r\n"a"\r\n""'
    assert review.write_approved(f, no, path, "csv", columns=["original"], skip_identical=False) == 3
    assert review.write_approved(f, no, path, "json", "2026", {"table": "t"}, ["confidence"]) == 2
    got = json.load(open(path))
    assert got["rows"] == [{"confidence": 90}, {"confidence": 60}] and got["summary"]["replacements"] == 2 and got["summary"]["table"] == "t"
    assert review.write_approved(f, no, path, "html", columns=["original"]) == 2
    page = open(path).read()
    assert page.startswith("<!DOCTYPE html>") and page.count("<tr>") == 3 and page.endswith("</html>")
    with pytest.raises(ValueError):
        review.write_approved(f, f, path, "csv", columns=["original"], skip_identical=False)
    with pytest.raises(ValueError):
        review.write_approved(f, no, path, "xml")
    assert open(path).read() == page


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([(2, 0, "a<b", 90), (1, 5, "=x", 70), (1, 0, None, 80)], "row_index int, start int, original string, confidence int").withColumns({"verse_count": F.lit(1), "ambiguous": F.lit(False)})
    review.write_report(review.csv_report(f, ["original", "confidence"]), str(tmp_path / "c"), "\r\n")
    data = next((tmp_path / "c").glob("part-*")).read_bytes().decode()
    assert data == '﻿"original","confidence"\r\n"","80"\r\n"\'=x","70"\r\n"a<b","90"\r\n'
    review.write_report(review.html_report(f, ["original"]), str(tmp_path / "h"))
    page = next((tmp_path / "h").glob("part-*")).read_text()
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</html>") and "<td>a&lt;b</td>" in page
    lines = [r.line for r in review.json_report(f, ["original"]).orderBy("part", "r", "s").collect()]
    assert lines[0] == '{"replacements":3,"verses":3,"averageConfidence":80,"lowConfidence":1}' and lines[3] == '{"original":"a<b"}'


def test_stream(spark, corpus, tmp_path):
    from citeweave.streaming import process_stream

    spark.createDataFrame([("a", "(الحمد لله رب العالمين)"), ("b", "no")], "id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, text string").parquet(str(tmp_path / "in"))
    process_stream(stream, corpus, str(tmp_path / "out"), str(tmp_path / "state"), trigger={"availableNow": True}).awaitTermination(180)
    got = {r.id: r.n_replacements for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 1, "b": 0}
