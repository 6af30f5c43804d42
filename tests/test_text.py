"""Text functions against values worked out by hand, and as properties."""

from pyspark.sql import functions as F

from citeweave.functions import text as T


def values(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_arabic_normalising(spark):
    got = values(spark, ["الْحَمْدُ لِلَّهِ", "و وهبنا له", "عتيا قال", "يا ايها", "لو ما", None, "", "٢ ۳ (إلى)"], lambda x: T.normalized(x))
    assert got == ["الحمد لله", "ووهبنا له", "عتيا قال", "ياايها", "لوما", "", "", "2 3 الي"]


def test_normalising_twice_changes_nothing(spark):
    rows = ["قُلۡ يَٰٓأَيُّهَا ٱلۡكَٰفِرُونَ", "و و قال", "a, b; C!", "  ", "ف ب ل"]
    once = values(spark, rows, lambda x: T.normalized(x, T.LATIN))
    assert once == values(spark, rows, lambda x: T.normalized(T.normalized(x, T.LATIN), T.LATIN))


def test_tokens_skeleton_digits_escape(spark):
    assert values(spark, ["", "a  b", None], lambda x: T.tokens(x, T.LATIN)) == [[], ["a", "b"], []]
    assert values(spark, ["العالمين", "العلمين"], lambda x: T.skeleton(x)) == ["لعلمن", "لعلمن"]
    assert values(spark, ["120"], T.arabic_digits) == ["١٢٠"]
    assert values(spark, ["<a href=\"x\">'&`</a>", None], T.escaped_html) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#96;&lt;/a&gt;", ""]


def test_csv_guard_and_clock(spark):
    assert values(spark, ["=cmd", "-1", 'a"b', None], T.csv_cell) == ["\"'=cmd\"", "\"'-1\"", '"a""b"', '""']
    df = spark.createDataFrame([(5,), (65,), (3661,), (-1,), (None,)], "x int")
    assert [r[0] for r in df.select(T.clock(F.col("x"))).collect()] == ["00:05", "01:05", "1:01:01", "00:00", "00:00"]


def test_distance_and_near_token(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("abcd", "abce"), ("abc", "abd"), ("abcdefg", "abcdfge"), ("", "")], "a string, b string")
    rows = df.select(T.edit_distance(F.col("a"), F.col("b"), 2), T.near_token(F.col("a"), F.col("b")), T.edit_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [3, 1, 1, 2, 0]
    assert [r[1] for r in rows] == [False, True, False, True, False]
    assert rows[4][2] == 1.0


def test_noise(spark):
    assert values(spark, ["الحمد k 12 ... لله", "12 k", "للع…"], T.without_noise) == ["الحمد لله", "12 k", "للع…"]
    assert values(spark, ["الحمد (٢) لله (3) [12] (x)"], T.without_brackets) == ["الحمد لله"]
    assert values(spark, ["لله ...", "لله"], T.trailing_dots) == [True, False]
