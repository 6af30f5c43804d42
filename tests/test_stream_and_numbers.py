"""Batches that run again leave no doubles, stages take no more room with each batch; numbers and pages over many tasks."""

import os
import shutil

from pyspark.sql import functions as F

from citeweave.functions import sql as S
from citeweave.functions import text as T
from citeweave.operators import corpus as C
from citeweave.operators import numbering, review
from citeweave.plans import store
from citeweave.streaming import cancel_stream, process_stream


def _corpus(spark):
    return C.from_records(spark.createDataFrame([(1, 1, "one two three"), (1, 2, "four five six seven")], "sura int, aya int, ayahImlai string"), T.LATIN)


def test_a_batch_that_runs_again_leaves_no_doubles(spark, tmp_path, monkeypatch):
    from citeweave.plans import engine

    for i in range(3):
        spark.createDataFrame([(f"r{i}", "say (one two three) and (four five six seven)")], "id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monkeypatch.setattr(engine, "shared_folder", lambda s: str(tmp_path / "shared"))
    cfg, out = engine.Config(profile=T.LATIN), str(tmp_path / "out")
    corpus = store.kept(_corpus(spark), "corpus")
    sizes = []
    real = engine.process

    def counted(*a, **k):
        folder = next((tmp_path / "shared").glob("stream-*"), None)
        sizes.append(len(os.listdir(folder)) if folder else 0)
        return real(*a, **k)

    monkeypatch.setattr(engine, "process", counted)
    go = lambda: process_stream(stream, corpus, out, str(tmp_path / "state"), cfg, trigger={"availableNow": True})
    go().awaitTermination(300)
    rows = lambda: sorted((r.id, r.n_replacements) for r in spark.read.parquet(out).collect())
    assert rows() == [("r0", 2), ("r1", 2), ("r2", 2)]
    # tables of a batch stand where those of the batch before stood
    assert len(sizes) == 3 and sizes[1] == sizes[2] == len(os.listdir(next((tmp_path / "shared").glob("stream-*"))))
    # the last batch was written, but its commit was lost: it runs again
    for f in (tmp_path / "state" / "commits").glob("*2*"):
        f.unlink()
    go().awaitTermination(300)
    assert rows() == [("r0", 2), ("r1", 2), ("r2", 2)]
    query = process_stream(stream, corpus, out, str(tmp_path / "state"), cfg)
    cancel_stream(spark, query, out)
    assert not query.isActive
    shutil.rmtree(tmp_path / "shared", ignore_errors=True)


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = numbering.numbered(df, [F.desc("x")], "n", store.kept).collect()
    assert sorted((r.n, r.x) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    same = numbering.numbered(df.withColumn("x", F.lit(1)), ["x"], "n", store.kept)
    assert sorted(r.n for r in same.collect()) == list(range(1, 1001))
    assert numbering.numbered(df.limit(0), ["x"], "n", store.kept).count() == 0


def test_verses_are_numbered_alike_by_many_tasks(spark):
    rows = spark.createDataFrame([(c, v, f"word{c} word{v}") for c in range(9, 0, -1) for v in range(5, 0, -1)], "sura int, aya int, ayahImlai string")
    key = lambda df: sorted((r.v_idx, r.chapter, r.verse) for r in df.collect())
    assert key(C.from_records(rows, T.LATIN)) == key(C.from_records(rows, T.LATIN, keep=store.kept))


def test_a_page_reads_its_blocks_only(spark, tmp_path):
    facts = spark.range(5300).select((F.col("id") * 7 % 5300).alias("row_index"), F.lit("x").alias("original"))
    index = review.page_index(facts, [F.col("row_index")], str(tmp_path / "index"), store.kept)
    page = review.page_of(index, 6, 200)
    assert [r.row_index for r in page.collect()] == list(range(1000, 1200))
    assert len(os.listdir(tmp_path / "index")) >= 6 and len({r[0] for r in page.select("place", F.input_file_name()).select(F.regexp_extract("input_file_name()", "block=[0-9]+", 0)).collect()}) == 1
    assert "PartitionFilters: [isnotnull(block" in page._jdf.queryExecution().toString()
    assert review.page_of(index, 99, 200).count() == 0


def test_functions_in_sql(spark):
    rows = ["الْحَمْدُ لِلَّهِ", "و وهبنا له", "يا ايها", None, "a'b \\ c", "العالمين ٢٣"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    df.createOrReplaceTempView("texts_")
    for profile in (T.ARABIC, T.LATIN):
        assert len(S.register(spark, profile)) == 5
        got = spark.sql("SELECT i, citeweave_normalized(x) n, citeweave_tokens(x) t, citeweave_skeleton(x) s FROM texts_ ORDER BY i").collect()
        want = df.select("i", T.normalized(F.col("x"), profile).alias("n"), T.tokens(F.col("x"), profile).alias("t"), T.skeleton(F.col("x"), profile).alias("s")).orderBy("i").collect()
        assert got == want
    pairs = [("kitten", "sitting"), ("abcd", "abce"), ("abc", "abd"), ("abcdefg", "abcdfge"), ("", ""), ("a b c", "a c")]
    df = spark.createDataFrame(pairs, "a string, b string")
    df.createOrReplaceTempView("pairs_")
    got = spark.sql("SELECT citeweave_near_token(a, b) x, citeweave_similarity(a, b) y FROM pairs_").collect()
    assert got == df.select(T.near_token(F.col("a"), F.col("b")).alias("x"), T.similarity(F.col("a"), F.col("b")).alias("y")).collect()


def test_one_file_by_many_tasks(spark, tmp_path):
    from citeweave.sources.single_file import write_lines

    lines = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(9).withColumn("line", F.when(F.col("k") % 50 != 3, F.concat(F.lit("é"), "k")))
    path = tmp_path / "out.txt"
    write_lines(lines, ["k"], str(path), "\r\n", "head[", "<", "]foot")
    want = "head[<" + "\r\n".join("" if k % 50 == 3 else f"é{k}" for k in range(500)) + "]foot"
    assert path.read_bytes().decode() == want
    write_lines(lines.limit(0), ["k"], str(tmp_path / "none.txt"), ",", "a", "b", "c")
    assert (tmp_path / "none.txt").read_text() == "ac"

    @F.udf("string")
    def fails(k):
        if k == 250:
            raise ValueError("no")
        return str(k)

    for target in (path, tmp_path / "new.txt"):
        try:
            write_lines(lines.withColumn("line", fails("k")), ["k"], str(target))
            raise AssertionError("written")
        except Exception as e:
            assert "no" in str(e) and not isinstance(e, AssertionError)
    # what stood there stands; nothing else is left
    assert path.read_bytes().decode() == want and sorted(x.name for x in tmp_path.iterdir()) == ["none.txt", "out.txt"]
