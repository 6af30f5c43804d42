"""Round trips of SQLite, JSON, text and DOCX."""

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from citeweave.sources import documents as D
from citeweave.sources import tables as S


def test_sqlite(spark, tmp_path):
    path, name = str(tmp_path / "a.db"), 'odd "name'
    db = sqlite3.connect(path)
    db.execute(f"CREATE TABLE {S.quoted(name)} (ID INTEGER PRIMARY KEY, AyahText TEXT NOT NULL, x REAL)")
    db.executemany(f"INSERT INTO {S.quoted(name)} VALUES (?, ?, ?)", [(1, "a", 1.5), (2, "b", None)])
    db.commit()
    db.close()
    S.register(spark)
    assert S.list_tables(path) == [name]
    df = spark.read.format("sqlite").option("table", name).load(path)
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [(1, "a", 1.5), (2, "b", None)]
    assert df.schema["ID"].metadata["primary_key"]
    out = str(tmp_path / "b.db")
    S.write_sqlite(df.orderBy("ID"), out, name, S.table_sql(path, name))
    assert sqlite3.connect(out).execute(f"SELECT * FROM {S.quoted(name)}").fetchall() == [(1, "a", 1.5), (2, "b", None)]
    (tmp_path / "no.db").write_text("nothing")
    with pytest.raises(ValueError):
        S.list_tables(str(tmp_path / "no.db"))


@pytest.mark.parametrize("doc", [[[1, 3, "t", None, "1-7"], [2]], [{"SuraID": 1, "t": "x", "n": {"a": [1]}}, {"t": None, "z": True}], {"data": [[1, 2, "q"]]}, {"name": "x", "rows": [[1, 2, "q"]], "meta": {"v": [1, None]}, "none": None}])
def test_json_table(spark, tmp_path, doc):
    path, out = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    open(path, "w").write(json.dumps(doc))
    df, layout = S.read_json_table(spark, path)
    S.write_json_table(df, layout, out)
    got = json.load(open(out))
    key = layout["wrapper"]
    inner, want = (got[key], doc[key]) if isinstance(doc, dict) else (got, doc)
    if isinstance(doc, dict):  # what stands beside the rows stays, in its order
        assert list(got) == list(doc) and {k: v for k, v in got.items() if k != key} == {k: v for k, v in doc.items() if k != key}
    for a, b in zip(inner, want):
        if isinstance(b, dict):
            assert {k: v for k, v in a.items() if v is not None} == {k: v for k, v in b.items() if v is not None}
        else:
            assert a == b + [None] * (len(a) - len(b))


def test_columns():
    assert S.guess_column(["x", "AyahText"], "ayahtext", "text") == "AyahText"
    assert S.guess_column(["x", "mytext2"], "ayahtext", "text") == "mytext2"
    assert S.guess_column(["x", "y"], "text") == "x"


def test_text_paragraphs(spark):
    text = "\n".join(f"line {i}" for i in range(50)) + "\f\f\nlast\r\n\r\rend"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "id string, text string")
    rows = D.text_paragraphs(df, "id", "text").orderBy("paragraph").collect()
    assert len(rows) == 52 and rows[44].page == 1 and rows[45].page == 2
    assert rows[-1].text == "end" and rows[-1].paragraph == 52


def test_page_estimate(spark):
    df = spark.createDataFrame([(["a" * 1000, "b" * 700, "c" * 200, "d" * 5000, "e"],)], "t array<string>")
    assert df.select(D.estimated_pages(F.col("t"))).first()[0] == [1, 1, 2, 3, 4]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:br w:type="page"/><w:t>three</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("other.bin", b"keep")
    path = tmp_path / "a.docx"
    path.write_bytes(data.getvalue())
    rows = D.read_docx(spark, str(path)).orderBy("p_index").collect()
    assert [(r.page, r.paragraph, r.p_index, r.text) for r in rows] == [(1, 1, 0, "one two"), (2, 2, 2, "three")]
    files = spark.read.format("binaryFile").load(str(path)).select("path", "content")
    edits = files.select("path", F.lit(2).alias("p_index"), F.lit("new").alias("text"))
    out = D.docx_with_edits(files, edits).first().content
    assert [p["text"] for p in D.docx_paragraphs(bytes(out))] == ["one two", "new"]
    assert zipfile.ZipFile(io.BytesIO(out)).read("other.bin") == b"keep"
    with pytest.raises(ValueError):
        D.docx_paragraphs(b"no zip")


def test_sqlite_odd_keys_updates_and_saves(spark, tmp_path):
    path = str(tmp_path / "a.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t (ID INTEGER PRIMARY KEY, AyahText TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(-5, "a"), (2, "b"), (9_000_000_000_000, "c")])
    db.execute("CREATE TABLE w (k TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID")
    db.execute("INSERT INTO w VALUES ('x', 'y')")
    db.commit()
    db.close()
    df, layout = S.read_table(spark, path)
    assert layout["format"] == "sqlite" and layout["table"] == "t"
    assert sorted(tuple(r) for r in df.collect()) == [(-5, "a"), (2, "b"), (9_000_000_000_000, "c")]
    assert [tuple(r) for r in S.read_table(spark, path, "w")[0].collect()] == [("x", "y")]
    assert S.update_sqlite(spark.createDataFrame([(2, "B"), (77, "no")], "k long, v string"), path, "t", "AyahText", "ID") == 1
    assert sqlite3.connect(path).execute("SELECT AyahText FROM t ORDER BY ID").fetchall() == [("a",), ("B",), ("c",)]
    with pytest.raises(ValueError):
        S.save_table(df, layout, str(tmp_path / "no.db"), 0)
    assert S.save_table(df, layout, str(tmp_path / "b.db"), 1) == "sqlite" and S.list_tables(str(tmp_path / "b.db")) == ["t"]
    assert S.save_table(df.orderBy("ID"), layout, str(tmp_path / "b.json"), 1, "json") == "json"
    assert json.load(open(tmp_path / "b.json"))[0] == {"ID": -5, "AyahText": "a"}
    doc, layout = S.read_table(spark, str(tmp_path / "b.json"))
    assert layout["format"] == "json" and doc.count() == 3


def test_documents_are_routed_and_saved(spark, tmp_path):
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "b.txt").write_text("PK first\n\nsecond", encoding="utf-8")
    (tmp_path / "c.other").write_text("third", encoding="utf-8")
    before = D.read_document(spark, str(tmp_path)).cache()
    name = lambda p: p.rsplit("/", 1)[1]
    assert sorted((name(r.path), r.paragraph, r.text) for r in before.collect()) == [("a.docx", 1, "one"), ("a.docx", 2, "two"), ("b.txt", 1, "PK first"), ("b.txt", 2, "second"), ("c.other", 1, "third")]
    assert D.as_table(before).columns[:3] == ["ص", "الفقرة", "AyahText"]
    after = before.withColumn("text", F.when(F.col("text") == "two", "2").when(F.col("text") == "second", "2nd").otherwise(F.col("text")))
    got = {name(r.path): bytes(r.content) for r in D.save_documents(spark, str(tmp_path), before, after).collect()}
    assert [x["text"] for x in D.docx_paragraphs(got["a.docx"])] == ["one", "2"]
    assert got["b.txt"].decode() == "\ufeffPK first\n\n2nd" and set(got) == {"a.docx", "b.txt", "c.other"}


def test_corpus_files(spark, tmp_path):
    from citeweave.operators import corpus as C

    good = [{"surah_num": 1, "ayah_num": 1, "ayah_imlai": "الحمد لله", "ayah_notashkil": "الحمد ل لله"}, {"surah_num": 1, "ayah_num": 1, "ayah_imlai": "رب العالمين"}]
    (tmp_path / "good.json").write_text(json.dumps({"verses": good}), encoding="utf-8")
    (tmp_path / "bad.json").write_text("[]", encoding="utf-8")
    with pytest.warns(UserWarning):
        assert C.auto_load(spark, [str(tmp_path / "none.json"), str(tmp_path / "bad.json")]) is None
    path, corpus = C.auto_load(spark, [str(tmp_path / "none.json"), str(tmp_path / "bad.json"), str(tmp_path / "good.json")])
    assert path.endswith("good.json") and [r.norm for r in corpus.orderBy("v_idx").collect()] == ["الحمد لله", "رب العالمين"]
    assert corpus.orderBy("v_idx").first().alias == "الحمد ل لله"
    assert [r.norm for r in C.by_key(corpus).collect()] == ["رب العالمين"]  # the last of a key that comes twice
