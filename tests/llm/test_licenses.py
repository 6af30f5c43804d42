"""A short notice that stands several times in a row."""

from citeweave.llm import licenses


def test_repeated_short_notice(spark):
    notice = "All rights reserved."
    docs = spark.createDataFrame([(0, notice), (1, f"{notice}\n{notice}"), (2, f"a b {notice} {notice} {notice} c"), (3, "all rights")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score, r.n_notices) for r in licenses.scan(docs).collect()}
    assert got == {0: ("all-rights-reserved", 1.0, 1), 1: ("all-rights-reserved", 1.0, 2), 2: ("all-rights-reserved", 1.0, 3), 3: ("", 0.0, 0)}
