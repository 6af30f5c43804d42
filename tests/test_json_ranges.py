"""Arrays in JSON documents read in byte ranges, against the standard library's reader."""

import json
import random

import pytest

from citeweave.sources import tables as S
from citeweave.sources.json_ranges import JsonDocument

NASTY = ['"', "\\", '\\"', "\\\\", "{", "}", "[", "]", ",", ":", "a", "é", "字", "\n", " ", "null"]


def _value(r: random.Random, depth: int):
    kind = r.randrange(6 if depth else 4)
    if kind == 4:
        return [_value(r, depth - 1) for _ in range(r.randrange(4))]
    if kind == 5:
        return {_word(r): _value(r, depth - 1) for _ in range(r.randrange(4))}
    return [None, r.randrange(100), _word(r), True][kind]


def _word(r: random.Random) -> str:
    return "".join(r.choice(NASTY) for _ in range(r.randrange(12)))


@pytest.mark.parametrize("seed,size,block", [(1, 40, 7), (2, 97, 1), (3, 64, 1000), (4, 10_000, 13)])
def test_elements_equal_the_library(spark, tmp_path, seed, size, block):
    r = random.Random(seed)
    rows = [_value(r, 3) for _ in range(40)] + ["\\" * 150, '\\"' * 80]
    for i, (ascii_only, indent, wrapped) in enumerate([(True, None, False), (False, 2, True)]):
        path = tmp_path / f"{i}.json"
        beside = {'a"]\\': {"rows": [1]}, "b": "x,y:[{"}
        text = json.dumps({**beside, "rows": rows, "c": None} if wrapped else rows, ensure_ascii=ascii_only, indent=indent)
        path.write_bytes((b"" if ascii_only else b"\xef\xbb\xbf \n") + text.encode() + b"\n \n")
        doc = JsonDocument(spark, str(path), max(size, len(text) // 20), block)
        span = next((x[1:] for x in doc.keys if x[0] == "rows"), None) if wrapped else (None, None)
        if wrapped:
            assert {k: json.loads(doc.text(a, b)) for k, a, b in doc.keys if k != "rows"} == {**beside, "c": None}
        got = sorted(tuple(x) for x in doc.elements(*span).collect())
        assert [x[0] for x in got] == list(range(len(rows))) and [json.loads(x[1]) for x in got] == rows
        assert doc.n > 1 or size == 10_000


def test_ends(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(" [ \n ] ")
    assert JsonDocument(spark, str(path), 3, 2).elements().count() == 0
    for bad in ["", "  ", "[1, 2", '["a]', "[1]]"]:
        path.write_text(bad)
        with pytest.raises(ValueError):
            JsonDocument(spark, str(path), 3, 2)
    path.write_text('{"rows": 7}')
    doc = JsonDocument(spark, str(path), 4, 2)
    with pytest.raises(ValueError):
        doc.elements(*doc.keys[0][1:])
    path.write_text("[1, , 2]")
    with pytest.raises(Exception, match="nothing stands before byte 4"):
        JsonDocument(spark, str(path), 3, 2).elements().count()


def test_table_from_ranges(spark, tmp_path, monkeypatch):
    from citeweave.sources import json_ranges

    monkeypatch.setattr(json_ranges.JsonDocument.__init__, "__defaults__", (200, 64))
    rows = [{"id": i, 'a "q"': f"x{i}]}},", "n": {"k": [i, None]}} for i in range(50)]
    path, out = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    with open(path, "w") as f:
        json.dump({"data": None, "records": rows, "more": [1, {"z": "é"}]}, f)
    df, layout = S.read_json_table(spark, path)
    assert layout["wrapper"] == "records" and df.rdd.getNumPartitions() > 5
    S.write_json_table(df, layout, out)
    assert json.load(open(out)) == json.load(open(path))
    lines = open(out, encoding="utf-8").read().split("\n")
    assert lines[0] == "{" and lines[1] == '  "data": null,' and lines[2].startswith('  "records": [') and len(lines) == 50 + 6
