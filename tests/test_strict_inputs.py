"""Inputs that must fail loudly or be told apart."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillvec.functions.vector import fingerprint
from quillvec.operators.search import _matrix
from quillvec.sources.corpus import parse_jsonl, read_text_dir


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_values_that_are_not_finite_fail(bad):
    column = pa.array([[1.0, 2.0], [bad, 0.0]], pa.list_(pa.float32()))
    with pytest.raises(ValueError, match="finite"):
        _matrix(column, 2)


def test_fingerprint_of_doubles_and_nulls(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [5.0] * 4), (3, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    found = {r.id: (r.d, r.f) for r in df.select("id", fingerprint(F.col("v")).alias("d"), fingerprint(F.col("v").cast("array<float>")).alias("f")).collect()}
    assert found[1][0] != found[2][0] and found[1][0] == found[1][1] and found[3] == (None, None)


def test_single_quotes_are_malformed(spark):
    lines = spark.createDataFrame([("{'text': 'x'}",), ('{"text": "y"}',)], "value string")
    assert [r.text for r in parse_jsonl(lines).collect()] == ["y"]


def test_only_whole_objects_with_a_value_are_kept(spark):
    kept = [
        ('{"text": "a"}', "a"), ('{"text": "0"}', "0"), ('{"text": "false"}', "false"),
        ('{"text": "[]"}', "[]"), ('{"text": "{}"}', "{}"), ('  {"x": {"y": [1]}, "text": "b"} ', "b"),
        ('{"text": "q\\"uote ] } , \\u00e4"}', 'q"uote ] } , \u00e4'), ('{"text": 5}', "5"), ('{"text": true}', "true"),
    ]
    dropped = [
        '{"text": 0}', '{"text": 0.0}', '{"text": -0}', '{"text": false}', '{"text": []}', '{"text": {}}',
        '{"text": null}', '{"text": ""}', '{"text": "a"} trailing', '{"text": "a"}{"text": "b"}',
        '{"text": "a"},{"text": "b"}', '{"text": "a"}] x', '{"text": "a"', '["text"]', '"text"', "5", "",
    ]
    lines = spark.createDataFrame([(v,) for v, _ in kept] + [(v,) for v in dropped], "value string")
    assert sorted(r.text for r in parse_jsonl(lines).collect()) == sorted(t for _, t in kept)


def test_text_files_by_path_glob_in_path_order(spark, tmp_path):
    for name in ("a-b.txt", "a/b.txt", "a/c/d.txt", "a/c/e.md", "z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)

    def found(**options):
        return [r.text for r in read_text_dir(spark, str(tmp_path), **options).orderBy("doc_id").collect()]

    assert found() == ["a/b.txt", "a/c/d.txt", "a-b.txt", "z.txt"]
    assert found(glob="a/**/*.md") == ["a/c/e.md"]
    assert found(glob="a/*.txt") == ["a/b.txt"]
    assert found(glob="**/[!az].txt") == ["a/b.txt", "a/c/d.txt"]
    assert found(max_docs=1) == ["a/b.txt"]
