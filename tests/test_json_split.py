"""A top-level JSON array read by many ranges equals the multiLine read."""

import json
import random

import pytest

from expband.sources import io, json_split

SCHEMA = "job_id string, label string, title string, nested array<string>"
NASTY = ['a,b', '[', ']', '{', '}', '"', '\\', ',"', '\\",', 'é中', '\n', ' , ', '\\u002c', '']


def _records(rng, n):
    out = []
    for i in range(n):
        r = {"job_id": f"J{i}", "label": str(rng.randint(1, 4)),
             "title": "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 5))),
             "nested": ["".join(rng.choice(NASTY) for _ in range(2)) for _ in range(rng.randint(0, 3))]}
        if rng.random() < 0.2:
            r["extra"] = {"k": [1, {"x": ",]"}], "y": None}
        out.append(r)
    return out


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_many_ranges_equal_multiline(spark, tmp_path, small_ranges, indent):
    rng = random.Random(3)
    folder = tmp_path / "json"
    folder.mkdir()
    recs = _records(rng, 600)
    (folder / "a.json").write_text(json.dumps(recs, indent=indent, ensure_ascii=rng.random() < 0.5))
    (folder / "b.json").write_text(" [ ]\n")
    (folder / "c.json").write_text(json.dumps(recs[:7]))
    got = json_split.read_json(spark, str(folder), SCHEMA)
    assert spark.read.option("lineSep", ",").text(str(folder / "a.json")).rdd.getNumPartitions() > 10
    rows = [(r.job_id, r.label, r.title, r.nested) for r in got.orderBy("x_file", "x_order").collect()]
    want = [(r["job_id"], r["label"], r["title"], r["nested"]) for r in recs + recs[:7]]
    assert rows == want
    one = spark.read.schema(SCHEMA).json(str(folder), multiLine=True).collect()
    assert sorted(map(str, rows)) == sorted(str((r.job_id, r.label, r.title, r.nested)) for r in one)


def test_label_files_written_by_the_library(spark, tmp_path, small_ranges):
    rows = spark.createDataFrame([(f"J{i}", str(i % 4 + 1), "true" if i % 3 else "") for i in range(2000)],
                                 "job_id string, label string, unsure string")
    io.write_label_records(rows, str(tmp_path / "l"), per_file=700)
    got = json_split.read_json(spark, str(tmp_path / "l"), io.LABEL_SCHEMA)
    want = spark.read.schema(io.LABEL_SCHEMA).json(str(tmp_path / "l"), multiLine=True)
    assert sorted(map(tuple, got.drop("x_file", "x_order").collect())) == sorted(map(tuple, want.collect()))
