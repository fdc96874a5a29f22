"""Quoted multi-line CSV read by many ranges equals the one-task read."""

import random

import pytest
from pyspark.sql import functions as F

from expband.sources import csv_split, io

PIECES = ["a", "b c", '"', '""', ",", "\n", "\r\n", "é中", " ", "x" * 50, "line\nfeed", ""]


def _field(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))


def _quoted(v):
    return '"' + v.replace('"', '""') + '"'


def _write(path, rng, rows, crlf=False):
    end = "\r\n" if crlf else "\n"
    data = [(str(i), _field(rng), _field(rng)) for i in range(rows)]
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("id,a,b" + end)
        for r in data:
            f.write(",".join(_quoted(v) if (i or rng.random() < 0.5) else v for i, v in enumerate(r)) + end)
    return data


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("crlf", [False, True])
def test_many_ranges_equal_one_task(spark, tmp_path, small_ranges, crlf):
    rng = random.Random(5 + crlf)
    folder = tmp_path / "csv"
    folder.mkdir()
    want = _write(str(folder / "one.csv"), rng, 700, crlf)
    got = csv_split.read_csv(spark, str(folder))
    assert spark.read.option("lineSep", "\n").text(str(folder)).rdd.getNumPartitions() > 10
    rows = [(r.id, r.a, r.b) for r in got.orderBy("x_file", "x_order").collect()]
    assert [(i, a or "", b or "") for i, a, b in rows] == want  # an empty field reads as null, as Spark's reader does
    one = io.read_csv(spark, str(folder)).collect()  # the one-task read of the same file

    def same(v):  # in files of CRLF lines, Spark's reader also turns a quoted CRLF into LF; the split read keeps it
        return v.replace("\r\n", "\n") if crlf and v else v
    assert sorted([tuple(map(same, r)) for r in rows], key=str) == sorted([tuple(map(same, (r.id, r.a, r.b))) for r in one], key=str)


def test_many_files_and_empty_lines(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    folder = tmp_path / "csv"
    folder.mkdir()
    want = []
    for k in range(3):
        want += _write(str(folder / f"{k}.csv"), rng, 50 * k)
    with open(folder / "3.csv", "a", encoding="utf-8") as f:
        f.write('id,a,b\n\n"9","x\n\ny",""\n\n')
    want.append(("9", "x\n\ny", ""))
    got = csv_split.read_csv(spark, str(folder))
    assert sorted((r.id, r.a or "", r.b or "") for r in got.collect()) == sorted(want)


def test_last_row_wins_by_file_order(spark, tmp_path, small_ranges):
    folder = tmp_path / "csv"
    folder.mkdir()
    with open(folder / "a.csv", "w", encoding="utf-8") as f:
        f.write("UniqueJobAdID,OrigJobTitle,JobDescription\n")
        for i in range(300):
            f.write(f'"{i % 7}","t{i}","d ""{i}""\nmore"\n')
    got = io.last_wins(csv_split.read_csv(spark, str(folder)), "UniqueJobAdID", ["x_file", "x_order"])
    assert {r.UniqueJobAdID: r.OrigJobTitle for r in got.collect()} == {str(k): f"t{max(i for i in range(300) if i % 7 == k)}"
                                                                         for k in range(7)}
