"""The split reader of delimited files and numbering, against one-task reading and plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gridrisk.functions.numbering import numbered
from gridrisk.sources import delimited as L
from gridrisk.sources import readers as R
from gridrisk.sources import writers as W


def made(n, seed=1):
    pick = random.Random(seed)
    texts = ['plain', 'two\nlines', 'say "hi", all', '\n\n"\n"', 'end\r\nhere', None, " ", 'é, 😀\n', '"', 'x' * 300, 'a\n' * 40 + 'b']
    return [(i, f"{i:05d}", pick.choice(texts), pick.choice(texts)) for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_file_is_read_by_many_tasks_with_equal_rows(spark, tmp_path, small_blocks):
    df = spark.createDataFrame(made(600), "n int, code string, first string, second string")
    path = str(tmp_path / "one")
    W.write_csv(df.coalesce(1), path)
    raw = spark.read.option("lineSep", "\n").text(path)
    assert raw.rdd.getNumPartitions() > 20
    columns = ["second", "n", "code", "gone", "first"]
    got = L.read_delimited(spark, path, columns)
    want = R.read_csv_strings(spark, path, columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert rows == sorted(map(tuple, want.collect()), key=str) and len(rows) == 600
    # Records are numbered in the order of the file, the header being the first.
    assert [(r.record, r.code) for r in got.orderBy("record").collect()] == [(i + 2, f"{i:05d}") for i in range(600)]


def test_files_of_a_folder_and_odd_ends(spark, tmp_path, small_blocks):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_bytes('﻿b,a ,"c"\r\n1,"x\r\ny",3\r\n\r\n"4",5\r\n'.encode())
    (folder / "b.csv").write_bytes('b,a ,"c"\n7,"8 ""q"",",9,10'.encode())
    (folder / "c.csv").write_bytes('b,a ,"c"\n'.encode() + b'"' + b"long\n" * 3000 + b'",end,\n')
    got = L.read_delimited(spark, str(folder), ["a", "b", "c"])
    rows = {(os.path.basename(r.file), r.record): (r.a, r.b, r.c) for r in got.collect()}
    assert rows == {
        ("a.csv", 2): ("x\r\ny", "1", "3"), ("a.csv", 4): ("5", "4", None), ("b.csv", 2): ('8 "q",', "7", "9"),
        ("c.csv", 2): ("end", "long\n" * 3000, None),
    }


@pytest.mark.parametrize(
    ("texts", "columns"), [(["a,b\n1,2\n", "b,a\n1,2\n"], ["a"]), (["a,b\n1,2\n"], ["z"]), (['a,b\n1,"2\n'], ["a"]), ([""], ["a"])]
)
def test_files_that_cannot_be_read(spark, tmp_path, texts, columns):
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_text(text)
    with pytest.raises(ValueError):
        L.read_delimited(spark, str(tmp_path), columns)


def test_later_catalogue_file_wins(spark, tmp_path):
    """Order is that of file times, whatever the names and sizes."""
    header = "cveID,vendorProject,product,dateAdded,shortDescription,requiredAction,dueDate,knownRansomwareCampaignUse\n"
    for name, days, lines in (("z.csv", 9, 400), ("a.csv", 3, 1), ("m.csv", 6, 50)):
        path = tmp_path / "kev" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(header + "".join(f"C{i},{name},p,d,solar,act,due,Known\n" for i in range(lines)))
        past = path.stat().st_mtime - days * 86_400
        os.utime(path, (past, past))
    rows = R.read_kev_csv(spark, str(tmp_path / "kev")).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 452))
    assert [(r.vendorProject, r.cveID) for r in rows] == [
        (name, f"C{i}") for name, lines in (("z.csv", 400), ("m.csv", 50), ("a.csv", 1)) for i in range(lines)
    ]


def test_numbers_are_those_of_one_sort(spark):
    rows = [(i * 7919 % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = numbered(df, "n", F.col("a").desc(), F.col("b").asc())
    assert [(r.n, r.a, r.b) for r in got.orderBy("n").collect()] == [
        (n, a, b) for n, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)
    ]
    assert numbered(df.limit(0), "n", F.col("a").asc()).count() == 0
