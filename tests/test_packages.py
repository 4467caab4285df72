"""Snapshots with pushed filters, and packages whose validator names what is wrong."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import contracts, rankstats
from lodestrand.sources import sinks, snapshots

KINDS = "station string, date date, tmax double"


@pytest.fixture
def folder(tmp_path):
    def file(name, site, days):
        rows = "".join(f"{site},{d},{v}\n" for d, v in days)
        (tmp_path / name).write_text(f"﻿station,date,tmax\n{rows}", encoding="utf-8")

    file("a-2001.csv", "A", [("2001-01-01", 5), ("2001-12-31", "")])
    file("a-2002.csv", "A", [("2002-01-01", 6), ("2002-06-01", 7)])
    file("b-2001.csv", "B", [("2001-05-05", 8)])
    return tmp_path


def test_filters_choose_files(spark, folder):
    path = str(folder)
    made = snapshots.seal_snapshots(spark, path, KINDS, "station", "date")
    assert made["files"]["a-2002.csv"]["first"] == "2002-01-01" and made["files"]["b-2001.csv"]["rows"] == 1
    assert snapshots.seal_snapshots(spark, path, KINDS, "station", "date") == made
    every = snapshots.snapshots(spark, path, KINDS)
    assert every.rdd.getNumPartitions() == 3 and every.count() == 5
    # Bytes that a filter keeps from being read may be anything.
    (folder / "b-2001.csv").write_text("station,date,tmax\nB,2001-05-05,9\n")
    one = every.where("station = 'A' AND date >= '2002-01-15'")
    assert one.rdd.getNumPartitions() == 1 and [(str(r.date), r.tmax) for r in one.collect()] == [("2002-06-01", 7.0)]
    assert sorted(str(r.tmax) for r in every.where("station IN ('A', 'Z') AND date < '2002-01-01'").collect()) == ["5.0", "None"]
    assert every.where("station = 'Z'").count() == 0 and every.where(F.col("tmax") > 6).where("station = 'A'").count() == 1
    with pytest.raises(Exception, match="b-2001.csv is not the file of the manifest"):
        every.collect()
    with pytest.raises(ValueError, match="not as in the immutable manifest: b-2001.csv"):
        snapshots.seal_snapshots(spark, path, KINDS, "station", "date")


def test_snapshots_are_validated(spark, folder):
    path = str(folder)
    snapshots.seal_snapshots(spark, path, KINDS, "station", "date")
    with pytest.raises(Exception, match="lacks tmin"):
        snapshots.snapshots(spark, path, "station string, tmin double").collect()
    (folder / "c.csv").write_text("station,date,tmax\nA,2003-01-01,1\nB,2003-01-01,1\n")
    with pytest.raises(ValueError, match="not of one site: c.csv"):
        snapshots.seal_snapshots(spark, path, KINDS, "station", "date")


def checks():
    rows = {"tests": {"p in range": ("range", F.col("p").between(0, 1))}}
    totals = {"tests": {"ten tests": ("coverage", F.count("*"), lambda v: v == 10)}}
    again = contracts.differing("tests", ["id"], ["holm"], lambda t: rankstats.holm(t["tests"].drop("holm", "passed"), "p", [], ["id"]))
    across = {"holm derived again": ("identity", again), "groups known": ("reference", contracts.lacking("tests", "groups", {"g": "name"})), "ids once": ("identity", contracts.repeated("tests", ["id"]))}
    return rows, totals, across


def package(spark, folder, spoil=None):
    tests = rankstats.holm(spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("g"), ((F.col("id") + 1) / 200).alias("p")), "p", [], ["id"])
    if spoil is not None:
        tests = tests.withColumn("holm", F.when(F.col("id") == spoil, 0.5).otherwise(F.col("holm")))
    return sinks.publish(spark, {"tests": tests.coalesce(1), "groups": spark.createDataFrame([("0",), ("1",)], "name string")}, folder, seeds={"bootstrap": 41})


def part_of(path):
    """The one part of the table, without the side file in which a local file system keeps checksums of its own."""
    for side in glob.glob(f"{path}/tests/.*.crc"):
        os.remove(side)
    (part,) = glob.glob(f"{path}/tests/*.parquet")
    return part


def failed(table):
    return {(r.table, r.check_id): (r.value, r.detail or "") for r in table.collect() if not r.passed}


def test_a_sound_package_passes(spark, tmp_path):
    manifest = package(spark, str(tmp_path / "p"))
    assert manifest["seeds"] == {"bootstrap": 41} and manifest["versions"]["spark"] == spark.version
    out = sinks.validate_package(spark, str(tmp_path / "p"), *checks())
    assert out.count() == 11 and not failed(out)
    contracts.enforce_all(out)


def test_what_is_wrong_is_named(spark, tmp_path):
    """A flipped byte, a dropped row, a file besides, a wrong value: each by its own check."""
    path = str(tmp_path / "flipped")
    package(spark, path)
    part = part_of(path)
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 1
    open(part, "wb").write(data)
    bad = failed(sinks.validate_package(spark, path, *checks()))
    assert "has other bytes" in bad["tests", "parts as published"][1] and part.split("/")[-1] in bad["tests", "parts as published"][1]
    assert bad["*", "holm derived again"] == (None, "tests is not as published") and bad["tests", "p in range"][1] and ("groups", "parts as published") not in bad

    path = str(tmp_path / "dropped")
    package(spark, path)
    part = part_of(path)
    short = spark.read.parquet(part).where("id <> 3").coalesce(1).toPandas()
    short.to_parquet(part)
    short.to_parquet(part.replace("part-", "part-9"))
    bad = failed(sinks.validate_package(spark, path, *checks()))
    assert bad["tests", "parts as published"][0] == 2.0 and "is not listed" in bad["tests", "parts as published"][1]

    path = str(tmp_path / "wrong")
    package(spark, path, spoil=4)
    bad = failed(sinks.validate_package(spark, path, *checks()))
    assert list(bad) == [("*", "holm derived again")] and '"id":4' in bad["*", "holm derived again"][1]
    with pytest.raises(ValueError, match="holm derived again"):
        contracts.enforce_all(sinks.validate_package(spark, path, *checks()))


def test_a_gate_names_all_failures(spark):
    tables = {"a": spark.createDataFrame([(1, 5.0), (1, None), (2, -1.0)], "k int, v double"), "b": spark.createDataFrame([(1,)], "key int")}
    out = contracts.check_tables(tables, {"a": {"v positive": ("range", F.col("v") > 0)}}, {"b": {"two rows": ("coverage", F.count("*"), lambda v: v == 2)}}, {"k known": ("reference", contracts.lacking("a", "b", {"k": "key"})), "k once": ("identity", contracts.repeated("a", ["k"]))})
    with pytest.raises(ValueError, match=r'\*: k known \(1, {"k":2}\); \*: k once \(1, {"k":1,"n":2}\); a: v positive \(2\); b: two rows \(1\)'):
        contracts.enforce_all(out)
