"""Tables replaced part by part: what a reader sees, lost writers, two writers."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import stored, writers

ROWS = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), (None, 1, 4.0), ('c "x"/é', 1, 5.0)]
KIND = "scene string, id int, v double"


def _seen(spark, path, parts=None):
    return sorted((tuple(r) for r in stored.read(spark, path, parts).collect()), key=str)


@pytest.fixture()
def path(spark, tmp_path):
    at = f"{tmp_path}/t"
    stored.create(spark.createDataFrame(ROWS, KIND), at, "scene")
    return at


def test_parts_are_replaced_dropped_and_added(spark, path):
    assert _seen(spark, path) == sorted(ROWS, key=str) and _seen(spark, path, ["a", None]) == sorted([r for r in ROWS if r[0] in ("a", None)], key=str)
    stored.replace(spark.createDataFrame([("a", 9, 9.0), ("d", 1, 1.0)], KIND), path)
    stored.replace(spark.createDataFrame([], KIND), path, [None, 'c "x"/é'])
    assert _seen(spark, path) == [("a", 9, 9.0), ("b", 1, 3.0), ("d", 1, 1.0)] and _seen(spark, path, ["none"]) == []
    stored.upsert(spark.createDataFrame([("a", 9, 0.0), ("a", 10, 1.0), (None, 1, 7.0)], KIND), path, ["scene", "id"])
    want = [("a", 10, 1.0), ("a", 9, 0.0), ("b", 1, 3.0), ("d", 1, 1.0), (None, 1, 7.0)]
    assert _seen(spark, path) == want
    assert stored.clean(spark, path) > 0 and _seen(spark, path) == want and stored.clean(spark, path) == 0
    with pytest.raises(FileExistsError):
        stored.create(spark.createDataFrame(ROWS, KIND), path, "scene")
    with pytest.raises(ValueError, match="other parts"):
        stored.replace(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], KIND), path, ["a"])
    with pytest.raises(ValueError, match="could stand in another part"):
        stored.upsert(spark.createDataFrame(ROWS, KIND), path, ["id"])
    assert _seen(spark, path) == want


def test_a_writer_that_fails_leaves_the_table(spark, path):
    broken = spark.createDataFrame(ROWS, KIND).withColumn("v", F.when(F.col("scene") == "b", F.raise_error(F.lit("lost")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="lost"):
        stored.replace(broken, path)
    assert _seen(spark, path) == sorted(ROWS, key=str)


def test_the_second_of_two_writers_is_refused(spark, path, monkeypatch):
    own = stored._written

    def slow(df, at, part):
        made = own(df, at, part)
        monkeypatch.setattr(stored, "_written", own)
        stored.replace(spark.createDataFrame([("a", 5, 5.0)], KIND), path)  # another one, meanwhile
        return made

    monkeypatch.setattr(stored, "_written", slow)
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        stored.replace(spark.createDataFrame([("a", 6, 6.0)], KIND), path)
    assert ("a", 5, 5.0) in _seen(spark, path)


_WRITER = """
import sys, time
from pyspark.sql import SparkSession
from tessera.sources import stored
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
started = sys.argv[2]
def slow(batches):
    for k, batch in enumerate(batches):
        yield batch
        open(started, "w").close()
        time.sleep(600)
rows = spark.createDataFrame([("a", 7, 7.0), ("b", 7, 7.0)], "scene string, id int, v double")
stored.replace(rows.mapInArrow(slow, rows.schema), sys.argv[1])
"""


def test_a_writer_that_is_killed_half_way_leaves_the_table(spark, path, tmp_path):
    started = tmp_path / "started"
    writer = subprocess.Popen([sys.executable, "-c", _WRITER, path, str(started)], env=os.environ | {"PYTHONPATH": os.getcwd()}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        for _ in range(240):
            if started.exists():
                break
            time.sleep(0.5)
    finally:
        writer.kill()
        writer.wait()
    assert started.exists() and _seen(spark, path) == sorted(ROWS, key=str)
    assert stored.clean(spark, path) >= 0 and _seen(spark, path) == sorted(ROWS, key=str)


def test_files_are_replaced_in_one_step(spark, tmp_path):
    at = f"{tmp_path}/f.txt"
    for text in ("one", "two"):
        writers.replace_file(spark.createDataFrame([(text,)], "value string"), at)
        assert open(at).read() == f"{text}\n"
    stored.write_text(spark, at, "three")
    assert open(at).read() == "three" and [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["f.txt"]
