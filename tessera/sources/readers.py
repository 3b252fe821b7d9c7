"""Readers of episode data: JSON lines, JSON files keyed by path, tables of text, rasters."""

from __future__ import annotations

import io
import json
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, a bad line fails the job that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """One object a line; bad lines are left out."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def bad_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """file, rows, bad: how many lines of each file are no object of the schema."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(F.length(F.trim("value")) > 0)
    bad = F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"})["_bad"]
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.count(bad).alias("bad"))


def numbered_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """file, line (from 1, by file), value, and row if a schema is given.

    Lines are numbered without a single task: each split keeps the order of its
    file, and the counts of the splits before it are added.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    within = raw.withColumn("_k", F.row_number().over(Window.partitionBy("file", "block").orderBy("_id")))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = within.join(sizes, ["file", "block"]).select("file", (F.col("_before") + F.col("_k")).alias("line"), "value")
    return out if schema is None else out.withColumn("row", F.from_json("value", schema))


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """file, place (from 0) and the members of each file that holds one array of objects; other files are errors."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", T.ArrayType(T._parse_datatype_string(schema) if isinstance(schema, str) else schema), {"mode": "FAILFAST"}).alias("rows"))
    return raw.select("file", F.posexplode("rows").alias("place", "row")).select("file", "place", "row.*")


def at_line(spark: SparkSession, path: str, wanted: DataFrame, line: str, schema: T.StructType | str) -> DataFrame:
    """Adds row, the object on the line (from 1) of the file that each wanted row names by its columns file and ``line``; null where there is none."""
    lines = numbered_lines(spark, path, schema).select("file", F.col("line").alias(line), "row")
    return wanted.join(lines, ["file", line], "left")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], error: str | None = None, retry: bool = False) -> DataFrame:
    """Tasks whose key is not done; where failures are retried, only rows without an error count as done."""
    finished = done.filter(F.length(F.coalesce(F.col(error), F.lit(""))) == 0) if error and retry else done
    return tasks.join(finished.select(*keys).distinct(), keys, "left_anti")


def output_counts(spark: SparkSession, path: str, schema: T.StructType, error: str, hit: str) -> DataFrame:
    """rows, errors, hits of the lines of a folder; a line that is no object is an error."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    found = spark.read.schema(full).option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.col("_bad").isNotNull() | (F.length(F.coalesce(F.col(error), F.lit(""))) > 0)
    return found.agg(F.count("*").alias("rows"), F.count_if(bad).alias("errors"), F.count_if(F.coalesce(F.col(hit), F.lit(False)) & F.col("_bad").isNull()).alias("hits"))


def path_parts(pattern: str, names: list[str]) -> list[Column]:
    """Columns from the groups of a pattern over a file's path, for readers of files keyed by path."""
    return [F.regexp_extract(F.col("_metadata.file_path"), pattern, k + 1).alias(n) for k, n in enumerate(names)]


def keyed_json(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str, names: list[str], keep: DataFrame | None = None) -> DataFrame:
    """One object a file, with key columns from its path; only files whose key is in ``keep``, if that is given."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("*", *path_parts(pattern, names))
    return rows if keep is None else rows.join(keep.select(*names).distinct(), names, "left_semi")


def partitioned_lines(spark: SparkSession, folder: str, schema: T.StructType | str, skip: str = "failed_", key: str = "scene") -> DataFrame:
    """JSON lines of a folder without files whose name starts with ``skip``; a missing key is the file's stem."""
    rows = spark.read.schema(schema).json(folder).withColumn("_file", F.col("_metadata.file_name")).filter(~F.col("_file").startswith(skip))
    stem = F.regexp_replace("_file", r"\.[^.]*$", "")
    return rows.withColumn(key, F.coalesce(F.col(key), stem) if key in rows.columns else stem).drop("_file")


def by_suffix(spark: SparkSession, folder: str, schemas: dict[str, T.StructType | str], rest: T.StructType | str) -> dict[str, DataFrame]:
    """A table for each suffix of file names, and one under "" for all other files."""
    out = {s: spark.read.schema(schema).option("pathGlobFilter", f"*{s}").json(folder) for s, schema in schemas.items()}
    others = spark.read.schema(rest).json(folder).withColumn("_file", F.col("_metadata.file_name"))
    for s in schemas:
        others = others.filter(~F.col("_file").endswith(s))
    return out | {"": others.drop("_file")}


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def lanes(spark: SparkSession, path: str) -> DataFrame:
    """lane, gpu, scenes (array), dataset of a tab-separated table of three or four columns."""
    rows = spark.read.schema("lane string, gpu string, scenes string, dataset string").option("sep", "\t").option("mode", "PERMISSIVE").csv(path)
    scenes = F.filter(F.transform(F.split("scenes", ","), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return rows.filter(F.col("lane").isNotNull()).withColumn("scenes", scenes)


def key_list(spark: SparkSession, path: str, field: str = "trajectory_key", parts: int = 3) -> DataFrame:
    """key of each line that is neither blank nor a comment; a line may be an object with the key in a field. A key without so many parts is an error."""
    line = F.trim(F.col("value"))
    rows = spark.read.text(path).filter((F.length(line) > 0) & ~line.startswith("#"))
    key = F.when(line.startswith("{"), F.get_json_object(line, f"$.{field}")).otherwise(line)
    ok = F.assert_true(F.size(F.split(key, "::")) == parts, F.concat(F.lit("bad key "), line))
    return rows.select(key.alias("key"), ok.alias("_ok")).filter(F.col("_ok").isNull()).select("key")


def progress(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """step, completed: the largest n of n/expected in a log."""
    found = F.transform(F.regexp_extract_all("value", F.lit(rf"(\d+)/{expected}\b"), F.lit(1)), lambda s: s.cast("long"))
    return spark.read.text(path).select(F.explode(found).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("step")).withColumn("completed", F.col("step") >= expected)


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    fs, p = file_system(spark, path)
    return fs.exists(p)


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, with the schema they have now."""
    fs, p = file_system(spark, path)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return source.parquet(path) if fs.getFileStatus(p).isDirectory() else source.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def merged_or_parts(spark: SparkSession, merged: str, parts: str, schema: T.StructType | str) -> DataFrame:
    """The merged table where it is written, else the parts."""
    return spark.read.schema(schema).json(merged if exists(spark, merged) else parts)


def policy(spark: SparkSession, path: str) -> dict:
    """A small object from a JSON file: its member policy, else itself."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    payload = json.loads(text)
    return payload.get("policy", payload)


def file_listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length, modified of the files below a folder, as a table to join paths with."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def npy_shapes(files: DataFrame) -> DataFrame:
    """path, height, width, finite, least of stored arrays (binaryFile rows): finite values and their least; nulls for what is no array of two dimensions."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    a = np.load(io.BytesIO(data), allow_pickle=False)
                    ok = np.isfinite(a) if a.ndim == 2 else None
                except (ValueError, EOFError, OSError, TypeError):
                    ok = None
                rows.append((path, None, None, None, None) if ok is None else (path, *a.shape, int(ok.sum()), float(a[ok].min()) if ok.any() else None))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "finite", "least"]).astype({"height": "Int32", "width": "Int32", "finite": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, finite long, least double")


def stem(path: str) -> str:
    return PurePosixPath(path).stem
