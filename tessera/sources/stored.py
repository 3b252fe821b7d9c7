"""Tables that are replaced part by part in place: a manifest says which folders they are, and is swapped last.

A table is a folder with a folder for each version and part, which is never
changed, and one manifest file. A writer writes whole new folders beside the old
ones and then moves a new manifest over the old one, in one step. Whoever reads
sees the table before or after; a writer that is lost leaves folders that no
manifest names, which ``clean`` takes away. Of two writers that began from the
same manifest the second is refused.

Parts are the values of one column, a few thousand at most: the manifest, a line
each, is read by the driver. Null is a part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.readers import exists, file_system

MANIFEST = "manifest.json"


def move_over(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file over another in one step, on file systems that can (HDFS, local disks); there is always the one or the other."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(source).toUri(), spark._jsc.hadoopConfiguration()) if "://" in source else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    path = jvm.org.apache.hadoop.fs.Path
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(source), path(target), over)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by the driver: written beside its place, then moved over what stands there."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, p = file_system(spark, beside)
    fs.mkdirs(p.getParent())
    out = fs.create(p, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    move_over(spark, beside, path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path}/{MANIFEST}"))


def _written(df: DataFrame, path: str, part: str) -> dict[str, str]:
    """Writes new folders, one for each part, and gives them by the part's value as JSON."""
    version, spark = uuid.uuid4().hex, df.sparkSession
    value = F.to_json(F.struct(F.col(f"`{part}`").cast("string").alias("v")), {"ignoreNullFields": "false"})
    df.withColumn("_part", F.sha2(value, 256)).write.partitionBy("_part").parquet(f"{path}/{version}")
    # What was written, not what the plan would give again.
    there = spark.read.schema(df.schema).parquet(f"{path}/{version}").select(value.alias("v"), F.sha2(value, 256).alias("folder")).distinct().collect()
    return {_named(json.loads(r.v)["v"]): f"{version}/_part={r.folder}" for r in there}


def create(df: DataFrame, path: str, part: str) -> None:
    """Writes a new table; refuses where there is one."""
    spark = df.sparkSession
    if exists(spark, f"{path}/{MANIFEST}"):
        raise FileExistsError(path)
    write_text(spark, f"{path}/{MANIFEST}", json.dumps({"version": 1, "part": part, "schema": df.schema.jsonValue(), "folders": _written(df, path, part)}))


def read(spark: SparkSession, path: str, parts: Sequence | None = None) -> DataFrame:
    """The table as it is now, or some of its parts: other folders are not listed."""
    now = _manifest(spark, path)
    wanted = None if parts is None else {_named(v) for v in parts}
    folders = [f"{path}/{f}" for v, f in now["folders"].items() if wanted is None or v in wanted]
    schema = T.StructType.fromJson(now["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _named(value) -> str:
    text = value if value is None or isinstance(value, str) else str(value)
    return json.dumps({"v": text}, separators=(",", ":"), ensure_ascii=False)


def replace(df: DataFrame, path: str, parts: Sequence | None = None) -> None:
    """Puts the rows in the place of the parts that they have, or of all the parts named; one without rows goes.

    Rows of a part that is not named are an error, found before anything is swapped.
    """
    spark, before = df.sparkSession, _manifest(df.sparkSession, path)
    schema = T.StructType.fromJson(before["schema"])
    made = _written(df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)), path, before["part"])
    named = set(made) if parts is None else {_named(v) for v in parts}
    if not set(made) <= named:
        raise ValueError(f"rows of other parts: {sorted(set(made) - named)}")
    folders = {v: f for v, f in before["folders"].items() if v not in named} | made
    if _manifest(spark, path)["version"] != before["version"]:
        raise RuntimeError(f"{path} was changed meanwhile")
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(before | {"version": before["version"] + 1, "folders": folders}))


def upsert(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Rows of equal keys are replaced, others added, by rewriting only the parts that the rows have; keys include the part."""
    spark = df.sparkSession
    part = _manifest(spark, path)["part"]
    if part not in keys:
        raise ValueError(f"the keys lack {part}, so a row could stand in another part")
    touched = [r[0] for r in df.select(part).distinct().collect()]
    same: Column | None = None
    new = df.select(*(F.col(f"`{k}`").alias(f"_new_{k}") for k in keys)).distinct()
    old = read(spark, path, touched)
    for k in keys:
        one = old[k].eqNullSafe(new[f"_new_{k}"])
        same = one if same is None else same & one
    replace(old.join(new, same, "left_anti").unionByName(df.select(*old.columns)), path, touched)


def clean(spark: SparkSession, path: str) -> int:
    """Deletes folders that the manifest does not name; gives how many. For when nobody reads or writes an older state."""
    named = {f.split("/")[0] for f in _manifest(spark, path)["folders"].values()}
    kept = {f for f in _manifest(spark, path)["folders"].values()}
    fs, p = file_system(spark, path)
    gone = 0
    for version in fs.listStatus(p):
        if not version.isDirectory():
            continue
        name = version.getPath().getName()
        for folder in [version] if name not in named else fs.listStatus(version.getPath()):
            if folder is version or folder.isDirectory() and f"{name}/{folder.getPath().getName()}" not in kept:
                gone += fs.delete(folder.getPath(), True)
    return gone
