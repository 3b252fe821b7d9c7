"""Writers: JSON lines and CSV with modes, splits by predicate, manifests, resumable appends."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.readers import file_system
from tessera.sources.stored import move_over


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls written; refuses to overwrite unless the mode says so."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def split(df: DataFrame, outputs: dict[str, tuple[Column, Sequence[str] | None]], mode: str = "errorifexists") -> None:
    """Writes the rows that meet each test, with all or some columns, to a path each."""
    for path, (test, columns) in outputs.items():
        rows = df.filter(test)
        json_lines(rows.select(*columns) if columns else rows, path, mode)


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence[Column | str] = (), mode: str = "errorifexists") -> None:
    """CSV with a header; the given columns only, in their order, sorted."""
    rows = df.select(*columns) if columns else df
    (rows.orderBy(*order) if order else rows).write.mode(mode).option("header", True).csv(path)


def ragged_union(parts: Sequence[DataFrame], alphabetic: bool = False) -> DataFrame:
    """Rows of tables with different columns: their union in first-seen or alphabetic order, blanks where missing."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*sorted(out.columns)) if alphabetic else out


def manifest(df: DataFrame, measures: dict[str, Column], facts: dict[str, str]) -> DataFrame:
    """One JSON object of counts and provenance, as a row of text."""
    return df.agg(*(c.alias(k) for k, c in measures.items())).select(F.to_json(F.struct(*measures, *(F.lit(v).alias(k) for k, v in facts.items())), {"ignoreNullFields": "false"}).alias("value"))


def replace_file(lines: DataFrame, path: str) -> None:
    """Writes one column of text as one file, beside its place first, and moves it over what stands there in one step: there is always the old file or the new one. For small files."""
    spark, beside = lines.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    lines.coalesce(1).write.text(beside)
    fs, source = file_system(spark, beside)
    part = next(f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    target = file_system(spark, path)[1]
    fs.mkdirs(target.getParent())
    move_over(spark, part.toString(), path)
    fs.delete(source, True)


def keys(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """One key a line, sorted."""
    df.select(F.col(key).cast("string").alias("value")).distinct().orderBy("value").write.mode(mode).text(path)


def append_new(df: DataFrame, done: DataFrame | None, key: Sequence[str], path: str) -> None:
    """Appends the rows whose key is not done, so that a repeated call adds nothing."""
    rows = df if done is None else df.join(done.select(*key).distinct(), list(key), "left_anti")
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def shards(df: DataFrame, shard: str, path: str, mode: str = "errorifexists") -> None:
    """A folder for each shard, to be read again as one table."""
    df.write.mode(mode).partitionBy(shard).option("ignoreNullFields", False).json(path)


def markdown(rows: list[dict], columns: Sequence[str]) -> str:
    """A small collected summary as a table of text."""
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(columns), line("-" for _ in columns), *(line("" if r.get(c) is None else r[c] for c in columns) for r in rows)])
