"""Choices of examples to look at: greedy ones with priorities and uniqueness, each round one aggregate over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import describe
from tessera.operators.sampling import greedy
from tessera.sources.scratch import written

#: Digits to which scores are compared, so that they do not hang on the order of sums.
DIGITS = 12


def typical(df: DataFrame, category: str, value: Column, out: str) -> DataFrame:
    """Adds 1 less the distance of log(1 + value) from its category's median, as a share of the largest such distance (1 at least).

    Values below 0, and null ones, count as 0. The median is taken in ranges, so
    a category can hold any share of the rows.
    """
    df = df.withColumn("_log", F.log1p(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("double")))
    middle = describe(df, [category], "_log", (0.5,)).select(F.col(category).alias("_c"), F.col("median").alias("_m"), F.greatest(F.lit(1.0), F.col("max") - F.col("median"), F.col("median") - F.col("min")).alias("_s"))
    return df.join(middle, F.col(category).eqNullSafe(F.col("_c"))).withColumn(out, F.round(1 - F.abs(F.col("_log") - F.col("_m")) / F.col("_s"), DIGITS)).drop("_log", "_c", "_m", "_s")


def _seen(taken: Column, c: str) -> Column:
    return F.exists(taken, lambda t: t[c].eqNullSafe(F.col(c)))


def representatives_by_rule(df: DataFrame, category: str, n: int, weights: dict[str, float], value: Column, frames: str, identity: str, priority: DataFrame | None = None) -> DataFrame:
    """n rows of each category, with pick from 1.

    First those of ``priority`` (identity, place) by place; then, one a round, the
    row with the greatest weight of values that no chosen row has plus typicality
    (see ``typical``), of equals that with the fewest frames, then the greatest
    identity. A category of n rows or fewer has all of them, in the order of
    their identity.

    Identities are unique; null values of weighed columns are a value; null
    frames count as 0; a repeated priority counts at its first place.
    """
    columns = df.columns
    rows = typical(df, category, value, "_typical").withColumn("_few", -F.coalesce(F.col(frames), F.lit(0)).cast("long"))
    if priority is None:
        rows = rows.withColumn("_first", F.lit(0).cast("long"))
    else:
        name, place = priority.columns
        first = priority.groupBy(F.col(name).alias("_id")).agg(F.max(-F.col(place).cast("long")).alias("_at"))
        # Above all others, and among themselves by place.
        rows = rows.join(first, F.col(identity) == F.col("_id"), "left").withColumn("_first", F.when(F.col("_at").isNull(), F.lit(-(2**62))).otherwise(F.col("_at"))).drop("_id", "_at")

    def order(taken: Column) -> list[Column]:
        score = F.col("_typical")
        for c, w in weights.items():
            score = score + F.when(_seen(taken, c), 0.0).otherwise(float(w))
        return [F.col("_first"), F.round(score, DIGITS), F.col("_few"), F.col(identity)]

    out = greedy(rows, [category], n, identity, [*weights, "_typical", "_few", "_first"], order, largest=True)
    sizes = df.groupBy(F.col(category).alias("_c")).agg(F.count("*").alias("_all"))
    by_name = F.row_number().over(Window.partitionBy(category).orderBy(identity))  # of n rows at most
    out = out.join(sizes, F.col(category).eqNullSafe(F.col("_c"))).withColumn("pick", F.when(F.col("_all") <= n, by_name).otherwise(F.col("pick")))
    return out.select(*columns, "pick")


def diverse_examples(df: DataFrame, order: Sequence[str], n: int, fresh: str, never: Sequence[str], identity: str) -> DataFrame:
    """n rows, with pick from 1: the first by ``order`` of each new value of ``fresh``, then the first of any; values of ``never`` are never chosen twice.

    Null values of these columns are one value. ``order`` and ``identity`` tell rows apart.
    """
    rows = df.withColumn("_one", F.lit(1))

    def turn(taken: Column) -> list[Column]:
        return [_seen(taken, fresh).cast("int"), *(F.col(c) for c in order)]

    def used(taken: Column) -> Column:
        out = F.lit(False)
        for c in never:
            out = out | _seen(taken, c)
        return out

    remember = list(dict.fromkeys([fresh, *never, *(c for c in order if c != identity)]))
    return greedy(rows, ["_one"], n, identity, [c for c in remember if c != identity], turn, unless=used).select(*df.columns, "pick")


def class_coverage(actors: DataFrame, candidates: DataFrame, n: int, name: str, error: str, usual: float, kind: str, place: Sequence[str], episode: str) -> DataFrame:
    """n rows (name, kind, episode, turn, pick): of each actor its candidate with the least episode.

    Actors stand by how far their error is from the usual one, then by name, both
    falling. First comes the first actor of each kind (turn 0), then all others
    (turn 1). An actor's kind is that of its first candidate by ``place``, or its
    name where that is null; actors without candidates take no part, and one that
    is listed more than once counts at its farthest. A null error counts as 0.

    Two aggregates and one sorted limit; no window, so a kind with most actors is no burden.
    """
    far = actors.groupBy(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("_name")).agg(F.max(F.abs(F.coalesce(F.col(error), F.lit(0.0)) - usual)).alias("_far"))
    own = candidates.groupBy(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("_name")).agg(F.min_by(F.struct(F.col(kind).cast("string").alias("v")), F.struct(*place)).alias("_kind"), F.min(F.col(episode).cast("long")).alias("_episode"))
    met = written(far.join(own, "_name").withColumn("_kind", F.coalesce("_kind.v", "_name")).withColumn("_rank", F.struct("_far", "_name")))
    first = met.groupBy(F.col("_kind").alias("_c")).agg(F.max("_rank").alias("_top"))
    out = met.join(first, F.col("_kind") == F.col("_c")).withColumn("turn", (F.col("_rank") != F.col("_top")).cast("int"))
    best = out.orderBy("turn", F.desc("_far"), F.desc("_name")).limit(n)
    pick = F.row_number().over(Window.orderBy("turn", F.desc("_far"), F.desc("_name")))  # of n rows at most
    return best.select(F.col("_name").alias(name), F.col("_kind").alias(kind), F.col("_episode").alias(episode), "turn", pick.alias("pick"))
