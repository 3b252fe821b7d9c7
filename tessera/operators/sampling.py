"""Deterministic choice of rows: quotas, stratified rounds, shards, greedy diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import col, order_key
from tessera.operators.aggregates import upper_median
from tessera.sources.scratch import written


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | Column) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*(col(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def hashed(df: DataFrame, keys: Sequence[str], identity: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows of each key, chosen by the hash of their identity: the same rows at any partitioning."""
    return first_n(df, keys, [order_key(seed, *identity), *identity], n)


def stratified_rounds(df: DataFrame, group: str, strata: Sequence[Column | str], order: Sequence[Column | str], limits: dict[str, int] | int) -> DataFrame:
    """Of each group so many rows, one of each stratum a round, strata in their order, until the limit.

    Adds round and pick. Taking the rows by (place in their stratum, stratum)
    is the same as going round the strata.
    """
    s = [col(c).alias(f"_s{k}") for k, c in enumerate(strata)]
    names = [f"_s{k}" for k in range(len(s))]
    rows = df.select("*", *s)
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy(group, *names).orderBy(*(col(c) for c in order))))
    most = F.lit(limits) if isinstance(limits, int) else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col(group)), F.lit(0))
    # A row of the k-th round is the k-th at least, so later rounds go before a group is put in order.
    rows = rows.filter(F.col("round") <= most).withColumn("pick", F.row_number().over(Window.partitionBy(group).orderBy("round", *names)))
    return rows.filter(F.col("pick") <= most).drop(*names)


def balanced(df: DataFrame, label: str, sub: str, quotas: dict[tuple[str, str], int], per_label: int, order: Sequence[Column | str]) -> DataFrame:
    """Up to per_label rows of each label, with at most a quota of those (label, sub) pairs that have one."""
    pairs = F.create_map(*(x for (a, b), n in quotas.items() for x in (F.lit(f"{a}|{b}"), F.lit(n)))) if quotas else None
    rows = df.withColumn("_k", F.row_number().over(Window.partitionBy(label, sub).orderBy(*(col(c) for c in order))))
    if pairs is not None:
        quota = F.try_element_at(pairs, F.concat_ws("|", label, sub))
        rows = rows.filter(quota.isNull() | (F.col("_k") <= quota))
    return first_n(rows.drop("_k"), [label], order, per_label)


def assign_shards(costs: DataFrame, key: str, cost: str, shards: int) -> DataFrame:
    """key, cost, shard: the largest first to the least loaded shard, ties by key and number.

    Equal costs are one run. When a run of cost c begins, a shard lies so many
    whole steps of c above the least loaded one, and a rest; its j-th row of the
    run comes at step whole + j, and within a step shards stand by rest and
    number. So the shard of the t-th row follows from t, and only the runs are
    gone through one after another, in one task that holds the loads alone: its
    steps are the distinct costs. Rows get their t by ranges of cost and key, so
    a run with most rows is spread over most ranges.

    Loads are added as exact fractions; rows without a cost count as 0, a cost
    of 0 or less goes to the least loaded shard; NaN is an error.
    """
    rows = costs.select(F.col(key).alias("_key"), F.col(cost).alias("_given"), F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("_cost"))
    dealt = written(rows.repartitionByRange(F.desc("_cost"), F.asc("_key")).withColumn("_part", F.spark_partition_id()))
    sizes = written(dealt.groupBy("_cost", "_part").agg(F.count("*").alias("_n")))
    runs = sizes.groupBy("_cost").agg(F.sum("_n").alias("_n")).repartition(1).sortWithinPartitions(F.desc("_cost"))
    begun = written(runs.mapInPandas(_Loads(shards), "_cost double, steps array<long>, shard array<int>"))
    below = F.sum("_n").over(Window.partitionBy("_cost").orderBy("_part")) - F.col("_n")
    # When i shards take part: from the row on at which the i-th highest of them is reached.
    steps = F.array_sort("steps")
    reached = F.transform(steps, lambda top, i: F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + top - x))
    parts = sizes.withColumn("_below", below).join(begun, "_cost").select("_cost", "_part", "_below", steps.alias("_steps"), reached.alias("_from"), F.arrays_zip("steps", "shard").alias("_order"))
    t = F.row_number().over(Window.partitionBy("_cost", "_part").orderBy("_key")) - 1 + F.col("_below")
    placed = dealt.join(parts, ["_cost", "_part"]).withColumn("_t", t)
    placed = placed.withColumn("_i", F.size(F.filter("_from", lambda f: f <= F.col("_t"))))
    step = F.when(F.col("_cost") > 0, F.col("_t") - F.element_at("_from", F.col("_i"))).otherwise(F.lit(0))
    taking = F.filter("_order", lambda o: o["steps"] <= F.element_at("_steps", F.col("_i")))
    chosen = F.when(F.col("_cost") > 0, F.get(taking, (step % F.col("_i")).cast("int"))["shard"]).otherwise(F.element_at("_order", 1)["shard"])
    return placed.select(F.col("_key").alias(key), F.col("_given").cast("double").alias(cost), chosen.alias("shard"))


class _Loads:
    """Goes through the runs, highest cost first: gives each run's shards by rest and number, with their whole steps above the least loaded one."""

    def __init__(self, shards: int):
        self._shards = shards

    def __call__(self, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [Fraction(0)] * self._shards
        for pdf in batches:
            out = []
            for cost, n in zip(pdf["_cost"].tolist(), pdf["_n"].tolist(), strict=True):
                c, least = Fraction(cost), min(loads)
                if c <= 0:
                    order = sorted(range(self._shards), key=lambda s: (loads[s], s))
                    out.append((cost, [0] * self._shards, order))
                    loads[order[0]] += n * c
                    continue
                above = [divmod(x - least, c) for x in loads]
                order = sorted(range(self._shards), key=lambda s: (above[s][1], s))
                out.append((cost, [int(above[s][0]) for s in order], order))
                for s, k in zip(order, taken([int(above[s][0]) for s in order], n), strict=True):
                    loads[s] += k * c
            yield pd.DataFrame(out, columns=["_cost", "steps", "shard"])


def taken(steps: Sequence[int], n: int) -> list[int]:
    """How many of n rows each shard gets, of shards in the order in which they stand within a step, that lie so many steps high."""
    most = sorted(steps)
    i = max(k for k in range(1, len(most) + 1) if sum(most[k - 1] - x for x in most[:k]) <= n)
    rounds, rest = divmod(n - sum(most[i - 1] - x for x in most[:i]), i)
    level, out = most[i - 1] + rounds, []
    for x in steps:
        one = x <= most[i - 1]
        out.append((level - x + (rest > 0)) if one else 0)
        rest -= one
    return out


def every_nth(df: DataFrame, index: str, shard: int, shards: int) -> DataFrame:
    return df.filter(F.pmod(F.col(index), F.lit(shards)) == shard)


def numeric_order(c: Column | str) -> list[Column]:
    """Sort keys that put numbers first, by value, then other strings."""
    n = col(c).try_cast("double")
    return [n.isNull().cast("int"), n, col(c)]


def best_of_pool(df: DataFrame, keys: Sequence[str], pool: int, order: Sequence[Column | str], choose: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Runs a choice in each key over its ``pool`` best rows by ``order``, where the pool is what is asked for: what one task holds is bounded by it."""
    return first_n(df, keys, order, pool).groupBy(*keys).applyInPandas(choose, df.schema)


def greedy(df: DataFrame, keys: Sequence[str], n: int, identity: str, remember: Sequence[str], order: Callable[[Column], Sequence[Column]], largest: bool = False, unless: Callable[[Column], Column] | None = None) -> DataFrame:
    """n rows of each key, one a round: that which is least in ``order``, over all rows of the key that are not taken yet; adds pick, from 1.

    ``order`` makes its sort keys from the taken ones, an array of structs of
    ``identity`` and ``remember``; it must tell rows apart. ``largest`` takes the
    greatest instead, and rows for which ``unless`` (of the taken ones) holds are
    passed over. A round is one
    aggregate of all rows, of which each task sends one a key, so a key can
    hold any number of rows; rounds are written, each key's taken ones are n at most.
    """
    key, fields = F.struct(*keys).alias("_k"), [identity, *remember]
    rows = written(df.select(*dict.fromkeys([*keys, *fields])).withColumn("_k", key))
    kind = F.array().cast(f"array<struct<{','.join(f'`{c}`:{rows.schema[c].dataType.simpleString()}' for c in fields)}>>")
    taken = written(rows.select("_k").distinct().withColumn("_taken", kind))
    for _ in range(n):
        met = rows.join(taken, "_k").filter(~F.exists("_taken", lambda t: t[identity].eqNullSafe(F.col(identity))))
        if unless is not None:
            met = met.filter(~unless(F.col("_taken")))
        best = met.groupBy("_k").agg((F.max_by if largest else F.min_by)(F.struct(*fields), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order(F.col("_taken")))))).alias("_b"))
        taken = written(taken.join(best, "_k", "left").select("_k", F.when(F.col("_b").isNull(), F.col("_taken")).otherwise(F.concat("_taken", F.array("_b"))).alias("_taken")))
    picks = taken.select(F.col("_k"), F.posexplode("_taken").alias("pick", "_b")).select("_k", (F.col("pick") + 1).alias("pick"), F.col(f"_b.{identity}").alias(identity))
    return df.withColumn("_k", key).join(picks, ["_k", identity]).drop("_k")


def diverse(df: DataFrame, keys: Sequence[str], n: int, quality: str, bits: str, path: str, weight: float = 0.25) -> DataFrame:
    """n rows of each key: the best, then those that add most quality and Hamming distance of 64-bit hashes to the nearest taken one; one row a path."""
    rows = df.groupBy(*keys, path).agg(F.max(F.struct(quality, bits)).alias("_r")).select(*keys, path, f"_r.{quality}", f"_r.{bits}")

    def order(taken: Column) -> list[Column]:
        apart = F.coalesce(F.array_min(F.transform(taken, lambda t: F.bit_count(t[bits].bitwiseXOR(F.col(bits))))), F.lit(0))
        return [-(F.col(quality) + weight * apart / 64), -apart, F.col(path)]

    return greedy(rows, keys, n, path, [quality, bits], order)


def covering(df: DataFrame, keys: Sequence[str], n: int, weights: dict[str, float], typical: str, identity: str) -> DataFrame:
    """n rows of each key, each adding most weight of values not yet seen in the columns, then typicality; of equals the smallest identity."""

    def seen(taken: Column, c: str) -> Column:
        return F.exists(taken, lambda t: t[c].eqNullSafe(F.col(c)))

    def order(taken: Column) -> list[Column]:
        gain = F.col(typical)
        for c, w in weights.items():
            gain = gain + F.when(seen(taken, c), 0.0).otherwise(float(w))
        return [-gain, F.col(identity)]

    return greedy(df, keys, n, identity, [*weights, typical], order)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def subset_in_order(df: DataFrame, index: str, n: int, seed: int) -> DataFrame:
    """n rows by the hash of their index, in the order of the index."""
    return df.orderBy(order_key(seed, index), index).limit(n).orderBy(index)


def rounds_from_end(df: DataFrame, lane: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """n rows, taken one of each lane a round from the end of its order."""
    back = Window.partitionBy(lane).orderBy(*(col(c).desc() for c in order))
    rows = df.withColumn("_round", F.row_number().over(back))
    return rows.orderBy("_round", lane).limit(n).drop("_round")


def typicality(df: DataFrame, value: Column, keys: Sequence[str], out: str = "typicality") -> DataFrame:
    """Adds how near the logarithm of a value is to its median within the keys: 1 at the median, falling with the distance."""
    log = F.log1p(value)
    middle = df.groupBy(*keys).agg(F.percentile(log, F.lit(0.5)).alias("_m"))
    return df.join(middle, list(keys)).withColumn(out, 1 / (1 + F.abs(log - F.col("_m")))).drop("_m")


def unique_first(unique: Sequence[str], never: Sequence[str], order: str, n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A choice of n rows in order: first those with new values of ``unique``, then any; values of ``never`` never twice."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, taken = pdf.sort_values(order, kind="stable").reset_index(drop=True), []
        fresh, used = set(), {c: set() for c in never}
        for strict in (True, False):
            for i in range(len(rows)):
                value = tuple(rows[c][i] for c in unique)
                if len(taken) == n or i in taken or (strict and value in fresh) or any(rows[c][i] in used[c] for c in never):
                    continue
                taken.append(i)
                fresh.add(value)
                for c in never:
                    used[c].add(rows[c][i])
        return rows.iloc[taken]

    return choose


def representatives(df: DataFrame, value: str, size: str, scene: str, key: str, n: int) -> DataFrame:
    """n rows by nearness to the upper median: one of each size, then of scenes not seen yet, then the rest.

    The order is made of ranks alone: the place of a row in its size, and
    whether its scene occurs among the first of the sizes.
    """
    middle = df.agg(upper_median(value).alias("_m"))
    rows = df.crossJoin(F.broadcast(middle)).withColumn("_gap", F.abs(F.col(value) - F.col("_m")))
    rows = rows.withColumn("_in_size", F.row_number().over(Window.partitionBy(size).orderBy("_gap", key)))
    firsts = rows.filter("_in_size = 1").select(F.col(scene).alias("_scene")).distinct().withColumn("_seen", F.lit(1))
    rows = rows.join(firsts, F.col(scene).eqNullSafe(F.col("_scene")), "left")
    rows = rows.withColumn("_in_scene", F.row_number().over(Window.partitionBy(scene, F.col("_in_size") == 1).orderBy("_gap", key)))
    turn = F.when(F.col("_in_size") == 1, 0).when(F.col("_seen").isNull() & (F.col("_in_scene") == 1), 1).otherwise(2)
    return rows.withColumn("_turn", turn).orderBy("_turn", "_gap", key).limit(n).drop("_m", "_gap", "_in_size", "_scene", "_seen", "_in_scene", "_turn")
