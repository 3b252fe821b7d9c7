"""Columns over JSON whose shape differs from row to row, held as VARIANT, and over maps of scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col

_NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
#: What a label of a candidate was given: sums and means of log probabilities, and how many tokens.
SCORE = "struct<sum_logprob:double,mean_logprob:double,token_count:double>"


def parsed(json: Column | str) -> Column:
    """JSON text as VARIANT; null for null and for text that is no JSON."""
    return F.try_parse_json(col(json))


def shape(v: Column | str) -> Column:
    """array, object, text, number, boolean or null, as the outermost value is; null where nothing was parsed."""
    found = F.schema_of_variant(col(v))
    return (
        F.when(found.startswith("ARRAY"), "array")
        .when(found.startswith("OBJECT"), "object")
        .when(found == "STRING", "text")
        .when(found.rlike(_NUMBERS), "number")
        .when(found == "BOOLEAN", "boolean")
        .when(found == "VOID", "null")
    )


def numbers(v: Column | str) -> Column:
    """A list as doubles, null for each member that is no number; null for what is no list."""
    members = F.try_variant_get(col(v), "$", "array<variant>")
    return F.transform(members, lambda e: F.when(F.schema_of_variant(e).rlike(_NUMBERS), F.try_variant_get(e, "$", "double")))


def positions(v: Column | str) -> Column:
    """Positions (x, y, z) of a pose: of one flat list, of each list in a list, or of the ``position`` of an object; else an empty list.

    Lists of fewer than three members, or with another value than a number among
    the first three, are left out; what follows the third (a heading) is cut off.
    """
    v = col(v)
    at = F.when(shape(v) == "object", F.try_variant_get(v, "$.position", "variant")).otherwise(v)
    three = lambda a: F.slice(a, 1, 3)
    whole = lambda a: F.coalesce((F.size(a) == 3) & F.forall(a, lambda x: x.isNotNull()), F.lit(False))
    flat = three(numbers(at))
    each = F.filter(F.transform(F.coalesce(F.try_variant_get(at, "$", "array<variant>"), F.array().cast("array<variant>")), lambda e: three(numbers(e))), whole)
    return F.when(whole(flat), F.array(flat)).otherwise(each)


def found_fields(df: DataFrame, column: str) -> dict[str, str]:
    """The fields of the objects in a VARIANT column with the types that hold all their values, as one aggregate finds them; ``variant`` where kinds differ.

    An aggregate that merges: each task sends one schema, whose size is that of
    the fields. Values that are no objects add no field.
    """
    objects = df.filter(shape(column) == "object")
    text = objects.agg(F.schema_of_variant_agg(col(column)).alias("s")).first().s
    return _fields(text) if text and text.startswith("OBJECT<") else {}


def _fields(text: str) -> dict[str, str]:
    """Top-level fields of OBJECT<a: BIGINT, b: ARRAY<...>>; names with other characters stand in backquotes."""
    out, body, depth, start, quoted = {}, text[len("OBJECT<") : -1], 0, 0, False
    for k, c in enumerate([*body, ","]):
        quoted ^= c == "`"
        depth += 0 if quoted else (c in "<(") - (c in ">)")
        if c == "," and not depth and not quoted:
            name, kind = re.fullmatch(r"\s*(`(?:[^`]|``)*`|[^:]*): (.*)", body[start:k], re.S).groups()
            kind = re.sub(r"OBJECT<", "struct<", kind)
            out[name[1:-1].replace("``", "`") if name.startswith("`") else name] = "string" if kind == "VOID" else re.sub(r"\bVOID\b", "string", kind)
            start = k + 1
    return out


def shredded(df: DataFrame, column: str, fields: dict[str, str] | None = None, prefix: str = "") -> DataFrame:
    """Adds a typed column for each field of the objects in a VARIANT column: given ones, or those found; a value that its type cannot hold is null.

    Fields of differing kinds stay VARIANT. Existing columns of those names are replaced.
    """
    for name, kind in (found_fields(df, column) if fields is None else fields).items():
        quote = '"' if "'" in name else "'"
        if quote in name:
            raise ValueError(f"no path leads to a name with both quotes: {name}")
        df = df.withColumn(prefix + name, F.try_variant_get(F.col(f"`{column}`"), f"$[{quote}{name}{quote}]", kind))
    return df


def candidate_scores(v: Column | str, path: str = "$.candidate_scores") -> Column:
    """Label to (sum_logprob, mean_logprob, token_count) of an evaluation step; null where it has none."""
    return F.try_variant_get(col(v), path, f"map<string,{SCORE}>")


def means(scores: Column | str) -> Column:
    """Label to mean log probability: the stored mean, else sum over tokens; labels without either are left out."""
    each = F.transform_values(col(scores), lambda _, s: F.coalesce(s["mean_logprob"], F.try_divide(s["sum_logprob"], s["token_count"])))
    return F.map_filter(each, lambda _, m: m.isNotNull())


def score_gaps(a: Column | str, b: Column | str) -> Column:
    """Label to difference of two maps of numbers, over the labels of both; a label that one lacks has null."""
    return F.map_zip_with(col(a), col(b), lambda _, x, y: x - y)


def ranked(scores: Column | str) -> Column:
    """Labels by falling score, equal ones by name."""
    entries = F.transform(F.map_entries(col(scores)), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("label")))
    return F.transform(F.array_sort(entries), lambda e: e["label"])


def ranks(scores: Column | str) -> Column:
    """Label to its place from 1 by falling score, equal ones by name."""
    return F.map_from_entries(F.transform(ranked(scores), lambda label, k: F.struct(label, k + 1)))
