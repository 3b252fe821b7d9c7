"""Columns over strings: falsy fallbacks, safe names, sizes, descriptions, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def falsy_coalesce(*columns: Column | str) -> Column:
    """The first string that is neither null nor empty, else the last one as it is."""
    *head, last = map(col, columns)
    return F.coalesce(*(F.when(F.length(c) > 0, c) for c in head), last)


def safe_name(c: Column | str, default: str | None = None) -> Column:
    """Runs of other characters than letters, digits, _ . - become one underscore; with a default, outer underscores go and nothing left becomes it."""
    out = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^A-Za-z0-9_.\-]+", "_")
    if default is None:
        return out
    out = F.trim(out, F.lit("_"))
    return F.when(F.length(out) > 0, out).otherwise(F.lit(default))


def normalize_description(c: Column | str) -> Column:
    """White space collapsed and trimmed, trailing punctuation dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")), r"[ .,;:!?]+$", "")


# Size buckets in the order in which they are tried.
SIZES = ("small", "mid", "big")


def _first(tests, default) -> Column:
    out = None
    for test, value in tests:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def size_bucket(c: Column | str) -> Column:
    """small, mid or big where the text starts with it or has it after a blank; else unknown."""
    t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return _first([(t.startswith(s) | t.contains(f" {s}"), F.lit(s)) for s in SIZES], F.lit("unknown"))


def size_prefix(c: Column | str) -> Column:
    """small, mid or big where the text starts with it; else unknown."""
    t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return _first([(t.startswith(s), F.lit(s)) for s in SIZES], F.lit("unknown"))


def size_before_bracket(c: Column | str) -> Column:
    """The text before the first bracket, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(F.coalesce(col(c), F.lit("")), "(", 1)))


def size_word(c: Column | str) -> Column:
    """The first whole word small, mid or big; null without one."""
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(col(c), F.lit(""))), r"\b(small|mid|big)\b", 1), F.lit(""))


def size_letters(c: Column | str) -> Column:
    """The letters that the text starts with; null without any."""
    return F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"^\s*([A-Za-z]+)", 1), F.lit(""))


def short_id(prefix: str, *columns: Column | str, length: int = 12) -> Column:
    """A prefix with the first digits of the sha1 of the columns joined by colons."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(":", *map(col, columns))), 1, length))


def order_key(seed: int, *columns: Column | str) -> Column:
    """A repeatable order: sha1 of the seed and the columns, joined by colons."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *(col(c).cast("string") for c in columns)))


def bounded_stem(c: Column | str, most: int = 80) -> Column:
    """Texts over ``most`` characters keep their start and get 10 digits of their sha1."""
    return F.when(F.length(col(c)) <= most, col(c)).otherwise(F.concat(F.substring(col(c), 1, most - 11), F.lit("_"), F.substring(F.sha1(col(c)), 1, 10)))


def actor_name(c: Column | str) -> Column:
    """Letters and digits in lower case, without a trailing c and number."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]", ""), r"c\d+$", "")


def lenient(c: Column | str, kind: str, default) -> Column:
    """A cast whose failures and nulls become the default."""
    return F.coalesce(col(c).try_cast(kind), F.lit(default).cast(kind))


def bins(c: Column | str, cuts: list[tuple[float, str]], above: str, missing: str | None = None) -> Column:
    """The name of the first cut that the value does not exceed, else ``above``; nulls get ``missing``."""
    x = col(c)
    return _first([(x.isNull(), F.lit(missing)), *((x <= cut, F.lit(name)) for cut, name in cuts)], F.lit(above))


# The bins of pixel counts, distances and centre offsets.
PIXEL_BINS = [(0, "p0"), (128, "p1_128"), (512, "p129_512"), (2048, "p513_2048"), (8192, "p2049_8192")]
DISTANCE_BINS = [(4, "d0_4"), (8, "d4_8"), (12, "d8_12"), (16, "d12_16")]
CENTER_BINS = [(0.15, "center"), (0.35, "middle")]


def lookup_number(table: dict[str, float], key: Column, fallback: str = "unknown") -> Column:
    """A number by a key of a small fixed table, or by the fallback's key."""
    return _first([(key == F.lit(k), F.lit(v)) for k, v in table.items() if k != fallback], F.lit(table[fallback]))
