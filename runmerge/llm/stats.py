"""Statistics of a text as native expressions, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

_WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, _WHITE, "")).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _WHITE, "")) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def with_repeat_words(df: DataFrame, ws: str, name: str) -> DataFrame:
    """Adds ``name``: the words in windows of eight that occur twice or more, the first included.

    Words are hashed once and windows by the hashes of their words, so two windows count as equal if 64 bits are.
    Windows are sorted by hash with their places, those equal to a neighbour are put back in order of place, and each
    adds the words up to the next one, eight at most. Only texts with equal windows are sorted. Each step is
    a column of its own that is used more than once, as Catalyst merges a column that is used once into its use, and a lambda
    computes again for every element what it refers to.
    """
    h, windows, equal, in_order, places = (F.col(f"{name}_{x}") for x in "hwesp")
    starts = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    same = lambda e, i: F.coalesce(F.get(in_order, i)["x"] == e["x"], F.lit(False))
    twice = F.transform(in_order, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return (
        df.withColumn(f"{name}_h", F.transform(ws, lambda w: F.xxhash64(w)))
        .withColumn(f"{name}_w", F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
        .withColumn(f"{name}_e", F.size(F.array_distinct(windows)) < F.size(windows))
        .withColumn(f"{name}_s", F.when(equal, F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
        .withColumn(f"{name}_p", F.sort_array(F.array_compact(twice)))
        .withColumn(name, F.coalesce(covered, F.lit(0)).cast("bigint"))
        .drop(*(f"{name}_{x}" for x in "hwesp"))
    )
