"""Exact dedup by a heavy-hitter split.

Texts are reduced to a SHA-256 of their normalised form. A Misra-Gries summary of every partition finds the
digests that may be frequent; an exact count verifies them; the at most ``k`` winners are broadcast and settle
their rows where they are, so that a text with a third of all rows is never shuffled. What is left has at most
``2 n / k`` rows a digest and goes through an ordinary shuffle: digests are summed up, so that a task sends one row for
each, and joined back, where Spark may split a digest of many rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, whole


def merge_counters(counters: dict, more: dict, k: int) -> dict:
    """The Misra-Gries summary of both inputs: at most ``k`` counters, each too low by at most n / (k + 1)."""
    for key, n in more.items():
        counters[key] = counters.get(key, 0) + n
    if len(counters) > k:
        least = sorted(counters.values(), reverse=True)[k]
        counters = {key: n - least for key, n in counters.items() if n > least}
    return counters


def misra_gries(df: DataFrame, column: str, k: int) -> DataFrame:
    """``value, estimate`` of every value of ``column`` with more than 2 n / k rows, and at most ``k`` rows in all.

    Each partition yields at most ``k`` counters; their sums are too low by at most n / (k + 1) in all.
    """

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for batch in batches:
            counters = merge_counters(counters, Counter(batch.column(0).to_pylist()), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], ["value", "estimate"])

    n = df.count()
    return (
        df.select(column)
        .mapInArrow(summarise, "value binary, estimate bigint")
        .groupBy("value")
        .agg(F.sum("estimate").alias("estimate"))
        .filter(F.col("estimate") * k >= n)
        .orderBy(F.desc("estimate"), "value")
        .limit(k)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), k: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256`` and the ``carry`` columns.

    Texts are equal when they are identical after each run of white space became one space. Of equal texts the
    row with the smallest id stays. A null text counts as empty. A null id is larger than any other; of rows
    with equal text and equal id exactly one stays, the first in the order of reading. An empty table gives none. Other
    columns of ``docs`` are not read, whatever their names.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    digests = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.regexp_replace(whole(text_col), f"{SPACE}+", " "), 256)).alias("digest"),
            *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = lambda rows: rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))
    frequent = F.broadcast(cut(misra_gries(digests, "digest", k).select(F.col("value").alias("digest"))))  # k rows at most
    winners = groups(digests.join(frequent, "digest"))
    others = digests.join(frequent, "digest", "left_anti")
    found = digests.join(F.broadcast(winners), "digest").unionByName(others.join(groups(others), "digest"))
    return found.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)),
    )
