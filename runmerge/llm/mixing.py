"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. A source is cut at its budget in the order of that key: the key's first
digits split each source into buckets that are in range order, bucket sums give distributed prefix sums, and
each bucket is sorted by itself. So no task ever holds a whole source. Budgets above a source's size take whole
epochs first; the document at the cut is taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, whole

DECIMAL = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``sizes`` (``source, source_size``, a row for each source) with ``target`` and ``budget``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops
    at ``cap`` times its source's size; the excess is shared anew by weight until none is above. That is a water
    level: with sources in the order of size by weight, the first so many stop at their cap and the others
    share what remains.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything).cast(DECIMAL)
    left = total - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)).cast(DECIMAL)
    rest = F.sum("weight").over(after)
    level = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.lit(list(weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
        .withColumn("left", left)
        .withColumn("rest", rest)
        .withColumn("capped", (F.col("source_size") * cap).cast(DECIMAL) * F.col("rest") <= F.col("weight") * F.col("left"))
    )
    opened = F.min(F.when(~F.col("capped"), F.struct("order_", "left", "rest"))).over(everything)
    return (
        level.withColumn("order_", F.row_number().over(fill))
        .withColumn("open", opened)
        .withColumn("capped", F.coalesce(F.col("order_") < F.col("open.order_"), F.lit(True)))
        .select(
            "source", "source_size", "weight",
            F.when(F.col("capped"), (F.col("source_size") * cap).cast("double"))
            .otherwise((F.col("weight") * F.col("open.left")).cast("double") / F.col("open.rest").cast("double"))
            .alias("target"),
        )
        .withColumn("budget", F.round("target").cast("bigint"))
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix", carry: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, source_size, target, taken`` and ``source, epochs, before, carry...``.

    ``size`` counts the text's words (null: 0). ``taken`` is how many words the mix takes of the row: its size
    for each whole epoch, and in the last, partial epoch all, some or none of it. The ``taken`` of a source add
    up to its target, rounded. Reruns agree: the key is a hash of seed and id, and ties are broken by id, size
    and text. A null source is a source; a null id is an id. Rows with no words take none. An empty table gives
    none. Other columns of ``docs`` are not read.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(whole(text_col).cast("binary"))).cast("binary"))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), F.regexp_count(whole(text_col), F.lit(WORD)).cast("bigint").alias("size"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)),
        ).withColumn("bucket", F.substring("key", 1, 3))
    )
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    prefix = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(prefix), F.lit(0)))
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "start", "source_size", "target", "budget")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", *names).rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("bigint")
    return (
        rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("before", F.col("start") + F.col("own"))
        .withColumn("epochs", epochs)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before"))))
        .select(
            "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
            "source", "epochs", "before", *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)),
        )
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM s),
w2 AS (SELECT *, CAST((r - 1) % 3 + 1 AS BIGINT) AS weight FROM w),
f AS (SELECT *, row_number() OVER o AS ord,
        sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
        sum(weight) OVER (ORDER BY source_size / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w2 WINDOW o AS (ORDER BY source_size / weight, r)),
g AS (SELECT min(ord) AS ord FROM f WHERE 3 * source_size * rest > weight * l),
h AS (SELECT f.ord, f.l, f.rest FROM f JOIN g USING (ord)),
t AS (SELECT f.source, f.source_size,
        CASE WHEN h.ord IS NULL OR f.ord < h.ord THEN CAST(3 * f.source_size AS DOUBLE)
             ELSE CAST(f.weight * h.l AS DOUBLE) / CAST(h.rest AS DOUBLE) END AS target
      FROM f LEFT JOIN h ON true),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, e.budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - bef)) AS BIGINT) AS taken,
  source, CAST(epochs AS BIGINT) AS epochs, CAST(bef AS BIGINT) AS before FROM p
"""
