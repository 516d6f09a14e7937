"""License scans by diagonal voting.

All rolling word k-grams of a text are joined with the positions at which the license templates hold them. A hit
at word i of the text and word j of a template votes for the diagonal i - j. Votes are added up by text, template
and diagonal; runs of diagonals a few words apart, which insertions and deletions leave, are merged, as far as they stay
within half a template's length of one another; and the merged span is verified by the share of the template's k-grams
that it holds, each counted once however often it stands there.

Phrases are templates that must stand word for word: their k-gram is the whole phrase.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_ids, whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are found word for word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of public licenses, by label. Their k-grams have GRAM words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license",
    "apache": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3.0": "you can redistribute it and or modify it under the terms of the gnu general public license version 3",
    "gpl-notice": "under the gnu general public license version 3",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "mit-license": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
GRAM = 3
DRIFT = 3  # diagonals that are merged
VERIFIED = 0.6  # share of a template's k-grams in a span


def grams(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, k: int = GRAM) -> list[tuple]:
    """``gram, k, label, name, position, of, exact``: every k-gram of every template and phrase, ``of`` being how many it has."""
    rows = []
    for name, label in phrases.items():
        rows.append((name, len(name.split()), label, name, 0, 1, True))
    for label, text in templates.items():
        ws = text.split()
        n = max(1, len(ws) - k + 1)
        rows += [(" ".join(ws[j : j + k]), min(k, len(ws)), label, label, j, n, False) for j in range(n)]
    return rows


def reach_of(of: Column, k: int) -> Column:
    """How many diagonals a merged span covers at most: half the template's words, 16 at least."""
    return F.greatest(F.lit(16), F.floor((of + k - 1) / 2))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, k: int = GRAM, verified: float = VERIFIED) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``spans``.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are their least and greatest start
    (null if none), ``labels`` has the phrases' labels and those of verified templates, ``score`` is the largest
    share of a template's k-grams or phrase that was found. ``spans`` lists template, first word, last word and share of
    each merged span, verified or not; a span that is cut in two ways is listed for both. A null text counts as empty and has no words, score 0 and no labels. Repeated
    rows are rows; null ids are kept; an empty table gives none. Other columns are not read. ``docs`` must be a
    file scan, or what else numbers its rows alike when computed again.

    The template table has as many rows as the templates have words, whatever the input, and is broadcast. Only
    k-grams whose first word starts a template's k-gram are written out as rows, the others cannot join.
    """
    spark: SparkSession = docs.sparkSession
    table = grams(phrases, templates, k)
    known = F.broadcast(spark.createDataFrame(table, "gram string, k int, label string, name string, position int, of int, exact boolean").withColumn("hash", F.xxhash64("gram")))
    sizes = sorted({r[1] for r in table})
    first_words = sorted({r[0].split()[0] for r in table})
    lower = F.translate(whole(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = row_ids(docs.select(F.col(id_col).alias("doc_id"), lower.alias("text")), "row").withColumn("ws", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    starts = F.filter(F.sequence(F.lit(1), F.size("ws")), lambda i: F.element_at("ws", i).isin(*first_words))
    starts = F.when(F.size("ws") > 0, starts).otherwise(F.array().cast("array<int>"))

    def grams_of(n: int):
        whole_ones = F.filter(starts, lambda i: i + n - 1 <= F.size("ws"))
        return F.transform(whole_ones, lambda i: F.struct((i - 1).alias("i"), F.array_join(F.slice("ws", i, n), " ").alias("gram")))

    at = F.flatten(F.array(*map(grams_of, sizes)))
    hits = (
        rows.select("row", "doc_id", F.size("ws").cast("bigint").alias("n_words"), F.explode_outer(at).alias("at"))
        .select("row", "doc_id", "n_words", F.col("at.i").alias("i"), F.col("at.gram").alias("gram"), F.xxhash64("at.gram").alias("hash"))
        .join(known.withColumnRenamed("gram", "theirs"), "hash", "left")
        .withColumn("same", F.coalesce(F.col("gram") == F.col("theirs"), F.lit(False)))
    )
    # every row keeps one empty vote at least, so texts without hits stay
    hit = F.col("same")
    votes = (
        hits.groupBy("row", "doc_id", "n_words", *(F.when(hit, F.col(c)).alias(c) for c in ("name", "label", "of", "exact")), F.when(hit & ~F.col("exact"), F.col("i") - F.col("position")).alias("diagonal"))
        .agg(
            F.count(F.when(hit, F.lit(1))).alias("votes"),
            F.min(F.when(hit, F.col("i"))).alias("lo"),
            F.max(F.when(hit, F.col("i"))).alias("hi"),
            F.collect_set(F.when(hit & ~F.col("exact"), F.col("position"))).alias("positions"),  # no more than the template has
        )
    )
    order = Window.partitionBy("row", "name").orderBy("diagonal")
    runs = (
        votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"))
        .withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("from_start", F.col("diagonal") - F.min("diagonal").over(Window.partitionBy("row", "name", "run")))
    )
    # a run longer than its template may be apart is cut, twice, so that what belongs together is whole in one of both
    reach = reach_of(F.col("of"), k)
    pieces = F.when(F.col("from_start").isNull(), F.array(F.struct(F.lit(0).alias("grid"), F.lit(0).cast("bigint").alias("piece")))).otherwise(
        F.array(*(F.struct(F.lit(g).alias("grid"), F.floor((F.col("from_start") + g * F.floor(reach / 2)) / reach).alias("piece")) for g in (0, 1)))
    )
    merged = (
        runs.withColumn("at", F.explode(pieces))
        .groupBy("row", "doc_id", "n_words", "name", "label", "of", "exact", "run", "at")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("held"))
        .withColumn("share", F.when(F.col("exact"), 1.0).when(F.col("name").isNotNull(), F.col("held") / F.col("of")))
        .withColumn("grid", F.col("at.grid"))
    )
    base = F.col("exact")
    text_of = lambda labels: F.array_join(F.array_sort(labels), ",")
    return merged.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("votes"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("hi"))).cast("bigint").alias("last_word"),
        text_of(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        text_of(F.collect_set(F.when(F.col("share") >= verified, F.col("label")))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("name").isNotNull(), F.struct("name", "lo", (F.col("hi") + F.when(base, F.size(F.split("name", " "))).otherwise(k) - 1).alias("hi"), "share")))).alias("spans"),
    ).drop("row")


def oracle() -> str:
    """DuckDB SQL for the same rows, without ``spans``.

    Hits of a template are taken one by one: the start of a hit's run is the last diagonal up to its own that has none within
    the drift before it, and the k-grams of a piece are counted as distinct places.
    """
    quote = lambda x: "'" + x + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in grams())
    return rf"""
WITH g(gram, k, label, name, position, of_, exact) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(len(ws))) AS i FROM d),
q AS (SELECT r, i, k, array_to_string(ws[i + 1:i + k], ' ') AS gram FROM p, (SELECT DISTINCT k FROM g) WHERE i + k <= len(ws)),
h AS (SELECT r, i, g.label, g.name, g.of_, g.exact, g.position, i - g.position AS diag FROM q JOIN g USING (gram, k)),
first AS (SELECT DISTINCT a.r, a.name, a.diag FROM h a WHERE NOT a.exact AND NOT EXISTS (
    SELECT 1 FROM h b WHERE b.r = a.r AND b.name = a.name AND b.diag < a.diag AND b.diag >= a.diag - {DRIFT})),
placed AS (SELECT h.*, f.diag AS start FROM h ASOF JOIN first f ON h.r = f.r AND h.name = f.name AND h.diag >= f.diag WHERE NOT h.exact),
cutting AS (SELECT *, greatest(16, (of_ + {GRAM} - 1) // 2) AS reach, unnest([0, 1]) AS grid FROM placed),
spans AS (SELECT r, label, CAST(count(DISTINCT position) AS DOUBLE) / of_ AS share FROM cutting
  GROUP BY r, label, name, of_, start, grid, (diag - start + grid * (reach // 2)) // reach),
t AS (SELECT r, max(share) AS share, list(DISTINCT label) FILTER (share >= {VERIFIED}) AS labels FROM spans GROUP BY r),
b AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM h WHERE exact GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
  CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(t.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(t.share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN t USING (r)
"""
