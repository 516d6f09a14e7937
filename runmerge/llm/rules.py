"""Quality rules: fixed base rules, then robust multivariate outliers, with DataFrame functions only.

Each text gives a vector of transformed statistics. For every language and source a minimum-covariance-determinant
estimate is found by concentration steps from two deterministic starts, each step being one grouped aggregation
over all rows: take the half-plus of the rows nearest to the current estimate, estimate anew. The start with the
smaller determinant wins. A text is rejected if its squared Mahalanobis distance to its group's estimate is above
the cut, a quantile of the distance of normal rows. The subset of a step ends at the edge of a fine bin of log distance, so it is found from counts that
add up across tasks, and the result does not depend on how rows are dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole
from .stats import count_of, duplicate_lines, with_repeat_words, word_chars, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊÑÓ"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
VECTOR = ("x1", "x2", "x3")
FEW = 20_000  # pools whose rows (numbers of 200 bytes) are sent to all tasks
SALTS = 32  # parts of a pool, where pools are more
BINS = 64  # bins of a unit of log distance
CUT_OFF = 25.9  # of normal rows, 1 in 100,000 has a larger squared distance (chi-square on three axes)


def base_statistics(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep``, the base statistics of each text, and its raw vector."""
    text = F.col("_text")
    rows = docs.select(*keep, whole(text_col).alias("_text")).withColumn("_words", words(text))
    return with_repeat_words(rows, "_words", "n_repeat_words").select(
        *docs.select(*keep).columns,
        F.size("_words").cast("bigint").alias("n_words"),
        word_chars(text).alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        "n_repeat_words",
        count_of(text, PUNCTUATION).alias("_punct"),
        count_of(text, UPPER).alias("_upper"),
    )


PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
SUMS = ["n", *(f"s{i}" for i in range(3)), *(f"q{i}{j}" for i, j in PAIRS)]


def _sums() -> list[Column]:
    """What a mean and a covariance are made of; adds up over parts."""
    return [
        F.count(F.lit(1)).alias("n"),
        *(F.sum(x).alias(f"s{i}") for i, x in enumerate(VECTOR)),
        *(F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}{j}") for i, j in PAIRS),
    ]


def _estimated(sums: DataFrame, keys: list[str], floor: float, *more: str) -> DataFrame:
    """Mean and covariance from sums. A small variance is added to each axis, so that constant statistics leave the matrix regular."""
    n = F.col("n")
    return sums.select(
        *keys,
        *(( F.col(f"s{i}") / n).alias(f"m{i}") for i in range(3)),
        *((F.col(f"q{i}{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n + (floor if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS),
        *more,
    )


def _cov(i: int, j: int) -> Column:
    return F.col(f"c{min(i, j)}{max(i, j)}")


def _determinant() -> Column:
    c = _cov
    return c(0, 0) * (c(1, 1) * c(2, 2) - c(1, 2) * c(1, 2)) - c(0, 1) * (c(0, 1) * c(2, 2) - c(1, 2) * c(0, 2)) + c(0, 2) * (c(0, 1) * c(1, 2) - c(1, 1) * c(0, 2))


def _distance() -> Column:
    """The squared Mahalanobis distance, by the adjugate of the 3 x 3 matrix."""
    c = _cov
    d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(VECTOR)]
    adj = {
        (0, 0): c(1, 1) * c(2, 2) - c(1, 2) * c(1, 2), (1, 1): c(0, 0) * c(2, 2) - c(0, 2) * c(0, 2), (2, 2): c(0, 0) * c(1, 1) - c(0, 1) * c(0, 1),
        (0, 1): c(0, 2) * c(1, 2) - c(0, 1) * c(2, 2), (0, 2): c(0, 1) * c(1, 2) - c(0, 2) * c(1, 1), (1, 2): c(0, 1) * c(0, 2) - c(0, 0) * c(1, 2),
    }
    quadratic = reduce(lambda a, b: a + b, [adj[i, j] * d[i] * d[j] * (1 if i == j else 2) for i, j in adj])
    return F.greatest(quadratic / _determinant(), F.lit(0.0))


def _first_bin(counts: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """For each key, the first bin at which ``share`` of its rows are reached. ``counts``: keys, bin, n."""
    up_to = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.select(*keys, "bin", F.sum("n").over(up_to).alias("_up_to"), F.sum("n").over(Window.partitionBy(*keys)).alias("_all"))
        .filter(F.col("_up_to") >= F.col("_all") * share)
        .groupBy(*keys)
        .agg(F.min("bin").alias(name))
    )


def _log_bin() -> Column:
    return F.floor(F.log(F.col("d2") + 1e-9) * BINS)


def _with_pools(rows: DataFrame, pools: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with their row of ``pools``, of which there are ``n``: sent to all tasks if those are ``FEW``, else dealt by salt."""
    if n <= FEW:
        return rows.join(F.broadcast(pools), on, how)
    return rows.join(pools.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"], how)


def robust_estimates(rows: DataFrame, share: float = 0.75, most_steps: int = 10, floor: float = 1e-4) -> DataFrame:
    """``pool, m0.., c00.., scale``: the minimum-covariance-determinant estimate of each pool of ``rows`` (``pool, x1, x2, x3``).

    Both starts go on until no pool's determinant changes by a hundredth, ``most_steps`` at most. A column ``salt`` below ``SALTS``
    that a retried task gives again deals the rows of a pool; without it, it is made from the vector. A step is one pass: rows are
    joined with their pool's estimate and summed by bin of distance, and sums are added up to the bin that has the share.
    """
    if "salt" not in rows.columns:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("pool", *VECTOR), F.lit(SALTS)).cast("int"))
    rows = cut(rows.select("pool", "salt", *VECTOR))
    binned = rows.select("pool", F.posexplode(F.array(*(F.floor(F.col(x) * 4 * BINS) for x in VECTOR))).alias("axis", "bin")).groupBy("pool", "axis", "bin").agg(F.count(F.lit(1)).alias("n"))
    binned = cut(binned)
    middle = _first_bin(binned, ["pool", "axis"], 0.5, "middle")
    spread = _first_bin(
        binned.join(middle, ["pool", "axis"]).groupBy("pool", "axis", F.abs(F.col("bin") - F.col("middle")).alias("bin")).agg(F.sum("n").alias("n")), ["pool", "axis"], 0.5, "spread"
    )
    zero = F.lit(0.0)
    at = lambda axis, column: F.max(F.when(F.col("axis") == axis, F.col(column)))
    numbers = ["pool", "start", *(f"m{i}" for i in range(3)), *(f"c{i}{j}" for i, j in PAIRS)]
    medians = middle.join(spread, ["pool", "axis"]).groupBy("pool").agg(
        *((at(i, "middle") + 0.5).alias(f"b{i}") for i in range(3)), *((at(i, "spread") + 0.5).alias(f"s{i}") for i in range(3))
    ).select(
        "pool", F.lit(0).alias("start"), *((F.col(f"b{i}") / (4 * BINS)).alias(f"m{i}") for i in range(3)),
        *((F.col(f"s{i}") * 1.4826 / (4 * BINS)) ** 2 + floor if i == j else zero for i, j in PAIRS),
    ).toDF(*numbers)
    plain = _estimated(rows.groupBy("pool").agg(*_sums()).withColumn("start", F.lit(1)), ["pool", "start"], floor)
    estimate = cut(medians.unionByName(plain).withColumn("volume", F.log(_determinant())))
    n = estimate.count()
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    up_to = Window.partitionBy("pool", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(most_steps):
        placed = _with_pools(both, estimate.select(*numbers, F.col("volume").alias("was")), ["pool", "start"], n)
        bins = placed.withColumn("d2", _distance()).groupBy("pool", "start", _log_bin().alias("bin")).agg(*_sums(), F.max("was").alias("was"))
        ahead, all_ = F.coalesce(F.sum("n").over(up_to), F.lit(0)), F.sum("n").over(Window.partitionBy("pool", "start"))
        inside = bins.withColumn("ahead", ahead).withColumn("all", all_).filter(F.col("ahead") < F.col("all") * share)
        sums = inside.groupBy("pool", "start").agg(*(F.sum(c).alias(c) for c in SUMS), F.max("was").alias("was"))
        estimate = cut(_estimated(sums, ["pool", "start"], floor, "was").withColumn("volume", F.log(_determinant())))
        if (estimate.agg(F.max(F.abs(F.col("volume") - F.col("was")))).first()[0] or 0.0) < 0.01:
            break
    best = Window.partitionBy("pool").orderBy(F.round("volume", 3), "start")
    estimate = cut(estimate.withColumn("best", F.row_number().over(best)).filter("best = 1").drop("best", "volume", "was", "start"))
    counts = _with_pools(rows, estimate, ["pool"], n).withColumn("d2", _distance()).groupBy("pool", _log_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # 2.366 is the median of the squared distance of normal rows on three axes
    return cut(estimate.join(_first_bin(counts, ["pool"], 0.5, "half"), "pool").withColumn("scale", F.greatest(F.exp((F.col("half") + 0.5) / BINS) / 2.366, F.lit(1e-6))).drop("half"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    cut_off: float = CUT_OFF, least_rows: int = 100, share: float = 0.75, even_words: int = 200,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words``, the base statistics, ``base_failed, kept, distance``.

    The vector has mean word length, log punctuation and log capitals per word; each is taken from its pool's
    mean rate and shrunk by sqrt(n / (n + ``even_words``)), as rates of short texts vary more. A pool is a
    language and source with ``least_rows`` rows that passed the base rules, else what is left of the language if that has as
    many, else all rows. If fewer than that have passed in the whole table, there is nothing to estimate from: no text is
    rejected and ``distance`` is null. Null language or source is a value of its own; a null text has no words and fails the
    base rules, and so does an empty one. Repeated rows count each. An empty table gives none. Other columns are not read.
    """
    raw = base_statistics(docs, text_col, [F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("\0")).alias("_lang"), F.coalesce(F.col(source_col), F.lit("\0")).alias("_source")])
    raw = cut(raw.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)))
    # from a row's place in what was written, so a task that is run again deals its rows as before
    raw = raw.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    sums = ("n_words", "word_chars", "_punct", "_upper")
    groups = raw.filter(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{c}") for c in sums))
    small = F.col("n") < least_rows
    left = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("_lang"))
    chosen = cut(groups.withColumn("pool", F.when(~small, F.concat_ws("\x1f", F.lit("s"), "_lang", "_source")).when(left >= least_rows, F.concat_ws("\x1f", F.lit("l"), "_lang")).otherwise("a")))
    totals = lambda pools: pools.agg(F.sum("n").alias("pool_rows"), *(F.sum(f"s{c}").alias(f"t{c}") for c in sums))
    of_all = totals(chosen).crossJoin(F.broadcast(chosen.agg(F.count(F.when(F.col("pool") == "a", 1)).alias("used"))))  # a row each
    of_pool = totals(chosen.filter("pool != 'a'").groupBy("pool")).unionByName(of_all.filter("used > 0").select(F.lit("a").alias("pool"), "pool_rows", *(f"t{c}" for c in sums)))
    # a row of a pool of its own is also one of those from which the pool of all is estimated
    in_all = chosen.filter("pool != 'a'").select("_lang", "_source", F.lit("a").alias("pool"), F.lit(False).alias("own"))
    pooled = cut(chosen.select("_lang", "_source", "pool", F.lit(True).alias("own")).unionByName(in_all).join(of_pool, "pool"))
    even = F.sqrt(F.col("n_words") / (F.col("n_words") + even_words))
    rate = lambda c, over: F.col(c) / F.col(over) if c.endswith("word_chars") else F.log(F.col(c) / F.col(over) + 0.1)
    x = {name: (rate(c, "n_words") - rate(f"t{c}", "tn_words")) * even for name, c in zip(VECTOR, sums[1:], strict=True)}
    passed = _with_pools(raw.filter(~F.col("base_failed")), pooled, ["_lang", "_source"], pooled.count()).withColumns(x)
    estimates = robust_estimates(passed.filter(F.col("pool_rows") >= least_rows).select("pool", "salt", *VECTOR), share)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = (
        _with_pools(passed.filter("own"), estimates, ["pool"], estimates.count(), "left")
        .withColumn("distance", _distance() / F.col("scale"))
        .select(*out, F.coalesce(F.col("distance") <= cut_off, F.lit(True)).alias("kept"), "distance")
    )
    return raw.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")).unionByName(judged)
