"""Quality rules: hard limits plus robust multivariate outliers.

Per document a few text statistics are transformed into a vector; per language
and source the minimum-covariance-determinant method fits centre and scatter
to the three quarters of the rows that lie closest together, and documents far
from them (squared Mahalanobis distance above ``CUTOFF``) are rejected, beside
those that break the base limits.

The fit, over all rows that pass the base limits:

* start: medians and quartile ranges of each statistic;
* concentration steps: the rows' distances are laid out on a fine grid, sums
  and products add up per group and grid cell (combined before the shuffle, a
  bounded number of cells per group), and the cells of the nearest ``H_SHARE``
  rows give the next centre and scatter.

Statistics are integers (1/1024 steps), so sums are exact and reruns agree.
Centre and scatter of a group are blended with its language's (``PRIOR_ROWS``
rows' worth), and each statistic keeps a least spread (``FLOOR``), so small or
uniform groups do not reject documents for lack of variety.

DataFrame functions only.  What meets in one place is one row per language and
source.

Defined cases: null text has no words and fails the base limits; null lang or
source is a group of its own; rows that repeat are judged each; an empty table
gives an empty result; extra columns are ignored by :func:`quality_verdicts`
and kept by :func:`keep_quality`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import materialized

MIN_WORDS = 20
MAX_REPEAT_SHARE = 30  # per cent of words in repeated windows
WINDOW_WORDS = 8

#: Transformed statistics and the least standard deviation each is given.
FLOOR = {
    "log_words": 1.0,        # ln(words)
    "log_word_len": 0.08,    # ln(code points per word)
    "symbols": 0.08,         # square root of symbols per word
    "upper": 0.08,           # square root of the share of A-Z in word characters
    "dup_lines": 0.15,       # square root of the share of repeated lines
    "repeats": 0.15,         # square root of the share of words in repeated windows
}
STEPS_PER_UNIT = 1024
H_SHARE = 0.75
CONSISTENCY = 1.36   # of the scatter of the nearest 75 % of six normal statistics
CUTOFF = 33.11       # chi-square, 6 degrees of freedom, upper tail 1e-5
PRIOR_ROWS = 50
CONCENTRATION_STEPS = 3
_GRID = 32           # cells per unit of ln(1 + squared distance)
_FAR = 1_000_000     # bound of squared distances on that grid

_SPACES = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\x0c\r"
_D = len(FLOOR)
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]


# ------------------------------------------------------------- statistics

def _count(text: Column, others: str) -> Column:
    """Code points left when runs of ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, ""))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``_n_words, _word_chars, _n_symbols, _n_dup_lines,
    _n_repeat_words, _n_upper, _n_lines`` of its ``text``."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(_BLANK))
    empty = F.array().cast("array<string>")
    step = docs.select(
        *keep,
        F.when(F.length(bare) == 0, empty).otherwise(F.split(bare, _SPACES)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANK)) != "").alias("_lines"),
        _count(text, r"[^#*$%&|<>]+").alias("_n_symbols"),
        _count(text, r"[^A-Z]+").alias("_n_upper"))
    step = step.select(
        *keep, "_n_symbols", "_n_upper",
        F.size("_words").alias("_n_words"),
        F.length(F.array_join("_words", "")).alias("_word_chars"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_wh"))
    done = [*keep, "_n_symbols", "_n_upper", "_n_words", "_word_chars", "_n_lines", "_n_dup_lines"]
    step = step.select(*done, F.when(
        F.col("_n_words") >= WINDOW_WORDS, F.transform(
            F.sequence(F.lit(0), F.col("_n_words") - WINDOW_WORDS),
            lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + j) for j in range(WINDOW_WORDS)]))
    ).otherwise(F.array().cast("array<bigint>")).alias("_win"))
    # windows by hash, then place; only texts that hold an equal pair need it
    step = step.select(*done, F.when(
        F.size("_win") > F.size(F.array_distinct("_win")), F.sort_array(
            F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).alias("_sorted"))

    def twin(x: Column, k: Column) -> Column:
        near = [F.get(F.col("_sorted"), k + d)["h"].eqNullSafe(x["h"]) for d in (-1, 1)]
        return near[0] | near[1]

    step = step.select(*done, F.sort_array(F.transform(
        F.filter("_sorted", twin), lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(
        F.transform("_at", lambda x, k: F.least(
            F.lit(WINDOW_WORDS), F.coalesce(F.get(F.col("_at"), k + 1) - x, F.lit(WINDOW_WORDS)))),
        F.lit(0), lambda total, n: total + n)
    step = step.select(*done, F.coalesce(covered, F.lit(0)).alias("_n_repeat_words"))
    return step.withColumns({c: F.col(c).cast("long") for c in (
        "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words",
        "_n_upper", "_n_lines")})


def base_failed() -> Column:
    return ((F.col("_n_words") < MIN_WORDS)
            | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * MAX_REPEAT_SHARE))


def _vector() -> list[Column]:
    words = F.greatest("_n_words", F.lit(1))
    lines = F.greatest("_n_lines", F.lit(1))
    chars = F.greatest("_word_chars", F.lit(1))
    stats = {
        "log_words": F.log(words), "log_word_len": F.log(chars / words),
        "symbols": F.sqrt(F.col("_n_symbols") / words), "upper": F.sqrt(F.col("_n_upper") / chars),
        "dup_lines": F.sqrt(F.col("_n_dup_lines") / lines),
        "repeats": F.sqrt(F.col("_n_repeat_words") / words),
    }
    return [F.round(stats[name] * STEPS_PER_UNIT).cast("long").alias(f"_x{i}")
            for i, name in enumerate(FLOOR)]


# ------------------------------------------------------------------- fit

def _squared_distance() -> Column:
    """Squared Mahalanobis distance of ``_x*`` from the joined centre ``_c*``,
    with ``_m*`` the inverse Cholesky factor of the scatter."""
    off = [F.col(f"_x{i}") / STEPS_PER_UNIT - F.col(f"_c{i}") for i in range(_D)]
    total = F.lit(0.0)
    for i in range(_D):
        z = reduce(lambda a, b: a + b, [F.col(f"_m{i}_{j}") * off[j] for j in range(i + 1)])
        total = total + z * z
    return total


def _factored(groups: DataFrame) -> DataFrame:
    """Adds the inverse Cholesky factor ``_m{i}_{j}`` of ``_s{i}_{j}``."""
    keys = ["lang", "source", *[f"_c{i}" for i in range(_D)]]
    step = groups
    for j in range(_D):  # Cholesky, one column at a time
        inner = [F.col(f"_l{j}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)]
        step = step.withColumn(f"_l{j}_{j}", F.sqrt(
            reduce(lambda a, b: a - b, inner, F.col(f"_s{j}_{j}"))))
        for i in range(j + 1, _D):
            inner = [F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)]
            step = step.withColumn(f"_l{i}_{j}", reduce(
                lambda a, b: a - b, inner, F.col(f"_s{i}_{j}")) / F.col(f"_l{j}_{j}"))
    for i, j in _PAIRS:  # its inverse, by rows
        if i == j:
            value = 1 / F.col(f"_l{i}_{i}")
        else:
            value = -reduce(lambda a, b: a + b, [
                F.col(f"_l{i}_{k}") * F.col(f"_m{k}_{j}") for k in range(j, i)]) / F.col(f"_l{i}_{i}")
        step = step.withColumn(f"_m{i}_{j}", value)
    return step.select(*keys, *[f"_m{i}_{j}" for i, j in _PAIRS])


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the parameters of their language and source."""
    g = groups.withColumnsRenamed({"lang": "_g_lang", "source": "_g_source"})
    return rows.join(g, rows["lang"].eqNullSafe(g["_g_lang"])
                     & rows["source"].eqNullSafe(g["_g_source"]), "left").drop("_g_lang", "_g_source")


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and a diagonal scatter from quartile ranges."""
    coarse = STEPS_PER_UNIT // 64
    aggs = [F.percentile(F.round(F.col(f"_x{i}") / coarse), [0.25, 0.5, 0.75]).alias(f"_q{i}")
            for i in range(_D)]
    groups = rows.groupBy("lang", "source").agg(*aggs)
    spread = {i: (F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]) / 64 / 1.349 for i in range(_D)}
    floors = list(FLOOR.values())
    return groups.select(
        "lang", "source", *[(F.col(f"_q{i}")[1] / 64).alias(f"_c{i}") for i in range(_D)],
        *[(spread[i] * spread[i] + floors[i] ** 2 if i == j else F.lit(0.0)).alias(f"_s{i}_{j}")
          for i, j in _PAIRS])


def _concentrated(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One concentration step: the next centre and scatter per group."""
    cell = F.floor(F.log1p(F.least(_squared_distance(), F.lit(float(_FAR)))) * _GRID)
    sums = [F.sum(F.col(f"_x{i}")).alias(f"_t{i}") for i in range(_D)]
    products = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_p{i}_{j}") for i, j in _PAIRS]
    names = [f"_t{i}" for i in range(_D)] + [f"_p{i}_{j}" for i, j in _PAIRS]
    cells = (_with_group(rows, groups).groupBy("lang", "source", cell.alias("_cell"))
             .agg(F.count(F.lit(1)).alias("_n"), *sums, *products))
    group = Window.partitionBy("lang", "source")
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    near = (cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .withColumn("_all", F.sum("_n").over(group))
            .filter(F.col("_before") < F.col("_all") * H_SHARE))
    own = near.groupBy("lang", "source").agg(
        F.sum("_n").alias("_n"), *[F.sum(c).cast("double").alias(c) for c in names])
    tongue = Window.partitionBy("lang")
    blend = own.select("lang", "source", "_n", *names, F.sum("_n").over(tongue).alias("_ln"),
                       *[F.sum(c).over(tongue).alias(f"_l{c}") for c in names])
    weight = F.col("_n") / (F.col("_n") + PRIOR_ROWS)

    def mean(prefix: str, i: int) -> Column:
        n = F.col("_n") if prefix == "" else F.col("_ln")
        return F.col(f"{prefix}_t{i}") / n / STEPS_PER_UNIT

    def scatter(prefix: str, i: int, j: int) -> Column:
        n = F.col("_n") if prefix == "" else F.col("_ln")
        return (F.col(f"{prefix}_p{i}_{j}") / n / STEPS_PER_UNIT ** 2
                - mean(prefix, i) * mean(prefix, j))

    floors = list(FLOOR.values())

    def mixed(own_value: Column, parent: Column) -> Column:
        return weight * own_value + (1 - weight) * parent

    return blend.select(
        "lang", "source",
        *[mixed(mean("", i), mean("_l", i)).alias(f"_c{i}") for i in range(_D)],
        *[(mixed(scatter("", i, j), scatter("_l", i, j)) * CONSISTENCY
           + (floors[i] ** 2 if i == j else 0.0)).alias(f"_s{i}_{j}") for i, j in _PAIRS])


def fit_groups(stats: DataFrame) -> DataFrame:
    """Centre and inverse factor per ``lang`` and ``source`` of a stored table
    of statistics; one row per group."""
    rows = stats.filter(~base_failed()).select("lang", "source", *_vector())
    groups = materialized(_factored(_start(rows)), "quality_start")
    for _ in range(CONCENTRATION_STEPS):
        scatter = materialized(_concentrated(rows, groups), "quality_scatter")
        groups = materialized(_factored(scatter), "quality_fit")
    return groups


def judged(stats: DataFrame) -> DataFrame:
    """``stats`` with ``_base_failed``, ``_distance`` and ``_kept``."""
    groups = fit_groups(stats)
    rows = stats.select("*", *_vector(), base_failed().alias("_base_failed"))
    rows = _with_group(rows, groups).withColumn("_distance", _squared_distance())
    return rows.withColumn("_kept", ~F.col("_base_failed")
                           & (F.coalesce("_distance", F.lit(0.0)) <= CUTOFF))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), "text")
    stats = materialized(with_statistics(own).drop("text"), "quality_stats")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "distance")
    return judged(stats).select("doc_id", *[F.col(f"_{n}").alias(n) for n in names])


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    own = docs.select(row, F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), "text")
    # written once with the texts: the statistics are not computed again
    stats = materialized(with_statistics(own).drop("text"), "quality_rows")
    return judged(stats).filter("_kept").select(*[F.col(f"d.`{c}`") for c in docs.columns])
