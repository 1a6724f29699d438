"""Mixing sources to target weights by capped water-filling.

Sizes (words) add up per source; the mix holds ``total_share`` of all sizes.
Each source's target is its weight's part of that, at most ``max_epochs`` times
its own size; what a capped source cannot take is dealt to the others by
weight until none is above its cap.  A target then means ``r`` repetitions of
the source: every document is taken ``floor(r)`` times, and the fraction is
sampled: documents in the order of a seeded hash are taken once more until the
source's remaining words are reached.  The running sum over a source is not
one window: documents fall into ``HASH_BINS`` bins of the hash, the bins' sums
are accumulated, and only the one bin where the target falls is ordered hash by
hash.  Rows that repeat id and text share a hash; of the hash where the target
falls as many rows are taken as bring the sum nearest to it.  They are counted
per writing task and numbered from the tasks' offsets, so that a row with very
many copies is not gathered.

DataFrame functions only.  One row per distinct source is all that is ever
gathered in one place.

Defined cases: null or blank text has size 0 and is never taken; a null source
is a source of its own, last; with no words at all every target is 0; which of
the rows that repeat id and text are taken once more than the others is
arbitrary (they are equal to the mix); extra columns are ignored by
:func:`mix_sources` and kept by :func:`apply_mix`; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import materialized
from wavelake.operators.ordering import PART_COL, POS_COL, tag_positions

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
HASH_BINS = 4096  # three hexadecimal digits
_SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(
        F.size(F.split(bare, _SPACES))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS,
                   total_share: float = TOTAL_SHARE,
                   max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` per distinct source of ``sized``
    (``source``, ``size``); weights repeat over the sources in code-point
    order, null last.

    Water-filling in closed form: sources are capped in the order of size per
    weight, so the level after capping the first k of them is (total - their
    caps) / (weights of the others); the first level that the next source can
    take is the one at which none is above its cap."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.get(
        cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"),
                             F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(total_share))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = ((total - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything)
                - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = ranked.withColumn("level", level).withColumn(
        "_fits", F.when(F.col("level") * F.col("weight") <= cap, F.col("level")))
    final = F.first("_fits", ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(final.isNull(), cap).otherwise(F.least(cap, final * F.col("weight")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def _sample_key(doc_id: Column, text: Column) -> Column:
    """Hexadecimal hash that orders a source's documents for the sample."""
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(SEED), name, body).cast("binary"))


def _sized(docs: DataFrame, *keep: Column) -> DataFrame:
    """``source, size, key`` of every row, and the columns to ``keep``."""
    return docs.select(*keep, F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"),
                       _sample_key(F.col("doc_id"), F.col("text")).alias("key"))


def _cutoffs(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source ``whole`` repetitions, the ``cut_key`` below which rows are
    taken once more (null: none are), and of how many rows of that very key
    the same holds (``cut_copies``; ``cut_parts``: it has more)."""
    per = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0,
               F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"))
    per = per.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    bins = (sized.filter("size > 0").groupBy("source", F.substring("key", 1, 3).alias("bin"))
            .agg(F.sum("size").alias("words")))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    crossing = materialized(
        bins.join(per, F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("need") >= F.col("before"))
                & (F.col("need") < F.col("before") + F.col("words")))
        .select("s", F.col("bin").alias("cut_bin"), "before", "need"), "mix_bins")
    # copies of a row are one row with their number before the window
    inside = (sized.filter("size > 0")
              .join(crossing, F.col("source").eqNullSafe(F.col("s"))
                    & (F.substring("key", 1, 3) == F.col("cut_bin")))
              .groupBy("s", "before", "need", "key", "size").agg(F.count(F.lit(1)).alias("copies")))
    ahead = Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(ahead), F.lit(0))
    # a row is taken when that leaves the running sum nearer to the need
    taken = F.floor((F.col("need") - upto) / F.col("size") + F.lit(0.5))
    cut = (inside.withColumn("cut_copies", F.least(F.col("copies"), taken)).filter("cut_copies > 0")
           .groupBy(F.col("s").alias("c"))
           .agg(F.max(F.struct(F.col("key").alias("cut_key"), "cut_copies", "copies")).alias("cut")))
    marks = crossing.join(cut, F.col("s").eqNullSafe(F.col("c")), "left").select(
        F.col("s").alias("m"), F.coalesce("cut.cut_key", "cut_bin").alias("cut_key"),
        F.coalesce("cut.cut_copies", F.lit(0)).alias("cut_copies"),
        F.coalesce(F.col("cut.cut_copies") < F.col("cut.copies"), F.lit(False)).alias("cut_parts"))
    return materialized(per.join(marks, F.col("s").eqNullSafe(F.col("m")), "left")
                        .select("s", "source_size", "target", "whole", "need", "cut_key", "cut_copies",
                                "cut_parts"), "mix_plan")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS,
             total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS
             ) -> tuple[DataFrame, DataFrame]:
    """The sized rows (written once) and the plan: one row per source."""
    sized = materialized(_sized(docs, F.col("doc_id").cast("long").alias("doc_id")), "mix_sizes")
    targets = materialized(source_targets(sized, weights, total_share, max_epochs), "mix_targets")
    return sized, _cutoffs(sized, targets)


def _with_repeats(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` rows with their source's plan and their ``repeats``."""
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
    at_cut = F.coalesce("cut_parts", F.lit(False)) & F.col("key").eqNullSafe(F.col("cut_key"))
    below = F.coalesce(F.col("key") <= F.col("cut_key"), F.lit(False))

    def repeats(sampled: Column) -> Column:
        return F.when(F.col("size") == 0, 0).otherwise(
            F.col("whole") + F.when((F.col("need") > 0) & sampled, 1).otherwise(0)).cast("long")

    if not plan.filter("cut_parts").limit(1).count():
        return rows.withColumn("repeats", repeats(below))
    others = rows.filter(~at_cut).withColumn("repeats", repeats(below))
    # the copies of a cut row, numbered over all tasks: offsets of the tasks
    # from their counts, and positions within a task
    copies = materialized(tag_positions(rows.filter(at_cut).sortWithinPartitions("s")), "mix_copies")
    summary = copies.groupBy(F.col("s").alias("of"), F.col(PART_COL).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min(POS_COL).alias("first"))
    ahead = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    summary = materialized(
        summary.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n"), "mix_offsets")
    number = F.col("ahead") + F.col(POS_COL) - F.col("first")
    numbered = (copies.join(summary, F.col("s").eqNullSafe(F.col("of"))
                            & (F.col(PART_COL) == F.col("part")))
                .withColumn("repeats", repeats(number < F.col("cut_copies"))))
    return others.unionByName(numbered.select(*others.columns))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS,
                total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, repeats, taken``."""
    sized, plan = mix_plan(docs, weights, total_share, max_epochs)
    return _with_repeats(sized, plan).select(
        "doc_id", "size", "source_size", "target", "repeats",
        (F.col("size") * F.col("repeats")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS,
              total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    _, plan = mix_plan(docs, weights, total_share, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    taken = (_with_repeats(_sized(docs, row), plan).filter("repeats > 0")
             .select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("n")))
    return taken.select(*[F.col(f"d.`{c}`") for c in docs.columns])
