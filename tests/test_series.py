"""Running aggregates, moving frames, as-of and interval joins against plain
Python, with a hot series over many tasks and other splits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wavelake.operators.asof import asof_join
from wavelake.operators.intervals import interval_join
from wavelake.operators.scan import FIRST, LAST, MAX, MIN, SUM, neighbours, over_rows, running


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _no_single_task(df, scratch_rows: int = 0):
    plan = _plan(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan


def _series_rows(seed=1):
    """One series holds 80 % of the rows; a null series; null values."""
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        s = "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
        rows.append((s, i * 3, rng.randint(-50, 50) if rng.random() < 0.9 else None,
                     rng.choice(["x", "y", None])))
    return rows


def _scans(values, texts):
    out, total, low, high, last, first = [], None, None, None, None, None
    for v, t in zip(values, texts):
        if v is not None:
            total = v if total is None else total + v
            low = v if low is None else min(low, v)
            high = v if high is None else max(high, v)
        last = t if t is not None else last
        first = first if first is not None else t
        out.append((total, low, high, last, first))
    return out


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (7, 10_000), (23, 16)])
def test_running_aggregates_over_any_split(spark, parts, batch):
    rows = _series_rows(parts)
    df = spark.createDataFrame(rows, "s string, at long, v long, t string").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        columns = {"total": (SUM, F.col("v")), "low": (MIN, F.col("v") * 1.0), "high": (MAX, F.col("v")),
                   "last": (LAST, F.col("t")), "first": (FIRST, F.col("t"))}
        whole = running(df, ["at"], columns, num_partitions=parts)
        by_series = running(df, ["at"], columns, series=["s"], num_partitions=parts)
        assert whole.columns == [*df.columns, *columns]
        _no_single_task(whole)
        for out, key in ((whole, lambda r: 0), (by_series, lambda r: r["s"])):
            groups = {}
            for r in sorted(out.collect(), key=lambda r: r["at"]):
                groups.setdefault(key(r), []).append(r)
            assert sum(map(len, groups.values())) == len(rows)
            for rs in groups.values():
                assert [(r["total"], r["low"], r["high"], r["last"], r["first"]) for r in rs] == _scans(
                    [r["v"] for r in rs], [r["t"] for r in rs])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_hot_series_is_scanned_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("s"), F.col("id").alias("at"), F.lit(1).cast("long").alias("v"))
    out = running(df, ["at"], {"n": (SUM, F.col("v"))}, series=["s"], num_partitions=10)
    assert out.filter("n <> at + 1").count() == 0
    stored = [f for f in out.inputFiles() if "/scan-" in f]
    assert len(stored) == 10


def test_running_aggregates_of_nothing(spark):
    empty = spark.createDataFrame([], "s string, at long, v double")
    assert running(empty, ["at"], {"n": (SUM, F.col("v"))}, series=["s"]).collect() == []
    assert neighbours(empty, ["at"], {"p": ("v", -1)}).collect() == []


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_moving_frames_over_any_blocks(spark, block):
    rows = [r for r in _series_rows(9)][:600]
    df = spark.createDataFrame(rows, "s string, at long, v long, t string").repartition(4)
    out = over_rows(df, ["at"], {"total": lambda w: F.sum("v").over(w), "n": lambda w: F.count(F.lit(1)).over(w)},
                    preceding=3, following=2, series=["s"], block_rows=block)
    _no_single_task(out)
    groups = {}
    for r in sorted(out.collect(), key=lambda r: r["at"]):
        groups.setdefault(r["s"], []).append(r)
    assert sum(map(len, groups.values())) == len(rows)
    for rs in groups.values():
        for i, r in enumerate(rs):
            frame = [x["v"] for x in rs[max(0, i - 3):i + 3]]
            known = [v for v in frame if v is not None]
            assert (r["total"], r["n"]) == (sum(known) if known else None, len(frame))


def test_lag_and_lead_at_the_ends(spark):
    df = spark.range(300).select(F.col("id").alias("at"), (F.col("id") * 10).alias("v")).repartition(6)
    out = neighbours(df, ["at"], {"before": ("v", -7), "after": ("v", 4), "own": ("v", 0)}).collect()
    for r in out:
        i = r["at"]
        assert r["before"] == (10 * (i - 7) if i >= 7 else None) and r["own"] == 10 * i
        assert r["after"] == (10 * (i + 4) if i + 4 < 300 else None)


def _asof(left, right, forward, equal, keyed):
    out = []
    for lk, lt, _ in left:
        best = None
        for rk, rt, rv in right:
            if lt is None or rt is None or keyed and (lk is None or lk != rk):
                continue
            fits = (rt >= lt if forward else rt <= lt) and (equal or rt != lt)
            if fits:
                order = (-rt if forward else rt, rv)
                best = max(best, (order, rv)) if best else (order, rv)
        out.append((lk, lt, best and best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_asof_join_equals_a_search(spark, forward, equal, keyed):
    rng = random.Random(forward + 2 * equal + 4 * keyed)

    def rows(n, first):
        return [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(40)]), first + i)
                for i in range(n)]

    left, right = rows(150, 0), rows(60, 1000)
    out = asof_join(spark.createDataFrame(left, "k string, t long, v long").repartition(3),
                    spark.createDataFrame(right, "k string, t long, v long"), "t",
                    by=["k"] if keyed else [], direction="forward" if forward else "backward",
                    allow_equal=equal, order_ties=["v"], num_partitions=9)
    _no_single_task(out)
    assert out.columns == ["k", "t", "v", "right_k", "right_t", "right_v"]
    got = sorted(((r["k"], r["t"], r["right_v"]) for r in out.collect()), key=str)
    assert got == _asof(left, right, forward, equal, keyed)
    assert all(r["right_v"] is not None for r in asof_join(
        spark.createDataFrame(left, "k string, t long, v long"),
        spark.createDataFrame(right, "k string, t long, v long"), "t", how="inner").collect())


def test_asof_join_checks_its_arguments(spark):
    df = spark.createDataFrame([(1, 2)], "t long, right_t long")
    with pytest.raises(ValueError):
        asof_join(df, df.select("t"), "t")
    with pytest.raises(ValueError):
        asof_join(df, df, "t", direction="sideways", prefix="r_")
    empty = df.limit(0)
    assert asof_join(df, empty, "t", prefix="r_").collect()[0]["r_t"] is None
    assert asof_join(empty, df, "t", prefix="r_").collect() == []


@pytest.mark.parametrize("hot_rows", [5, 100_000])
@pytest.mark.parametrize("keyed", [False, True])
def test_interval_join_equals_all_pairs(spark, hot_rows, keyed):
    rng = random.Random(hot_rows)

    def rows(n):
        out = []
        for i in range(n):
            lo = rng.choice([rng.randint(-60, 60), 7, rng.randint(-(1 << 40), 1 << 40)])
            length = rng.choice([0, 0, 1, 2, 3, 7, 8, 30, 1 << 20, 1 << 41])
            out.append((i, rng.choice(["a", "a", "b", None]), lo, lo + length))
        return out + [(n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, "a", 6, 5), (n + 3, "a", 7, 7),
                      (n + 3, "a", 7, 7), (n + 4, "a", -(1 << 63), (1 << 63) - 1)]

    left, right = rows(120), rows(90)
    schema = "i long, k string, lo long, hi long"
    out = interval_join(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema),
                        ("lo", "hi"), ("lo", "hi"), by=["k"] if keyed else [], hot_rows=hot_rows)
    plan = _plan(out)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r["i"], r["right_i"]) for r in out.collect())

    def real(r):
        return r[2] is not None and r[3] is not None and r[2] <= r[3]

    want = sorted((x[0], y[0]) for x in left for y in right if real(x) and real(y)
                  and x[2] <= y[3] and y[2] <= x[3] and (not keyed or x[1] is not None and x[1] == y[1]))
    assert got == want and len(want) > 500


@pytest.mark.parametrize("block_rows", [1, 4, 256])
def test_interval_join_handles_blocks_of_points(spark, block_rows):
    """The join makes a row per interval and block; its pairs come out of the blocks."""
    rng = random.Random(block_rows)
    rows = [(i, "k", lo, lo + rng.choice([0, 500, 4000])) for i, lo in
            ((i, rng.choice([50, rng.randint(0, 5000)])) for i in range(400))]
    df = spark.createDataFrame(rows, "i long, k string, lo long, hi long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = interval_join(df, df, ("lo", "hi"), ("lo", "hi"), by=["k"], **({} if block_rows == 256 else
                            {"hot_rows": 40, "block_rows": block_rows}))
        got = sorted((r["i"], r["right_i"]) for r in out.collect())
        joined, plans = 0, [out._jdf.queryExecution().executedPlan()]
        while plans:
            plan = plans.pop()
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
            if plan.nodeName() == "SortMergeJoin":
                joined += plan.metrics().get("numOutputRows").get().value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[2] <= y[3] and y[2] <= x[3])
    assert len(got) > 50_000
    if block_rows == 256:
        assert 0 < joined < len(got) / 10


def _exchanged(plan, metric):
    total, plans = 0, [plan]
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Exchange":
            total += plan.metrics().get(metric).get().value()
    return total


def test_interval_join_moves_rows_once(spark):
    """Intervals of 20 levels: what is shuffled does not grow with the levels."""
    rng = random.Random(20)
    rows = [(i, lo, lo + rng.randrange(1 << rng.randrange(20))) for i, lo in
            ((i, rng.randrange(1 << 18)) for i in range(1500))]
    df = spark.createDataFrame(rows, "i long, lo long, hi long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = interval_join(df, df, ("lo", "hi"), ("lo", "hi"))
        got = sorted((r["i"], r["right_i"]) for r in out.collect())
        moved = _exchanged(out._jdf.queryExecution().executedPlan(), "dataSize")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[1] <= y[2] and y[1] <= x[2])
    # each side's rows as intervals (of about 100 bytes) and as points
    assert 0 < moved < 2 * len(rows) * 200


def test_interval_join_with_chunks_that_are_not_broadcast(spark):
    rng = random.Random(22)
    rows = [(i, rng.choice("ab"), lo, lo + rng.choice([0, 5, 3000])) for i, lo in
            ((i, rng.choice([50, rng.randint(0, 5000)])) for i in range(200))]
    df = spark.createDataFrame(rows, "i long, k string, lo long, hi long")
    out = interval_join(df, df, ("lo", "hi"), ("lo", "hi"), by=["k"], keep=["right_i", "i"], hot_rows=30,
                        block_rows=4, few_chunks=0)
    assert out.columns == ["i", "right_i"] and "NestedLoop" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == sorted(
        (x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])


def test_interval_join_of_nothing(spark):
    df = spark.createDataFrame([(1, 2)], "lo long, hi long")
    assert interval_join(df, df.limit(0), ("lo", "hi"), ("lo", "hi")).collect() == []
    assert interval_join(df.limit(0), df, ("lo", "hi"), ("lo", "hi")).collect() == []
    with pytest.raises(ValueError):
        interval_join(df.withColumn("right_lo", F.lit(1)), df, ("lo", "hi"), ("lo", "hi"))
