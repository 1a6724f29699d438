"""Line automata, column profiles and the summary table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wavelake.operators.automaton import run_automaton
from wavelake.operators.profile import (append_profiles, column_profiles, merge_profiles, profile_report,
                                        read_profiles)
from wavelake.sinks.lake import SUMMARY_SCHEMA, append_summary, compact_summaries, find_summary, read_summary


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (9, 10_000), (30, 16)])
@pytest.mark.parametrize("states", [1, 2, 7])
def test_automaton_equals_a_loop(spark, parts, batch, states):
    rng = random.Random(parts * states)
    table = [[rng.randrange(states) for _ in range(states)] for _ in range(4)]
    start = rng.randrange(states)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice([None, 0, 1, 2, 3, 99]))
            for i in range(700)]
    df = spark.createDataFrame(rows, "s string, at long, sym int").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for series in ([], ["s"]):
            out = run_automaton(df, ["at"], F.col("sym"), table, start, series, num_partitions=parts)
            plan = out._jdf.queryExecution().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            state = {}
            got = sorted(out.collect(), key=lambda r: r["at"])
            assert len(got) == len(rows)
            for r in got:
                key = r["s"] if series else 0
                before = state.get(key, start)
                after = table[r["sym"]][before] if r["sym"] is not None and r["sym"] < 4 else before
                assert (r["state_before"], r["state_after"]) == (before, after)
                state[key] = after
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_automaton_checks_its_table(spark):
    df = spark.createDataFrame([], "at long, sym int")
    assert run_automaton(df, ["at"], F.col("sym"), [[0]]).collect() == []
    for bad in ([], [[0], [0, 1]], [[1]], [[]]):
        with pytest.raises(ValueError):
            run_automaton(df, ["at"], F.col("sym"), bad)


def test_profiles_merge_without_the_rows(spark, tmp_dir):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else "b", str(rng.randint(0, 5000)), rng.choice(["x", "x", "y", None]), None)
            for _ in range(20_000)] + [("b", "n/a", "z", None)]
    df = spark.createDataFrame(rows, "task string, v string, k string, none string").repartition(6)
    append_profiles(column_profiles(df, by=["task"]), f"{tmp_dir}/p", "task")
    append_profiles(column_profiles(df.filter("task = 'b'"), by=["task"]), f"{tmp_dir}/p", "task")   # replaced
    whole = {r["column"]: r for r in profile_report(merge_profiles(
        read_profiles(spark, f"{tmp_dir}/p", "task")), [0.5]).collect()}
    v = sorted(float(r[1]) for r in rows[:-1])
    assert whole["v"]["rows"] == 20_001 and whole["v"]["numbers"] == 20_000 and whole["v"]["nulls"] == 0
    assert (whole["v"]["lowest"], whole["v"]["highest"]) == (v[0], v[-1])
    n = len({r[1] for r in rows})
    assert abs(whole["v"]["distinct"] - n) < 0.06 * n
    assert abs(whole["v"]["quantiles"][0] - v[10_000]) < 150
    assert whole["none"]["nulls"] == 20_001 and whole["none"]["quantiles"] is None and whole["none"]["distinct"] == 0
    counts = {x: sum(r[2] == x for r in rows) for x in "xyz"}
    assert {f["item"]: f["count"] for f in whole["k"]["frequent"] if f["item"] is not None} == counts
    one = profile_report(read_profiles(spark, f"{tmp_dir}/p", "task", ["b"])).collect()
    assert {r["rows"] for r in one} == {sum(r[0] == "b" for r in rows)}
    with pytest.raises(ValueError):
        column_profiles(df.select("task"), by=["task"])


def _summary(spark, rid, text, at):
    return spark.createDataFrame([(rid, text, "COMPLETED")], "id string, result string, status string").select(
        "id", "result", "status", F.timestamp_seconds(F.lit(at)).alias("created_time"))


def test_summaries_of_many_results_share_folders(spark, tmp_dir):
    path = f"{tmp_dir}/s"
    many = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("first").alias("result"),
                                    F.lit("COMPLETED").alias("status"), F.timestamp_seconds(F.lit(5)).alias("created_time"))
    append_summary(many.coalesce(1), path)
    append_summary(_summary(spark, "17", "second", 9), path)
    append_summary(_summary(spark, "18", "older", 1), path)
    assert find_summary(spark, path, "17").result == "second" and find_summary(spark, path, "18").result == "first"
    assert read_summary(spark, path, "x").schema.names == SUMMARY_SCHEMA.names
    assert len(spark.read.parquet(path).inputFiles()) <= 66
    compact_summaries(spark, path)
    assert len(spark.read.parquet(path).inputFiles()) <= 64 and spark.read.parquet(path).count() == 3000
    assert find_summary(spark, path, "17").result == "second" and find_summary(spark, path, "zzz") is None


def test_range_lookups_read_few_files(spark, tmp_dir):
    from wavelake.sinks.interleaved import append_interleaved, read_ranges

    rng = random.Random(8)
    rows = [(int(rng.expovariate(0.001)) if i % 3 else 7, rng.random() * 100 if i % 50 else None, f"r{i}")
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "a long, b double, c string").repartition(7)
    path = f"{tmp_dir}/z"
    append_interleaved(df.filter("substr(c, -1) < '5'"), path, ["a", "b"], files=32)
    append_interleaved(df.filter("substr(c, -1) >= '5'"), path, ["a", "b"], files=32)
    sizes = [r["rows"] for r in spark.read.parquet(f"{path}/_ranges").collect()]
    assert 50 <= len(sizes) <= 64 and sum(sizes) == 20_000 and max(sizes) < 1200     # a hot value is spread
    for low, high in (((500, 900), (20.0, 30.0)), ((7, 7), (0.0, 5.0)), ((3000, None), (None, 50.0))):
        found = read_ranges(spark, path, {"a": low, "b": high})
        want = sorted(r for r in rows if (low[0] is None or r[0] >= low[0]) and (low[1] is None or r[0] <= low[1])
                      and r[1] is not None and (high[0] is None or r[1] >= high[0])
                      and (high[1] is None or r[1] <= high[1]))
        assert sorted(map(tuple, found.collect())) == want and want
        assert len(found.inputFiles()) < 0.4 * len(sizes)
    one = read_ranges(spark, path, {"a": (500, 520), "b": (20.0, 22.0)})
    assert len(one.inputFiles()) <= 0.15 * len(sizes)
    assert read_ranges(spark, path, {"a": (-5, -1)}).collect() == []
    with pytest.raises(ValueError):
        append_interleaved(df, path, ["c"], 2)


def test_interleaved_keys_take_a_search_per_cell(spark):
    """A row's key costs one search per cell, not one per bit and cell."""
    from wavelake.sinks.interleaved import with_interleaved_key

    df = spark.range(100).select(F.timestamp_seconds("id").alias("a"), (F.col("id") / 7).alias("b"))
    plan = with_interleaved_key(df, ["a", "b"], "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("bucketizer_") == 2 and plan.count("unix_micros") <= 1


def test_interleaved_keys(spark):
    from wavelake.sinks.interleaved import with_interleaved_key

    rng = random.Random(3)
    odd = [None, float("nan"), float("-inf"), float("inf"), 0.0, 7.0]
    rows = [(rng.choice(odd) if i % 4 == 0 else rng.gauss(0, 9), None, i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, n double, i int")
    got = with_interleaved_key(df, ["x", "n", "i"], "key", bits=4)
    assert got.columns == ["x", "n", "i", "key"]

    shares = [(i + 1) / 16 for i in range(15)]
    bounds = df.agg(F.percentile_approx("x", shares, 10_000), F.percentile_approx(F.col("i").cast("double"), shares, 10_000)).first()

    def place(value, marks):
        if value is None:
            return 0
        return sum(value != value or m <= value for m in marks)

    for r in got.collect():
        want = 0
        for j, (value, marks) in enumerate(((r["x"], bounds[0]), (None, []), (r["i"], bounds[1]))):
            p = place(value, marks)
            want |= sum(1 << (b * 3 + j) for b in range(4) if p >> b & 1)
        assert r["key"] == want, r
