"""T4 + T5 against the sequential state machine; split invariance (§5 (3))."""

import os
import random

import pytest

from wavelake.operators.blocks import clean_blocks, file_blocks, ordered_blocks
from wavelake.plans.logs import clean_log_stateful, clean_log_stateless
from wavelake.session import recorded_scratch
from wavelake.sources.text import read_lines

from helpers import rows, sequential_blocks


def _make_files(tmp_dir, n_files=3, n_lines=900, seed=7):
    rng = random.Random(seed)
    files = []
    for f in range(n_files):
        lines = []
        # data before the first header must be dropped
        lines.append("1,1.0,1.0")
        for i in range(n_lines):
            r = rng.random()
            if r < 0.04:
                lines.append("[INFO] log line %d" % i)
            elif r < 0.06:
                lines.append("   [WARN] indented %d" % i)
            elif r < 0.10:
                lines.append("timestamp,sensor_A,sensor_B")
            elif r < 0.12:
                lines.append("")
            elif r < 0.13:
                lines.append("%d,%d" % (i, i))
            elif r < 0.14:
                lines.append("%d.5,1,2" % i)
            elif r < 0.15:
                lines.append("%d,1 2,3" % i)
            elif r < 0.16:
                lines.append("%d,%d.25,%d.5,extra" % (1678886400 + i, i % 97, f))
            else:
                lines.append("%d,%d.25,%d.5" % (1678886400 + i, i % 97, f))
        files.append(lines)
        with open(os.path.join(tmp_dir, f"part{f}.log"), "w") as fh:
            fh.write("\n".join(lines) + "\n")
    return files


@pytest.mark.parametrize("max_bytes", [None, "700", "4096"])
def test_file_blocks_match_sequential_for_any_split_size(spark, tmp_dir, max_bytes):
    files = _make_files(tmp_dir)
    expected = sorted(sequential_blocks(files))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        if max_bytes:
            spark.conf.set(key, max_bytes)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = read_lines(spark, tmp_dir)
        if max_bytes == "700":
            assert lines.select("_split").distinct().count() > 10
        got = rows(clean_blocks(file_blocks(lines)))
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected


def test_stateful_plan_and_stateless_plan_differ(spark, tmp_dir):
    files = _make_files(tmp_dir, n_files=1, n_lines=200)
    stateful = clean_log_stateful(spark, tmp_dir).collect()
    stateless = clean_log_stateless(spark, tmp_dir).collect()
    assert len(stateful) == len(sequential_blocks(files))
    assert len(stateless) > len(stateful)
    assert any(r.timestamp is None for r in stateless)


def test_ordered_blocks_per_stream_with_hot_stream(spark):
    rng = random.Random(3)
    data, files = [], {}
    for stream, n in (("hot", 3000), ("a", 200), ("b", 50)):
        lines = []
        for i in range(n):
            r = rng.random()
            line = ("[E] x" if r < 0.1 else "timestamp,a,b" if r < 0.2
                    else "%d,%d.5,1" % (i, i))
            lines.append(line)
            data.append((stream, i, line))
        files[stream] = lines
    data.append((None, 0, "timestamp,a,b"))
    data.append((None, 1, "5,5,5"))
    files[None] = ["timestamp,a,b", "5,5,5"]
    df = spark.createDataFrame(data, "stream string, n long, value string") \
        .repartition(5)
    got = rows(clean_blocks(ordered_blocks(df, ["n"], stream_cols=["stream"])))
    assert got == sorted(sequential_blocks(list(files.values())))


@pytest.mark.parametrize("batch", ["1", "7", "64"])
def test_state_carries_across_arrow_batches(spark, tmp_dir, batch):
    files = _make_files(tmp_dir, n_files=2, n_lines=300, seed=11)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = rows(clean_blocks(file_blocks(read_lines(spark, tmp_dir))))
    finally:
        spark.conf.set(key, old)
    assert got == sorted(sequential_blocks(files))


def test_rotated_files_form_one_stream(spark, tmp_dir):
    from wavelake.operators.blocks import file_folder
    files = _make_files(tmp_dir, n_files=4, n_lines=400, seed=5)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "900")
    try:
        lines = read_lines(spark, tmp_dir)
        got = rows(clean_blocks(file_blocks(lines, stream_of=file_folder())))
    finally:
        spark.conf.set(key, old)
    # part0.log .. part3.log in path order are one continuous stream
    assert got == sorted(sequential_blocks([sum(files, [])]))


def test_rows_do_not_depend_on_later_split_sizes(spark, tmp_dir):
    """The scan may be split differently once the frame is acted on."""
    files = _make_files(tmp_dir, n_files=2, n_lines=2000, seed=13)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        spark.conf.set(key, "900")
        by_file = clean_blocks(file_blocks(read_lines(spark, tmp_dir)))
        data = [(i, line) for i, line in enumerate(files[0])]
        table = spark.createDataFrame(data, "n long, value string")
        by_order = clean_blocks(ordered_blocks(table, ["n"]))
        spark.conf.set(key, "70000")
        assert rows(by_file) == sorted(sequential_blocks(files))
        assert rows(by_order) == sorted(sequential_blocks(files[:1]))
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_text_is_scanned_once(spark, tmp_dir):
    _make_files(tmp_dir, n_files=1, n_lines=50)
    plan = file_blocks(read_lines(spark, tmp_dir))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "MapInArrow" not in plan


def test_a_file_of_one_block_over_many_splits(spark, tmp_dir):
    lines = ["timestamp,a,b"] + ["%d,1.5,2.5" % i for i in range(3000)] + ["[end]", "9,9,9"]
    with open(os.path.join(tmp_dir, "one.log"), "w") as fh:
        fh.write("\n".join(lines))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        got = rows(clean_log_stateful(spark, tmp_dir))
    finally:
        spark.conf.set(key, old)
    assert got == [(i, 1.5, 2.5) for i in range(3000)]


def test_a_task_reads_many_small_splits(spark, tmp_dir):
    files = _make_files(tmp_dir, n_files=8, n_lines=600)
    with recorded_scratch() as made:
        got = rows(clean_log_stateful(spark, tmp_dir, split_bytes=100))
    assert got == sorted(sequential_blocks(files))
    splits = sum(-(-os.path.getsize(os.path.join(tmp_dir, f)) // 100) for f in os.listdir(tmp_dir))
    tasks = max(8, spark.sparkContext.defaultParallelism)
    stage = spark.read.parquet(next(p for p in made if "blocks-" in p))
    assert splits > 50 * tasks and stage.filter("_wl_end").count() > 0.5 * splits
    assert len(stage.inputFiles()) < 3 * tasks
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
