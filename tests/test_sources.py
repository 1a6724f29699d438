"""S2, S3 (options only: no database is started), S4, S5."""

import os

import pytest

from helpers import rows

from wavelake.sources.jdbc import read_query
from wavelake.sources.lake import read_task_csv, task_object_uri
from wavelake.sources.sql import run_sql
from wavelake.sources.text import read_lines


def test_task_addressing_and_bulk_scan(spark, tmp_dir):
    assert task_object_uri("s3a://b", 7) == "s3a://b/task_7/raw.dat"
    assert task_object_uri("hdfs://nn/base/b/", "9", "x.csv") == "hdfs://nn/base/b/task_9/x.csv"
    for task, rows in (("1", ["a,b", "1,2", "3,4"]), ("22", ["a,b", "5,6"])):
        os.makedirs(os.path.join(tmp_dir, f"task_{task}"))
        with open(os.path.join(tmp_dir, f"task_{task}", "raw.dat"), "w") as fh:
            fh.write("\n".join(rows) + "\n")
    df = read_task_csv(spark, tmp_dir, columns=["a", "b"])
    assert sorted(tuple(r) for r in df.collect()) == [
        ("1", "1", "2"), ("1", "3", "4"), ("22", "5", "6")]
    assert read_task_csv(spark, tmp_dir, ["22"], columns=["a", "b"]).count() == 1


def test_read_lines_positions(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "f.txt"), "w") as fh:
        fh.write("x\ny\nz\n")
    rows = read_lines(spark, tmp_dir).orderBy("_line").collect()
    assert [r.value for r in rows] == ["x", "y", "z"]
    assert rows[0]._file.endswith("f.txt") and rows[0]._split == 0


def test_run_sql_over_registered_frames(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, g string")
    out = run_sql(spark, "SELECT g, count(*) AS n FROM t GROUP BY g", {"t": df})
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2), ("b", 1)]


def test_partitioned_jdbc_read_needs_bounds(spark):
    with pytest.raises(ValueError):
        read_query(spark, "jdbc:x:y", "SELECT 1", {}, partition_column="id")


def test_scratch_tables_can_be_dropped(spark):
    from wavelake.session import drop_scratch, scratch_path, scratch_root
    path = scratch_path(spark, "tmp")
    spark.range(3).write.parquet(path)
    assert path.startswith(scratch_root(spark))
    assert drop_scratch(spark, path)
    assert not os.path.exists(path.replace("file:", ""))


def test_top_level_exports_resolve():
    import wavelake
    assert all(callable(getattr(wavelake, name)) for name in wavelake.__all__)


def test_task_id_from_any_uri(spark):
    from wavelake.sources.lake import task_id_from_path
    df = spark.createDataFrame(
        [("hdfs://nn/base/bucket/task_42/raw.dat",), ("s3a://bucket/task_x-1/a.csv",),
         ("file:/data/other/a.csv",)], "p string")
    assert [r.t for r in df.select(task_id_from_path("p").alias("t")).collect()] == \
        ["42", "x-1", ""]


def test_tables_of_a_query_do_not_outlive_it(spark):
    from wavelake.plans import catalog
    from wavelake.sources.sql import run_sql
    sf = "/root/testdata/sf0.001"
    want = rows(catalog.queries()["sql_topk"](spark, sf))
    spark.range(3).createOrReplaceTempView("kept_view")
    other = spark.createDataFrame([(1, 2.0)], "o_orderkey long, o_totalprice double")
    got = run_sql(spark, "SELECT count(*) AS n FROM orders, kept_view",
                  {"orders": other, "kept_view": spark.range(1)})
    assert got.first().n == 1
    assert spark.table("kept_view").count() == 3
    assert rows(catalog.queries()["sql_topk"](spark, sf)) == want
    other.createOrReplaceTempView("orders")
    assert rows(catalog.queries()["sql_topk"](spark, sf)) == want
    run_sql(spark, "SELECT 1 AS one", {"gone_view": other})
    assert not spark.catalog.tableExists("gone_view")


def test_tasks_keep_their_own_columns(spark, tmp_dir):
    from wavelake.sources.csv import write_csv
    from wavelake.sources.lake import read_task_csv, task_folder
    write_csv(spark.createDataFrame([("1", "a")], "ts string, amp string"), task_folder(tmp_dir, 1))
    write_csv(spark.createDataFrame([("b", "2", "x")], "amp string, ts string, extra string"),
              task_folder(tmp_dir, 2))
    df = read_task_csv(spark, tmp_dir)
    assert sorted(map(tuple, df.select("task_id", "ts", "amp", "extra").collect())) == [
        ("1", "1", "a", None), ("2", "2", "b", "x")]
    assert read_task_csv(spark, tmp_dir, [2]).columns == ["task_id", "amp", "ts", "extra"]


def test_a_file_with_another_header_fails_the_read(spark, tmp_dir):
    from wavelake.sources.csv import read_csv_strings
    for name, text in (("a.csv", "ts,amp\n1,a\n"), ("b.csv", "amp,ts\nb,2\n")):
        with open(os.path.join(tmp_dir, name), "w") as fh:
            fh.write(text)
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_strings(spark, tmp_dir, ["ts", "amp"]).collect()
