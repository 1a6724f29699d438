"""T7 contiguous index and T6–T12 spectrum against brute force."""

import pytest
from pyspark.sql import functions as F

from wavelake.operators.ordering import contiguous_index
from wavelake.operators.spectrum import numeric_samples, require_columns, spectrum

from helpers import rows


def _skewed(spark, n=6000):
    # one series holds most rows; a null series key; unique (ts, id) order
    data = [("hot" if i % 10 < 7 else ("cold" if i % 10 < 9 else None), (i * 7919) % n, i,
             float(i % 13) - 6.0) for i in range(n)]
    return spark.createDataFrame(data, "series string, ts long, id long, amplitude double")


def test_contiguous_index_matches_row_number(spark):
    df = _skewed(spark).repartition(7)
    got = contiguous_index(df, ["ts", "id"], partition_by=["series"], count_col="n")
    pdf = df.toPandas()
    pdf["series"] = pdf["series"].fillna("<null>")
    pdf = pdf.sort_values(["series", "ts", "id"])
    pdf["idx"] = pdf.groupby("series").cumcount()
    pdf["n"] = pdf.groupby("series")["id"].transform("count")
    exp = sorted(zip(pdf["id"], pdf["idx"], pdf["n"]))
    assert rows(got, ["id", "sample_index", "n"]) == exp


@pytest.mark.parametrize("parts", ["3", "16"])
def test_global_index_invariant_to_partitions(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = _skewed(spark, 3000)
        got = contiguous_index(df, ["ts", "id"], count_col="n")
        out = rows(got, ["ts", "id", "sample_index", "n"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    exp = sorted((ts, i, k, 3000) for k, (ts, i) in
                 enumerate(sorted((r[1], r[2]) for r in df.collect())))
    assert out == exp


def test_arrival_order_index(spark):
    df = spark.range(0, 1000, numPartitions=4)
    got = contiguous_index(df, None)
    assert sorted(r.sample_index for r in got.collect()) == list(range(1000))


def test_spectrum_compatible_values(spark):
    data = [("0.000", "1.000"), ("0.001", "-0.5"), ("0.002", "bad"), ("0.003", ""),
            ("0.004", "NaN"), ("0.005", "2")]
    df = spark.createDataFrame(data, "timestamp string, amplitude string")
    out = spectrum(df, "r9", order_by=[F.col("timestamp").cast("double")])
    cols = ["result_id", "sample_index", "frequency_hz", "magnitude", "phase", "created_time"]
    assert out.columns == cols
    got = [tuple(r)[:5] for r in out.orderBy("sample_index").collect()]
    assert got[0] == ("r9", 0, 0.0, 1.0, 0.0)
    assert got[1] == ("r9", 1, 250.0, 0.5, 0.0)
    assert got[2][:3] == ("r9", 2, 500.0) and got[2][3] != got[2][3]  # NaN kept
    assert got[3] == ("r9", 3, 750.0, 2.0, 0.0)


def test_spectrum_requires_amplitude(spark):
    df = spark.createDataFrame([(1.0,)], "value double")
    with pytest.raises(ValueError):
        spectrum(df, "r", order_by=["value"])
    with pytest.raises(ValueError):
        require_columns(df, "amplitude")
    assert numeric_samples(df.withColumnRenamed("value", "amplitude")).count() == 1


def test_spectrum_by_series_restarts(spark):
    df = _skewed(spark, 500)
    out = spectrum(df, F.concat(F.lit("r-"), F.coalesce("series", F.lit("none"))),
                   order_by=["ts", "id"], series=["series"], with_created_time=False)
    pdf = out.toPandas()
    for rid, g in pdf.groupby("result_id"):
        n = len(g)
        assert sorted(g["sample_index"]) == list(range(n))
        assert (g["frequency_hz"] == g["sample_index"] * 1000.0 / n).all()
    assert set(pdf["result_id"]) == {"r-hot", "r-cold", "r-none"}


def test_hot_series_is_spread_over_balanced_tasks(spark):
    from wavelake.operators.ordering import PART_COL, sorted_table
    n = 40000
    data = [("hot" if i % 10 < 7 else f"s{i % 50}", i, float(i)) for i in range(n)]
    df = spark.createDataFrame(data, "series string, ts long, v double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tagged = sorted_table(df, ["series", "ts"], keep=["series", "v"])
        sizes = [r["count"] for r in tagged.groupBy(PART_COL).count().collect()]
        hot_parts = tagged.filter("series = 'hot'").select(PART_COL).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) <= 2 * n / 8
    assert hot_parts >= 5  # the hot series spans most tasks instead of one


def test_explicit_range_partitions(spark):
    df = _skewed(spark, 2000)
    got = contiguous_index(df, ["ts", "id"], count_col="n", num_partitions=5)
    assert sorted(r.sample_index for r in got.collect()) == list(range(2000))


def test_spectrum_schema_matches_fixture_f4(spark):
    df = spark.createDataFrame([("1", "0.5")], "t string, amplitude string")
    out = spectrum(df, "r", order_by=["t"])
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [
        ("result_id", "string"), ("sample_index", "bigint"), ("frequency_hz", "double"),
        ("magnitude", "double"), ("phase", "double"), ("created_time", "timestamp")]


def test_cluster_conf_sizes_partitions_to_input():
    from wavelake.session import cluster_conf
    conf = cluster_conf(100 * 2**40, cores=8000)   # 100 TiB
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 * 2**20)
    assert cluster_conf(10, cores=4)["spark.sql.shuffle.partitions"] == "8"
