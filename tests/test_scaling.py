"""M1–M6 on the fixture 1..5 and the edge frames of FIXTURES F3."""

import math
import os

import pytest
from pyspark.sql import types as T

from wavelake.ml.minmax import ColumnMinMaxScaler, ColumnMinMaxScalerModel
from wavelake.operators.scaling import minmax_bounds, minmax_scale, minmax_scale_narrow
from wavelake.plans.scale import scale_feature

SCHEMA = T.StructType([T.StructField("feature", T.DoubleType(), True)])


def _frame(spark, values, schema=SCHEMA):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_fixture_one_to_five_all_methods(spark):
    df = _frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    expected = [0.0, 0.25, 0.5, 0.75, 1.0]
    for method in ("dataframe", "ml", "narrow"):
        out = scale_feature(df, "feature", method=method)
        assert sorted(r["scaled"] for r in out.collect()) == expected
    narrow = minmax_scale_narrow(df, "feature")
    assert narrow.columns == ["feature", "scaled"]
    assert minmax_bounds(df, "feature").first().asDict() == {"min": 1.0, "max": 5.0}


def test_constant_column_with_nulls_is_half_everywhere(spark):
    df = _frame(spark, [3.0, None, 3.0])
    assert [r.scaled for r in minmax_scale(df, "feature").collect()] == [0.5, 0.5, 0.5]


def test_nulls_stay_null(spark):
    df = _frame(spark, [1.0, None, 3.0])
    assert [r.scaled for r in minmax_scale(df, "feature").collect()] == [0.0, None, 1.0]


def test_nan_makes_every_value_nan(spark):
    df = _frame(spark, [1.0, float("nan"), 3.0])
    assert all(math.isnan(r.scaled) for r in minmax_scale(df, "feature").collect())


def test_empty_and_all_null(spark):
    assert minmax_scale(_frame(spark, []), "feature").count() == 0
    out = minmax_scale(_frame(spark, [None, None]), "feature").collect()
    assert [r.scaled for r in out] == [None, None]
    with pytest.raises(ValueError):
        ColumnMinMaxScaler(inputCol="feature", outputCol="s").fit(_frame(spark, [None]))


def test_integer_column_and_schema_checks(spark):
    df = spark.createDataFrame([(1,), (3,)], "n int")
    assert [r.scaled for r in minmax_scale(df, "n").collect()] == [0.0, 1.0]
    with pytest.raises(ValueError):
        minmax_scale(df, "missing")
    with pytest.raises(ValueError):
        minmax_scale(spark.createDataFrame([("a",)], "s string"), "s")
    scaler = ColumnMinMaxScaler(inputCol="n", outputCol="s")
    schema = scaler.transformSchema(df.schema)
    assert schema["s"].dataType == T.DoubleType() and not schema["s"].nullable


def test_narrow_fails_on_null_input(spark):
    with pytest.raises(Exception):
        minmax_scale_narrow(_frame(spark, [1.0, None]), "feature").collect()


def test_model_on_unseen_data_and_persistence(spark, tmp_dir):
    train = _frame(spark, [2.0, 4.0])
    model = ColumnMinMaxScaler(inputCol="feature", outputCol="scaled").fit(train)
    assert (model.getOriginalMin(), model.getOriginalMax()) == (2.0, 4.0)
    unseen = _frame(spark, [0.0, 3.0, 6.0])
    assert [r.scaled for r in model.transform(unseen).collect()] == [-1.0, 0.5, 2.0]
    path = os.path.join(tmp_dir, "model")
    model.save(path)
    loaded = ColumnMinMaxScalerModel.load(path)
    assert (loaded.getOriginalMin(), loaded.getOriginalMax()) == (2.0, 4.0)
    assert [r.scaled for r in loaded.transform(unseen).collect()] == [-1.0, 0.5, 2.0]
    copied = model.copy({model.outputCol: "other"})
    assert copied.getOutputCol() == "other" and copied.getOriginalMax() == 4.0
    est_path = os.path.join(tmp_dir, "est")
    ColumnMinMaxScaler(inputCol="feature", outputCol="x").save(est_path)
    assert ColumnMinMaxScaler.load(est_path).getOutputCol() == "x"


def test_model_transform_on_stream(spark, tmp_dir):
    model = ColumnMinMaxScaler(inputCol="feature", outputCol="scaled").fit(
        _frame(spark, [0.0, 10.0]))
    src = os.path.join(tmp_dir, "in")
    _frame(spark, [5.0, 10.0]).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    q = model.transform(stream).writeStream.format("memory").queryName("scaled_s").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.scaled for r in spark.table("scaled_s").collect()) == [0.5, 1.0]
