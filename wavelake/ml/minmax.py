"""M2–M5 — single-column min-max scaler as a ``pyspark.ml`` estimator/model.

``fit`` learns the bounds with one global aggregate; ``transform`` is a
column expression, so it also runs on streaming frames and on data the model
never saw (values may leave [0, 1]).  Bounds are ``Param``s, so
``save``/``load`` and ``copy`` keep them (the reference kept them as plain
fields and lost them).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.operators.scaling import CONSTANT_SCALED, require_numeric


class _ScalerParams(HasInputCol, HasOutputCol):
    def transformSchema(self, schema: T.StructType) -> T.StructType:
        """M4 — check the input column, add the non-null double output."""
        name = self.getInputCol()
        if name not in schema.fieldNames():
            raise ValueError(f"no column {name!r} in the input")
        if not isinstance(schema[name].dataType, T.NumericType):
            raise ValueError(f"Input column {name} must be numeric.")
        return T.StructType([*schema.fields,
                             T.StructField(self.getOutputCol(), T.DoubleType(), False)])


class ColumnMinMaxScaler(Estimator, _ScalerParams, DefaultParamsReadable,
                         DefaultParamsWritable):
    """M2 — learns min and max of ``inputCol``."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCol: str | None = None, outputCol: str | None = None):
        return self._set(**self._input_kwargs)

    def setInputCol(self, value: str) -> "ColumnMinMaxScaler":
        return self._set(inputCol=value)

    def setOutputCol(self, value: str) -> "ColumnMinMaxScaler":
        return self._set(outputCol=value)

    def _fit(self, dataset: DataFrame) -> "ColumnMinMaxScalerModel":
        name = self.getInputCol()
        require_numeric(dataset, name)
        x = F.col(name).cast("double")
        row = dataset.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        if row is None or row["lo"] is None:
            raise ValueError(f"Input column {name} has no non-null values to fit.")
        model = ColumnMinMaxScalerModel(inputCol=name, outputCol=self.getOutputCol(),
                                        originalMin=row["lo"], originalMax=row["hi"])
        return self._copyValues(model)


class ColumnMinMaxScalerModel(Model, _ScalerParams, DefaultParamsReadable,
                              DefaultParamsWritable):
    """M3 — applies the learnt bounds; M5 — persisted with them."""

    originalMin = Param(Params._dummy(), "originalMin", "learnt minimum",
                        typeConverter=TypeConverters.toFloat)
    originalMax = Param(Params._dummy(), "originalMax", "learnt maximum",
                        typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None,
                 originalMin: float | None = None, originalMax: float | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def setInputCol(self, value: str) -> "ColumnMinMaxScalerModel":
        return self._set(inputCol=value)

    def setOutputCol(self, value: str) -> "ColumnMinMaxScalerModel":
        return self._set(outputCol=value)

    def getOriginalMin(self) -> float:
        return self.getOrDefault(self.originalMin)

    def getOriginalMax(self) -> float:
        return self.getOrDefault(self.originalMax)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, out = self.getInputCol(), self.getOutputCol()
        require_numeric(dataset, name)
        lo, hi = self.getOriginalMin(), self.getOriginalMax()
        rng = hi - lo
        if rng == 0.0:
            return dataset.withColumn(out, F.lit(CONSTANT_SCALED))
        return dataset.withColumn(out, (F.col(name).cast("double") - F.lit(lo)) / F.lit(rng))
