"""P5 — scale one feature three ways (DataFrame code, ML stage, narrowed)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wavelake.ml.minmax import ColumnMinMaxScaler
from wavelake.operators.scaling import minmax_scale, minmax_scale_narrow


def scale_feature(df: DataFrame, input_col: str, output_col: str = "scaled",
                  method: str = "dataframe") -> DataFrame:
    if method == "dataframe":
        return minmax_scale(df, input_col, output_col)
    if method == "ml":
        return ColumnMinMaxScaler(inputCol=input_col, outputCol=output_col).fit(df).transform(df)
    if method == "narrow":
        return minmax_scale_narrow(df, input_col)
    raise ValueError(f"unknown method {method!r}")
