"""T4 + T5 on an unbounded line stream (e.g. lines with an offset from a
message bus), where one block can span micro-batches.

Each micro-batch runs the batch block scan (range sort on the full key, so a
hot stream spans many tasks) over its lines, seeded with every stream's last
marker from the batch before.  Output and state go to ``batch_id=<n>`` folders
with overwrite, so a replayed batch reproduces them; the query's checkpoint
says which batch comes next.

Lines must arrive in order across micro-batches (true per partition of a
log-structured source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.functions.text import CLOSE_BLOCK, OPEN_BLOCK, block_marker
from wavelake.operators.blocks import clean_blocks, ordered_blocks
from wavelake.session import drop_scratch

_SEED_TEXT = {OPEN_BLOCK: "timestamp", CLOSE_BLOCK: "["}


def _state_folder(state_path: str, batch_id: int) -> str:
    return f"{state_path.rstrip('/')}/batch_id={batch_id}"


def _read_state(spark, state_path: str, batch_id: int,
                schema: T.StructType) -> DataFrame | None:
    """State after the batch before; only the first batch has none.  A folder
    that is missing later is an error: going on would close every open block."""
    if batch_id == 0:
        return None
    return spark.read.schema(schema).parquet(_state_folder(state_path, batch_id - 1))


def clean_blocks_micro_batch(batch: DataFrame, batch_id: int, stream_cols: Sequence[str],
                             order_col: str, target_path: str, state_path: str,
                             value_col: str = "value") -> None:
    """One micro-batch of the skew-safe streaming T4 + T5.

    The stored state of every stream (its last marker) re-enters as a
    synthetic marker line ordered before the batch's lines; the batch block
    scan (range sort on the full key, so a hot stream spans many tasks) does
    the rest.  Output and the new state go to ``batch_id=<n>`` folders with
    overwrite, so a replayed batch reproduces them exactly."""
    spark = batch.sparkSession
    stream_cols = list(stream_cols)
    lines = batch.select(*stream_cols, order_col, value_col)
    state_schema = T.StructType([*[lines.schema[c] for c in stream_cols],
                                 T.StructField("marker", T.IntegerType())])
    state = _read_state(spark, state_path, batch_id, state_schema)
    if state is not None:
        first = F.lit(None).cast(lines.schema[order_col].dataType)
        seeds = state.select(
            *stream_cols, first.alias(order_col),
            F.when(F.col("marker") == OPEN_BLOCK, F.lit(_SEED_TEXT[OPEN_BLOCK]))
            .otherwise(F.lit(_SEED_TEXT[CLOSE_BLOCK])).alias(value_col))
        lines = lines.unionByName(seeds)
    # nulls sort first: a seed precedes every line of its stream
    order = F.col(order_col).asc_nulls_first()
    blocks = ordered_blocks(lines, [order], stream_cols, value_col, keep=[])
    (clean_blocks(blocks, value_col, keep=stream_cols)
     .write.mode("overwrite").parquet(f"{target_path.rstrip('/')}/batch_id={batch_id}"))

    # new state: each stream's last marker; a seed (null order) ranks first
    rank = F.struct(F.col(order_col).isNotNull(), F.col(order_col))
    new_state = (lines.withColumn("_wl_m", block_marker(value_col))
                 .filter(F.col("_wl_m").isNotNull())
                 .groupBy(*stream_cols)
                 .agg(F.max_by("_wl_m", rank).cast("int").alias("marker")))
    new_state.write.mode("overwrite").parquet(_state_folder(state_path, batch_id))
    if batch_id >= 2:  # a replay needs the state of the batch before, none older
        drop_scratch(spark, _state_folder(state_path, batch_id - 2))


def stream_clean_blocks_skew_safe(lines: DataFrame, stream_cols: Sequence[str],
                                  order_col: str, target_path: str, state_path: str,
                                  checkpoint: str, value_col: str = "value",
                                  available_now: bool = False):
    """Start the skew-safe streaming T4 + T5 (``foreachBatch`` over
    :func:`clean_blocks_micro_batch`)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        clean_blocks_micro_batch(batch, batch_id, stream_cols, order_col, target_path,
                                 state_path, value_col)
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
