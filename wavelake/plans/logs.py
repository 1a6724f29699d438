"""P3, P4 — cleaning interleaved log / measurement text files.

P3 (stateless) keeps every data-looking line and nulls malformed cells; P4
(stateful) keeps only lines inside header-opened blocks and drops malformed
ones.  They are different operators and give different rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wavelake.operators.blocks import clean_blocks, file_blocks
from wavelake.operators.clean import drop_noise_lines, parse_fields
from wavelake.sources.text import read_lines


def clean_log_stateless(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """P3 = S2 + T2 + T3."""
    return parse_fields(drop_noise_lines(read_lines(spark, paths, with_position=False)))


def clean_log_stateful(spark: SparkSession, paths: str | Sequence[str],
                       split_bytes: int | None = None) -> DataFrame:
    """P4 = S2 + T4 + T5, state carried across splits of each file (of
    ``split_bytes``; None: as the session is set)."""
    return clean_blocks(file_blocks(read_lines(spark, paths), split_bytes=split_bytes))
