"""wavelake — sensor and signal tables on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function (or a ``pyspark.ml``
stage) so Catalyst plans, prunes and distributes the work.  Operator ids in

The main entry points are importable from the package itself; they load on
first use, so importing one submodule (as executors do) stays light.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    # sources
    "read_csv_strings": "wavelake.sources.csv",
    "read_lines": "wavelake.sources.text",
    "read_gzip_lines": "wavelake.sources.gzip_lines",
    "read_query": "wavelake.sources.jdbc",
    "run_sql": "wavelake.sources.sql",
    "read_task_csv": "wavelake.sources.lake",
    "task_object_uri": "wavelake.sources.lake",
    # operators
    "drop_all_null": "wavelake.operators.clean",
    "drop_noise_lines": "wavelake.operators.clean",
    "parse_fields": "wavelake.operators.clean",
    "parse_fields_strict": "wavelake.operators.clean",
    "file_blocks": "wavelake.operators.blocks",
    "ordered_blocks": "wavelake.operators.blocks",
    "clean_blocks": "wavelake.operators.blocks",
    "contiguous_index": "wavelake.operators.ordering",
    "spectrum": "wavelake.operators.spectrum",
    "framed_dft": "wavelake.operators.dft",
    "minmax_scale": "wavelake.operators.scaling",
    "minmax_scale_narrow": "wavelake.operators.scaling",
    "running": "wavelake.operators.scan",
    "over_rows": "wavelake.operators.scan",
    "neighbours": "wavelake.operators.scan",
    "asof_join": "wavelake.operators.asof",
    "interval_join": "wavelake.operators.intervals",
    "series_dft": "wavelake.operators.spectra",
    "frame_spectra": "wavelake.operators.spectra",
    "averaged_spectrum": "wavelake.operators.spectra",
    "resample": "wavelake.operators.spectra",
    "periodogram": "wavelake.operators.spectra",
    "run_automaton": "wavelake.operators.automaton",
    "column_profiles": "wavelake.operators.profile",
    "merge_profiles": "wavelake.operators.profile",
    "profile_report": "wavelake.operators.profile",
    "quality_counts": "wavelake.operators.quality",
    "run_summary": "wavelake.operators.quality",
    "preview": "wavelake.operators.quality",
    "line_protocol": "wavelake.functions.lineproto",
    "with_line_protocol": "wavelake.functions.lineproto",
    # ml
    "ColumnMinMaxScaler": "wavelake.ml.minmax",
    "ColumnMinMaxScalerModel": "wavelake.ml.minmax",
    # sinks and plans
    "sink_for": "wavelake.sinks.registry",
    "LakeSink": "wavelake.sinks.lake",
    "append_interleaved": "wavelake.sinks.interleaved",
    "read_ranges": "wavelake.sinks.interleaved",
    "ingest_csv": "wavelake.plans.ingest",
    "run_analysis": "wavelake.plans.analysis",
    "clean_log_stateless": "wavelake.plans.logs",
    "clean_log_stateful": "wavelake.plans.logs",
    "scale_feature": "wavelake.plans.scale",
    # session
    "build_session": "wavelake.session",
    "cluster_conf": "wavelake.session",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    module = _EXPORTS.get(name)
    if module is None:
        raise AttributeError(f"module 'wavelake' has no attribute {name!r}")
    value = getattr(importlib.import_module(module), name)
    globals()[name] = value
    return value
