"""Structured Streaming forms of the ingest and cleaning jobs.

The stateless operators (T1–T3, T5, T6, T9, T10, T13, M3) are plain column
logic and take a ``readStream`` frame as they are.  T4 keeps state within a
stream: a file source hands each file whole to one micro-batch, so the batch
form runs per micro-batch through ``foreachBatch`` (:mod:`.jobs`); for line
streams whose blocks span micro-batches, :mod:`.blocks` keeps the last marker
per stream with ``applyInPandasWithState``.
"""
