"""Property tests for the two custom distributed algorithms (T4, T7):
random inputs and random split / partition sizes against brute force."""

import os
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wavelake.operators.blocks import clean_blocks, file_blocks
from wavelake.operators.ordering import contiguous_index
from wavelake.sources.text import read_lines

from helpers import rows, sequential_blocks

LINE = st.one_of(
    st.just("[INFO] log"), st.just("  [WARN] indented"), st.just("timestamp,a,b"),
    st.just(""), st.just("1,2"), st.just("7.5,1,2"),
    st.builds(lambda i, a, b: f"{i},{a}.5,{b}", st.integers(0, 10**9),
              st.integers(0, 99), st.integers(0, 9)))

SLOW = settings(max_examples=6, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture,
                                       HealthCheck.too_slow])


@SLOW
@given(files=st.lists(st.lists(LINE, min_size=0, max_size=120), min_size=1, max_size=3),
       split=st.integers(40, 3000))
def test_blocks_equal_sequential_for_any_layout(spark, tmp_path, files, split):
    folder = os.path.join(str(tmp_path), uuid.uuid4().hex)
    os.makedirs(folder)
    for i, lines in enumerate(files):
        with open(os.path.join(folder, f"f{i}.log"), "w") as fh:
            fh.write("\n".join(lines) + ("\n" if lines else ""))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, str(split))
    try:
        got = rows(clean_blocks(file_blocks(read_lines(spark, folder))))
    finally:
        spark.conf.set(key, old)
    assert got == sorted(sequential_blocks(files))


@SLOW
@given(keys=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 50)),
                     min_size=1, max_size=300),
       parts=st.integers(1, 12))
def test_index_equals_rank_for_any_partitioning(spark, keys, parts):
    data = [(s, t, i) for i, (s, t) in enumerate(keys)]
    df = spark.createDataFrame(data, "s string, t long, id long").repartition(parts)
    got = rows(contiguous_index(df, ["t", "id"], partition_by=["s"], count_col="n"),
               ["id", "sample_index", "n"])
    expected = []
    for series in ("a", "b", None):
        members = sorted((t, i) for s, t, i in data if s == series)
        expected += [(i, k, len(members)) for k, (_, i) in enumerate(members)]
    assert got == sorted(expected)
