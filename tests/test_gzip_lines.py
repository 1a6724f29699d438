"""Gzip files of several members, read in splits."""

from __future__ import annotations

import gzip
import io
import random

import pytest

from wavelake.sources.gzip_lines import first_member, read_gzip_lines, split_lines, write_gzip_members


def _file(parts, level=6):
    return b"".join(gzip.compress(p, level) for p in parts)


@pytest.mark.parametrize("split", [1, 7, 50, 333, 1 << 20])
@pytest.mark.parametrize("seed", range(3))
def test_every_line_is_read_once_in_order(split, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "bc", "\n", "\r\n", "é" * 30, "long " * 40]) for _ in range(400)).encode()
    if seed == 1:
        text = text.rstrip(b"\r\n") + b"\n"
    cuts = sorted(rng.sample(range(len(text)), 12))
    parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
    data = _file(parts[:6]) + _file([b""]) + _file(parts[6:], level=0)   # one empty, some stored members
    if seed == 2:
        data += b"\0" * 20                                                # padding
    want = [x.removesuffix(b"\r") for x in text.split(b"\n")]
    want = want if want[-1] else want[:-1]
    got = []
    for start in range(0, len(data), split):
        got += split_lines(io.BytesIO(data), start, min(len(data), start + split), len(data))
    assert got == want


def test_header_bytes_inside_a_member_are_no_member():
    inner = gzip.compress(b"inside\n")
    broken = inner[:6] + b"\xff" + inner[7:-6]
    data = _file([b"x" * 50 + broken + b"\n"], level=0) + _file([b"next\n"])
    at = data.find(b"\x1f\x8b\x08", 5)
    assert at < data.rfind(b"\x1f\x8b\x08")
    assert first_member(io.BytesIO(data), 1, len(data)) == data.rfind(b"\x1f\x8b\x08")
    assert first_member(io.BytesIO(data), 1, at + 5) is None


def test_one_file_is_many_splits(spark, tmp_dir):
    lines = spark.range(5000).selectExpr("id", "concat('line ', id, ' ', repeat('x', int(id % 90))) AS value")
    assert write_gzip_members(lines.repartitionByRange(2, "id").sortWithinPartitions("id"), f"file://{tmp_dir}/g", 100) == 2
    got = read_gzip_lines(spark, f"file://{tmp_dir}/g", split_bytes=1024)
    assert got.rdd.getNumPartitions() > 10
    rows = sorted((r["_file"], r["_split"], r["_line"], r["value"]) for r in got.collect())
    assert len(rows) == 5000 and len({r[:2] for r in rows}) > 10
    assert [int(r[3].split()[1]) for r in rows] == list(range(5000))
    plain = sorted(r["value"] for r in spark.read.text(f"file://{tmp_dir}/g").collect())
    assert plain == sorted(r[3] for r in rows)
    with pytest.raises(Exception, match="missing"):
        read_gzip_lines(spark, f"file://{tmp_dir}/missing").count()
