"""Spectra of whole, framed, unevenly spaced series against numpy and sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators.spectra import (averaged_spectrum, frame_spectra, periodogram, resample, series_dft,
                                        window_weights)

SCHEMA = "s string, at long, v double"


def _rows(lengths, seed=0):
    rng = random.Random(seed)
    rows = [(s, i * 5, rng.uniform(-10, 10)) for s, n in lengths.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


def _values(rows):
    out = {}
    for s, _, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(s, []).append(v)
    return out


@pytest.mark.parametrize("block_points", [1, 16, 1 << 18])
def test_whole_series_equal_numpy(spark, block_points):
    rows = _rows({"hot": 900, "a": 1, "b": 2, "c": 3, None: 37, "d": 64})
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bits", F.lit(9)).repartition(5)
    out = series_dft(df, "v", ["at"], ["s"], sample_rate=100.0, block_points=block_points).collect()
    got = {}
    for r in out:
        got.setdefault(r["s"], {})[r["bin"]] = r
    for s, x in _values(rows).items():
        n = 1 << math.ceil(math.log2(len(x))) if len(x) > 1 else 1
        want = np.fft.fft(x, n)[:n // 2 + 1]
        assert sorted(got[s]) == list(range(n // 2 + 1))
        for k, w in enumerate(want):
            r = got[s][k]
            assert abs(r["re"] - w.real) < 1e-8 and abs(r["im"] - w.imag) < 1e-8
            assert r["n_points"] == n and r["frequency_hz"] == k * 100.0 / n
    assert sum(map(len, got.values())) == len(out)


def test_whole_series_without_series_or_rows(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 2, 3.0), ("x", 3, 4.0)], SCHEMA)
    assert sorted((r["bin"], r["re"]) for r in series_dft(df, "v", ["at"]).collect()) == [(0, 7.0), (1, -1.0)]
    assert series_dft(df.limit(0), "v", ["at"], ["s"]).collect() == []


@pytest.mark.parametrize("size,hop,block", [(8, 3, 1), (8, 8, 40), (16, 1, 1 << 18), (6, 10, 30), (7, 2, 20)])
@pytest.mark.parametrize("window", ["hann", "boxcar"])
def test_overlapping_frames(spark, size, hop, block, window):
    rows = _rows({"hot": 300, "short": size - 1, "one": size, None: 41}, seed=size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    weights = window_weights(window, size)
    want, power = {}, {}
    for s, x in _values(rows).items():
        for f, i in enumerate(range(0, len(x) - size + 1, hop)):
            spectrum = np.fft.rfft(np.array(x[i:i + size]) * weights)
            for k, w in enumerate(spectrum):
                want[s, f, k] = w
                sides = 1 if k == 0 or 2 * k == size else 2
                power.setdefault((s, k), []).append(abs(w) ** 2 * sides / (50.0 * (weights ** 2).sum()))
    got = {(r["s"], r["frame"], r["bin"]): complex(r["re"], r["im"]) for r in frame_spectra(
        df, "v", ["at"], ["s"], size, hop, window, 50.0, block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    mean = {(r["s"], r["bin"]): (r["frames"], r["power"]) for r in averaged_spectrum(
        df, "v", ["at"], ["s"], size, hop, window, 50.0, block).collect()}
    assert mean.keys() == power.keys()
    assert all(n == len(power[k]) and abs(p - np.mean(power[k])) < 1e-9 for k, (n, p) in mean.items())


def test_a_sample_is_moved_once_not_once_per_frame(spark):
    from wavelake.operators.spectra import _in_blocks

    df = spark.range(4000).select(F.lit("x").alias("s"), F.col("id").alias("at"), F.rand(1).alias("v"))
    rows, block = _in_blocks(df, "v", ["at"], ["s"], 64, 4, 1000)     # 16 frames a sample
    assert block == 1000 and rows.count() == 4000 + 3 * 63


def _ticks(samples, step, max_gap):
    out = []
    samples = sorted(samples)
    for i, (t, _, x) in enumerate(samples):
        t1, x1 = (samples[i + 1][0], samples[i + 1][2]) if i + 1 < len(samples) else (None, None)
        k = -(-t // step)
        while k * step < t1 if t1 is not None else k * step <= t:
            at = k * step
            gap = t1 is not None and max_gap is not None and t1 - t > max_gap and at > t
            v = x if at == t else None if gap else x + (x1 - x) * ((at - t) / (t1 - t))
            out.append((k, at, v, gap))
            k += 1
    return out


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
@pytest.mark.parametrize("max_gap", [None, 40])
def test_uniform_clock(spark, piece, max_gap):
    rng = random.Random(piece)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(-400, 400), i, rng.uniform(0, 9))
            for i in range(200)] + [("far", -7, 0, 1.0), ("far", 90_000, 1, 5.0), ("single", 20, 0, 2.0),
                                    ("off", 21, 0, 2.0), ("b", None, 1, 3.0), ("b", 5, 1, None)]
    df = spark.createDataFrame(rows, "s string, t long, i long, v double").repartition(5)
    out = resample(df, "t", "v", 10, max_gap, ["s"], ["i"], piece_points=piece).collect()
    got = {}
    for r in out:
        got.setdefault(r["s"], []).append((r["tick"], r["time"], r["value"], r["in_gap"]))
    for s in {r[0] for r in rows}:
        want = _ticks([(t, i, v) for key, t, i, v in rows if key == s and t is not None and v is not None], 10, max_gap)
        have = sorted(got.get(s, []))
        assert [h[:2] + h[3:] for h in have] == [w[:2] + w[3:] for w in want], s
        assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9)
                   for a, b in zip(have, want))
    assert "single" in got and "off" not in got
    assert resample(df.limit(0), "t", "v", 10).collect() == []


def test_periodogram_finds_a_tone_in_uneven_samples(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 10 else "b", t := rng.uniform(0, 40), math.sin(2 * math.pi * 0.7 * t + 1) + 5)
            for i in range(1200)] + [("none", None, 1.0), ("flat", 1.0, 2.0), ("flat", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "s string, t double, v double").repartition(6)
    freqs = [0.1 * k for k in range(1, 21)]
    out = periodogram(df, F.col("t"), "v", freqs, ["s"])
    got = {(r["s"], round(r["frequency"], 1)): r for r in out.collect()}
    for s in ("hot", "b"):
        assert got[s, 0.7]["power"] > 0.999 and max(got[s, round(f, 1)]["power"] for f in freqs if abs(f - .7) > .05) < 0.3
        t = np.array([r[1] for r in rows if r[0] == s])
        y = np.array([r[2] for r in rows if r[0] == s])
        for f in (0.3, 0.7):
            base = np.stack([np.ones_like(t), np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)], axis=1)
            left = y - base @ np.linalg.lstsq(base, y, rcond=None)[0]
            want = 1 - (left @ left) / ((y - y.mean()) @ (y - y.mean()))
            assert abs(got[s, f]["power"] - want) < 1e-9 and got[s, f]["samples"] == len(t)
    assert got["flat", 0.3]["power"] is None and ("none", 0.3) not in got
    whole = periodogram(df.filter("s = 'b'"), F.col("t"), "v", [0.7]).collect()
    assert len(whole) == 1 and abs(whole[0]["power"] - got["b", 0.7]["power"]) < 1e-9
