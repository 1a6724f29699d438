"""X1 framed DFT against numpy.fft.rfft on synthetic tones (FIXTURES warns
the sample CSV's label is not its real frequency, so tones are synthesised)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators.dft import framed_dft


def _tone(n, freq, rate=1000.0, amp=1.0, offset=0.0):
    t = np.arange(n) / rate
    return amp * np.sin(2 * np.pi * freq * t) + offset


def test_matches_numpy_per_frame_and_series(spark):
    n, size = 300, 64  # 4 full frames + a zero-padded partial one
    a = _tone(n, 125.0, amp=2.0, offset=0.5)
    b = _tone(n, 62.5)
    data = [("a", i, float(a[i])) for i in range(n)] + [("b", i, float(b[i])) for i in range(n)]
    df = spark.createDataFrame(data, "series string, ts long, value double").repartition(3)
    out = framed_dft(df, "value", ["ts"], series=["series"], frame_size=size).toPandas()
    assert len(out) == 2 * 5 * (size // 2 + 1)
    for name, sig in (("a", a), ("b", b)):
        for frame in range(5):
            chunk = np.zeros(size)
            part = sig[frame * size:(frame + 1) * size]
            chunk[:len(part)] = part
            ref = np.fft.rfft(chunk)
            got = out[(out.series == name) & (out.frame == frame)].sort_values("bin")
            assert np.allclose(got.re.values, ref.real, atol=1e-9)
            assert np.allclose(got.magnitude.values, np.abs(ref), atol=1e-9)
            assert np.allclose(got.frequency_hz.values, np.arange(size // 2 + 1) * 1000.0 / size)
    # peak of a full frame sits on the tone's bin (125 Hz -> bin 8, 62.5 Hz -> bin 4)
    full = out[out.frame == 0]
    peak = full.loc[full[full.bin > 0].groupby("series").magnitude.idxmax()]
    assert dict(zip(peak.series, peak.bin)) == {"a": 8, "b": 4}


def test_dc_and_nyquist_phase_are_exact(spark):
    data = [(i, float((-1) ** i) - 0.25) for i in range(8)]
    df = spark.createDataFrame(data, "ts long, value double")
    out = framed_dft(df, "value", ["ts"], frame_size=8).toPandas().sort_values("bin")
    assert out.im.iloc[0] == 0.0 and out.im.iloc[-1] == 0.0
    assert out.phase.iloc[0] == pytest.approx(np.pi)  # DC = -2 < 0
    assert out.magnitude.iloc[-1] == pytest.approx(8.0)


def test_rejects_tiny_frames(spark):
    with pytest.raises(ValueError):
        framed_dft(spark.range(3).withColumnRenamed("id", "v"), "v", ["v"], frame_size=1)


def test_order_by_expression(spark):
    data = [(f"{i / 1000:.3f}", float(np.cos(2 * np.pi * 125.0 * i / 1000))) for i in range(64)]
    df = spark.createDataFrame(data, "timestamp string, amplitude double").repartition(3)
    out = framed_dft(df, "amplitude", [F.col("timestamp").cast("double")], frame_size=64)
    peak = out.filter("bin > 0").orderBy(F.desc("magnitude")).first()
    assert peak.bin == 8 and peak.frequency_hz == 125.0


def test_frames_across_tasks_and_batches(spark):
    rng = np.random.default_rng(1)
    sig = {None: rng.normal(size=150), "": rng.normal(size=33), "x": rng.normal(size=1000)}
    data = [(k, i, float(v)) for k, x in sig.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "series string, ts long, value double").repartition(7)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
            "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("3000", "0", "17")):
            spark.conf.set(k, v)
        out = framed_dft(df, "value", ["ts"], series=["series"], frame_size=32).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out["series"] = out["series"].where(out["series"].notna(), None)
    for name, x in sig.items():
        mine = out[out.series.isna()] if name is None else out[out.series == name]
        n = -(-len(x) // 32)
        want = np.fft.rfft(np.pad(x, (0, n * 32 - len(x))).reshape(n, 32), axis=1)
        got = mine.sort_values(["frame", "bin"])
        assert np.allclose(got.re.to_numpy().reshape(n, -1), want.real, atol=1e-9)
        assert np.allclose(got.magnitude.to_numpy().reshape(n, -1), np.abs(want), atol=1e-9)
