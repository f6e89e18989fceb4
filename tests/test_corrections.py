"""Corrections by spec, designs, triggers and alignment against one call a spec, exhaustive search and single samples."""

import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqlake.operators import cellular, corrections, filters, frames
from iqlake.plans import catalog_corrections  # noqa: F401  (registers triggers)

BLOCK = "capture_id long, port int, n0 long, re array<double>, im array<double>"
SPECS = {
    0: {"fs": 32.0, "scale": 2.0, "bandwidth": 16.0, "taps": 9},
    1: {"fs": 32.0, "nfft": 16, "nfft_out": 8, "bandwidth": 12.0, "taps": 21, "conjugate": True},
    2: {"fs": 64.0, "nfft": 12, "nfft_out": 18, "window": "blackman"},
    3: {"fs": 32.0, "nfft": 10, "nfft_out": 20, "window": "blackmanharris", "bandwidth": 20.0, "taps": 5, "scale": 0.5},
    4: {"fs": 8.0, "scale": 3.0},
}


def pieces(x, cap, port, cuts):
    bounds = [0, *cuts, len(x)]
    return [(cap, port, lo, x.real[lo:hi].tolist(), x.imag[lo:hi].tolist()) for lo, hi in itertools.pairwise(bounds)]


def signals(n=300):
    rng = np.random.default_rng(8)
    return {c: rng.normal(size=n + 7 * c) + 1j * rng.normal(size=n + 7 * c) for c in SPECS}


def series(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.capture_id, r.port), {}).update({r.n0 + i: complex(a, b) for i, (a, b) in enumerate(zip(r.re, r.im, strict=True))})
    return out


def with_spec(df, only=None):
    col = None
    for c, s in SPECS.items():
        one = corrections.spec_column(**({"transition": 4.0} | s))
        col = F.when(F.col("capture_id") == c, one) if col is None else col.when(F.col("capture_id") == c, one)
    return df.withColumn("spec", col)


def step_by_step(spark, x, spec):
    """One spec's corrections, each with its own call."""
    s = corrections.DEFAULTS | {"transition": 4.0} | spec
    df = filters.scaled(spark.createDataFrame(pieces(x, 0, 0, []), BLOCK), s["scale"])
    fs = s["fs"]
    if s["nfft"] != s["nfft_out"]:
        df = filters.oa_resample(df, fs, s["nfft"], s["nfft_out"], s["window"], s["bandwidth"])
        fs = fs * s["nfft_out"] / s["nfft"]
    df = filters.conjugate(df.withColumn("flag", F.lit(s["conjugate"])), "flag").drop("flag")
    if s["bandwidth"] < float("inf"):
        df = filters.filtered(df, s["bandwidth"], fs, s["taps"], s["transition"])
    got = series(df)[0, 0]
    return np.array([got[n] for n in range(len(got))])


@pytest.mark.parametrize("size", [1, 37, 64, 1 << 18])
def test_mixed_specs_equal_one_call_each(spark, size):
    x = signals()
    rng = np.random.default_rng(size)
    rows = [r for c in SPECS for r in pieces(x[c], c, 0, sorted(rng.choice(np.arange(1, 300), 5, replace=False).tolist()))]
    got = series(corrections.corrected(with_spec(spark.createDataFrame(rows, BLOCK)), size))
    whole = series(corrections.corrected(with_spec(spark.createDataFrame([r for c in SPECS for r in pieces(x[c], c, 0, [])], BLOCK)), size, one_block=True))
    for c, s in SPECS.items():
        want = step_by_step(spark, x[c], s)
        for found in (got, whole):
            assert sorted(found[c, 0]) == list(range(len(want)))
            assert np.abs(np.array([found[c, 0][n] for n in range(len(want))]) - want).max() < 1e-9


def test_the_plan_has_one_exchange_or_none(spark):
    df = with_spec(spark.createDataFrame(pieces(signals()[0], 0, 0, []), BLOCK))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(corrections.corrected(df)).count("Exchange") == 1 and "Exchange" not in plan(corrections.corrected(df, one_block=True))


def test_a_band_between_bins_is_moved_to_zero(spark):
    n = np.arange(4000)
    x = np.exp(2j * np.pi * (5.3 + 0.4) / 64 * n)
    spec = corrections.spec_column(fs=64.0, nfft=320, nfft_out=160, shift=5.3, window="blackmanharris")
    got = series(corrections.corrected(spark.createDataFrame(pieces(x, 0, 0, [700, 1900]), BLOCK).withColumn("spec", spec), 640))[0, 0]
    y = np.array([got[i] for i in range(200, 1800)])
    want = np.exp(2j * np.pi * 0.4 / 32 * np.arange(200, 1800))
    assert np.abs(y - want).max() < 1e-4


def test_bad_specs_raise(spark):
    df = spark.createDataFrame(pieces(signals()[0], 0, 0, []), BLOCK)
    with pytest.raises(Exception, match="no spec"):
        corrections.corrected(df.withColumn("spec", F.lit(None).cast(corrections.SPEC))).collect()
    with pytest.raises(Exception, match="several blocks"):
        corrections.corrected(with_spec(df.withColumn("n0", F.lit(5).cast("long"))), one_block=True).collect()
    with pytest.raises(ValueError):
        corrections.spec_column(fs=1.0, speed=2)
    with pytest.raises(ValueError):
        corrections.Design(**(corrections.DEFAULTS | {"fs": 8.0, "shift": 1.0}))
    assert corrections.corrected(with_spec(df.limit(0))).count() == 0


def test_alignment_equals_single_samples(spark):
    x = signals()
    rng = np.random.default_rng(2)
    rows = [r for c in SPECS for p in range(2) for r in pieces(x[c], c, p, sorted(rng.choice(np.arange(1, 300), 6, replace=False).tolist()))]
    df = spark.createDataFrame(rows, BLOCK)
    lags = spark.createDataFrame([(c, p, int(rng.integers(0, 90))) for c in SPECS for p in range(2) if (c, p) != (3, 1)], "capture_id long, port int, lag long")
    got = {(r.capture_id, r.port, r.n): (r.re, r.im) for r in frames.samples(corrections.aligned(df, lags, 200)).collect()}
    want = {(r.capture_id, r.port, r.n): (r.re, r.im) for r in cellular.align(frames.samples(df), lags, 200).collect()}
    assert got == want and len(got) == 9 * 200
    with pytest.raises(Exception, match="too short"):
        corrections.aligned(df, lags, 295).collect()
    assert corrections.aligned(df, lags, 295, strict=False).count() > 0


def test_triggers_are_resolved():
    name = "cellular_5g_pss_sync"
    spec = {"sample_rate": 3.84e6, "spacing": 15e3, "symbols": (2,)}
    how, found = corrections.resolve_trigger(name, {"cellular_5g_pss_correlation": spec, "other": {}})
    assert found == spec and how.name == name
    sizes = cellular.sync_sizes(3.84e6, 15e3, 4)
    assert how.max_lag(**spec) == sizes["lags"] / 3.84e6
    assert corrections.resolve_trigger({"cellular_5g_pss_correlation": spec, "x": None})[0].name == name
    assert corrections.resolve_trigger(None) is None
    for bad in (("nothing", {}), (name, {}), ({"a": {}, "b": {}}, None), ({"unknown": {}}, None)):
        with pytest.raises(ValueError):
            corrections.resolve_trigger(*bad)
    with pytest.raises(ValueError):
        corrections.register_trigger(name, "x", lambda: 0.0)(lambda b: b)


def test_a_sync_block_is_found_corrected_and_aligned(spark):
    """Two ports with different delays at twice the synchronisation rate: one plan resamples, measures, shifts and cuts."""
    fs, spacing = 3.84e6, 15e3
    wave = cellular.templates("pss", fs, spacing)[1]
    period = round(0.02 * fs)
    up = filters.resample(np.concatenate([wave, np.zeros(period - len(wave))]), 2 * period)
    rng = np.random.default_rng(5)
    rows = []
    for port, delay in ((0, 260), (1, 1222)):
        x = np.zeros(4 * period, complex)
        for k in range(2):
            x[k * 2 * period + delay : (k + 1) * 2 * period] += up[: 2 * period - delay]
        rows += pieces(x + 0.01 * (rng.normal(size=len(x)) + 1j * rng.normal(size=len(x))), 7, port, [50_001, 120_000])
    spec = corrections.spec_column(fs=2 * fs, nfft=512, nfft_out=256)
    df = spark.createDataFrame(rows, BLOCK).withColumn("spec", spec)
    analysis = {"cellular_5g_pss_correlation": {"sample_rate": fs, "spacing": spacing, "symbols": (0,)}}
    got = series(corrections.correct_iq(df, F.lit(0), F.lit(2 * period - 2000), "cellular_5g_pss_sync", analysis))
    for port in range(2):
        y = np.array([got[7, port][n] for n in range(2 * period - 2000)])
        assert len(got[7, port]) == 2 * period - 2000
        r = np.abs(np.vdot(wave, y[: len(wave)])) / np.linalg.norm(wave) / np.linalg.norm(y[: len(wave)])
        assert r > 0.97


def plain_design(base, target, bandwidth, shift, window, lo=0.25e6, least=256, whole_bins=False):
    sign = {"none": 0, "left": -1, "right": 1}[shift]
    need = target + (1.1 * bandwidth / 2 + lo / 2 if sign else 0)
    fs = Fraction(base) if base <= target else Fraction(base) / int(base / need)
    ratio, offset = fs / Fraction(target), sign * (bandwidth + lo) / 2 if sign else 0
    for n in range(least + 1, 1 << 17):
        if (ratio * n).denominator != 1 or n > 100 and n % 2 and all(n % p for p in range(3, int(n**0.5) + 1, 2)):
            continue
        d = corrections.DIVISORS[window]
        times = d if n % d or int(ratio * n) % d else 1
        if whole_bins and offset and (Fraction(offset) * ratio * n * times / fs).denominator != 1:
            continue
        return float(fs), int(ratio * n) * times, n * times, offset
    return None


@pytest.mark.parametrize("whole_bins", [False, True])
def test_designs_equal_exhaustive_search(spark, whole_bins):
    rows = []
    for base, target, window in itertools.product((122.88e6, 40e6), (1.92e6, 7.68e6, 5e6, 20e6), corrections.DIVISORS):
        for bandwidth, shift in ((float("inf"), "none"), (1e6, "left"), (1.5e6, "right"), (1e6, "none")):
            want = plain_design(base, target, bandwidth, shift, window, whole_bins=whole_bins)
            if want:
                rows.append((base, target, bandwidth, shift, window, want))
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "id int, master_clock_rate double, sample_rate double, analysis_bandwidth double, lo_shift string, window string")
    got = {r.id: (r.fs_sdr, r.nfft, r.nfft_out, r.lo_offset) for r in corrections.designed(df, whole_bins=whole_bins).collect()}
    assert len(rows) > 100
    for i, r in enumerate(rows):
        assert got[i][1:3] == r[5][1:3] and abs(got[i][0] - r[5][0]) < 1e-3 and got[i][3] == r[5][3]


def test_designs_that_cannot_be():
    for bad in ({"lo_shift": "left"}, {"bandwidth": 2e9}, {"bandwidth": 90e6, "lo_shift": "right"}):
        with pytest.raises(ValueError):
            corrections.design_resampler(100e6, 80e6, **bad)
    with pytest.raises(ValueError):
        corrections.design_resampler(np.pi * 1e8, 1e8)
    assert corrections.design_resampler(1e6, 4e6)["fs_sdr"] == 1e6 and corrections.design_resampler(100e6, 10e6, backend=20e6)["fs_sdr"] == 20e6


def test_overlaps_hold_whole_fast_blocks():
    for nfft, fs, duration, bandwidth, lag in ((256, 3e6, 0.01, float("inf"), 0), (1000, 15.36e6, 0.1, 10e6, 7000), (4096, 30.72e6, 0.02, 1e6, 1)):
        low, high = corrections.overlap(nfft, fs, duration, bandwidth, lag)
        size = round(duration * fs)
        assert 0 <= high - low <= 1 and (low + high + size) % nfft == 0 and low + high > lag
        assert bandwidth == float("inf") or low > 2001
        n = (low + high + size) // nfft
        for p in (2, 3, 5, 7, 11):
            while n % p == 0:
                n //= p
        assert n == 1 or bandwidth != float("inf")
