"""Closed forms and edge cases of the signal operators."""

import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from iqlake.functions import columns as C
from iqlake.functions import ofdm, windows
from iqlake.operators import calibration, cellular, filters, frames, spectrum, stats
from iqlake.plans import results, sweep
from iqlake.sources import files, synthetic, tables


def block(spark, x, capture=0, port=0):
    x = np.asarray(x, complex)
    return spark.createDataFrame([(capture, port, 0, x.real.tolist(), x.imag.tolist())], "capture_id long, port int, n0 long, re array<double>, im array<double>")


def test_tone_has_one_peak(spark):
    iq = synthetic.tone(spark, 256, 64.0, 8.0)
    spec = spectrum.stft_power(synthetic.blocks_of(iq, 256), 64, 32)
    best = spec.groupBy("frame").agg(F.max_by("k", "power").alias("k")).select("k").distinct().collect()
    assert [r["k"] for r in best] == [64 // 2 + 8]
    total = spec.groupBy("frame").agg(F.sum("power").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in total) or len(total) == 7


def test_pulse_is_flat(spark):
    iq = synthetic.pulse(spark, 64, 64.0, 20 / 64.0)
    spec = spectrum.stft_power(synthetic.blocks_of(iq, 64), 64, 0, "rect")
    p = [r["power"] for r in spec.collect()]
    assert max(p) - min(p) < 1e-12 and len(p) == 64


def test_sawtooth_mean_power(spark):
    iq = synthetic.sawtooth(spark, 1024, 1024.0, 0.125)
    assert abs(iq.agg(F.avg(F.col("re") ** 2)).first()[0] - np.mean((np.arange(128) / 128) ** 2)) < 1e-9


def test_blocks_cut_at_overlaps_give_the_same_frames(spark):
    x = np.random.default_rng(1).normal(size=300) + 1j * np.random.default_rng(2).normal(size=300)
    whole = spectrum.stft_power(block(spark, x), 32, 16)
    cut = spectrum.stft_power(spectrum.overlapping_blocks(block(spark, x), 100, 32, 16), 32, 16)
    a = {(r.frame, r.k): r.power for r in whole.collect()}
    b = {(r.frame, r.k): r.power for r in cut.collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_decibels_of_zero_and_nan(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),)], "p double").select(C.pow_to_db(F.col("p")).alias("d")).collect()
    assert rows[0].d == -math.inf and rows[1].d == 0 and math.isnan(rows[2].d)


def test_histogram_edges_and_nan(spark):
    values = [-100.0, -0.25, -0.26, 0.0, 0.24, 0.25, 9.74, 10.0, 10.24, 10.25, 50.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.bin: r.n for r in stats.histogram(df, "x", 0.0, 10.0, 0.5).collect()}
    centers = stats.power_centers(0.0, 10.0, 0.5)
    edges = [-math.inf] + [c - 0.25 for c in centers[1:-1]] + [10.25, math.inf]
    want: dict = {}
    for v in values[:-1]:
        i = next(i for i in range(len(edges) - 1) if edges[i] <= v < edges[i + 1])
        want[i] = want.get(i, 0) + 1
    assert got == want


def test_empty_table_gives_no_rows(spark):
    empty = spark.createDataFrame([], "x double")
    assert stats.histogram(empty, "x", 0, 10, 1).count() == 0
    assert stats.ccdf(empty, "x", [1.0]).count() == 0
    none = spark.createDataFrame([], "capture_id long, port int, n0 long, re array<double>, im array<double>")
    assert spectrum.stft_power(none, 16).count() == 0


@pytest.mark.parametrize("count", [1, 3])
def test_ratio_needs_two_ports(spark, count):
    rows = [(0, p, 0, 0, 1.0) for p in range(count)]
    df = spark.createDataFrame(rows, "capture_id long, port int, frame long, k long, power double")
    with pytest.raises(Exception, match="exactly two ports"):
        spectrum.ratio_histogram(df, -10, 10, 1).collect()


def test_whole_frames(spark):
    df = spark.createDataFrame([(0, 0, n) for n in range(10)], "capture_id long, port int, n long")
    assert frames.whole_frames(df, 4).count() == 8
    with pytest.raises(Exception, match="multiple"):
        frames.whole_frames(df, 4, strict=True).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 40))
def test_centred_bins_hold_the_centre(size, count):
    start, bins = frames.binned_layout(size, count, True)
    if count <= size // 2:
        assert start >= 0 and start + bins * count <= size + count
        assert bins % 2 == 1


def test_band_outside_the_spectrum_raises():
    with pytest.raises(ValueError):
        frames.band_slice(16, 16.0, 20.0)
    with pytest.raises(ValueError):
        C.whole(3.4, "x")


def test_windows_have_unit_power_and_known_bandwidth():
    for name in ("hamming", "blackman", "blackmanharris", "hann", ("kaiser", 11.88), ("knab", 2.0), ("cosh", 2.0), ("modified_bessel", 2.0)):
        assert abs(np.mean(windows.window(name, 128, 16) ** 2) - 1) < 1e-12
    assert abs(windows.noise_bandwidth("hann", 256) - 1.5) < 1e-9
    beta = windows.parameter_for_bandwidth("kaiser", 1.8, 512)
    assert abs(windows.noise_bandwidth(("kaiser", beta), 512) - 1.8) < 1e-4
    assert abs(windows.window(("acg", 0.1), 65, normalise=False).max() - 1) < 1e-12


def test_sequences():
    for n in range(3):
        d = ofdm.pss(n)
        assert len(d) == 127 and set(d) == {1, -1}
        assert sorted({int(d @ np.roll(d, k)) for k in range(1, 127)}) == [-1]
    assert abs(int(ofdm.sss(0, 0) @ ofdm.sss(1, 0))) < 40
    phy = ofdm.Numerology(15.36e6)
    assert phy.slot_size == 15360 and len(phy.prefix_indexes()) == 10 * 14 * 72
    assert ofdm.Numerology(30.72e6, 30e3, "5G").slot_size == 15360
    with pytest.raises(ValueError):
        ofdm.tdd_symbols(30e3, "du")
    assert ofdm.tdd_symbols(15e3, "d") == ["d"] * 140


def test_sync_finds_the_lag_per_port(spark):
    rate, spacing = 3.84e6, 30e3
    rng = np.random.default_rng(0)
    out = None
    for port, lag in ((0, 11), (1, 90)):
        x = 0.01 * (rng.normal(size=3000) + 1j * rng.normal(size=3000))
        wave = ofdm.sync_waveform(ofdm.pss(2), rate, spacing)
        x[lag : lag + len(wave)] += wave
        b = block(spark, x, port=port)
        out = b if out is None else out.unionByName(b)
    got = cellular.sync(cellular.correlate(out, "pss", rate, spacing, (0,), period=3000 / rate), rate)
    assert {r.port: r.lag for r in got.collect()} == {0: 11, 1: 90}


def test_filters(spark):
    h = filters.fir_lowpass(10e6, 50e6, 501, 1e6)
    f = np.abs(np.fft.fft(h, 5000))
    assert abs(f[0] - 1) < 0.02 and abs(f[300] - 1) < 0.02 and f[2000] < 0.02
    t = np.arange(128)
    x = np.exp(2j * np.pi * 4 * t / 128)
    y = filters.resample(x, 64)
    assert np.allclose(y, np.exp(2j * np.pi * 4 * np.arange(64) / 64))
    assert np.allclose(filters.resample(y, 128), x)
    with pytest.raises(ValueError):
        filters.resample(x[:127], 64)
    row = filters.filtered(block(spark, x), 0.5, 1.0, 31, 0.1).first()
    assert len(row.re) == 128
    design = filters.design_resampler(125e6, 15.36e6)
    assert design["fs_sdr"] >= 15.36e6 and abs(design["nfft"] / design["nfft_out"] - design["fs_sdr"] / 15.36e6) < 1e-9


def test_interpolation_on_below_and_above(spark):
    grid = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "k string, f double, v double")
    asked = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 2.0), ("a", 3.5), ("b", 2.0)], "k string, f double")
    got = {(r.k, r.f): r.c for r in calibration.interpolate(asked, grid, ("k",), "f", "v", "c").collect()}
    assert got == {("a", 0.5): None, ("a", 1.0): 10.0, ("a", 2.0): 20.0, ("a", 3.5): None, ("b", 2.0): None}
    with pytest.raises(Exception, match="no calibration"):
        calibration.interpolate(asked, grid, ("k",), "f", "v", "c", strict=True).collect()
    assert calibration.missing_calibration(asked, grid, ("k",)).count() == 1


def test_sweep_rules(spark):
    captures = spark.createDataFrame([(1, 10.0)], "id int, gain double")
    with pytest.raises(ValueError):
        sweep.expand(captures, [{"kind": "list", "field": "gain", "values": [1.0]}, {"kind": "repeat", "count": 2}])
    with pytest.raises(ValueError):
        sweep.expand(captures, [{"kind": "list", "field": "gain", "values": [1.0]}] * 2)
    got = sweep.expand(captures, [{"kind": "repeat", "count": 2}, {"kind": "range", "field": "gain", "start": 0.0, "stop": 1.0, "step": 0.5}])
    assert got.count() == 6
    lookup = spark.createDataFrame([(2, "x")], "id int, site string")
    assert sweep.remap(captures, lookup, ["id"], "site", "place").first().place is None
    with pytest.raises(Exception, match="no place"):
        sweep.remap(captures, lookup, ["id"], "site", "place", required=True).collect()


def test_results_queries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, s string")
    assert {r.i for r in results.last_match(df, "i", "s").collect()} == {2, 3}
    assert results.select(df, "i > 1 and s = 'b'").count() == 2
    assert [r.time for r in results.concat_time(df, ["i"], [], 0.5).orderBy("i").collect()] == [0.0, 0.5, 1.0]


def test_files_and_units(spark, tmp_path):
    x = (np.arange(10) + 1j * np.arange(10)).astype("complex64")
    np.save(tmp_path / "a.npy", x)
    (np.arange(20).astype("<i2")).tofile(tmp_path / "b.iq")
    got = files.read_iq_files(spark, f"file://{tmp_path}/*", block=4).collect()
    assert sum(len(r.re) for r in got) == 20 and len(got) == 6
    df = tables.with_units(spark.createDataFrame([(1.0,)], "p double"), {"p": "dBm"})
    assert df.schema["p"].metadata["units"] == "dBm"


def test_overload_rule(spark):
    df = spark.createDataFrame([(0, 1e9, 0.0, 5), (0, 1e9, -30.0, 5)], "port int, center_frequency double, gain double, headroom int")
    assert calibration.overload(df).count() == 1


def side_lobes(w):
    """Highest side lobe in decibels of a periodic window's symmetric form."""
    full = np.append(w, w[0])
    level = 20 * np.log10(np.abs(np.fft.fft(full, 8192)) / abs(full.sum()) + 1e-30)[:4096]
    return level[int(np.argmax(np.diff(level) > 0)) :].max()


@pytest.mark.parametrize("n", [16, 17, 64, 65])
def test_windows_with_a_shape_parameter(n):
    assert abs(side_lobes(windows.chebyshev(n, 60)) + 60) < 1e-3
    assert abs(side_lobes(windows.taylor(n, 4, 35)) + 35) < 0.5
    m = n + 1
    d = np.subtract.outer(np.arange(m), np.arange(m))
    kernel = np.where(d == 0, 5 / m, np.sin(5 * np.pi * d / m) / np.where(d == 0, 1, np.pi * d))
    top = np.abs(np.linalg.eigh(kernel)[1][:, -1])
    assert np.abs(windows.slepian(n, 2.5) - (top / top.max())[:n]).max() < 1e-9


@pytest.mark.parametrize("name", ["kaiser", "chebwin", "dpss"])
def test_window_parameter_gives_the_bandwidth(name):
    low = 30.0 if name == "chebwin" else 0.5
    found = windows.parameter_for_bandwidth(name, 1.6, 256, low, 100.0 if name == "chebwin" else 12.0)
    assert abs(windows.noise_bandwidth((name, found), 256) - 1.6) < 1e-5


@pytest.mark.parametrize(("edge", "stop", "ripple", "loss"), [(0.1, 0.12, 0.1, 60), (0.2, 0.25, 0.5, 80), (0.05, 0.2, 1, 40)])
def test_elliptic_filter_keeps_its_bounds_and_equals_the_recursion(spark, edge, stop, ripple, loss):
    z, p, gain = filters.elliptic(edge, stop, ripple, loss)
    f = np.linspace(0, 0.5, 4001)
    w = np.exp(-2j * np.pi * f)
    h = 20 * np.log10(np.abs(gain * np.prod(1 - np.multiply.outer(w, z), axis=1) / np.prod(1 - np.multiply.outer(w, p), axis=1)) + 1e-30)
    assert np.abs(p).max() < 1 and h[f <= edge].min() > -ripple - 1e-6 and h[f <= edge].max() < 1e-6 and h[f >= stop].max() < -loss + 1e-3
    x = np.random.default_rng(4).normal(size=200)
    b, a, want = np.real(np.poly(z)) * gain, np.real(np.poly(p)), np.zeros(200)
    for n in range(200):
        want[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * want[n - k] for k in range(1, len(a)) if n >= k)
    got = filters.iir_lowpass(block(spark, x), 2 * edge, 1.0, ripple, loss, stop - edge).first()
    assert np.abs(np.array(got.re) - want).max() < 1e-8


def test_elliptic_filter_refuses_bad_edges():
    with pytest.raises(ValueError, match="passband"):
        filters.elliptic(0.3, 0.2, 1, 40)


def test_ofdma_numerology():
    phy = ofdm.OfdmaNumerology(10e6, size=1024)
    assert (phy.standard_rate, phy.nfft, phy.prefix, phy.symbols_per_frame, phy.frame_size) == (11.2e6, 1024, 128, 48, 56_000)
    assert ofdm.OfdmaNumerology(7e6).standard_rate == 8e6 and ofdm.OfdmaNumerology(7e6, factor=28 / 25).standard_rate == 7.84e6
    half = ofdm.OfdmaNumerology(10e6, size=1024, recorded_rate=5.6e6)
    at = half.prefix_indexes(frames=(0, 2), symbols=(0, 3))
    assert at.shape == (2, 2, 64) and at[1, 1, 5] == 3 * (512 + 64) + 2 * 28_000 + 5


@pytest.mark.parametrize("bad", [{"bandwidth": 1e6}, {"bandwidth": 10.01e6}, {"bandwidth": 10e6, "size": 1000}, {"bandwidth": 10e6, "prefix_ratio": 0.3}, {"bandwidth": 10e6, "frame_duration": 1.0}, {"bandwidth": 10e6, "recorded_rate": 10e6}])
def test_ofdma_numerology_refuses(bad):
    with pytest.raises(ValueError, match="must be"):
        ofdm.OfdmaNumerology(**bad)


def mat_element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def mat_file(name, z, packed):
    parts = mat_element(6, struct.pack("<II", 6 | 0x800, 0)) + mat_element(5, struct.pack("<ii", 1, len(z))) + (mat_element(1, name.encode()) if len(name) > 4 else struct.pack("<HH4s", 1, len(name), name.encode()))
    parts += mat_element(9, z.real.tobytes()) + mat_element(9, z.imag.tobytes())
    body = mat_element(14, parts)
    if packed:
        body = zlib.compress(body)
        body = struct.pack("<II", 15, len(body)) + body
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + body


def tdms_text(s):
    return struct.pack("<I", len(s)) + s.encode()


def tdms_segment(channels, interleaved=False, again=False):
    meta = struct.pack("<I", len(channels))
    for path, x in channels:
        code = {"i2": 2, "f8": 10, "i4": 3}[x.dtype.str[1:]]
        meta += tdms_text(path) + (struct.pack("<I", 0) if again else struct.pack("<IIIQ", 20, code, 1, len(x)))
        meta += struct.pack("<I", 2) + tdms_text("unit") + struct.pack("<I", 0x20) + tdms_text("V") + tdms_text("gain") + struct.pack("<Id", 10, 1.5)
    raw = np.stack([x for _, x in channels], axis=1).tobytes() if interleaved else b"".join(x.tobytes() for _, x in channels)
    return b"TDSm" + struct.pack("<IIQQ", 0xA | (0x4 if not again else 0) | (0x20 if interleaved else 0), 4713, len(meta) + len(raw), len(meta)) + meta + raw


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("name", ["iq", "waveform"])
def test_mat_files(spark, tmp_path, packed, name):
    z = np.arange(5) + 1j * np.arange(5, 10)
    (tmp_path / "a.mat").write_bytes(mat_file(name, z, packed))
    got = files.read_iq_files(spark, f"file://{tmp_path}", block=3, key=name).orderBy("n0").collect()
    assert [r.n0 for r in got] == [0, 3] and np.allclose(np.concatenate([np.array(r.re) + 1j * np.array(r.im) for r in got]), z)
    with pytest.raises(KeyError, match=name):
        files.mat_variable(mat_file(name, z, packed), "other")


@pytest.mark.parametrize("interleaved", [False, True])
def test_tdms_files(spark, tmp_path, interleaved):
    i, q = np.arange(6, dtype="<i2"), np.arange(10, 16, dtype="<i2")
    head = tdms_segment([("/'head'/'total_samples'", np.array([11], "<i4")), ("/'head'/'reference_level_dBm'", np.array([20.0]))])
    data = [("/'iq'/'I'", i), ("/'iq'/'Q'", q)]
    raw = head + tdms_segment(data, interleaved) + tdms_segment(data, interleaved, again=True)
    (tmp_path / "a.tdms").write_bytes(raw)
    got = files.read_iq_files(spark, f"file://{tmp_path}").first()
    want = np.concatenate([i + 1j * q] * 2)[:11] * (10 / 32767)
    assert np.allclose(np.array(got.re) + 1j * np.array(got.im), want)


def test_shaped_spectrum_is_that_of_circular_filtering(spark):
    x = np.random.default_rng(8).normal(size=64) + 1j * np.random.default_rng(9).normal(size=64)
    taps = filters.fir_lowpass(16.0, 64.0, 9, 8.0)
    round_trip = np.fft.ifft(np.fft.fft(x) * np.fft.fft(taps, 64))
    want = {r.k: r.power for r in spectrum.stft_power(block(spark, round_trip), 64, 0, "rect").collect()}
    power = spectrum.stft_power(block(spark, x), 64, 0, "rect")
    got = filters.shaped(power, taps, 64)
    assert got.columns == power.columns and all(abs(r.power - want[r.k]) < 1e-12 for r in got.collect())
    with pytest.raises(ValueError, match="longer"):
        filters.shaped(power, np.ones(65), 64)


def capture_rows(spark, x, cuts):
    """One capture, cut into blocks at ``cuts``."""
    at = [0, *cuts, len(x)]
    return spark.createDataFrame([(0, 0, s, x[s:e].real.tolist(), x[s:e].imag.tolist()) for s, e in zip(at, at[1:], strict=False)], "capture_id long, port int, n0 long, re array<double>, im array<double>")


def whole_capture(df):
    rows = sorted(df.collect(), key=lambda r: r.n0)
    assert [r.n0 for r in rows] == np.cumsum([0, *(len(r.re) for r in rows[:-1])]).tolist()
    return np.concatenate([np.array(r.re) + 1j * np.array(r.im) for r in rows])


def test_filters_do_not_depend_on_the_cuts(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=700) + 1j * rng.normal(size=700)
    one, many = capture_rows(spark, x, []), capture_rows(spark, x, [3, 90, 91, 350, 512]).repartition(4)
    fir = filters.fir_lowpass(0.4, 1.0, 31, 0.1)
    want = np.convolve(x, fir)[15 : 15 + 700]
    assert np.allclose(whole_capture(filters.filtered(one, 0.4, 1.0, 31, 0.1)), want)
    assert np.allclose(whole_capture(filters.filtered(many, 0.4, 1.0, 31, 0.1, size=64)), want)
    iir = [whole_capture(filters.iir_lowpass(b, 0.2, 1.0, 0.1, 40.0, 0.1, size=s)) for b, s in ((one, 1 << 10), (many, 50))]
    assert np.allclose(*iir) and np.abs(iir[0]).max() > 0.1
    for kind, n in (("hamming", 32), ("blackman", 30), ("blackmanharris", 40), ("rect", 32)):
        # With the whole band the frames add up to the samples.
        assert np.allclose(whole_capture(filters.oa_filter(many, 1.0, n, (-1, 1), kind, margin=0.0, size=100)), x)
        narrow = [whole_capture(filters.oa_filter(b, 1.0, n, (-0.2, 0.1), kind, margin=0.0, size=s)) for b, s in ((one, 1 << 10), (many, 64))]
        assert np.allclose(*narrow) and np.linalg.norm(narrow[0]) < 0.8 * np.linalg.norm(x)
    tone = np.exp(2j * np.pi * np.arange(640) / 32)
    half = whole_capture(filters.oa_resample(capture_rows(spark, tone, [77]), 1.0, 32, 16, size=96))
    assert len(half) == 320 and np.allclose(half[16:-16], np.exp(2j * np.pi * np.arange(320) / 16)[16:-16], atol=1e-2)
    with pytest.raises(ValueError):
        filters.oa_filter(one, 1.0, 31, (-1, 1))
    done = whole_capture(filters.corrected(one.withColumn("flip", F.lit(True)), 1.0, 2.0, "flip", 0.4, 31, 0.1))
    assert np.allclose(done, np.convolve(2 * np.conj(x), fir)[15:715])
    assert np.allclose(filters.fractional_delay(tone, 1.0), np.roll(tone, 1))


def test_kernels_on_blocks_equal_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=200) + 1j * rng.normal(size=200)
    many = capture_rows(spark, x, [3, 64, 101])
    rows = frames.samples(many)
    kinds = ("min", "max", "mean", "rms", "peak")
    both = [{(r.bin, r.power_detector): round(r.value, 9) for r in df.collect()} for df in (stats.block_power(many, 7, kinds), stats.bin_power(rows, 7, kinds))]
    assert both[0] == both[1]
    with pytest.raises(ValueError):
        stats.block_power(many, 7, (0.5,))
    lags = [{r.j: round(r.r, 9) for r in df.collect()} for df in (stats.lagged_product_blocks(many, 16, [0, 5, 90, 150], 30, 32), stats.lagged_product(rows, 16, [0, 5, 90, 150], 30))]
    assert lags[0] == lags[1] and len(lags[0]) == 30


def test_correlation_periods_do_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=330) + 1j * rng.normal(size=330)
    waves = {0: rng.normal(size=20) + 1j * rng.normal(size=20), 7: rng.normal(size=20) + 0j}
    found = [sorted(cellular.correlate_waves(capture_rows(spark, x, c), waves, (0, 30), 25, 100).collect()) for c in ([], [50, 133, 260])]
    assert found[0] == found[1] and {r.block for r in found[0]} == {0, 1, 2}
    for r in found[0][::37]:
        part = x[r.block * 100 : r.block * 100 + 100]
        at = r.beam * 30 + r.lag
        seg = part[at : at + 20]
        assert abs(complex(r.re, r.im) - np.vdot(waves[r.cell_id][: len(seg)], seg)) < 1e-9
    mean = {(r.block, r.lag): r.p for r in cellular.correlate_waves(capture_rows(spark, x, [99]), waves, (0, 30), 25, 100, mean=True).collect()}
    for key in mean:
        assert abs(mean[key] - np.mean([r.re**2 + r.im**2 for r in found[0] if (r.block, r.lag) == key])) < 1e-9


def test_ssb_symbols():
    assert ofdm.ssb_symbols("a", 2e9) == (2, 8, 16, 22) and ofdm.ssb_symbols("B") == (4, 8, 16, 20, 32, 36, 44, 48)
    assert len(ofdm.ssb_symbols("c", shared=True)) == 20 and ofdm.ssb_case(30e3, True) == "c" and ofdm.ssb_case(120e3) == "d"
    for bad in (lambda: ofdm.ssb_symbols("b", shared=True), lambda: ofdm.ssb_case(30e3), lambda: ofdm.ssb_case(60e3)):
        with pytest.raises(ValueError):
            bad()


def test_sweep_helpers(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"defaults": {"gain": 1.0}, "captures": [{"port": 0}, {"port": 1, "gain": 2.0}]}')
    spec = sweep.read_spec(str(tmp_path / "s.json"))
    assert {(r.port, r.gain) for r in sweep.captures_of(spark, spec).collect()} == {(0, 1.0), (1, 2.0)}
    assert sweep.bin_points(0.0, 10.0, 3.0) == [2.0, 5.0, 8.0]
    with pytest.raises(ValueError):
        stats.contiguous_segments(spark.range(3), "id", ())


def test_histogram_fractions_of_one_port(spark):
    rows = [(0, 0, 1.0), (0, 0, 1.0), (0, 1, 1.0), (0, 1, 5.0), (0, 1, 5.0), (0, 1, 5.0)]
    df = spark.createDataFrame(rows, "capture_id long, port int, power double")
    got = {(r.port, r.n): r.fraction for r in spectrum.spectrogram_histogram(df, 0, 10, 1, normalise_port=0).collect()}
    assert got == {(0, 2): 1.0, (1, 1): 0.5, (1, 3): 1.5}


def test_statistics_in_the_kernel_equal_those_of_pixels(spark):
    rng = np.random.default_rng(3)
    rows = [(c, p, 0, *(rng.normal(size=n).tolist() for _ in range(2))) for c, n in ((0, 64), (1, 64), (2, 100), (3, 10), (4, 64), (5, 0)) for p in range(2)]
    df = spark.createDataFrame(rows, "capture_id long, port int, n0 long, re array<double>, im array<double>")
    kinds = ("mean", 0.25, "max", "min", "median")
    for nfft, overlap in ((16, 8), (15, 5), (16, 0)):
        want = {(r.capture_id, r.port, r.k, r.time_statistic): r.value for r in spectrum.power_spectral_density(spectrum.stft_power(df, nfft, overlap), kinds).collect()}
        got = {(r.capture_id, r.port, r.k, r.time_statistic): r.value for r in spectrum.block_psd(df, nfft, overlap, stats=kinds).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Exchange" not in spectrum.block_psd(df, 16)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="several blocks"):
        spectrum.block_psd(df.withColumn("n0", F.lit(1).cast("long")), 16).collect()


def test_transforms_of_many_rows_equal_those_of_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(c, 0, 8 * c, *(rng.normal(size=n).tolist() for _ in range(2))) for c, n in enumerate((32, 32, 40, 7, 32, 32, 32))]
    df = spark.createDataFrame(rows, "capture_id long, port int, n0 long, re array<double>, im array<double>").coalesce(1)
    got = {(r.capture_id, r.frame, r.k): r.power for r in spectrum.stft_power(df, 8, 4, "hamming").collect()}
    w = windows.window("hamming", 8, center=True) / 8
    want = {}
    for c, _, n0, re, im in rows:
        x = np.array(re) + 1j * np.array(im)
        for f in range((len(x) - 8) // 4 + 1):
            want |= {(c, n0 // 4 + f, k): v for k, v in enumerate(np.abs(np.fft.fft(x[4 * f : 4 * f + 8] * w)) ** 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
