"""What is stored and read back: precision, paths, slices, labels, specs with parts; filters that ring on; times of blocks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqlake.functions import columns as C
from iqlake.functions import ofdm
from iqlake.operators import filters, frames
from iqlake.plans import measurements, results, sweep
from iqlake.sources import tables

BLOCK = "capture_id long, port int, n0 long, re array<double>, im array<double>"


def test_half_precision_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = [*(rng.normal(size=500) * 10.0 ** rng.integers(-9, 6, 500)).tolist(), *(s * 2.0**e * f for e in range(-26, 18) for f in (1, 1 + 2**-11, 1 + 3 * 2**-11, 1 - 2**-12) for s in (1, -1)), 0.0, 65504.0, 65519.9, 65520.0, math.inf, -math.inf]
    got = [r.h for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(C.to_half(F.col("x")).alias("h")).collect()]
    with np.errstate(over="ignore"):
        want = np.array(x).astype(np.float16).astype(float)
    assert np.array_equal(np.abs(got), np.abs(want)) and all(a == b or a == -b == 0 for a, b in zip(got, want.tolist(), strict=True))
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(C.to_half(F.col("x")).alias("h")).collect()
    assert math.isnan(odd[0].h) and odd[1].h is None


def test_spectrogram_in_half_precision(spark):
    df = spark.createDataFrame([(0, 0, 0, np.arange(64.0).tolist(), [0.0] * 64)], BLOCK)
    spg = {"frequency_resolution": 2.0}
    full, half = ({(r.spectrogram_time, r.baseband_frequency): r.value for r in measurements.evaluate(df, {"sample_rate": 32.0}, {"spectrogram": spg | {"half_precision": h}}).collect()} for h in (False, True))
    assert all(half[k] == float(np.float16(full[k])) for k in full) and half != full


def test_paths_from_templates(spark):
    df = spark.createDataFrame([("a", 7, 1_700_000_000_000_000_000), (None, 1, 0)], "name string, n int, ns long")
    path = C.path_of("{name}/{n:03d}-{start_time}", {"name": F.col("name"), "n": F.col("n"), "start_time": C.timestamp_suffix(F.col("ns"))})
    assert [r[0] for r in df.select(path).collect()] == ["a/007-20231114-22h13m20", None]
    assert df.select(C.path_of("x{y}", {}, exact=False)).first()[0] == "x{y}" and df.select(C.path_of("", {})).first()[0] == ""
    with pytest.raises(ValueError):
        C.path_of("{unknown}", {"name": F.col("name")})


def test_nearest_slices(spark):
    rows = [("a", 1.0, 5.0), ("a", 3.0, 6.0), ("a", 3.0, 7.0), ("b", 10.0, 8.0), ("b", None, 9.0), ("b", float("nan"), 9.5)]
    df = spark.createDataFrame(rows, "g string, x double, v double")
    assert sorted(r.v for r in results.nearest_slice(df, {"x": 2.0}, ["g"]).collect()) == [5.0, 8.0]  # a tie goes to the smaller one
    assert sorted(r.v for r in results.nearest_slice(df, {"x": 2.5}, ["g"]).collect()) == [6.0, 7.0, 8.0]
    assert results.nearest_slice(df.limit(0), {"x": 2.5}, ["g"]).count() == 0


def test_incomplete_coordinates_go(spark):
    rows = [(0, 1.0, 5.0), (0, 1.0, float("nan")), (0, 2.0, 6.0), (1, 1.0, 7.0), (1, 2.0, None)]
    df = spark.createDataFrame(rows, "capture int, f double, value double")
    assert sorted((r.capture, r.f) for r in results.drop_incomplete(df, "f", ["capture"]).collect()) == [(0, 2.0), (1, 1.0)]


def test_labels_come_from_metadata(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, noise_level double").withMetadata("x", {"units": "Hz", "standard_name": "Baseband frequency"})
    assert results.axis_label(df, "x") == "Baseband frequency (Hz)" and results.axis_label(df, "noise_level") == "Noise level"


def test_specs_include_others(tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x))
    (tmp_path / "parts").mkdir()
    put("parts/base.json", {"gain": 1, "port": 0, "deep": {"$include": "leaf.json"}})
    put("parts/leaf.json", [1, 2])
    put("other.json", {"port": 5})
    put("main.json", {"captures": [{"$include": "parts/base.json", "gain": 9}, {"$include": ["parts/base.json", "other.json"]}], "list": {"$include": "parts/leaf.json"}})
    got = sweep.read_spec(str(tmp_path / "main.json"))
    assert got == {"captures": [{"gain": 9, "port": 0, "deep": [1, 2]}, {"gain": 1, "port": 5, "deep": [1, 2]}], "list": [1, 2]}
    put("a.json", {"x": {"$include": "b.json"}})
    put("b.json", {"x": {"$include": "a.json"}})
    put("c.json", {"$include": "parts/leaf.json", "x": 1})
    for bad in ("a.json", "c.json"):
        with pytest.raises(ValueError):
            sweep.read_spec(str(tmp_path / bad))


@pytest.mark.parametrize(("up", "down", "size"), [(1, 1, 7), (3, 2, 10), (2, 3, 9), (5, 1, 4)])
def test_filters_ring_on_behind_the_end(spark, up, down, size):
    rng = np.random.default_rng(up * 10 + down)
    h = rng.normal(size=11)
    rows, want = [], {}
    for c, n in ((0, 40), (1, 1), (2, 23)):
        x = rng.normal(size=n) + 1j * rng.normal(size=n)
        cuts = [0, *([n // 3, n // 2] if n > 5 else []), n]
        rows += [(c, 0, a, x.real[a:b].tolist(), x.imag[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
        stuffed = np.zeros((n - 1) * up + 1, complex)
        stuffed[::up] = x
        want[c] = np.convolve(stuffed, h)[::down]
    out = {}
    for r in filters.upfirdn(spark.createDataFrame(rows, BLOCK), h, up, down, size * down, full=True).collect():
        out.setdefault(r.capture_id, {}).update({r.n0 + i: complex(a, b) for i, (a, b) in enumerate(zip(r.re, r.im, strict=True))})
    for c, y in want.items():
        assert sorted(out[c]) == list(range(len(y))) and max(abs(out[c][i] - y[i]) for i in range(len(y))) < 1e-9


def test_blocks_have_times(spark):
    start = 1_700_000_000_123_456_789
    df = spark.createDataFrame([(0, 0, n0, [0.0], [0.0]) for n0 in (0, 1, 15_360_000 * 86_400 * 30 + 1)], BLOCK)
    got = {r.n0: r.time_ns for r in frames.with_time(df, F.lit(start), 15.36e6).collect()}
    assert got == {0: start, 1: start + 65, 15_360_000 * 86_400 * 30 + 1: start + 86_400 * 30 * 10**9 + 65}


def test_turned_blocks_fit_together(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50) + 1j * rng.normal(size=50)
    df = spark.createDataFrame([(0, 0, a, x.real[a:b].tolist(), x.imag[a:b].tolist()) for a, b in ((0, 7), (7, 31), (31, 50))], BLOCK)
    out = {r.n0 + i: complex(a, b) for r in filters.turned(df, F.lit(3.3), F.lit(16.0)).collect() for i, (a, b) in enumerate(zip(r.re, r.im, strict=True))}
    assert np.allclose([out[n] for n in range(50)], x * np.exp(2j * np.pi * 3.3 / 16 * np.arange(50)))


def test_delays_of_whole_samples_turn_a_block_around(spark):
    x = np.arange(8.0)
    df = spark.createDataFrame([(c, 0, 0, x.tolist(), (-x).tolist()) for c in range(3)], BLOCK)
    got = {r.capture_id: np.array(r.re) + 1j * np.array(r.im) for r in filters.delayed(df, F.col("capture_id") * 2).collect()}
    assert all(np.allclose(got[c], np.roll(x - 1j * x, 2 * c)) for c in range(3))


def test_numerologies_of_captures(spark):
    df = spark.createDataFrame([(1, 1.92e6, 15e3, "4G"), (2, 7.68e6, 30e3, "5G"), (3, 1e6, 15e3, "4G"), (4, 1.92e6, 15e3, "4G")], "id int, sample_rate double, subcarrier_spacing double, generation string")
    got = {r.id: r for r in ofdm.numerologies(df).collect()}
    assert got[1].prefixes == got[4].prefixes == [10, 9, 9, 9, 9, 9, 9] * 2 and got[1].slot_size == 1920 and got[2].nfft == 256 and got[2].slots_per_frame == 20
    assert got[3].nfft is None and got[3].starts is None and len(got) == 4


def test_batches_bound_files(spark, tmp_path):
    tables.write_results(spark.range(100).coalesce(1), f"file://{tmp_path}/r", batch_rows=30, chunk_bytes=1 << 20)
    assert len([f for f in (tmp_path / "r").iterdir() if f.suffix == ".parquet"]) == 4 and spark.read.parquet(f"file://{tmp_path}/r").count() == 100
