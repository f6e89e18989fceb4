"""The registry of measurements: one plan for those that share a spectrogram, coordinates in physical units, specs and bindings."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from iqlake.operators import cellular, spectrum, stats
from iqlake.plans import measurements as M

BLOCK = "capture_id long, port int, n0 long, re array<double>, im array<double>"
SPG = {"frequency_resolution": 2.0, "fractional_overlap": 0.5}


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(1)
    rows = [(c, p, 0, *(rng.normal(size=96).tolist() for _ in range(2))) for c in range(3) for p in range(2)]
    return spark.createDataFrame(rows, BLOCK)


def values(df, *keys):
    return {tuple(r[k] for k in keys): r.value for r in df.collect()}


def near(a, b, tol=1e-9):
    return a.keys() == b.keys() and all(x == b[k] or abs(x - b[k]) < tol for k, x in a.items())


def test_measurements_of_one_spectrogram_share_it(spark, raw):
    analysis = {"spectrogram": SPG, "power_spectral_density": SPG | {"time_statistic": ["mean", 0.9]}, "spectrogram_histogram": SPG | {"power_low": -30, "power_high": 0, "power_resolution": 2}}
    out = M.evaluate(raw, {"sample_rate": 32.0}, analysis)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan") == 1
    spec = spectrum.spectrogram(raw, 32.0, 2.0, 0.5)
    db = spectrum.to_db(spec)
    of = lambda m: out.where(F.col("measurement") == m)
    want = {(r.capture_id, r.port, r.frame * 0.25, (r.k - 8) * 2.0): r.power for r in db.collect()}
    assert near(values(of("spectrogram"), "capture_id", "port", "spectrogram_time", "baseband_frequency"), want)
    want = {(r.capture_id, r.port, r.time_statistic, (r.k - 8) * 2.0): r.value for r in spectrum.power_spectral_density(spec, ("mean", 0.9)).collect()}
    assert near(values(of("power_spectral_density"), "capture_id", "port", "time_statistic", "baseband_frequency"), want)
    centers = stats.power_centers(-30, 0, 2)
    want = {(r.capture_id, r.port, centers[r.bin]): r.fraction for r in spectrum.spectrogram_histogram(db, -30, 0, 2).collect()}
    assert near(values(of("spectrogram_histogram"), "capture_id", "port", "spectrogram_power_bin"), want)


def test_other_parameters_are_another_spectrogram(raw):
    analysis = {"spectrogram": SPG, "power_spectral_density": SPG | {"frequency_resolution": 4.0}}
    plan = M.evaluate(raw, {"sample_rate": 32.0}, analysis)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_units_stand_in_metadata_and_rows(raw):
    out = M.evaluate(raw, {"sample_rate": 32.0}, {"spectrogram_histogram": SPG | {"power_low": -30, "power_high": 0, "power_resolution": 2}, "power_spectral_density": SPG})
    assert out.schema["spectrogram_power_bin"].metadata == {"units": "dBm/0.002 kHz", "standard_name": "Spectrogram bin power"}
    assert out.schema["baseband_frequency"].metadata["units"] == "Hz" and "units" not in out.schema["time_statistic"].metadata
    assert {(r.measurement, r.units) for r in out.select("measurement", "units").distinct().collect()} == {("spectrogram_histogram", ""), ("power_spectral_density", "dBm/0.002 kHz")}


def test_frequencies_of_summed_and_trimmed_bins(raw):
    spec = SPG | {"integration_bandwidth": 6.0, "time_aperture": 0.5}
    out = M.evaluate(raw, {"sample_rate": 32.0, "analysis_bandwidth": 24.0}, {"spectrogram": spec, "power_spectral_density": spec | {"time_statistic": ["max"]}})
    # 12 bins from -12 Hz on are left; three of three fit around the middle one.
    found = sorted({r.baseband_frequency for r in out.where("measurement = 'spectrogram'").collect()})
    assert np.allclose(np.diff(found), 6.0) and 0.0 in found
    assert sorted({r.spectrogram_time for r in out.where("spectrogram_time is not null").collect()})[:2] == [0.0, 0.5]


def test_measurements_of_samples(raw):
    capture = {"sample_rate": 32.0}
    analysis = {
        "channel_power_time_series": {"detector_period": 0.25},
        "channel_power_histogram": {"detector_period": 0.25, "power_low": -5, "power_high": 5, "power_resolution": 1},
        "cyclic_channel_power": {"detector_period": 0.25, "cyclic_period": 0.5},
        "iq_waveform": {"start_time_sec": 0.25, "stop_time_sec": 0.5},
        "spectrogram_ratio_histogram": SPG | {"power_low": -10, "power_high": 10, "power_resolution": 2},
    }
    out = M.evaluate(raw, capture, analysis)
    of = lambda m: out.where(F.col("measurement") == m)
    want = {(r.capture_id, r.port, r.power_detector, r.time_elapsed): r.value for r in stats.channel_power_time_series(raw, 8, 0.25).collect()}
    assert near(values(of("channel_power_time_series"), "capture_id", "port", "power_detector", "time_elapsed"), want)
    shares = of("channel_power_histogram").groupBy("capture_id", "port", "power_detector").agg(F.sum("value").alias("s")).collect()
    assert len(shares) == 12 and all(abs(r.s - 1) < 1e-9 for r in shares)
    want = {(r.capture_id, r.port, r.power_detector, r.cyclic_statistic, r.cyclic_lag * 0.25): r.value for r in stats.cyclic_channel_power(raw, 8, 2).collect()}
    assert near(values(of("cyclic_channel_power"), "capture_id", "port", "power_detector", "cyclic_statistic", "cyclic_lag"), want)
    assert {(r.iq_index, r.iq_time) for r in of("iq_waveform").collect()} == {(n, n / 32) for n in range(8, 16)} and of("iq_waveform").count() == 6 * 8 * 2
    assert {r.port for r in of("spectrogram_ratio_histogram").collect()} == {0, 1}


def test_cellular_measurements_have_seconds_and_labels(spark):
    rate, spacing, period = 1.92e6, 15e3, 3840
    wave = cellular.templates("pss", rate, spacing)[2]
    x = np.zeros(2 * period, complex)
    for k in range(2):
        x[k * period + 100 : k * period + 100 + len(wave)] = wave
    df = spark.createDataFrame([(0, 0, 0, x.real[:5000].tolist(), x.imag[:5000].tolist()), (0, 0, 5000, x.real[5000:].tolist(), x.imag[5000:].tolist())], BLOCK)
    sync = {"sample_rate": rate, "subcarrier_spacing": spacing, "symbols": [0], "discovery_periodicity": period / rate, "max_lag_symbols": 2}
    spg = {"frequency_resolution": spacing, "window": "hamming"}
    analysis = {
        "cellular_5g_pss_correlation": sync,
        "cellular_5g_pss_sync": sync,
        "cellular_5g_sss_sync": sync,
        "cellular_cyclic_autocorrelation": {"subcarrier_spacings": [15e3], "generation": "4G"},
        "cellular_5g_ssb_spectrogram": spg | {"discovery_periodicity": 30 / spacing, "band_start": 4, "band_count": 120},
        "cellular_resource_power_histogram": spg | {"power_low": -100, "power_high": 0, "power_resolution": 10, "frame_slots": "dduuuuuuuu"},
    }
    out = M.evaluate(df, {"sample_rate": rate}, analysis)
    of = lambda m: out.where(F.col("measurement") == m)
    best = of("cellular_5g_pss_correlation").groupBy("cellular_cell_id", "cellular_ssb_start_time", "cellular_ssb_beam_index", "cellular_ssb_lag").agg(F.sum(F.col("value") ** 2).alias("p")).orderBy(F.desc("p")).limit(2).collect()
    assert {(r.cellular_cell_id, r.cellular_ssb_beam_index) for r in best} == {(2, 0)} and sorted(r.cellular_ssb_start_time for r in best) == [0.0, period / rate]
    assert all(abs(r.cellular_ssb_lag - 100 / rate) < 1e-12 for r in best)
    assert abs(of("cellular_5g_pss_sync").first().value - 100 / rate) < 1e-12 and of("cellular_5g_sss_sync").count() == 1
    acf = of("cellular_cyclic_autocorrelation").collect()
    assert {(r.link_direction, r.subcarrier_spacing) for r in acf} == {("downlink", 15e3), ("uplink", 15e3)} and all(r.value is None for r in acf if r.link_direction == "uplink")
    assert abs(max(r.cyclic_sample_lag for r in acf) - 136 / rate) < 1e-12
    ssb = of("cellular_5g_ssb_spectrogram").collect()
    assert {r.cellular_ssb_symbol_index for r in ssb} == set(range(28)) and min(r.baseband_frequency for r in ssb) == (4 - 64) * spacing
    assert {r.link_direction for r in of("cellular_resource_power_histogram").collect()} == {"downlink", "uplink"}


def test_specs_are_checked():
    ok = M.validated({"power_spectral_density": SPG | {"time_statistic": ["max", 0.5]}, "spectrogram": None})
    assert list(ok) == ["power_spectral_density"] and ok["power_spectral_density"]["window"] == "hamming"
    assert M.validated({"iq_waveform": {"stop_time_sec": ".inf"}})["iq_waveform"]["stop_time_sec"] == math.inf
    for bad in ({"nothing": {}}, {"spectrogram": {}}, {"spectrogram": SPG | {"speed": 1}}, {"spectrogram": {"frequency_resolution": "fast"}}, {"spectrogram": {"frequency_resolution": None}}, {"spectrogram": SPG | {"trim_stopband": 1}}, {"power_spectral_density": SPG | {"time_statistic": "max"}}, {"cellular_5g_pss_sync": {"sample_rate": 1, "subcarrier_spacing": 1, "max_lag_symbols": 1.5}}):
        with pytest.raises(ValueError):
            M.validated(bad)
    with pytest.raises(ValueError):
        M.evaluate(None, {"sample_rate": 1.0}, {})


def test_spec_type_and_schema_list_every_parameter(spark):
    kind, schema = M.spec_type(), M.json_schema()
    assert set(kind.fieldNames()) == set(M.MEASUREMENTS) == set(schema["properties"])
    one = schema["properties"]["spectrogram"]
    assert one["required"] == ["frequency_resolution"] and one["properties"]["time_aperture"]["type"] == ["number", "null"] and one["properties"]["fractional_overlap"]["default"] == 0.0
    json.dumps(schema, allow_nan=False)
    rows = spark.createDataFrame([({"frequency_resolution": 2.0, "fractional_overlap": 0.5},)], M.spec_type(("spectrogram",)).simpleString().replace("struct<spectrogram:", "spectrogram ")[:-1])
    assert rows.first().spectrogram.frequency_resolution == 2.0


def test_registering_twice_or_unknown_raises():
    for again in (lambda: M.coordinate("double", name="iq_time")(lambda c, s: None), lambda: M.measurement({}, name="spectrogram")(lambda b, c, s: b), lambda: M.measurement({}, ("no_such",), name="x")(lambda b, c, s: b), lambda: M.measurement({}, source="y", name="x")(lambda b, c, s: b)):
        with pytest.raises(ValueError):
            again()


def test_sources_are_bound_by_type(spark, raw):
    raw.createOrReplaceTempView("raw_blocks")
    M.register_source("view_for_test", {"name": M.Param(M.TEXT), "capture": M.Param(LongType(), -1)})(lambda session, name, capture: session.table(name).where((F.col("capture_id") == capture) | (F.lit(capture) < 0)))
    out = M.run_sweep(spark, {"source": {"type": "view_for_test", "name": "raw_blocks", "capture": 1}, "capture": {"sample_rate": 32.0}, "analysis": {"channel_power_time_series": {"detector_period": 0.25}}})
    assert {r.capture_id for r in out.collect()} == {1}
    for bad in ({"type": "none"}, {"type": "view_for_test"}, {"type": "view_for_test", "name": "x", "y": 1}):
        with pytest.raises(ValueError):
            M.source_of(spark, bad)
    with pytest.raises(ValueError):
        M.register_source("view_for_test", {})(lambda s: s)
