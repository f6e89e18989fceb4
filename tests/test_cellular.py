"""All secondary sequences at once, prefixes by direction, the synchronisation band and dense grids against direct forms."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqlake.functions import ofdm
from iqlake.operators import cellular, stats

BLOCK = "capture_id long, port int, n0 long, re array<double>, im array<double>"


def pieces(x, cap=0, port=0, cuts=()):
    return [(cap, port, lo, x.real[lo:hi].tolist(), x.imag[lo:hi].tolist()) for lo, hi in itertools.pairwise([0, *cuts, len(x)])]


def noise(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=n) + 1j * rng.normal(size=n)


def test_parts_make_every_sequence():
    a, b = ofdm.sss_parts()
    for n1, n2 in ((0, 0), (111, 1), (112, 2), (335, 2)):
        assert (np.roll(a, -(15 * (n1 // 112) + 5 * n2)) * np.roll(b, -(n1 % 112)) == ofdm.sss(n1, n2)).all()


@pytest.mark.parametrize(("rate", "spacing"), [(1.92e6, 15e3), (5.76e6, 30e3)])
def test_all_sequences_equal_direct_correlation(spark, rate, spacing):
    waves = cellular.templates("sss", rate, spacing)
    x = np.concatenate([noise(900, 1), 0.1 * noise(500, 2)])
    x[300 : 300 + len(waves[700])] += 5 * waves[700]
    df = spark.createDataFrame(pieces(x, 0, 0, (211, 900, 1100)) + pieces(noise(200, 3), 1, 1), BLOCK)
    args = ((120, 280), 24, 700)
    want = {tuple(r)[:6]: complex(r.re, r.im) for r in cellular.correlate_waves(df, waves, *args).collect()}
    got = {tuple(r)[:6]: complex(r.re, r.im) for r in cellular.correlate_sss(df, rate, spacing, *args).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
    best = max((k for k in got if k[0] == 0), key=lambda k: abs(got[k]))
    assert best[2:] == (700, 0, 1, 20)
    mean = lambda d: {tuple(r)[:4]: r.p for r in d.collect()}
    a, b = mean(cellular.correlate_sss(df, rate, spacing, *args, mean=True)), mean(cellular.correlate_waves(df, waves, *args, mean=True))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-8 * max(b.values())


def test_all_secondary_identities_go_by_their_structure(spark):
    df = spark.createDataFrame(pieces(noise(900, 5)), BLOCK)
    args = ("sss", 1.92e6, 15e3, (0,), 900 / 1.92e6, 1)
    some = {tuple(r)[:6]: complex(r.re, r.im) for r in cellular.correlate(df, *args, ids=(0, 500, 1007)).collect()}
    every = {tuple(r)[:6]: complex(r.re, r.im) for r in cellular.correlate(df, *args).where("cell_id in (0, 500, 1007)").collect()}
    assert some.keys() == every.keys() and max(abs(some[k] - every[k]) for k in some) < 1e-8


def plain_cyclic(x, sets):
    most = max(s["lags"] for s in sets)
    get = lambda i: x[i] if i < len(x) else 0.0
    out = {}
    for s in sets:
        for j in range(most):
            r = None
            if len(s["indexes"]) and j < s["lags"]:
                r = abs(sum(get(i + j) * np.conj(get(i + j + s["nfft"])) for i in s["indexes"].tolist())) / len(s["indexes"])
            out[s["direction"], s["spacing"], j] = r
    return out


@pytest.mark.parametrize("size", [7, 100, 1 << 18])
def test_prefixes_by_direction_equal_plain_sums(spark, size):
    sets = [{"direction": "downlink", "spacing": 1.0, "nfft": 16, "lags": 20, "indexes": np.array([0, 1, 2, 3, 40, 41, 42, 43, 80])}, {"direction": "uplink", "spacing": 1.0, "nfft": 16, "lags": 20, "indexes": np.zeros(0, int)}, {"direction": "downlink", "spacing": 2.0, "nfft": 8, "lags": 10, "indexes": np.array([5, 6, 90, 91])}, {"direction": "uplink", "spacing": 2.0, "nfft": 8, "lags": 10, "indexes": np.array([200, 201])}]
    x = {0: noise(130), 1: noise(60, 1)}
    df = spark.createDataFrame(pieces(x[0], 0, 0, (13, 50, 51)) + pieces(x[1], 1, 0, (30,)), BLOCK)
    got = {(r.capture_id, r.link_direction, r.subcarrier_spacing, r.j): r.r for r in stats.cyclic_autocorrelation(df, sets, size).collect()}
    for c in x:
        for k, want in plain_cyclic(x[c], sets).items():
            r = got.pop((c, *k))
            assert r is None if want is None else abs(r - want) < 1e-9
    assert not got
    assert stats.cyclic_autocorrelation(df.limit(0), sets, size).count() == 0


def test_lags_without_a_product_are_null_on_request(spark):
    """A capture that ends before a set's prefixes, one that ends among them, and one with a gap."""
    sets = [{"direction": "downlink", "spacing": 1.0, "nfft": 16, "lags": 20, "indexes": np.array([0, 1, 2, 40, 41])}, {"direction": "uplink", "spacing": 1.0, "nfft": 16, "lags": 20, "indexes": np.array([80, 81])}]
    x = {0: noise(70), 1: noise(100, 1), 2: noise(130, 2)}
    rows = [*pieces(x[0], 0), *pieces(x[1], 1, 0, (30,)), *(p for p in pieces(x[2], 2, 0, (88, 92)) if p[2] != 88)]
    has = {c: np.ones(len(v), bool) for c, v in x.items()}
    has[2][88:92] = False
    for size in (7, 50, 1000):
        got = {(r.capture_id, r.link_direction, r.j): r.r for r in stats.cyclic_autocorrelation(spark.createDataFrame(rows, BLOCK), sets, size, measured_only=True).collect()}
        for c, s, j in itertools.product(x, sets, range(20)):
            at = [i + j for i in s["indexes"].tolist() if i + j + 16 < len(x[c]) and has[c][i + j] and has[c][i + j + 16]]
            r = got.pop((c, s["direction"], j))
            assert (r is None) == (not at)
            if at:
                assert abs(r - abs(sum(x[c][n] * np.conj(x[c][n + 16]) for n in at)) / len(s["indexes"])) < 1e-9
        assert not got


def test_directions_of_a_short_last_capture_equal_the_sql(spark, tmp_path):
    import duckdb

    from iqlake.plans import catalog, catalog_cellular

    rng = np.random.default_rng(3)
    spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(253)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[:5]: r[5] for r in con.execute(catalog.SQL["cyclic_autocorr_directions"]).fetchall()}
    got = {tuple(r)[:5]: r.r for r in catalog_cellular.cyclic_autocorr_directions(spark, str(tmp_path)).collect()}
    assert got == want and want[1, 0, "uplink", 15e3, 0] is None


def test_prefix_sets():
    sets = ofdm.prefix_sets(3.84e6, (15e3, 30e3), {15e3: "dddddduuss", 30e3: "u"}, "4G", frames=(0, 1))
    assert [(s["direction"], s["spacing"], s["nfft"], s["lags"], len(s["indexes"])) for s in sets] == [("downlink", 15e3, 256, 274, 2 * 6 * 14 * 18), ("uplink", 15e3, 256, 274, 2 * 2 * 14 * 18), ("downlink", 30e3, 128, 137, 0), ("uplink", 30e3, 128, 137, 2 * 20 * 14 * 9)]
    assert ofdm.prefix_sets(3.84e6, (15e3,), None)[1]["indexes"].size == 0
    for bad in ("dd", "x" * 10):
        with pytest.raises(ValueError):
            ofdm.prefix_sets(3.84e6, (15e3,), bad)


def test_prefixes_of_a_made_signal_are_found(spark):
    """A signal whose symbols in uplink slots alone repeat their ends."""
    phy = ofdm.Numerology(1.92e6, 15e3, "4G")
    x = noise(phy.slot_size * 2, 9)
    for start, p in zip(phy.starts + phy.slot_size, phy.prefixes, strict=True):
        x[start : start + p] = x[start + phy.nfft : start + phy.nfft + p]
    sets = ofdm.prefix_sets(1.92e6, (15e3,), "du" + "s" * 8, "4G")
    got = {(r.link_direction, r.j): r.r for r in stats.cyclic_autocorrelation(spark.createDataFrame(pieces(x, cuts=(1000, 1930)), BLOCK), sets, 512).collect()}
    assert got["uplink", 0] > 1.6 and got["downlink", 0] < 0.5 and got["uplink", 60] < 0.5


def test_a_synchronisation_band_comes_to_its_rate(spark):
    fs_in, fs_out, spacing = 15.36e6, 3.84e6, 15e3
    assert cellular.ssb_sizes(fs_in, fs_out, spacing) == (384, 96)
    n = np.arange(60_000)
    x = np.exp(2j * np.pi * (2.1e6 + 123e3) / fs_in * n)
    df = spark.createDataFrame(pieces(x, cuts=(10_000, 10_500)), BLOCK)
    out = {}
    for r in cellular.ssb_iq(df, fs_in, fs_out, spacing, 2.1e6, delay=1000 / fs_in, max_blocks=1, discovery=40_000 / fs_in).collect():
        out |= {r.n0 + i: complex(a, b) for i, (a, b) in enumerate(zip(r.re, r.im, strict=True))}
    assert sorted(out) == list(range(10_000))
    y = np.array([out[i] for i in range(200, 9800)])
    # The band turns by the clock that begins at the delay.
    want = np.exp(2j * np.pi * (123e3 / fs_out * np.arange(200, 9800) + (2.1e6 + 123e3) / fs_in * 1000))
    assert np.abs(y - want).max() < 2e-3
    with pytest.raises(ValueError):
        cellular.ssb_iq(df, fs_in, 5e6, spacing, sizes=(384, 96))


def test_dense_grid_has_zeros_where_nothing_was_measured(spark):
    df = spark.createDataFrame(pieces(noise(16), 0, 0) + pieces(noise(16, 1), 1, 0), BLOCK)
    found = cellular.correlate_waves(df.where("capture_id = 0"), {0: np.ones(4), 5: np.ones(3)}, (0, 14), 4, 16)
    grid = cellular.completed(found, df, (0, 5), 2, 2, 4).collect()
    assert len(grid) == 2 * 2 * 2 * 2 * 4
    held = {tuple(r)[:6]: (r.re, r.im) for r in found.collect()}
    assert all((r.re, r.im) == held.get(tuple(r)[:6], (0.0, 0.0)) for r in grid) and all(r.re == 0 for r in grid if r.capture_id == 1)


def test_the_best_lag_goes_by_sorted_medians_and_waveforms_by_all_cores(spark):
    """Against the plain form, with odd and even numbers of periods; no step keeps a map of values for each lag, and few rows don't stay in one task."""
    from iqlake.sources.synthetic import placed

    rng = np.random.default_rng(8)
    power = {(c, k): rng.exponential(size=30) + 40 * (np.arange(30) == 3 * c) for c, n in ((1, 1), (2, 4), (3, 5)) for k in range(n)}
    rows = [(c, 0, k, lag, float(v)) for (c, k), p in power.items() for lag, v in enumerate(p)]
    found = cellular.sync(spark.createDataFrame(rows, "capture_id long, port int, block int, lag long, p double"), 2.0)
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.capture_id: (r.lag, r.delay) for r in found.collect()}
    for c in (1, 2, 3):
        p = np.median([v for (d, _), v in power.items() if d == c], axis=0)
        p = np.pad(np.where(p >= max(2 * np.median(p), p.max() / 2), p, 0), 4)
        s = sum(p[4 + k : 34 + k] * (1 - abs(k) / 5) for k in range(-4, 5))
        assert got[c] == (int(s.argmax()), int(s.argmax()) / 2.0)
    made = placed(spark.range(40).select(F.col("id").alias("capture_id"), F.col("id").alias("delay")).coalesce(1), np.ones(4, complex), 20)
    assert made.select(F.spark_partition_id()).distinct().count() > 1
