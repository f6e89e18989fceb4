"""Planning of captures, polyphase filters and the tables behind reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqlake.functions import columns as C
from iqlake.operators import calibration, filters, frames, stats
from iqlake.plans import results, sweep

BLOCK = "capture_id long, port int, n0 long, re array<double>, im array<double>"


@pytest.mark.parametrize("up,down,taps,cuts", [(1, 1, 1, 24), (3, 2, 7, 5), (2, 3, 4, 24), (4, 1, 2, 7), (1, 4, 9, 24)])
def test_upfirdn_is_stuff_filter_thin(spark, up, down, taps, cuts):
    rng = np.random.default_rng(up * 10 + down)
    x, h = rng.normal(size=24) + 1j * rng.normal(size=24), rng.normal(size=taps)
    rows = [(0, 0, i, x[i : i + cuts].real.tolist(), x[i : i + cuts].imag.tolist()) for i in range(0, 24, cuts)]
    out = frames.samples(filters.upfirdn(spark.createDataFrame(rows, BLOCK), h, up, down, size=12)).orderBy("n").collect()
    stuffed = np.zeros(24 * up, complex)
    stuffed[::up] = x
    want = np.convolve(stuffed, h)[::down][: 24 * up // down]
    assert np.allclose([r["re"] + 1j * r["im"] for r in out], want)


def test_random_bins_stay_inside_and_repeat(spark):
    lengths = spark.createDataFrame([(0, 0, 100), (1, 0, 8), (2, 0, 7)], "capture_id long, port int, n long")
    a = stats.random_starts(lengths, 8, 3).orderBy("capture_id", "bin").collect()
    assert a == stats.random_starts(lengths, 8, 3).orderBy("capture_id", "bin").collect()
    assert [r["capture_id"] for r in a] == [0] * 12 + [1] and all(0 <= r["start"] <= 92 for r in a) and a[-1]["start"] == 0


def test_read_count(spark):
    one = lambda **k: spark.range(1).select(C.read_count(F.lit(2.0), F.lit(10.0), F.lit(3), F.lit(2), F.lit(True), F.lit(15.0), **k).alias("n")).first()["n"]
    assert one() == 30 and one(overlap=4) == 34 and one(holdoff=1.0, strobe=0.5) == 60
    with pytest.raises(ValueError):
        one(overlap=3)
    with pytest.raises(Exception, match="multiple of the sample period"):
        spark.range(1).select(C.read_count(F.lit(0.33), F.lit(10.0), F.lit(1), F.lit(1), F.lit(False), F.lit(1.0))).collect()


def test_adjustments_and_merges(spark):
    df = spark.sql("select id, named_struct('a', named_struct('n', 1, 'm', 2), 'b', named_struct('n', 3)) spec, case id when 0 then map('n', 9, 'zz', 1) when 1 then map('m', cast(null as int)) end o from range(3)")
    out = sweep.adjust_analysis(df, "spec", "o").orderBy("id").collect()
    assert [(r["spec"]["a"]["n"], r["spec"]["a"]["m"], r["spec"]["b"]["n"], r["unused_adjust"]) for r in out] == [(9, 2, 9, ["zz"]), (1, None, 3, []), (1, 2, 3, [])]
    row = spark.sql("select map('x', 1, 'y', 2) a, map('y', 5) b, cast(null as map<string,int>) c").select(sweep.merged(F.col("a"), F.col("c"), F.col("b")).alias("m"), sweep.merged(F.col("c"), F.col("c")).alias("none")).first()
    assert row["m"] == {"x": 1, "y": 5} and row["none"] is None


def test_keys_are_checked_and_named(spark):
    captures = spark.createDataFrame([(1, "p"), (2, None)], "k int, port string")
    lookup = spark.createDataFrame([("1",), (None,)], "k string")
    assert {r["k"] for r in sweep.checked_keys(lookup, captures, ["k"]).collect()} == {1, None}
    with pytest.raises(Exception, match="not a value of k: one"):
        sweep.checked_keys(spark.createDataFrame([("one",)], "k string"), captures, ["k"]).collect()
    grid = spark.createDataFrame([(1, "p")], "k int, port string")
    assert {tuple(r) for r in calibration.missing_keys(captures, grid, ["k", "port"]).collect()} == {("k", "2"), ("port", None)}
    with pytest.raises(ValueError, match="port"):
        sweep.merge_peripherals(captures, grid, ["k"])


def test_reusable_and_empty(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, None), (2, 1, 5.0), (3, 2, 5.0)], "t int, port int, rate double")
    assert [r["reusable"] for r in sweep.reusable(df, "t", ("port",), ("rate",)).orderBy("t").collect()] == [False, True, False, False]
    assert sweep.reusable(df.limit(0), "t", ("port",), ("rate",)).count() == 0


def test_reports(spark):
    assert results.group_fields("{name}-{port} {site}.svg", ("site", "gain"), ("port",)) == ["port", "site", "gain"]
    df = spark.createDataFrame([(0, 15, 1.0), (0, 30, 1.0), (0, 30, float("nan")), (1, 15, 0.0), (1, 30, 2.0), (1, 30, None)], "port int, scs int, v double")
    got = results.strongest(df, ["port"], "scs", "v").collect()
    assert sorted((r["port"], r["scs"]) for r in got) == [(0, 15), (1, 30), (1, 30)]
    assert results.group_rows(df, {"port": 1, "v": None}).count() == 1
    corr = spark.createDataFrame([(0, c, b, k, 1.0 + b, 0.0) for c in (0, 1) for b in (0, 1) for k in range(3)], "block int, cell_id int, beam int, lag long, re double, im double").withColumn("capture_id", F.lit(0))
    floor = {h: {round(10 ** (r["floor"] / 10), 9) for r in results.correlation_report(corr, h, ["capture_id"]).collect()} for h in ("beam", "cell_id")}
    assert floor == {"beam": {0.2}, "cell_id": {0.5}}
    with pytest.raises(ValueError):
        results.correlation_report(corr, "port", ["capture_id"])
