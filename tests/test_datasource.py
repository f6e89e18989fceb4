"""The waveform source behind Spark's reader, in batch and as a stream."""

import numpy as np
import pytest

from iqlake.sources import datasource, synthetic


def samples(rows):
    return {(r.port, r.n0 + i): (a, b) for r in rows for i, (a, b) in enumerate(zip(r.re, r.im, strict=True))}


@pytest.mark.parametrize(("kind", "options", "make"), [("tone", {"frequency": 3.0}, lambda s: synthetic.tone(s, 100, 64.0, 3.0)), ("pulse", {"time": 0.5, "power": 20}, lambda s: synthetic.pulse(s, 100, 64.0, 0.5, 20.0)), ("sawtooth", {"period": 0.25}, lambda s: synthetic.sawtooth(s, 100, 64.0, 0.25))])
def test_batch_equals_the_column_form(spark, kind, options, make):
    datasource.register(spark)
    got = samples(spark.read.format("iq_waveform").options(kind=kind, fs=64.0, count=100, block=16, partitions=3, **options).load().collect())
    want = {(0, r.n): (r.re, r.im) for r in make(spark).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_noise_has_its_power_and_doesnt_depend_on_partitions(spark):
    datasource.register(spark)
    read = lambda parts: samples(spark.read.format("iq_waveform").options(fs=100.0, psd=10.0, count=20_000, block=1000, ports=2, partitions=parts).load().collect())
    one, many = read(1), read(7)
    assert one == many and len(one) == 40_000
    assert abs(np.mean([a * a + b * b for a, b in one.values()]) / 1000 - 1) < 0.05
    assert one[0, 0] != one[1, 0]


def test_empty_and_bad_options(spark):
    datasource.register(spark)
    assert spark.read.format("iq_waveform").options(count=0).load().count() == 0
    with pytest.raises(ValueError, match="kind"):
        datasource.Waveform.of({"kind": "square"})
    with pytest.raises(ValueError, match="positive"):
        datasource.Waveform.of({"block": "0"})


def test_stream_gives_every_block_once_over_a_restart(spark, tmp_path):
    datasource.register(spark)
    load = lambda count: spark.readStream.format("iq_waveform").options(kind="tone", fs=64.0, frequency=5.0, count=count, block=10, blocks_per_batch=2).load()
    for count in (45, 70):  # the second run goes on from the checkpoint
        q = load(count).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.n0 for r in rows) == [0, 10, 20, 30, 40, 50, 60]
