"""Recordings by ranges, plans of reads, and streams of sensors."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqlake.operators import corrections, filters, frames, stats
from iqlake.plans import acquisition
from iqlake.sources import files, ranges
from iqlake.streaming import capture, sensors

BLOCK = "capture_id long, port int, n0 long, re array<double>, im array<double>"


def noise(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=n) + 1j * rng.normal(size=n)


# files by ranges --------------------------------------------------------------------------------------------------------


def series(df):
    out = {}
    for r in df.collect():
        for i, (a, b) in enumerate(zip(r.re, r.im, strict=True)):
            assert (r.port, r.n0 + i) not in out
            out[r.port, r.n0 + i] = complex(a, b)
    return out


def as_array(found, port=0):
    n = sum(p == port for p, _ in found)
    return np.array([found[port, i] for i in range(n)])


def tdms(segments, names=("I", "Q"), total=None, level=None, interleaved=False):
    """A recording: properties in a first group, two channels in a second, several segments of raw data."""

    def text(s):
        return struct.pack("<I", len(s)) + s.encode()

    out = b""
    for k, (i, q) in enumerate(segments):
        objects = []
        raw = b""
        if k == 0 and (total is not None or level is not None):
            for name, value, kind in (("total_samples", total, 4), ("reference_level_dBm", level, 10)):
                if value is not None:
                    objects.append(text(f"/'info'/'{name}'") + struct.pack("<IIIQ", 20, kind, 1, 1) + struct.pack("<I", 0))
                    raw += struct.pack("<q" if kind == 4 else "<d", value)
            head = struct.pack("<I", len(objects)) + b"".join(objects)
            out += b"TDSm" + struct.pack("<IIQQ", 0b1110, 4713, len(head) + len(raw), len(head)) + head + raw
            objects, raw = [], b""
        for n, x in zip(names, (i, q), strict=True):
            objects.append(text(f"/'iq'/'{n}'") + struct.pack("<IIIQ", 20, 2, 1, len(x)) + struct.pack("<I", 0))
        head = struct.pack("<I", len(objects)) + b"".join(objects)
        raw = (np.stack([i, q], axis=1) if interleaved else np.stack([i, q])).astype("<i2").tobytes()
        out += b"TDSm" + struct.pack("<IIQQ", 0b1110 | (32 if interleaved else 0), 4713, len(head) + len(raw), len(head)) + head + raw
    return out


def mat(name, x, order="<"):
    """A level-5 file with one variable that isn't compressed, after another one."""

    def element(kind, body):
        return struct.pack(order + "II", kind, len(body)) + body + bytes(-len(body) % 8)

    def variable(name, x):
        x = np.atleast_2d(x)
        parts = element(6, struct.pack(order + "II", 6 | 0x800, 0)) + element(5, struct.pack(order + "ii", *x.shape)) + element(1, name.encode())
        return element(14, parts + element(9, x.real.astype(order + "f8").tobytes("F")) + element(9, x.imag.astype(order + "f8").tobytes("F")))

    return b"MATLAB 5.0".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + variable("other", np.arange(3)) + variable(name, x)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("iq")
    x = noise(1000)
    np.save(path / "a.npy", x.astype("c8"))
    np.save(path / "two.npy", np.stack([x, 2 * x]))
    ints = np.random.default_rng(1).integers(-30000, 30000, (1000, 2)).astype("<i2")
    ints.tofile(path / "b.int16")
    cut = [(ints[:400, 0], ints[:400, 1]), (ints[400:, 0], ints[400:, 1])]
    (path / "c.tdms").write_bytes(tdms(cut, total=970, level=6.0))
    (path / "d.tdms").write_bytes(tdms(cut, interleaved=True))
    (path / "e.mat").write_bytes(mat("waveform", x))
    (path / "f.mat").write_bytes(mat("waveform", np.stack([x, 3 * x]), ">"))
    (path / "notes.txt").write_text("x")
    z = ints[:, 0] + 1j * ints[:, 1].astype(float)
    return path, x, z


@pytest.mark.parametrize(("block", "step"), [(1000, 1 << 24), (7, 7), (64, 100), (300, 1)])
def test_every_range_gives_the_same_samples(spark, folder, block, step):
    path, x, z = folder
    read = lambda name, **o: series(ranges.read_iq_ranges(spark, f"{path}/{name}", block=block, range=step, **o))
    assert np.allclose(as_array(read("a.npy")), x.astype("c8"))
    two = read("two.npy")
    assert np.array_equal(as_array(two, 0), x) and np.array_equal(as_array(two, 1), 2 * x)
    assert np.allclose(as_array(read("b.int16")), z / 32767)
    assert np.allclose(as_array(read("c.tdms")), z[:970] * 10 ** (6 / 20) / 32767)
    assert np.allclose(as_array(read("d.tdms")), z / 32767)
    assert np.array_equal(as_array(read("e.mat")), x)
    many = read("f.mat")
    assert np.array_equal(as_array(many, 0), x) and np.array_equal(as_array(many, 1), 3 * x)
    # Rows don't depend on the range.
    rows = lambda s: sorted((r.port, r.n0, len(r.re)) for r in ranges.read_iq_ranges(spark, f"{path}/two.npy", block=block, range=s).collect())
    assert rows(step) == rows(5000)


def test_parts_loops_and_whole_frames(spark, folder):
    path, x, z = folder
    read = lambda name, **o: as_array(series(ranges.read_iq_ranges(spark, f"{path}/{name}", block=50, range=120, **o)))
    assert np.array_equal(read("e.mat", skip=10, count=333), x[10:343])
    assert np.array_equal(read("e.mat", skip=900, count=2500, loop=True), np.resize(np.roll(x, -900), 2500))
    assert len(read("c.tdms", frame=100)) == 900 and len(read("e.mat", skip=950, frame=60)) == 0
    with pytest.raises(Exception, match="has 1000 samples"):
        read("e.mat", count=1001)


def test_ranges_agree_with_whole_files(spark, folder):
    path, *_ = folder
    for name in ("a.npy", "b.int16", "c.tdms", "e.mat"):
        whole = series(files.read_iq_files(spark, f"file://{path}/{name}", block=70))
        assert as_array(whole).shape == as_array(series(ranges.read_iq_ranges(spark, f"file://{path}/{name}", block=70, range=140))).shape
        assert np.allclose(as_array(whole), as_array(series(ranges.read_iq_ranges(spark, f"{path}/{name}", block=70, range=140))))


def test_a_folder_is_read_file_by_file(spark, folder):
    path, *_ = folder
    df = ranges.read_iq_ranges(spark, str(path), block=100)
    assert df.select("path").distinct().count() == 7 and df.select("capture_id").distinct().count() == 7
    assert {r.port for r in df.select("port").distinct().collect()} == {0, 1}


def test_bad_files_and_options(spark, folder, tmp_path):
    path, x, _ = folder
    (tmp_path / "x.mat").write_bytes(mat("waveform", x))
    with pytest.raises(Exception, match="no numeric variable"):
        ranges.read_iq_ranges(spark, f"{tmp_path}/x.mat", key="none").collect()
    for bad in ({"form": "wav"}, {"block": "0"}, {"loop": "true"}, {"skip": "-1"}):
        with pytest.raises(ValueError):
            ranges.Options.of({"path": "x"} | bad)
    np.save(tmp_path / "empty.npy", np.zeros(0, complex))
    assert ranges.read_iq_ranges(spark, f"{tmp_path}/empty.npy").count() == 0
    np.save(tmp_path / "cut.npy", x)
    raw = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(raw[:-100])
    with pytest.raises(Exception, match="ends before"):
        ranges.read_iq_ranges(spark, f"{tmp_path}/cut.npy", block=100).collect()


def test_a_recording_of_three_gigabytes_is_many_partitions(spark, tmp_path):
    n = 3 * (1 << 30) // 16
    path = tmp_path / "long.npy"
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<c16", "fortran_order": False, "shape": (n,)})
        start = f.tell()
        f.truncate(start + 16 * n)  # a sparse file
        f.seek(start + 16 * (n - 3))
        f.write(np.array([1 + 2j, 3.0, 5j]).tobytes())
    try:
        df = ranges.read_iq_ranges(spark, str(path), range=1 << 22)
        assert df.rdd.getNumPartitions() == n >> 22
        tail = series(ranges.read_iq_ranges(spark, str(path), skip=n - 10, block=4))
        assert as_array(tail)[-3:].tolist() == [1 + 2j, 3.0, 5j] and len(tail) == 10
    finally:
        os.remove(path)


# plans ------------------------------------------------------------------------------------------------------------------


def plain_holdoff(start_ns, fs, overlap, transient, strobe, carried):
    least = overlap + (0 if carried else round(transient * fs))
    if not strobe:
        return least
    period_ns = round(strobe * 1e9)
    wait = round((period_ns - start_ns % period_ns) % period_ns / 1e9 * fs)
    period = round(strobe * fs)
    return wait + -(-least // period) * period if wait < least else wait


def test_holdoff_equals_the_plain_form(spark):
    rows = [(s, float(fs), o, c) for s in (0, 1, 999_999, 123_456_789_012, 10**18 + 7) for fs in (1e6, 15.36e6) for o in (0, 50) for c in (True, False)]
    df = spark.createDataFrame(rows, "s long, fs double, o long, c boolean")
    for transient, strobe in ((0.0, None), (1e-4, None), (0.0, 1e-3), (2.5e-3, 1e-3), (1e-5, 20e-3)):
        got = df.select("s", "fs", "o", "c", acquisition.holdoff(F.col("s"), F.col("fs"), F.col("o"), transient, strobe, F.col("c")).alias("h")).collect()
        assert all(r.h == plain_holdoff(r.s, r.fs, r.o, transient, strobe, r.c) for r in got)


def test_reads_share_what_the_capture_before_holds(spark):
    rng = np.random.default_rng(4)
    rows = [(r, k, int(rng.integers(1, 40)), int(rng.integers(0, 30)), int(rng.integers(0, 30)), int(rng.integers(0, 2))) for r in range(5) for k in range(30)]
    df = spark.createDataFrame(rows, "receiver int, number int, size int, overlap_low int, overlap_high int, gain int")
    got = {(r.receiver, r.number): r for r in acquisition.plan_reads(df, "number", ("receiver",), ("gain",)).collect()}
    for r in range(5):
        before, held, gain = None, set(), None
        for k in range(30):
            _, _, size, low, high, g = rows[r * 30 + k]
            if g != gain:
                at, held, before = low, set(), None
            need = set(range(at - low, at + size + high))
            x = got[r, k]
            assert (x.start, x.read_start, x.read_stop) == (at, at - low, at + size + high)
            gone = {n for n in need if before is not None and n < min(held)}
            assert x.shared == len(need & held) and x.missing == len(gone) and x.fresh == len(need - held - gone)
            before, held, gain, at = k, need, g, at + size


# streams ----------------------------------------------------------------------------------------------------------------

SAMPLES = "source_id string, n long, value double"


def stream_of(spark, tmp_path, batches, schema, name="in"):
    src = f"{tmp_path}/{name}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/batch={k:03}")
        os.utime(f"{src}/batch={k:03}", (k, k))
        for f in os.listdir(f"{src}/batch={k:03}"):
            os.utime(f"{src}/batch={k:03}/{f}", (1_600_000_000 + 100 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)


def finish(spark, tmp_path, stream, out="out"):
    q = capture.write_batches(stream, f"{tmp_path}/{out}", f"{tmp_path}/check-{out}")
    assert q.awaitTermination(180)
    if q.exception():
        raise q.exception()
    return spark.read.parquet(f"{tmp_path}/{out}")


def frames_of(spark, tmp_path, batches, **options):
    df = finish(spark, tmp_path, sensors.acquired_frames(stream_of(spark, tmp_path, batches, SAMPLES), 4, **options))
    return sorted((r.source_id, r.frame_start, r.power, r.lost, r.late) for r in df.collect())


def test_samples_out_of_order_wait_for_each_other(spark, tmp_path):
    rows = lambda *ns: [("a", n, float(n)) for n in ns]
    got = frames_of(spark, tmp_path, [rows(0, 1, 5, 6), rows(3, 2, 7), rows(4, 4, 1), rows(8, 9, 10, 11)], patience=8)
    power = lambda s: sum(n * n for n in range(s, s + 4)) / 4
    assert got == [("a", 0, power(0), 0, 0), ("a", 4, power(4), 0, 2), ("a", 8, power(8), 0, 0)]


def test_a_loss_is_told_and_held_off(spark, tmp_path):
    rows = lambda *ns: [("a", n, 1.0) for n in ns]
    # 6 and 7 never come; 12 is six beyond them. Two samples of holdoff, then a multiple of five.
    got = frames_of(spark, tmp_path, [rows(*range(6)), rows(8, 9, 10, 11), rows(12, 13, 14), rows(15, 16, 17, 18, 7)], patience=6, holdoff=2, strobe=5)
    assert got == [("a", 10, 1.0, 2, 0), ("a", 14, 1.0, 0, 0)] or got == [("a", 10, 1.0, 2, 0), ("a", 14, 1.0, 0, 1)]


def test_a_loss_can_fail_the_stream(spark, tmp_path):
    with pytest.raises(Exception, match="lost"):
        frames_of(spark, tmp_path, [[("a", 0, 1.0), ("a", 9, 1.0)]], patience=3, on_loss="except")


def test_sources_have_states_of_their_own(spark, tmp_path):
    batches = [[("a", n, 1.0) for n in range(3)] + [("b", n, 2.0) for n in range(100, 106)], [("a", 3, 1.0), ("b", 106, 2.0), ("b", 107, 2.0)]]
    assert frames_of(spark, tmp_path, batches) == [("a", 0, 1.0, 0, 0), ("b", 100, 4.0, 0, 0), ("b", 104, 4.0, 0, 0)]


def test_readings_join_captures_late_and_early(spark, tmp_path):
    stamp = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    taken = [[(1, "a", 10), (2, "b", 12)], [(3, "a", 40)], [(4, "a", 200)], [(5, "a", 400)], [(6, "a", 700)]]
    read = [[("b", 30, 5.0)], [("a", 8, 1.0), ("a", 42, 2.0)], [("a", 70, 9.0)], [("a", 401, 3.0)], [("a", 900, 9.0)]]
    captures = stream_of(spark, tmp_path, [[(i, k, stamp(s)) for i, k, s in b] for b in taken], "id int, sensor string, at string", "captures").select("id", "sensor", F.to_timestamp("at").alias("time"))
    readings = stream_of(spark, tmp_path, [[(k, stamp(s), v) for k, s, v in b] for b in read], "sensor string, at string, temperature double", "readings").select("sensor", F.to_timestamp("at").alias("reading_time"), "temperature")
    out = finish(spark, tmp_path, sensors.merge_readings(captures, readings, ["sensor"], late="60 seconds"))
    got = {(r.id, r.temperature) for r in out.collect()}
    assert {(1, 1.0), (3, 2.0), (5, 3.0), (2, None), (4, None)} <= got and not any(i == 2 and t for i, t in got)
    with pytest.raises(ValueError):
        sensors.merge_readings(captures, readings.withColumnRenamed("temperature", "id"), ["sensor"])


def test_calibrations_leave_once_when_they_are_whole(spark, tmp_path):
    points = [(on, f) for on in (True, False) for f in (1.0, 2.0)]
    rows = lambda port, *which: [(port, *points[i], float(10 * i + v)) for i, v in which]
    batches = [rows(0, (3, 0), (0, 0)), rows(1, (0, 0), (1, 0), (2, 0)) + [(0, True, 9.0, 1.0)], rows(0, (0, 5), (2, 0), (1, 0)), rows(0, (0, 7), (1, 7), (2, 7), (3, 7)) + rows(1, (3, 1))]
    schema = "port int, noise_diode_enabled boolean, frequency double, value double"
    stream = sensors.whole_groups(stream_of(spark, tmp_path, batches, schema), ["port"], ["noise_diode_enabled", "frequency"], points)
    got = sorted(map(tuple, finish(spark, tmp_path, stream).select("port", "noise_diode_enabled", "frequency", "value").collect()))
    want = [(0, *points[i], v) for i, v in ((0, 5.0), (1, 10.0), (2, 20.0), (3, 30.0))] + [(1, *points[i], v) for i, v in ((0, 0.0), (1, 10.0), (2, 20.0), (3, 31.0))]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        sensors.whole_groups(stream_of(spark, tmp_path, batches[:1], schema, "twice"), ["port"], ["frequency"], [(1.0,), (1.0,)])


# bins -------------------------------------------------------------------------------------------------------------------


def test_random_bins_of_blocks_equal_those_of_samples(spark):
    rows = []
    for c, n in ((0, 100), (1, 8), (2, 7), (3, 64)):
        x = noise(n, c)
        cuts = [0, *sorted({5, n // 2} - {0}), n] if n > 10 else [0, n]
        rows += [(c, 0, a, x.real[a:b].tolist(), x.imag[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
    df = spark.createDataFrame(rows, BLOCK)
    key = lambda r: (r.capture_id, r.port, r.bin, r.power_detector)
    want = {key(r): r.value for r in stats.random_bin_power(frames.samples(df), 8, ("rms", "peak", "min"), 3).collect()}
    got = {key(r): r.value for r in stats.random_bin_power_blocks(df, 8, ("rms", "peak", "min"), 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    with pytest.raises(ValueError):
        stats.random_bin_power_blocks(df, 8, ("median",))


# context from the source ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "left", "right", "step"), [(48, 20, 20, 48), (64, 64, 50, 128), (20, 100, 100, 20), (5000, 20, 20, 7000)])
def test_filters_of_chunks_with_context_shuffle_nothing(spark, folder, size, left, right, step):
    path, x, _ = folder
    rows = [(7, 0, a, x.real[a : a + 130].tolist(), x.imag[a : a + 130].tolist()) for a in range(0, 1000, 130)]
    whole = spark.createDataFrame(rows, BLOCK)
    ready = ranges.read_iq_chunks(spark, f"{path}/e.mat", size, left, right, range=step)
    of = lambda df: as_array({(r.port, r.n0 + i): complex(a, b) for r in df.collect() for i, (a, b) in enumerate(zip(r.re, r.im, strict=True))})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for make in (lambda b: filters.filtered(b, 16.0, 64.0, 31, 4.0, size), lambda b: filters.oa_filter(b, 64.0, 8, (-20.0, 20.0), size=size, nfft_out=4), lambda b: filters.upfirdn(b, np.arange(1.0, 8.0), 2, 1, size)):
        if size % 4:
            continue
        assert np.allclose(of(make(ready)), of(make(whole)), atol=1e-9) and "Exchange" not in plan(make(ready)) and "Exchange" in plan(make(whole))
    spec = corrections.spec_column(fs=64.0, nfft=8, nfft_out=4, bandwidth=20.0, taps=9, transition=4.0, conjugate=True)
    if left >= 20 and size % 4 == 0:
        fixed = lambda b: corrections.corrected(b.withColumn("spec", spec), size)
        assert np.allclose(of(fixed(ready)), of(fixed(whole)), atol=1e-9) and "Exchange" not in plan(fixed(ready))
    got = stats.lagged_product_blocks(ready, 16, [0, 5, 300], 12, size).orderBy("j").collect()
    want = stats.lagged_product_blocks(whole, 16, [0, 5, 300], 12, size).orderBy("j").collect()
    assert np.allclose([r.r for r in got], [r.r for r in want])


def test_chunks_with_too_little_context_raise(spark, folder):
    path, *_ = folder
    ready = ranges.read_iq_chunks(spark, f"{path}/e.mat", 100, 5, 5)
    for df in (filters.filtered(ready, 16.0, 64.0, 31, 4.0, 100), filters.filtered(ready, 16.0, 64.0, 5, 4.0, 50)):
        with pytest.raises(Exception, match="too little context"):
            df.collect()
