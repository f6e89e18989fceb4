"""Framed Fourier transforms and the spectral measurements on them.

Transforms run as numpy kernels on Arrow batches of whole blocks; everything after (binning, statistics, histograms) is DataFrame
expressions. A block is one row with its samples as arrays; long captures are cut into overlapping blocks beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pow_to_db, whole
from ..functions.windows import window as make_window
from .frames import KEYS, binned_mean, null_band, trim_band
from .stats import histogram, label, statistic, to_long

EPS = 1e-25


def overlapping_blocks(blocks: DataFrame, size: int, nfft: int, hop: int) -> DataFrame:
    """Long rows cut into blocks of about ``size`` samples that share the samples a frame needs at their borders."""
    per = max(1, (size - nfft) // hop + 1)
    count = F.greatest(F.floor((F.size("re") - nfft) / hop) + 1, F.lit(0))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(count / per) - 1, F.lit(0)).cast("int"))).alias("part")
    cut = lambda c: F.expr(f"slice({c}, part * {per * hop} + 1, {(per - 1) * hop + nfft})").alias(c)
    return blocks.select(*KEYS, "n0", "re", "im", part).select(*KEYS, (F.col("n0") + F.col("part") * per * hop).cast("long").alias("n0"), cut("re"), cut("im"))


#: Numbers of one transform in a kernel.
TRANSFORM = 1 << 21


def equal_runs(b: pa.RecordBatch, per_row: Callable[[int], int]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, samples by row) of runs of rows with as many samples each; runs are cut where they hold over ``TRANSFORM`` numbers, ``per_row`` of a row's samples."""
    re, im = b.column(3), b.column(4)
    bounds, other = re.offsets.to_numpy(), im.offsets.to_numpy()
    flat = [c.values.to_numpy(zero_copy_only=False) for c in (re, im)]
    sizes = np.diff(bounds)
    starts = np.flatnonzero(np.diff(sizes, prepend=-1)).tolist()
    for first, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
        n = int(sizes[first])
        step = max(1, TRANSFORM // max(1, per_row(n)))
        for lo in range(first, end, step) if n else ():
            hi = min(lo + step, end)
            yield lo, (flat[0][bounds[lo] : bounds[hi]].astype(float) + 1j * flat[1][other[lo] : other[hi]]).reshape(hi - lo, n)


def framed_power(x: np.ndarray, w: np.ndarray, hop: int) -> np.ndarray:
    """(rows, frames, bins): squared transforms of the windowed frames of each row, frequency zero in the middle."""
    y = np.fft.fft(np.lib.stride_tricks.sliding_window_view(x, len(w), axis=1)[:, ::hop] * w, axis=2)
    if len(w) % 2:
        y = np.fft.fftshift(y, axes=2)
    return y.real**2 + y.imag**2


def stft_power(blocks: DataFrame, nfft: int, overlap: int = 0, window: str | tuple = "hamming", zeros: int = 0) -> DataFrame:
    """capture_id, port, frame, k, power: |FFT(frame * window / nfft)|^2 with frequency zero at k = nfft // 2."""
    hop = nfft - overlap
    w = make_window(window, nfft, zeros, center=nfft % 2 == 0) / nfft

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEYS, "frame", "k", "power"]
        for b in batches:
            for first, x in equal_runs(b, lambda n: n // hop * nfft):
                if x.shape[1] < nfft:
                    continue
                p = framed_power(x, w, hop)
                rows, m, _ = p.shape
                at = np.repeat(np.arange(first, first + rows), m * nfft)
                frame = (b.column(2).to_numpy()[first : first + rows] // hop)[:, None] + np.arange(m)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.repeat(frame.ravel(), nfft)), pa.array(np.tile(np.arange(nfft), rows * m)), pa.array(p.ravel())], names=names)

    rows = blocks.select(F.col("capture_id").cast("long"), F.col("port").cast("int"), F.col("n0").cast("long"), "re", "im")
    return rows.mapInArrow(run, "capture_id long, port int, frame long, k long, power double")


def block_psd(blocks: DataFrame, nfft: int, overlap: int = 0, window: str | tuple = "hamming", zeros: int = 0, stats: tuple = ("mean", 0.5, 0.9, "max")) -> DataFrame:
    """:func:`power_spectral_density` of captures that are one block: statistics over the frames are taken where the block lies, no pixel leaves it and nothing is shuffled.

    A block that begins later than at 0 raises; one without a whole frame gives no rows.
    """
    hop = nfft - overlap
    w = make_window(window, nfft, zeros, center=nfft % 2 == 0) / nfft
    named = {"mean": np.mean, "rms": np.mean, "max": np.max, "peak": np.max, "min": np.min, "median": np.median}
    over = [named[s] if isinstance(s, str) else (lambda p, axis, q=s: np.quantile(p, q, axis=axis)) for s in stats]
    labels = [label(s) for s in stats]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEYS, "k", "time_statistic", "value"]
        for b in batches:
            if np.any(b.column(2).to_numpy()):
                raise ValueError("a capture has several blocks")
            for first, x in equal_runs(b, lambda n: n // hop * nfft):
                if x.shape[1] < nfft:
                    continue
                p = framed_power(x, w, hop)
                with np.errstate(divide="ignore"):
                    value = 10 * np.log10(np.stack([f(p, axis=1) for f in over], axis=2) + EPS)
                n = len(x)
                at = pa.array(np.repeat(np.arange(first, first + n), nfft * len(over)))
                kind = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(len(over), dtype=np.int32), n * nfft)), pa.array(labels)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.tile(np.repeat(np.arange(nfft), len(over)), n)), kind, pa.array(value.ravel())], names=names)

    rows = blocks.select(F.col("capture_id").cast("long"), F.col("port").cast("int"), F.col("n0").cast("long"), "re", "im")
    return rows.mapInArrow(run, "capture_id long, port int, k long, time_statistic string, value double")


def spectrogram(blocks: DataFrame, fs: float, resolution: float, overlap: float = 0.0, fill: float = 1.0, window: str | tuple = "hamming", bandwidth: float = float("inf"), integrate: float | None = None, aperture: int | None = None, lo_stop: float | None = None) -> DataFrame:
    """Linear spectrogram: framed power, local-oscillator band as NaN, trimmed band, frequency bins summed, time bins averaged."""
    nfft = whole(fs / resolution, "fs / resolution")
    noverlap, zeros = whole(overlap * nfft, "overlap * nfft"), whole((1 - fill) * nfft, "(1 - fill) * nfft")
    out = stft_power(blocks, nfft, noverlap, window, zeros)
    if lo_stop:
        out = null_band(out, nfft, fs, lo_stop)
    out = trim_band(out, nfft, fs, bandwidth)
    if integrate:
        count = whole(integrate / resolution, "integration / resolution")
        size = round(nfft * bandwidth / fs) if bandwidth != float("inf") else nfft
        first = (nfft - size) // 2 if bandwidth != float("inf") else 0
        out = binned_mean(out.withColumn("k", F.col("k") - first), size, count, (*KEYS, "frame"), "k", "power").withColumn("power", F.col("power") * count).withColumnRenamed("bin", "k")
    if aperture and aperture > 1:
        out = out.groupBy(*KEYS, F.floor(F.col("frame") / aperture).cast("long").alias("frame"), "k").agg(F.avg("power").alias("power"))
    return out


def to_db(spec: DataFrame, digits: int = 2) -> DataFrame:
    """Decibels of a linear spectrogram, rounded half to even."""
    return spec.withColumn("power", F.bround(pow_to_db(F.col("power"), EPS), digits))


def power_spectral_density(spec: DataFrame, stats: tuple = ("mean", 0.5, 0.9, "max")) -> DataFrame:
    """Statistics over time per port and frequency, in dB; all of them in one pass."""
    wide = spec.groupBy(*KEYS, "k").agg(*(statistic(s, F.col("power")).alias(label(s)) for s in stats))
    return to_long(wide, stats, "time_statistic").withColumn("value", pow_to_db(F.col("value"), EPS))


def spectrogram_histogram(spec_db: DataFrame, low: float, high: float, step: float, normalise_port: int | None = None) -> DataFrame:
    """Histogram per capture and port. Fractions are of each port's own pixels, or of those of ``normalise_port`` for all ports of a capture."""
    counts = histogram(spec_db, "power", low, high, step, ("capture_id", "port"), ("capture_id", "port"))
    if normalise_port is None:
        return counts
    total = F.sum(F.when(F.col("port") == normalise_port, F.col("n"))).over(Window.partitionBy("capture_id"))
    return counts.withColumn("fraction", F.col("n") / total)


def ratio_histogram(spec_db: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """Histogram of the dB difference between the two ports of a capture, either way round; other port counts raise."""
    p, q = F.min_by("power", "port").alias("p"), F.max_by("power", "port").alias("q")
    both = spec_db.groupBy("capture_id", "frame", "k").agg(F.count(F.lit(1)).alias("c"), F.min("port").alias("a"), F.max("port").alias("b"), p, q)
    two = (F.col("c") == 2) & (F.col("a") != F.col("b"))
    difference = F.when(two, F.col("p") - F.col("q")).otherwise(F.raise_error(F.lit("a ratio needs captures of exactly two ports")).cast("double"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("port"), difference.alias("power")), F.struct(F.col("b").alias("port"), (-difference).alias("power")))).alias("s")
    return histogram(both.select("capture_id", sides).select("capture_id", "s.port", "s.power"), "power", low, high, step, ("capture_id", "port"), ("capture_id", "port"))


def resource_histogram(spec: DataFrame, masks: DataFrame, frame_symbols: int, low: float, high: float, step: float) -> DataFrame:
    """Histogram of resource-grid power per link direction: pixels join the mask of their symbol in the frame."""
    masked = spec.withColumn("symbol", F.pmod("frame", F.lit(frame_symbols)).cast("int")).join(F.broadcast(masks), "symbol")
    db = masked.withColumn("power", pow_to_db(F.col("power"), EPS))
    return histogram(db, "power", low, high, step, ("capture_id", "port", "direction"), ("capture_id", "port"), drop_inf=True)


def ssb_spectrogram(spec: DataFrame, discovery_symbols: int, spacing: float, first: int, count: int) -> DataFrame:
    """The synchronisation blocks' part of a symbol-spaced spectrogram: the first two slots of each discovery period, one band."""
    held = 28 * round(spacing / 15e3)
    at = F.pmod("frame", F.lit(discovery_symbols))
    kept = spec.where((at < held) & (F.col("k") >= first) & (F.col("k") < first + count))
    return kept.select(*KEYS, F.floor(F.col("frame") / discovery_symbols).cast("long").alias("block"), at.alias("symbol"), (F.col("k") - first).alias("k"), F.bround(pow_to_db(F.col("power"), EPS), 3).alias("value"))
