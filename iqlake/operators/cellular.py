"""Cellular synchronisation: correlation with the PSS or SSS, and the choice of the best lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ofdm import pss, sss, sss_parts, sync_bins, sync_sizes, sync_waveform
from .corrections import corrected, cut, spec_column
from .filters import chunk_rows, chunk_samples
from .frames import KEYS, chunks


def templates(kind: str, sample_rate: float, spacing: float, ids: tuple[int, ...] | None = None) -> dict[int, np.ndarray]:
    """Time-domain sequences by cell id: three for ``pss``, 1008 for ``sss``."""
    if kind == "pss":
        return {i: sync_waveform(pss(i), sample_rate, spacing) for i in (ids or range(3))}
    return {i: sync_waveform(sss(i // 3, i % 3), sample_rate, spacing) for i in (ids if ids is not None else range(1008))}


def correlate_waves(blocks: DataFrame, waves: dict[int, np.ndarray], starts: tuple[int, ...], lags: int, period: int, mean: bool = False, one_block: bool = False) -> DataFrame:
    """Correlation of every period of ``period`` samples with every wave, at ``lags`` lags behind each start: a row per id, period, beam and lag.

    Periods are numbered from the capture's beginning, however its blocks are cut, and a period that its end cuts short counts if it is the only
    one. With ``mean`` the power is averaged over ids and beams inside the kernel: a row (p) per period and lag. Memory holds one period and
    the waves' transforms, whose size follows the lags.
    """
    longest = max(len(w) for w in waves.values())
    n = 1 << (lags + longest - 2).bit_length()
    ids = list(waves)
    conj = np.conj(np.stack([np.fft.fft(waves[i], n) for i in ids]))
    names = [*KEYS, "block", "lag", "p"] if mean else [*KEYS, "cell_id", "block", "beam", "lag", "re", "im"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cap, port, k, pieces in chunk_rows(b):
                x, own, _ = chunk_samples(pieces, k * period, period, 0, 0)
                if own < period and k:
                    continue
                power = np.zeros(lags)
                for beam, s in enumerate(starts):
                    part = x[s : s + lags + longest - 1]
                    r = np.fft.ifft(np.fft.fft(part, n) * conj, axis=1)[:, : min(lags, max(0, own - s))]
                    if mean:
                        power[: r.shape[1]] += (np.abs(r) ** 2).sum(axis=0)
                        continue
                    for cell, y in zip(ids, r, strict=True):
                        if len(y):
                            full = lambda v, t: pa.array(np.full(len(y), v), t)  # noqa: E731, B023
                            yield pa.RecordBatch.from_arrays([full(cap, pa.int64()), full(port, pa.int32()), full(cell, pa.int32()), full(k, pa.int32()), full(beam, pa.int32()), pa.array(np.arange(len(y), dtype=np.int64)), pa.array(y.real), pa.array(y.imag)], names=names)
                if mean:
                    full = lambda v, t: pa.array(np.full(lags, v), t)
                    yield pa.RecordBatch.from_arrays([full(cap, pa.int64()), full(port, pa.int32()), full(k, pa.int32()), pa.array(np.arange(lags, dtype=np.int64)), pa.array(power / (len(ids) * len(starts)))], names=names)

    rows = chunks(blocks, period, one_block=one_block).select(F.col("capture_id").cast("long"), F.col("port").cast("int"), "chunk", "pieces")
    return rows.mapInArrow(run, "capture_id long, port int, block int, lag long, p double" if mean else "capture_id long, port int, cell_id int, block int, beam int, lag long, re double, im double")


def correlate(blocks: DataFrame, kind: str, sample_rate: float, spacing: float, symbols: tuple[int, ...], period: float = 0.02, max_lag_symbols: int = 4, ids: tuple[int, ...] | None = None, mean: bool = False) -> DataFrame:
    """Correlation of every discovery period with every PSS or SSS sequence at the synchronisation rate; the SSS stands two symbols later."""
    size = sync_sizes(sample_rate, spacing, max_lag_symbols)
    later = size["secondary"] if kind == "sss" else 0
    starts = tuple(s * size["symbol"] + later for s in symbols)
    if kind == "sss" and ids is None:
        return correlate_sss(blocks, sample_rate, spacing, starts, size["lags"], round(period * sample_rate), mean)
    return correlate_waves(blocks, templates(kind, sample_rate, spacing, ids), starts, size["lags"], round(period * sample_rate), mean)


def correlate_sss(blocks: DataFrame, sample_rate: float, spacing: float, starts: tuple[int, ...], lags: int, period: int, mean: bool = False, one_block: bool = False) -> DataFrame:
    """:func:`correlate_waves` with all 1008 secondary sequences, by their structure.

    An SSS is the product of two sequences of 127 values, each turned by a shift of its own. So a lag needs the transform of its symbol once, a multiplication for each of
    the first sequence's nine shifts, and then one transform of length 127 that gives the correlations with all shifts of the second at once. Memory
    holds ``SSS_LAGS`` lags at a time.
    """
    prefix, nfft, bins = sync_bins(sample_rate, spacing)
    first, second = sss_parts()
    turned = np.stack([np.roll(first, -(15 * a + 5 * b)) for a in range(3) for b in range(3)]) / np.sqrt(127)
    spectrum = np.fft.fft(second)
    # (a, b, shift of the second) to the cell id 3 (112 a + shift) + b.
    ids = (3 * (112 * np.arange(3)[:, None, None] + np.arange(112)) + np.arange(3)[None, :, None]).reshape(-1)
    order = np.argsort(ids)
    names = [*KEYS, "block", "lag", "p"] if mean else [*KEYS, "cell_id", "block", "beam", "lag", "re", "im"]

    def correlations(symbols: np.ndarray) -> np.ndarray:
        """(lags, 1008): all ids for each row of samples."""
        y = np.fft.fft(symbols, axis=1)[:, bins]
        z = y[:, None, :] * turned
        r = np.fft.ifft(np.conj(np.fft.fft(np.conj(z), axis=2)) * spectrum, axis=2)[:, :, :112]
        return r.reshape(len(symbols), -1)[:, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cap, port, k, pieces in chunk_rows(b):
                x, own, _ = chunk_samples(pieces, k * period, period, 0, 0)
                if own < period and k:
                    continue
                power = np.zeros(lags)
                for beam, s in enumerate(starts):
                    part = x[s + prefix : s + prefix + lags + nfft - 1]
                    windows = np.lib.stride_tricks.sliding_window_view(np.pad(part, (0, lags + nfft - 1 - len(part))), nfft)
                    for lo in range(0, min(lags, max(0, own - s)), SSS_LAGS):
                        r = correlations(windows[lo : min(lo + SSS_LAGS, lags, own - s)])
                        if mean:
                            power[lo : lo + len(r)] += (np.abs(r) ** 2).sum(axis=1)
                            continue
                        n = r.size
                        full = lambda v, t: pa.array(np.full(n, v), t)  # noqa: E731, B023
                        cell, lag = np.tile(np.arange(1008, dtype=np.int32), len(r)), np.repeat(np.arange(lo, lo + len(r)), 1008)
                        flat = r.reshape(-1)
                        yield pa.RecordBatch.from_arrays([full(cap, pa.int64()), full(port, pa.int32()), pa.array(cell), full(k, pa.int32()), full(beam, pa.int32()), pa.array(lag), pa.array(np.ascontiguousarray(flat.real)), pa.array(np.ascontiguousarray(flat.imag))], names=names)
                if mean:
                    full = lambda v, t: pa.array(np.full(lags, v), t)
                    yield pa.RecordBatch.from_arrays([full(cap, pa.int64()), full(port, pa.int32()), full(k, pa.int32()), pa.array(np.arange(lags, dtype=np.int64)), pa.array(power / (1008 * len(starts)))], names=names)

    rows = chunks(blocks, period, one_block=one_block).select(F.col("capture_id").cast("long"), F.col("port").cast("int"), "chunk", "pieces")
    return rows.mapInArrow(run, "capture_id long, port int, block int, lag long, p double" if mean else "capture_id long, port int, cell_id int, block int, beam int, lag long, re double, im double")


#: Lags whose correlations with all secondary sequences are held at a time.
SSS_LAGS = 256


def ssb_sizes(fs_in: float, fs_out: float, spacing: float) -> tuple[int, int]:
    """Transform sizes (before, after) by which a capture comes to the synchronisation rate: an eighth of a symbol, in thirds for the overlap."""
    down = round(fs_in / spacing / 8)
    up = round(down * fs_out / fs_in)
    return (3 * down, 3 * up) if up % 3 else (down, up)


def ssb_iq(blocks: DataFrame, fs_in: float, fs_out: float, spacing: float, frequency_offset: float = 0.0, delay: float = 0.0, max_blocks: int | None = None, discovery: float = 0.02, sizes: tuple[int, int] | None = None, one_block: bool = False) -> DataFrame:
    """The synchronisation blocks' band: ``frequency_offset`` (any frequency) moved to zero and resampled to ``fs_out``, from ``delay`` on, for ``max_blocks`` discovery periods."""
    from_ = round(delay * fs_in)
    wanted = F.lit(round(max_blocks * discovery * fs_in)) if max_blocks is not None else F.lit((1 << 62) - from_)
    late = cut(blocks, F.lit(from_), wanted) if from_ or max_blocks is not None else blocks
    down, up = sizes or ssb_sizes(fs_in, fs_out, spacing)
    if abs(up / down - fs_out / fs_in) > 1e-9:
        raise ValueError(f"{down} and {up} don't hold the ratio of {fs_in:g} and {fs_out:g}")
    # A block that the delay cut stands at the capture's new beginning.
    return corrected(late.withColumn("spec", spec_column(fs=fs_in, nfft=down, nfft_out=up, shift=frequency_offset, window="blackman")), one_block=one_block)


def completed(correlation: DataFrame, captures: DataFrame, cells: tuple[int, ...], blocks: int, beams: int, lags: int) -> DataFrame:
    """A dense grid of correlations: zeros for the captures (capture_id, port) in which nothing was measured, and for what is missing in others."""
    axis = lambda values, kind, name: F.explode((values if isinstance(values, Column) else F.array(*map(F.lit, values))).cast(f"array<{kind}>")).alias(name)
    grid = captures.select(F.col("capture_id").cast("long"), F.col("port").cast("int")).distinct()
    for values, kind, name in ((cells, "int", "cell_id"), (range(blocks), "int", "block"), (range(beams), "int", "beam"), (F.sequence(F.lit(0), F.lit(lags - 1)), "long", "lag")):
        grid = grid.select("*", axis(values, kind, name))
    keys = [*KEYS, "cell_id", "block", "beam", "lag"]
    return grid.join(correlation, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("re", "im")))


def _middle(keys: list[str]) -> Column:
    """``__middle``: whether a row's p is one of the one or two whose mean is the median of its group. Sorting takes no map of values for each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("p").asc_nulls_last()))
    count = F.count("p").over(Window.partitionBy(*keys))
    return ((place == F.floor((count + 1) / 2)) | (place == F.floor(count / 2) + 1)).alias("__middle")


def sync(correlation: DataFrame, sample_rate: float, half_width: int = 4, per_port: bool = True, delay: float = 0.0) -> DataFrame:
    """Delay in seconds of the best lag.

    Power is averaged over ids and beams, its median over periods is taken, lags under max(2 median, max / 2) are zeroed, and a
    triangular window over neighbouring lags weighs the rest; ties go to the lowest lag.
    """
    keys = list(KEYS) if per_port else ["capture_id"]
    p = correlation if "p" in correlation.columns else correlation.withColumn("p", F.col("re") ** 2 + F.col("im") ** 2)
    # Averaged rows are dealt by capture once, and all steps below stay where they lie; others are averaged before that.
    p = p.repartition(*keys) if "p" in correlation.columns else p
    mean = p.groupBy(*keys, "block", "lag").agg(F.avg("p").alias("p"))
    mean = mean if "p" in correlation.columns else mean.repartition(*keys)
    mean = mean.select(*keys, "lag", "p", _middle([*keys, "lag"])).where(F.col("__middle")).groupBy(*keys, "lag").agg(F.avg("p").alias("p"))
    each = Window.partitionBy(*keys)
    level = mean.select(*keys, "lag", "p", _middle(keys)).select(*keys, "lag", "p", F.avg(F.when(F.col("__middle"), F.col("p"))).over(each).alias("m"), F.max("p").over(each).alias("x"))
    kept = level.withColumn("p", F.when(F.col("p") >= F.greatest(2 * F.col("m"), F.col("x") / 2), F.col("p")).otherwise(0.0))
    w = each.orderBy("lag")
    smooth = sum((F.coalesce(F.lag("p", k).over(w) if k > 0 else F.lead("p", -k).over(w), F.lit(0.0)) if k else F.col("p")) * (1 - abs(k) / (half_width + 1)) for k in range(-half_width, half_width + 1))
    best = kept.withColumn("s", smooth).groupBy(*keys).agg(F.max_by("lag", F.struct("s", -F.col("lag"))).alias("lag"))
    return best.select(*keys, "lag", (F.lit(delay) + F.col("lag") / sample_rate).alias("delay"))


def align(iq: DataFrame, shifts: DataFrame, size: int) -> DataFrame:
    """Samples from each port's trigger lag on, ``size`` of them, numbered anew. The shifts grow with the captures, so Spark picks the join by their size."""
    lag = F.col("__lag")
    joined = iq.join(shifts.select(*KEYS, F.col("lag").alias("__lag")), list(KEYS)).where((F.col("n") >= lag) & (F.col("n") < lag + size))
    return joined.withColumn("n", F.col("n") - lag).drop("__lag")
