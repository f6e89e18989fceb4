"""Corrections of raw IQ blocks: scale, conjugate, FIR low-pass and rational resampling, as kernels over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import noise_bandwidth
from ..functions.windows import window as make_window
from .frames import KEYS, chunks


def kernel(blocks: DataFrame, func: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a function of one complex array to every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [func(np.asarray(b.column(3)[i].values, float) + 1j * np.asarray(b.column(4)[i].values, float)) for i in range(b.num_rows)]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([y.real for y in out], kind), pa.array([y.imag for y in out], kind)], names=[*KEYS, "n0", "re", "im"])

    rows = blocks.select(F.col("capture_id").cast("long"), F.col("port").cast("int"), F.col("n0").cast("long"), "re", "im")
    return rows.mapInArrow(run, "capture_id long, port int, n0 long, re array<double>, im array<double>")


#: Samples of a chunk where a caller names none.
CHUNK = 1 << 18


def chunk_samples(pieces: list[tuple[int, np.ndarray, np.ndarray]], first: int, size: int, left: int, right: int, unit: int = 1) -> tuple[np.ndarray, int, int]:
    """Samples of a chunk with their context, zeros where the capture has none; how many of its own it has, and where what is there ends.

    A chunk at a capture's end is as long as its samples, in whole ``unit``s.
    """
    end = max((n0 + len(re) for n0, re, _ in pieces), default=first)
    own = min(size, end - first)
    x = np.zeros(left + -(-max(0, own) // unit) * unit + right, complex)
    for n0, re, im in pieces:
        at = n0 - (first - left)
        x.real[at : at + len(re)] = re[: len(x) - at]
        x.imag[at : at + len(re)] = im[: len(x) - at]
    return x, own, end


def chunk_rows(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """capture, port, chunk and pieces of the first four columns, samples as arrays that aren't copied."""
    pieces = b.column(3)
    bounds, z = pieces.offsets.to_numpy(), pieces.values
    starts, lists = z.field("n0").to_numpy(), [z.field(c) for c in ("re", "im")]
    cuts, flat = [x.offsets.to_numpy() for x in lists], [x.values.to_numpy() for x in lists]
    for i, (cap, port, k) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
        yield cap, port, k, [(int(starts[j]), *(f[c[j] : c[j + 1]] for f, c in zip(flat, cuts, strict=True))) for j in range(bounds[i], bounds[i + 1])]


def sample_batch(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    """One batch of blocks from (capture, port, n0, samples)."""
    x = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, complex)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]), pa.int32())
    heads = [pa.array([r[c] for r in rows], t) for c, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()))]
    return pa.RecordBatch.from_arrays([*heads, *(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(v))) for v in (x.real, x.imag))], names=[*KEYS, "n0", "re", "im"])


BLOCKS = "capture_id long, port int, n0 long, re array<double>, im array<double>"
#: Samples after which a kernel hands a batch on.
BATCH_SAMPLES = 1 << 20


def batched(rows: Iterator[tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[3])
        if n >= BATCH_SAMPLES:
            yield sample_batch(held)
            held, n = [], 0
    if held:
        yield sample_batch(held)


def chunk_kernel(blocks: DataFrame, func: Callable[[np.ndarray], np.ndarray], size: int, left: int, right: int, ratio: Fraction = Fraction(1), one_block: bool = False, unit: int = 1) -> DataFrame:
    """A function of samples with their context, applied to chunks: the result doesn't depend on how a capture is cut.

    ``func`` gets ``left`` samples before the chunk, the chunk (a capture's last one in whole ``unit``s) and ``right`` samples behind it, and returns the
    chunk's own output, ``ratio`` samples a sample. Beyond the ends of a capture, and in its gaps, samples are zero.
    """
    if (size * ratio).denominator != 1:
        raise ValueError("a chunk must give a whole number of samples")

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for b in batches:
            for cap, port, k, pieces in chunk_rows(b):
                x, own, _ = chunk_samples(pieces, k * size, size, left, right, unit)
                if own > 0:  # else context alone: the capture ended before
                    yield cap, port, int(k * size * ratio), func(x)[: int(own * ratio)]

    rows = chunks(blocks, size, left, right, one_block=one_block).select(F.col("capture_id").cast("long"), F.col("port").cast("int"), "chunk", "pieces")
    return rows.mapInArrow(lambda batches: batched(outputs(batches)), BLOCKS)


def conjugate(blocks: DataFrame, flag: str) -> DataFrame:
    """Blocks with the imaginary part negated where the boolean column ``flag`` holds."""
    return blocks.withColumn("im", F.when(F.col(flag), F.transform("im", lambda x: -x)).otherwise(F.col("im")))


def scaled(blocks: DataFrame, factor: float) -> DataFrame:
    return blocks.withColumn("re", F.transform("re", lambda x: x * factor)).withColumn("im", F.transform("im", lambda x: x * factor))


def fir_lowpass(bandwidth: float, fs: float, taps: int = 4001, transition: float = 250e3) -> np.ndarray:
    """Least-squares linear-phase low-pass: unit gain to the band's edge, zero after a linear transition."""
    if taps % 2 == 0:
        raise ValueError("an odd number of taps is needed")
    half = taps // 2
    lo, hi = max(bandwidth / 2 - transition / 2, 0.0) / fs, min(bandwidth / 2 + transition / 2, fs / 2) / fs
    n = np.arange(1, half + 1)
    # The unweighted least-squares answer over the whole axis is the ideal response's Fourier series, transition included.
    with np.errstate(invalid="ignore", divide="ignore"):
        h = (np.cos(2 * np.pi * lo * n) - np.cos(2 * np.pi * hi * n)) / (2 * np.pi**2 * n**2 * (hi - lo))
    return np.concatenate([h[::-1], [lo + hi], h])


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Samples of the convolution that depend on no sample beyond ``x``."""
    n = 1 << (len(x) - 1).bit_length()
    return np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(h, n))[len(h) - 1 : len(x)]


def filtered(blocks: DataFrame, bandwidth: float, fs: float, taps: int = 4001, transition: float = 250e3, size: int = CHUNK, one_block: bool = False) -> DataFrame:
    """Linear-phase low-pass without delay; chunks carry half the taps on either side."""
    h = fir_lowpass(bandwidth, fs, taps, transition)
    return chunk_kernel(blocks, lambda x: convolve(x, h), size, taps // 2, taps // 2, one_block=one_block)


#: Overlaps at which the shifted copies of a window add up to a constant.
OVERLAPS = {"rect": Fraction(0), "hamming": Fraction(1, 2), "blackman": Fraction(2, 3), "blackmanharris": Fraction(4, 5)}


def oa_window(window: str, nfft: int, nfft_out: int) -> tuple[np.ndarray, int, int]:
    """The window whose copies a hop apart add up to one, and the hops before and after resampling."""
    hop = nfft * (1 - OVERLAPS[window])
    ratio = Fraction(nfft_out, nfft)
    if hop.denominator != 1 or (hop * ratio).denominator != 1 or nfft % 2 or nfft_out % 2:
        raise ValueError(f"{nfft} and {nfft_out} must be even and leave whole hops under a {window} window")
    w = np.ones(nfft) if window == "rect" else make_window(window, nfft, normalise=False)
    return w / (w.sum() / int(hop)), int(hop), int(hop * ratio)


def oa_frames(x: np.ndarray, w: np.ndarray, held: np.ndarray, hop: int, nfft_out: int, hop_out: int, shift: int) -> np.ndarray:
    """Sum of the inverse transforms of windowed frames of ``x``, whose first begins with it; a sample is whole where all frames over it are there."""
    nfft = len(w)
    frames = np.lib.stride_tricks.sliding_window_view(x, nfft)[::hop]
    y = np.roll(np.fft.fftshift(np.fft.fft(frames * w, axis=1), axes=1) * held, -shift, axis=1)
    if nfft_out <= nfft:
        y = y[:, (nfft - nfft_out) // 2 : (nfft + nfft_out) // 2]
    else:
        y = np.pad(y, ((0, 0), ((nfft_out - nfft) // 2,) * 2))
    y = np.fft.ifft(np.fft.ifftshift(y, axes=1), axis=1) * (nfft_out / nfft)
    out = np.zeros(len(frames) * hop_out + nfft_out, complex)
    for part in range(0, nfft_out, hop_out):  # frames side by side, one part of them at a time
        out[part : part + len(frames) * hop_out] += y[:, part : part + hop_out].ravel()
    return out


def oa_filter(blocks: DataFrame, fs: float, nfft: int, passband: tuple[float, float], window: str = "hamming", nfft_out: int | None = None, shift: int = 0, margin: float | None = None, size: int = CHUNK, one_block: bool = False) -> DataFrame:
    """Band-pass by overlapped transforms: frames are windowed, bins outside the band are zeroed, and the inverse frames are added up.

    With ``nfft_out`` only that many bins around bin ``shift`` are kept (or zeros are added), which resamples by nfft_out / nfft. The band is narrowed by
    ``margin`` on either side, the window's noise bandwidth if none is given. Chunks carry the frames that reach over their ends, so the
    result doesn't depend on the cuts; beyond a capture samples are zero.
    """
    nfft_out = nfft_out or nfft
    w, hop, hop_out = oa_window(window, nfft, nfft_out)
    edge = (0.0 if window == "rect" else noise_bandwidth(window, nfft_out)) if margin is None else margin
    f = (np.arange(nfft) - nfft // 2) * fs / nfft
    held = (f >= passband[0] + edge) & (f <= passband[1] - edge)
    lead, ratio = nfft - hop, Fraction(nfft_out, nfft)

    def run(x: np.ndarray) -> np.ndarray:
        return oa_frames(x, w, held, hop, nfft_out, hop_out, shift)[int(lead * ratio) :]

    return chunk_kernel(blocks, run, max(1, size // hop) * hop, lead, lead, ratio, one_block, hop)


def oa_resample(blocks: DataFrame, fs: float, nfft: int, nfft_out: int, window: str = "hamming", bandwidth: float = float("inf"), shift: int = 0, size: int = CHUNK, one_block: bool = False) -> DataFrame:
    """Rational resampling by nfft_out / nfft through overlapped transforms, with a band-pass of ``bandwidth`` around zero on the way."""
    half = bandwidth / 2 if bandwidth != float("inf") else float("inf")
    return oa_filter(blocks, fs, nfft, (-half, half), window, nfft_out, shift, 0.0, size, one_block)


def fractional_delay(x: np.ndarray, delay: float) -> np.ndarray:
    """Samples later by a fraction of one, through the spectrum's phase; the ends meet."""
    n = len(x)
    return np.fft.ifft(np.fft.fft(x) * np.exp(-2j * np.pi * np.fft.fftfreq(n) * delay))


def delayed(blocks: DataFrame, delay: Column) -> DataFrame:
    """Each block later by its own fraction of samples (``delay``, a column), through its spectrum's phase; for captures of one block, whose ends meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples = [np.asarray(b.column(3)[i].values, float) + 1j * np.asarray(b.column(4)[i].values, float) for i in range(b.num_rows)]
            heads = [b.column(c).to_pylist() for c in range(3)]
            yield sample_batch([(*h, fractional_delay(x, d)) for *h, x, d in zip(*heads, samples, b.column(5).to_pylist(), strict=True)])

    rows = blocks.select(F.col("capture_id").cast("long"), F.col("port").cast("int"), F.col("n0").cast("long"), "re", "im", delay.cast("double").alias("__delay"))
    return rows.mapInArrow(run, BLOCKS)


def turned(blocks: DataFrame, frequency: Column, fs: Column) -> DataFrame:
    """Blocks moved by a frequency (a column, as the rate is), by the capture's own clock: blocks fit together. Expressions only."""
    cycles = lambda i: F.pmod(frequency / fs * (F.col("n0") + i), F.lit(1.0)) * (2 * math.pi)
    z = F.transform(F.arrays_zip("re", "im"), lambda x, i: F.struct((x["re"] * F.cos(cycles(i)) - x["im"] * F.sin(cycles(i))).alias("re"), (x["re"] * F.sin(cycles(i)) + x["im"] * F.cos(cycles(i))).alias("im")))
    return blocks.withColumn("__z", z).withColumns({c: F.col(f"__z.{c}") for c in ("re", "im")}).drop("__z")


def corrected(blocks: DataFrame, fs: float, scale: float = 1.0, conjugate_column: str | None = None, bandwidth: float = float("inf"), taps: int = 4001, transition: float = 250e3, resample_to: tuple[int, int] | None = None, window: str = "hamming", size: int = CHUNK) -> DataFrame:
    """The corrections of a capture in their order: voltage scale or resampling (nfft, nfft_out), conjugation by a flag column, FIR low-pass."""
    out = scaled(blocks, scale)
    if conjugate_column:
        out = conjugate(out, conjugate_column)
    if resample_to:
        nfft, nfft_out = resample_to
        out = oa_resample(out, fs, nfft, nfft_out, window, bandwidth, 0, size)
        fs = fs * nfft_out / nfft
    if bandwidth != float("inf"):
        out = filtered(out, bandwidth, fs, taps, transition, size)
    return out


def shaped(spectra: DataFrame, taps: np.ndarray, nfft: int) -> DataFrame:
    """Power per centred bin ``k`` behind a filter of at most ``nfft`` taps; the table that is broadcast has ``nfft`` rows."""
    if len(taps) > nfft:
        raise ValueError("the filter is longer than the transform")
    gain = np.abs(np.fft.fftshift(np.fft.fft(taps, nfft))) ** 2
    table = spectra.sparkSession.createDataFrame([(k, float(g)) for k, g in enumerate(gain)], "k long, __gain double")
    return spectra.join(F.broadcast(table), "k").withColumn("power", F.col("power") * F.col("__gain")).select(*spectra.columns)


def _landen(k: float) -> list[float]:
    """Descending moduli of Landen's transformation."""
    out = []
    while k > 1e-16 and len(out) < 40:
        k = (k / (1 + np.sqrt(1 - k * k))) ** 2
        out.append(float(k))
    return out


def _jacobi(start: np.ndarray, k: float) -> np.ndarray:
    """cd or sn of a quarter-period argument from its cosine or sine."""
    for v in reversed(_landen(k)):
        start = (1 + v) * start / (1 + v * start**2)
    return start


def _arc_sn(w: complex, k: float) -> complex:
    """Quarter-period argument of an sn value."""
    before = k
    for v in _landen(k):
        w = 2 * w / ((1 + np.sqrt(1 - (w * before) ** 2)) * (1 + v))
        before = v
    return 2 * np.arcsin(w + 0j) / np.pi


def elliptic(passband: float, stopband: float, ripple: float, attenuation: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the digital elliptic low-pass of least order; edges in cycles a sample, losses in decibels."""
    if not 0 < passband < stopband < 0.5:
        raise ValueError("0 < passband < stopband < half the sample rate is needed")
    e_pass, e_stop = (np.sqrt(10 ** (x / 10) - 1) for x in (ripple, attenuation))
    edge, k1 = np.tan(np.pi * passband), e_pass / e_stop
    selectivity = edge / np.tan(np.pi * stopband)
    other = np.sqrt(1 - k1 * k1)
    for order in range(1, 60):
        u = (2 * np.arange(1, order // 2 + 1) - 1) / order
        away = other**order * np.prod(_jacobi(np.sin(u * np.pi / 2), other)) ** 4
        k = float(np.sqrt(1 - min(1.0, away) ** 2))
        if k >= selectivity:
            break
    v0 = -1j / order * _arc_sn(1j / e_pass, k1)
    zeros = 1j / (k * _jacobi(np.cos(u * np.pi / 2), k))
    poles = 1j * _jacobi(np.cos((u - 1j * v0) * np.pi / 2), k)
    zeros, poles = np.concatenate([zeros, zeros.conj()]), np.concatenate([poles, poles.conj()])
    if order % 2:
        poles = np.append(poles, 1j * _jacobi(np.sin(1j * v0 * np.pi / 2), k))
    bilinear = lambda s: (1 + s * edge) / (1 - s * edge)
    z, p = np.append(bilinear(zeros), -np.ones(order % 2)), bilinear(poles)
    level = 1.0 if order % 2 else 10 ** (-ripple / 20)
    return z, p, float(level * abs(np.prod(1 - p) / np.prod(1 - z)))


def iir_response(passband: float, stopband: float, ripple: float, attenuation: float, floor: float = 1e-10) -> np.ndarray:
    """Impulse response of :func:`elliptic` up to where it stays under ``floor``: convolution with it is the recursion, without its state."""
    z, p, gain = elliptic(passband, stopband, ripple, attenuation)
    size = 1 << max(8, int(np.log(floor / 1e6) / np.log(np.abs(p).max())).bit_length())
    w = np.exp(-2j * np.pi * np.arange(size) / size)
    h = np.fft.ifft(gain * np.prod(1 - np.multiply.outer(w, z), axis=1) / np.prod(1 - np.multiply.outer(w, p), axis=1)).real
    return h[: int(np.flatnonzero(np.abs(h) > floor * np.abs(h).max())[-1]) + 1]


def iir_lowpass(blocks: DataFrame, bandwidth: float, fs: float, ripple: float = 0.1, attenuation: float = 60.0, transition: float = 250e3, size: int = CHUNK) -> DataFrame:
    """Causal elliptic low-pass, at rest before a capture; chunks carry the response's length before them."""
    h = iir_response(bandwidth / 2 / fs, (bandwidth / 2 + transition) / fs, ripple, attenuation)
    return chunk_kernel(blocks, lambda x: convolve(x, h), size, len(h) - 1, 0)


def resample(x: np.ndarray, num: int, shift: int = 0, scale: float = 1.0) -> np.ndarray:
    """Fourier resampling: the spectrum is cut or padded around ``shift`` bins."""
    if len(x) % 2:
        raise ValueError("an even number of samples is needed")
    y = np.roll(np.fft.fftshift(np.fft.fft(x)), -shift)
    n = len(x)
    if num <= n:
        first = n // 2 - num // 2
        y = y[first : first + num]
    else:
        lead = num // 2 - n // 2
        y = np.concatenate([np.zeros(lead), y, np.zeros(num - n - lead)])
    return np.fft.ifft(np.fft.ifftshift(y)) * (num / n) * scale


def resampled(blocks: DataFrame, up: int, down: int, shift: int = 0) -> DataFrame:
    """Fourier resampling of each block by itself, for captures of one block; :func:`oa_resample` is for longer ones."""
    ratio = Fraction(up, down)
    return kernel(blocks, lambda x: resample(x, int(len(x) * ratio), shift))


def design_resampler(base: float, target: float, divisor: int = 2, bandwidth: float = 0.0, lo_bandwidth: float = 0.0, oversampling: float = 1.1, least: int = 8191) -> dict:
    """Receiver rate and transform sizes of a rational resampler whose windows add up to a constant."""
    need = target if not lo_bandwidth else target + oversampling * bandwidth / 2 + lo_bandwidth / 2
    fs = base / int(base / need)
    ratio = Fraction(fs / target).limit_denominator(10_000)
    n = least + 1
    while (n * ratio).denominator != 1 or (n % 2 and n > 100 and all(n % p for p in range(3, int(n**0.5) + 1, 2))):
        n += 1
    offset = (bandwidth + lo_bandwidth) / 2 if lo_bandwidth else 0.0
    return {"fs_sdr": fs, "nfft": int(n * ratio) * divisor, "nfft_out": n * divisor, "lo_offset": offset}


def upfirdn(blocks: DataFrame, h: np.ndarray, up: int = 1, down: int = 1, size: int = CHUNK, one_block: bool = False, full: bool = False) -> DataFrame:
    """Zero-stuffing by ``up``, filter ``h`` and every ``down``-th sample, by polyphase branches: no stuffed zero is multiplied.

    A capture gives as many samples as its length holds, or with ``full`` also those that ring on behind its end: all ``ceil(((n - 1) up + len(h)) / down)``. For these
    only the captures' lengths are aggregated; a block of zeros is put behind each.
    """
    h = np.asarray(h, float)
    if full:
        most = -(-len(h) // up)
        ends = blocks.groupBy(*KEYS).agg(F.max(F.col("n0") + F.size("re")).cast("long").alias("n0"))
        zeros = F.array_repeat(F.lit(0.0), most + size)  # up to the next chunk's end, so that it is whole
        tail = ends.select(*KEYS, "n0", zeros.alias("re"), zeros.alias("im"))
        own = blocks.select(*KEYS, F.col("n0").cast("long").alias("n0"), F.col("re").cast("array<double>").alias("re"), F.col("im").cast("array<double>").alias("im"))
        out = upfirdn(own.unionByName(tail), h, up, down, size)
        wanted = F.ceil(((F.col("__end") - 1) * up + len(h)) / down).cast("long")
        held = out.join(ends.withColumnRenamed("n0", "__end"), list(KEYS)).withColumn("__keep", F.greatest(F.least(wanted - F.col("n0"), F.size("re").cast("long")), F.lit(0)).cast("int"))
        part = lambda c: F.slice(c, F.lit(1), F.col("__keep")).alias(c)
        return held.where("__keep > 0").select(*KEYS, "n0", part("re"), part("im"))
    h = np.pad(h, (0, max(0, up - len(h))))
    left = -(-(len(h) - 1) // up)

    def run(x: np.ndarray) -> np.ndarray:
        at = np.arange((len(x) - left) * up // down) * down + left * up
        y = np.empty(len(at), complex)
        for phase in np.unique(at % up):
            mine = at % up == phase
            taps = h[phase::up]
            padded = np.concatenate([np.zeros(len(taps) - 1), x])
            y[mine] = convolve(padded, taps)[at[mine] // up]
        return y

    return chunk_kernel(blocks, run, size, left, 0, Fraction(up, down), one_block)
