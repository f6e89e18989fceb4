"""Corrections of captures of many specs in one plan: designs as columns, one kernel, trimming, triggers and alignment on blocks.

Blocks carry the spec of their capture in a struct column ``spec`` (:data:`SPEC`), put there by the source or by :func:`with_specs`. Sizes of chunks and of
their context are expressions over that column, so captures of all specs share one exchange, and a worker makes each distinct design once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import BLOCKS, CHUNK, batched, chunk_rows, chunk_samples, convolve, fir_lowpass, oa_frames, oa_window
from .frames import KEYS, chunks

#: What a correction needs to know: rate of the samples, voltage scale, conjugation, transform sizes of the resampler (equal: none) and the frequency that it
#: moves to zero, analysis bandwidth (infinite: none), taps and transition of the low-pass, overlap window.
SPEC = "struct<fs:double,scale:double,conjugate:boolean,nfft:int,nfft_out:int,shift:double,bandwidth:double,taps:int,transition:double,window:string>"
DEFAULTS = {"scale": 1.0, "conjugate": False, "nfft": 1, "nfft_out": 1, "shift": 0.0, "bandwidth": float("inf"), "taps": 4001, "transition": 250e3, "window": "hamming"}
#: Frames a hop apart at which a window's copies add up: one, two, three or five to a transform. Fixed by the windows' spectra.
DIVISORS = {"rect": 1, "hamming": 2, "blackman": 3, "blackmanharris": 5}
MOST_NFFT = 1 << 17


def spec_column(**columns: Column | str | float | bool) -> Column:
    """The struct of :data:`SPEC` from columns or constants by name; what isn't named has its default. ``fs`` is needed."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = {k: as_column(v) for k, v in (DEFAULTS | columns).items()}
    names = [f.split(":")[0] for f in SPEC[7:-1].split(",")]
    if set(given) != set(names):
        raise ValueError(f"a spec has the fields {names}")
    return F.struct(*(given[n].alias(n) for n in names)).cast(SPEC)


def with_specs(blocks: DataFrame, captures: DataFrame, keys: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """Blocks with the ``spec`` of their capture. Spark picks the join by the captures' size; a block without a capture goes."""
    return blocks.join(captures.select(*keys, "spec"), list(keys))


def resampling(spec: Column) -> Column:
    return spec.nfft != spec.nfft_out


def _hop(spec: Column, size: str) -> Column:
    divisor = F.create_map(*(F.lit(x) for kv in DIVISORS.items() for x in kv))[spec.window]
    return F.when(resampling(spec), F.floor(spec[size] / divisor)).otherwise(1).cast("long")


def contexts(spec: Column, size: int) -> tuple[Column, Column]:
    """Samples of a chunk and of its context on either side: the resampler's overlap and what the low-pass needs of its output."""
    hop, hop_out = _hop(spec, "nfft"), _hop(spec, "nfft_out")
    half = F.when(spec.bandwidth < float("inf"), F.floor(spec.taps / 2)).otherwise(0)
    lead = F.when(resampling(spec), spec.nfft - hop).otherwise(0)
    return F.greatest(F.floor(F.lit(size) / hop), F.lit(1)) * hop, (lead + F.ceil(half / hop_out) * hop).cast("long")


class Design:
    """The correction of one spec."""

    def __init__(self, fs: float, scale: float, conjugate: bool, nfft: int, nfft_out: int, shift: float, bandwidth: float, taps: int, transition: float, window: str):
        self.fs, self.scale, self.conjugate, self.resamples = fs, scale, conjugate, nfft != nfft_out
        self.ratio, self.hop, self.lead = Fraction(1), 1, 0
        if self.resamples:
            self.ratio, self.nfft_out = Fraction(nfft_out, nfft), nfft_out
            self.w, self.hop, self.hop_out = oa_window(window, nfft, nfft_out)
            self.lead = nfft - self.hop
            self.shift = shift
            f = (np.arange(nfft) - nfft // 2) * fs / nfft
            self.held = (f >= -bandwidth / 2) & (f <= bandwidth / 2)
        elif shift:
            raise ValueError("a shift needs a resampler")
        self.h = fir_lowpass(bandwidth, fs * float(self.ratio), taps, transition) if bandwidth < float("inf") else None
        self.half = 0 if self.h is None else taps // 2
        self.pad = -(-self.half // int(self.hop * self.ratio)) * self.hop

    def correct(self, x: np.ndarray, first: int, own: int, end: int) -> np.ndarray:
        """Output of the ``own`` samples from ``first`` on; ``x`` has the context before and behind them, and the capture ends at ``end`` or behind ``x``."""
        y = x * self.scale
        if self.resamples:
            if self.shift:  # by the capture's own clock, so that frames and chunks fit together; it need not be a whole bin
                n = np.arange(len(x)) + first - self.lead - self.pad
                y = y * np.exp(-2j * np.pi * np.fmod(self.shift / self.fs * n, 1.0))
            whole = len(x) - 2 * self.lead
            y = oa_frames(y, self.w, self.held, self.hop, self.nfft_out, self.hop_out, 0)[int(self.lead * self.ratio) :][: int(whole * self.ratio)]
        if self.conjugate:
            y = np.conj(y)
        if self.h is None:
            return y[: int(own * self.ratio)]
        # The low-pass sees zeros beyond the capture's ends, not what the resampler rings there.
        at = np.arange(len(y)) + int((first - self.pad) * self.ratio)
        y[(at < 0) | (at >= int(end * self.ratio))] = 0
        skip = int(self.pad * self.ratio) - self.half
        return convolve(y, self.h)[skip : skip + int(own * self.ratio)]


@lru_cache(256)
def design_of(*spec: float | str) -> Design:
    """The design of one spec, its values in the order of :data:`SPEC`; a worker keeps the last ones."""
    return Design(*spec)


def corrected(blocks: DataFrame, size: int = CHUNK, one_block: bool = False) -> DataFrame:
    """Blocks after scale or resampling (with the shift of a band to zero), conjugation and low-pass, each by its own ``spec``; at most one exchange.

    Equal to a call of each step for each spec's captures. ``n0`` counts output samples. A null spec raises.
    """
    spec = F.when(F.col("spec").isNull(), F.raise_error(F.lit("a block has no spec")).cast(SPEC)).otherwise(F.col("spec"))
    chunk, context = contexts(F.col("spec"), size)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for b in batches:
            specs = b.column(4).to_pylist()
            for (cap, port, k, pieces), s, n in zip(chunk_rows(b), specs, b.column(5).to_pylist(), strict=True):
                d = design_of(*s.values())
                around = d.lead + d.pad
                x, own, end = chunk_samples(pieces, k * n, n, around, around, d.hop)
                if own > 0:
                    yield cap, port, int(k * n * d.ratio), d.correct(x, k * n, own, end)

    rows = blocks.withColumn("spec", spec).withColumns({"__chunk": chunk, "__context": context})
    cut = chunks(rows, F.col("__chunk"), F.col("__context"), F.col("__context"), ("spec", "__chunk"), one_block)
    rows = cut.select(F.col("capture_id").cast("long"), F.col("port").cast("int"), "chunk", "pieces", "spec", "__chunk")
    return rows.mapInArrow(lambda batches: batched(outputs(batches)), BLOCKS)


def cut(blocks: DataFrame, start: Column, size: Column) -> DataFrame:
    """The ``size`` samples of each capture from ``start`` on, numbered anew, by slices of its blocks where they lie."""
    lo = F.greatest(start - F.col("n0"), F.lit(0)).cast("int")
    hi = F.least(start + size - F.col("n0"), F.size("re").cast("long")).cast("int")
    part = lambda c: F.slice(c, F.col("__lo") + 1, F.col("__hi") - F.col("__lo"))
    rows = blocks.withColumns({"__start": start, "__lo": lo, "__hi": hi}).where("__hi > __lo")
    return rows.withColumns({"n0": (F.col("n0") + F.col("__lo") - F.col("__start")).cast("long"), "re": part("re"), "im": part("im")}).drop("__start", "__lo", "__hi")


def aligned(blocks: DataFrame, lags: DataFrame, size: int | Column, strict: bool = True) -> DataFrame:
    """``size`` samples of every port from its lag (in samples) on: blocks are renumbered and sliced, no sample leaves its block.

    ``size`` may be a column of ``lags``. With ``strict`` a port that ends too early raises; one without a lag is left out. The lags and ends have a row a port, so Spark
    broadcasts them where they are few.
    """
    size = F.lit(size) if isinstance(size, int) else size
    wanted = lags.select(*KEYS, F.col("lag").cast("long").alias("__lag"), size.cast("long").alias("__wanted"))
    if strict:
        ends = blocks.groupBy(*KEYS).agg(F.max(F.col("n0") + F.size("re")).alias("__end"))
        short = F.raise_error(F.concat(F.lit("capture "), F.col("capture_id").cast("string"), F.lit(" is too short to align"))).cast("long")
        wanted = wanted.join(ends, list(KEYS)).withColumn("__lag", F.when(F.col("__end") >= F.col("__lag") + F.col("__wanted"), F.col("__lag")).otherwise(short)).drop("__end")
    joined = blocks.join(wanted, list(KEYS))
    return cut(joined, F.col("__lag"), F.col("__wanted")).select(*blocks.columns)


# triggers ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trigger:
    """A measurement that gives each port's lag. ``lags(blocks, **spec)`` returns capture_id, port, lag in samples; ``max_lag(**spec)`` the largest one in seconds."""

    name: str
    measurement: str
    lags: Callable[..., DataFrame]
    max_lag: Callable[..., float]


TRIGGERS: dict[str, Trigger] = {}


def register_trigger(name: str, measurement: str, max_lag: Callable[..., float]) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Make a function of blocks a trigger that the analysis of ``measurement`` sets up."""

    def put(lags: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in TRIGGERS:
            raise ValueError(f"there is a trigger {name} already")
        TRIGGERS[name] = Trigger(name, measurement, lags, max_lag)
        return lags

    return put


def resolve_trigger(name: str | dict | None, analysis: dict[str, dict] | None = None) -> tuple[Trigger, dict] | None:
    """The trigger that a source names, and its parameters.

    These are the analysis of the trigger's measurement, or stand in the name itself as a mapping with one entry. No name gives no trigger.
    """
    if name is None:
        return None
    if isinstance(name, dict):
        explicit = {k: v for k, v in name.items() if v is not None}
        if len(explicit) != 1:
            raise ValueError("an explicit trigger names exactly one measurement")
        measurement, spec = next(iter(explicit.items()))
        found = [t for t in TRIGGERS.values() if t.measurement == measurement]
        if not found:
            raise ValueError(f"no trigger is measured by {measurement}")
        return found[0], spec
    if name not in TRIGGERS:
        raise ValueError(f"there is no trigger {name}; known are {sorted(TRIGGERS)}")
    spec = (analysis or {}).get(TRIGGERS[name].measurement)
    if spec is None:
        raise ValueError(f"trigger {name} needs an analysis of {TRIGGERS[name].measurement}")
    return TRIGGERS[name], spec


def correct_iq(blocks: DataFrame, offset: Column, size: Column, trigger: str | dict | None = None, analysis: dict[str, dict] | None = None, chunk: int = CHUNK, one_block: bool = False) -> DataFrame:
    """The whole correction: by spec, then the first ``offset`` output samples (of the acquisition's overlap) go, then ``size`` samples stay, from the trigger's lag on if one is named.

    ``offset`` and ``size`` are expressions over ``spec`` and the keys. The trigger sees the samples that would stay without it.
    """
    specs = blocks.select(*KEYS, "spec").dropDuplicates(list(KEYS))
    out = corrected(blocks, chunk, one_block)
    found = resolve_trigger(trigger, analysis)
    sized = specs.select(*KEYS, offset.cast("long").alias("__offset"), size.cast("long").alias("__size"))
    placed = out.join(sized, list(KEYS))
    if found is None:
        return cut(placed, F.col("__offset"), F.col("__size")).drop("__offset", "__size")
    how, spec = found
    seen = cut(placed, F.col("__offset"), F.col("__size")).drop("__offset", "__size")
    lags = how.lags(seen, **spec).join(sized, list(KEYS)).withColumn("lag", F.col("lag") + F.col("__offset"))
    return aligned(out, lags, F.col("__size"))


# designs ----------------------------------------------------------------------------------------------------------------


@lru_cache(1)
def slow_sizes() -> np.ndarray:
    """Which transform sizes up to ``MOST_NFFT`` are odd primes over a hundred."""
    prime = np.ones(MOST_NFFT + 1, bool)
    prime[:2] = False
    for p in range(2, int(MOST_NFFT**0.5) + 1):
        if prime[p]:
            prime[p * p :: p] = False
    prime[:101] = False
    return prime


@lru_cache(4096)
def design_resampler(base: float, target: float, bandwidth: float = float("inf"), lo_shift: str = "none", backend: float | None = None, window: str | None = "hamming", lo_bandwidth: float = 0.25e6, oversampling: float = 1.1, least: int = 256, whole_bins: bool = False) -> dict:
    """Receiver rate, transform sizes, oscillator offset and passband of a resampler.

    The receiver runs at the base clock divided by a whole number, fast enough for the oversampled band beside the oscillator's leakage if that is shifted
    ``left`` or ``right``. The transform sizes are the first over ``least`` that hold the rates' ratio, aren't slow primes and leave whole hops under the window; with ``whole_bins`` also
    the first at which the offset is a whole bin.
    """
    sign = {"none": 0, "left": -1, "right": 1}[lo_shift]
    if sign and bandwidth == float("inf"):
        raise ValueError("a shift of the oscillator needs an analysis bandwidth")
    if bandwidth != float("inf") and bandwidth > base:
        raise ValueError("the analysis bandwidth is over the receiver's largest rate")
    need = target + (oversampling * bandwidth / 2 + lo_bandwidth / 2 if sign else 0.0)
    if backend is not None:
        fs = backend
    elif base <= target:
        fs = base
    elif sign and need > base:
        raise ValueError(f"the shift needs a receiver rate of {need:g}; the largest is {base:g}")
    else:
        fs = base / int(base / need)
    offset = sign * (bandwidth + lo_bandwidth) / 2 if sign else 0.0
    ratio, n = fs / target, np.arange(1, MOST_NFFT + 1)
    divisor = DIVISORS[window or "rect"]
    inside = ratio * n
    fits = (np.abs(np.rint(inside) - inside) <= 1e-6) & (n > least) & ~slow_sizes()[1:]
    times = np.where((n % divisor > 0) | (np.rint(inside).astype(np.int64) % divisor > 0), divisor, 1)
    if whole_bins and offset:
        bins = offset * np.rint(inside) * times / fs
        fits &= np.abs(np.rint(bins) - bins) <= 1e-6
    at = np.flatnonzero(fits)
    if not len(at):
        raise ValueError("no transform sizes hold this ratio of rates")
    one, many = int(n[at[0]]), int(times[at[0]])
    half = bandwidth / 2
    return {"fs_sdr": fs, "nfft": round(ratio * one) * many, "nfft_out": one * many, "lo_offset": offset, "passband_low": offset - half, "passband_high": offset + half}


def fast_length(n: int) -> int:
    """The first number from ``n`` on without a prime factor over 11."""
    while True:
        m = n
        for p in (2, 3, 5, 7, 11):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def overlap(nfft: int, fs: float, duration: float, bandwidth: float, max_lag: int = 0, taps: int = 4001) -> tuple[int, int]:
    """Samples to acquire before and behind a capture: its transforms stay whole and fast, and the low-pass and the largest lag find samples.

    A block is so many transforms as the low-pass has half lengths in one; blocks beside the capture's whole ones hold the lag and one more, rounded to a fast number. An odd sample is acquired behind.
    """
    block = nfft * (-(-nfft // (taps // 2 + 1)) if bandwidth != float("inf") else 1)
    size = round(duration * fs)
    blocks = fast_length(size // block + -(-max_lag // block) + 1)
    extra = blocks * block - size
    return extra // 2, extra - extra // 2


#: Columns of captures that designs are made from, with the values that nulls and missing columns stand for.
DESIGN = {"master_clock_rate": None, "sample_rate": None, "analysis_bandwidth": float("inf"), "lo_shift": "none", "backend_sample_rate": 0.0, "window": "hamming", "duration": 0.0, "max_lag": 0.0}


def designed(captures: DataFrame, lo_bandwidth: float = 0.25e6, oversampling: float = 1.1, least: int = 256, taps: int = 4001, whole_bins: bool = False) -> DataFrame:
    """Captures with fs_sdr, nfft, nfft_out, lo_offset, passband_low, passband_high, overlap_low and overlap_high (samples before and behind, at the receiver's rate).

    Each distinct spec is designed once; the table of designs joins the captures by size.
    """
    names = list(DESIGN)
    value = lambda c: (F.col(c) if c in captures.columns else F.lit(None)) if DESIGN[c] is None else F.coalesce(F.col(c) if c in captures.columns else F.lit(None), F.lit(DESIGN[c]))
    kind = lambda c: "string" if isinstance(DESIGN[c], str) else "double"
    keyed = captures.withColumns({f"__{c}": value(c).cast(kind(c)) for c in names})
    specs = keyed.select(*(f"__{c}" for c in names)).distinct()
    found = ["fs_sdr", "nfft", "nfft_out", "lo_offset", "passband_low", "passband_high", "overlap_low", "overlap_high"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for base, target, bandwidth, shift, backend, window, duration, lag in f.itertuples(index=False):
                d = design_resampler(base, target, bandwidth, shift.lower(), backend or None, window, lo_bandwidth, oversampling, least, whole_bins)
                low, high = overlap(d["nfft"], d["fs_sdr"], duration, bandwidth, int(np.ceil(base * lag)), taps)
                rows.append(d | {"overlap_low": low, "overlap_high": high})
            yield pd.concat([f.reset_index(drop=True).add_prefix("__of").rename(columns=lambda c: c.replace("__of__", "__of_")), pd.DataFrame(rows, columns=found)], axis=1)

    schema = ", ".join([*(f"__of_{c} {kind(c)}" for c in names), "fs_sdr double", "nfft long", "nfft_out long", "lo_offset double", "passband_low double", "passband_high double", "overlap_low long", "overlap_high long"])
    designs = specs.mapInPandas(run, schema)
    on = [F.col(f"__{c}").eqNullSafe(F.col(f"__of_{c}")) for c in names]
    return keyed.join(designs, on).select(*captures.columns, *found)
