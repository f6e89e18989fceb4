"""OFDM numerology and synchronisation sequences: dimension tables of the cellular measurements."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of 3GPP TS 38.213, 4.1, by cell search case: first symbols of SS/PBCH blocks, symbols after which they repeat, the repetitions n up to a
#: centre frequency and above it, that frequency, and the repetitions in shared spectrum.
SSB_CASES = {
    "a": ((2, 8), 14, (0, 1), (0, 1, 2, 3), 3e9, (0, 1, 2, 3, 4)),
    "b": ((4, 8, 16, 20), 28, (0,), (0, 1), 3e9, None),
    "c": ((2, 8), 14, (0, 1), (0, 1, 2, 3), 1.88e9, (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "d": ((4, 8, 16, 20), 28, *2 * ((0, 1, 2, 3, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 18),), None, None),
    "e": ((8, 12, 16, 20, 32, 36, 40, 44), 56, *2 * ((0, 1, 2, 3, 5, 6, 7, 8),), None, None),
    "f": ((2, 9), 14, *2 * (tuple(range(32)),), None, None),
    "g": ((2, 9), 14, *2 * (tuple(range(32)),), None, None),
}
#: Cases that a subcarrier spacing implies; 30 kHz has two outside shared spectrum.
SPACING_CASES = {15e3: "a", 120e3: "d", 240e3: "e", 480e3: "f", 960e3: "g"}
NORMAL_SYMBOLS, EXTENDED_SYMBOLS = 14, 12


@dataclass(frozen=True)
class Numerology:
    """Sample counts of one subcarrier spacing at one sample rate (4G slots are pairs of half-slots with a longer first prefix)."""

    sample_rate: float
    subcarrier_spacing: float = 15e3
    generation: str = "4G"

    @property
    def nfft(self) -> int:
        n = self.sample_rate / self.subcarrier_spacing
        if abs(n - round(n)) > 1e-6:
            raise ValueError("the sample rate must be a multiple of the subcarrier spacing")
        return round(n)

    @property
    def prefixes(self) -> np.ndarray:
        """Cyclic prefix lengths of a slot's symbols."""
        short = 9 * self.nfft // 128
        if self.generation == "4G":
            return np.array(([10 * self.nfft // 128] + [short] * 6) * 2)
        extra = self.sample_rate * 16 / (15e3 * 2048)
        if abs(extra - round(extra)) > 1e-6:
            raise ValueError("the first prefix isn't a whole number of samples")
        return np.array([short + round(extra)] + [short] * 13)

    @property
    def slot_size(self) -> int:
        return int(self.prefixes.sum() + NORMAL_SYMBOLS * self.nfft)

    @property
    def slots_per_frame(self) -> int:
        return round(10 * self.subcarrier_spacing / 15e3)

    @property
    def starts(self) -> np.ndarray:
        """Offsets of the prefixes in a slot."""
        return np.concatenate([[0], np.cumsum(self.prefixes + self.nfft)[:-1]])

    def prefix_indexes(self, frames: tuple[int, ...] = (0,), slots: tuple[int, ...] | None = None, symbols: tuple[int, ...] | None = None) -> np.ndarray:
        """Sample indexes of cyclic prefixes, each as long as the short one."""
        slots = slots if slots is not None else tuple(range(self.slots_per_frame))
        picked = self.starts[list(symbols)] if symbols is not None else self.starts
        base = np.add.outer(np.array(frames) * self.slot_size * self.slots_per_frame, np.array(slots) * self.slot_size).ravel()
        return np.add.outer(np.add.outer(base, picked).ravel(), np.arange(self.prefixes[1])).ravel()


#: Fixed values of IEEE 802.16, 8.4: transform sizes, prefix ratios, frame durations in seconds, and the sampling factor 28/25 of
#: channel bandwidths that are multiples of these (in Hz) but not of 1.75 MHz; others have 8/7.
OFDMA_SIZES, OFDMA_PREFIXES = (128, 512, 1024, 2048), (1 / 32, 1 / 16, 1 / 8, 1 / 4)
OFDMA_FRAMES = (2e-3, 2.5e-3, 4e-3, 5e-3, 8e-3, 10e-3, 12.5e-3, 20e-3, 25e-3, 40e-3, 50e-3)
OFDMA_STEPS = (1.25e6, 1.5e6, 2e6, 2.75e6)


def whole_number(x: float, what: str) -> int:
    if abs(x - round(x)) > 1e-6:
        raise ValueError(f"{what} must be a whole number; it is {x}")
    return round(x)


@dataclass(frozen=True)
class OfdmaNumerology:
    """Sample counts of IEEE 802.16 OFDMA, at the standard sample rate or a whole multiple or divisor of it.

    ``factor`` replaces the standard's sampling factor, for recordings of equipment that uses one factor for every bandwidth.
    """

    bandwidth: float
    size: int = 2048
    prefix_ratio: float = 1 / 8
    frame_duration: float = 5e-3
    recorded_rate: float | None = None
    factor: float | None = None

    def __post_init__(self) -> None:
        if self.bandwidth < 1.25e6 or abs(self.bandwidth / 125e3 - round(self.bandwidth / 125e3)) > 1e-9:
            raise ValueError("the channel bandwidth must be a multiple of 125 kHz from 1.25 MHz on")
        for value, known, what in ((self.size, OFDMA_SIZES, "transform size"), (self.prefix_ratio, OFDMA_PREFIXES, "prefix ratio"), (self.frame_duration, OFDMA_FRAMES, "frame duration")):
            if value not in known:
                raise ValueError(f"the {what} must be one of {known}")
        if min(abs(x - round(x)) for x in (self.scale, 1 / self.scale)) > 1e-6:
            raise ValueError("the recorded rate must be a whole multiple or divisor of the standard one")
        whole_number(self.scale * self.prefix_ratio * self.size, "the prefix size")

    @property
    def standard_rate(self) -> float:
        steps = lambda step: abs(self.bandwidth / step - round(self.bandwidth / step)) < 1e-9
        factor = self.factor or (28 / 25 if any(map(steps, OFDMA_STEPS)) and not steps(1.75e6) else 8 / 7)
        return float(np.floor(factor * self.bandwidth / 8000 + 1e-9) * 8000)

    @property
    def scale(self) -> float:
        return (self.recorded_rate or self.standard_rate) / self.standard_rate

    @property
    def nfft(self) -> int:
        return round(self.size * self.scale)

    @property
    def prefix(self) -> int:
        return round(self.prefix_ratio * self.size * self.scale)

    @property
    def symbols_per_frame(self) -> int:
        return int(self.frame_duration * self.standard_rate / round((1 + self.prefix_ratio) * self.size) + 1e-9)

    @property
    def frame_size(self) -> int:
        return round(self.frame_duration * self.standard_rate * self.scale)

    def prefix_indexes(self, frames: tuple[int, ...] = (0,), symbols: tuple[int, ...] | None = None) -> np.ndarray:
        """Sample indexes of cyclic prefixes, one axis each for symbol, frame and place in the prefix."""
        at = np.array(symbols if symbols is not None else range(self.symbols_per_frame))
        if len(at) and (at.min() < 0 or at.max() >= self.symbols_per_frame):
            raise ValueError(f"a frame has {self.symbols_per_frame} symbols")
        starts = at * (self.prefix + self.nfft)
        return np.add.outer(np.add.outer(starts, np.array(frames) * self.frame_size), np.arange(self.prefix))


def lfsr(seed: list[int], taps: tuple[int, int], size: int = 127) -> np.ndarray:
    """A binary recursion x[i] = x[i - a] + x[i - b] modulo 2."""
    x = list(seed)
    while len(x) < size:
        x.append((x[-taps[0]] + x[-taps[1]]) % 2)
    return np.array(x)


def pss(n_id2: int) -> np.ndarray:
    """Primary synchronisation sequence (TS 38.211, 7.4.2.2): values of plus and minus one."""
    x = lfsr([0, 1, 1, 0, 1, 1, 1], (3, 7))
    return 1 - 2 * x[(np.arange(127) + 43 * n_id2) % 127]


def sss(n_id1: int, n_id2: int) -> np.ndarray:
    """Secondary synchronisation sequence (TS 38.211, 7.4.2.3)."""
    x0, x1 = lfsr([1, 0, 0, 0, 0, 0, 0], (3, 7)), lfsr([1, 0, 0, 0, 0, 0, 0], (6, 7))
    n = np.arange(127)
    return (1 - 2 * x0[(n + 15 * (n_id1 // 112) + 5 * n_id2) % 127]) * (1 - 2 * x1[(n + n_id1 % 112) % 127])


def sss_parts() -> tuple[np.ndarray, np.ndarray]:
    """The two sequences of plus and minus one whose shifted product every SSS is: the first by one of nine shifts, the second by up to 111."""
    return 1 - 2 * lfsr([1, 0, 0, 0, 0, 0, 0], (3, 7)), 1 - 2 * lfsr([1, 0, 0, 0, 0, 0, 0], (6, 7))


def sync_bins(sample_rate: float, subcarrier_spacing: float) -> tuple[int, int, np.ndarray]:
    """Samples before a synchronisation symbol's own (its prefix), its transform size, and the transform's bins of the 127 subcarriers."""
    phy = Numerology(sample_rate, subcarrier_spacing, "5G" if subcarrier_spacing != 15e3 else "4G")
    low = phy.nfft // 2 - 120 + 56
    if low < 0 or low + 127 > phy.nfft:
        raise ValueError("the sample rate is too small for the synchronisation band")
    return int(phy.prefixes.min()), phy.nfft, (low + np.arange(127) + phy.nfft // 2) % phy.nfft


def sync_waveform(sequence: np.ndarray, sample_rate: float, subcarrier_spacing: float, offset: float = 0.0) -> np.ndarray:
    """Time-domain symbol of a synchronisation sequence, with zeros for its cyclic prefix."""
    phy = Numerology(sample_rate, subcarrier_spacing, "5G" if subcarrier_spacing != 15e3 else "4G")
    size = phy.nfft
    low = size // 2 - 120 + 56 + round(offset / subcarrier_spacing)
    if low < 0 or low + 127 > size:
        raise ValueError("the sample rate is too small for the synchronisation band")
    grid = np.zeros(size, complex)
    grid[low : low + 127] = sequence / np.sqrt(127)
    x = np.fft.ifft(np.fft.fftshift(grid))
    x *= np.sqrt(127) / np.sqrt(np.mean(np.abs(x) ** 2)) / np.sqrt(127)
    return np.concatenate([np.zeros(int(phy.prefixes.min()), complex), x])


def sequence_table(spark: SparkSession) -> DataFrame:
    """(n_id2, i, d): the three primary sequences."""
    return spark.createDataFrame([(n, i, int(d)) for n in range(3) for i, d in enumerate(pss(n))], "n_id2 int, i int, d int")


def ssb_case(spacing: float, shared: bool = False) -> str:
    """The cell search case of a subcarrier spacing."""
    if spacing == 30e3 and shared:
        return "c"
    if spacing not in SPACING_CASES:
        raise ValueError("name case b or c at 30 kHz" if spacing == 30e3 else f"no cell search case at a spacing of {spacing:g} Hz")
    return SPACING_CASES[spacing]


def ssb_symbols(case: str, center_frequency: float | None = None, shared: bool = False) -> tuple[int, ...]:
    """First symbols of the SS/PBCH blocks in a half frame; without a centre frequency those of the higher range."""
    offsets, period, low, high, limit, in_shared = SSB_CASES[case.lower()]
    if shared and in_shared is None:
        raise ValueError(f"case {case} isn't defined in shared spectrum")
    times = in_shared if shared else (high if limit is None or center_frequency is None or center_frequency > limit else low)
    return tuple(o + period * n for n in times for o in offsets)


def ssb_symbols_of(case: Column, center_frequency: Column, shared: Column) -> Column:
    """:func:`ssb_symbols` of every row, an array; null where a case isn't known or isn't defined in shared spectrum. A null frequency stands for the higher range."""
    out = F.lit(None).cast("array<int>")
    for name, (_, _, _, _, limit, in_shared) in SSB_CASES.items():
        of = lambda *args: F.array(*map(F.lit, ssb_symbols(name, *args)))  # noqa: E731, B023
        own = of(None) if limit is None else F.when(center_frequency <= limit, of(limit)).otherwise(of(None))
        own = F.when(shared, of(None, True) if in_shared else F.lit(None)).otherwise(own)
        out = F.when(F.lower(case) == name, own).otherwise(out)
    return out


def sync_sizes(sample_rate: float, spacing: float, max_lag_symbols: int = 4) -> dict[str, int]:
    """Samples of a synchronisation symbol with its short prefix, lags searched, and the shift from the primary to the secondary symbol."""
    phy = Numerology(sample_rate, spacing, "5G" if spacing != 15e3 else "4G")
    step = phy.nfft + int(phy.prefixes.min())
    return {"symbol": step, "lags": phy.slot_size // NORMAL_SYMBOLS * max_lag_symbols, "secondary": 2 * step}


def tdd_symbols(spacing: float, frame_slots: str, special: str | None = None, flex_as: str | None = None, normal_prefix: bool = True) -> list[str]:
    """Direction of each symbol of a frame: d, u or - ; slot codes d, u, f, s (special) in ``frame_slots``."""
    slots = round(10 * spacing / 15e3)
    codes = frame_slots * slots if len(frame_slots) == 1 else frame_slots
    per = NORMAL_SYMBOLS if normal_prefix else EXTENDED_SYMBOLS
    if len(codes) != slots:
        raise ValueError(f"a frame has {slots} slots at this spacing; got {len(codes)} codes")
    if "s" in codes and (special is None or len(special) != per):
        raise ValueError(f"special slots need {per} symbol codes")
    out: list[str] = []
    for c in codes:
        out += list(special) if c == "s" else [c] * per
    return [(flex_as or "-") if c == "f" else c for c in out]


def mask_table(spark: SparkSession, spacing: float, frame_slots: str, special: str | None = None, flex_as: str | None = None) -> DataFrame:
    """(symbol, direction): the symbols of a frame that belong to a link direction."""
    names = {"d": "downlink", "u": "uplink"}
    return spark.createDataFrame([(i, names[c]) for i, c in enumerate(tdd_symbols(spacing, frame_slots, special, flex_as)) if c in names], "symbol int, direction string")


def prefix_sets(sample_rate: float, spacings: tuple[float, ...], frame_slots: str | dict[float, str] | None = None, generation: str = "5G", frames: tuple[int, ...] = (0,), symbols: tuple[int, ...] | None = None) -> list[dict]:
    """Cyclic prefixes by link direction and subcarrier spacing: direction, spacing, nfft, lags, indexes (none where the frame has no slot of the direction).

    ``frame_slots`` has a code a slot (or one for all), by spacing where they differ; none is all downlink. A spacing's lags end after a symbol with its short prefix.
    """
    out = []
    for spacing in spacings:
        phy = Numerology(sample_rate, spacing, generation)
        codes = frame_slots.get(spacing) if isinstance(frame_slots, dict) else frame_slots
        codes = (codes or "d").lower()
        codes = codes * phy.slots_per_frame if len(codes) == 1 else codes
        if len(codes) != phy.slots_per_frame or set(codes) - set("dus"):
            raise ValueError(f"a frame has {phy.slots_per_frame} slots of d, u or s at {spacing:g} Hz; got {codes}")
        for direction, code in (("downlink", "d"), ("uplink", "u")):
            slots = tuple(i for i, c in enumerate(codes) if c == code)
            indexes = phy.prefix_indexes(frames, slots, symbols) if slots else np.zeros(0, np.int64)
            out.append({"direction": direction, "spacing": float(spacing), "nfft": phy.nfft, "lags": phy.nfft + int(phy.prefixes[1]), "indexes": indexes})
    return out


def numerologies(captures: DataFrame) -> DataFrame:
    """Captures (sample_rate, subcarrier_spacing, generation) with nfft, slot_size, slots_per_frame and the ``prefixes`` and ``starts`` of a slot's symbols.

    A rate that the spacing doesn't divide, or that leaves a prefix with part of a sample, gives nulls. Each distinct numerology is worked out once per batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows = []
            for rate, spacing, generation in f.itertuples(index=False):
                try:
                    phy = Numerology(rate, spacing, generation)
                    rows.append((rate, spacing, generation, phy.nfft, phy.slot_size, phy.slots_per_frame, phy.prefixes.tolist(), phy.starts.tolist()))
                except ValueError:
                    rows.append((rate, spacing, generation, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["__rate", "__spacing", "__generation", *FACTS]).astype({c: "Int64" for c in FACTS[:3]})

    keys = ("sample_rate", "subcarrier_spacing", "generation")
    found = captures.select(*keys).distinct().mapInPandas(run, "__rate double, __spacing double, __generation string, nfft long, slot_size long, slots_per_frame long, prefixes array<long>, starts array<long>")
    on = [F.col(a) == F.col(b) for a, b in zip(keys, ("__rate", "__spacing", "__generation"), strict=True)]
    return captures.join(found, on).drop("__rate", "__spacing", "__generation")


FACTS = ["nfft", "slot_size", "slots_per_frame", "prefixes", "starts"]
