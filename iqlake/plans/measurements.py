"""Measurements declared once and compiled from a spec into one plan with coordinates in physical units.

A coordinate turns an index column of a result into its value (seconds, hertz, decibel bins, labels). A measurement names its parameters, coordinates, units and
what it is computed from: blocks of samples, or the spectrogram of some parameters. :func:`evaluate` groups the measurements of a spec by the spectrogram they need: each
group transforms the samples once, every pixel goes to the measurements' groups in one expansion, and one aggregation serves all of them, as grouping sets do.

The result is one long table: capture_id, port, measurement, a column for every coordinate in use (null where a measurement hasn't it), value, units.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import ofdm
from ..functions.columns import pow_to_db, to_half, whole
from ..operators import cellular, spectrum, stats
from ..operators.frames import KEYS, band_slice, binned_layout, samples

INF = float("inf")


@dataclass(frozen=True)
class Coordinate:
    """``value(capture, spec)`` is an expression over the index columns of a measurement's rows."""

    name: str
    kind: str
    value: Callable[[dict, dict], Column]
    units: str | Callable[[dict], str] | None = None
    standard_name: str = ""

    def metadata(self, spec: dict) -> dict:
        units = self.units(spec) if callable(self.units) else self.units
        return {k: v for k, v in (("units", units), ("standard_name", self.standard_name)) if v}


@dataclass(frozen=True)
class Param:
    """A parameter: its type, its default (``...``: it must be given) and whether it may be null."""

    kind: DataType
    default: object = ...
    optional: bool = False


@dataclass(frozen=True)
class Reduction:
    """What a measurement does to a spectrogram's pixels: groups by ``by`` (index column: expression over frame, k and power) and aggregates by label.

    ``aggregates`` take the pixel's power, null for pixels that aren't theirs. ``label`` names the column that the labels go to. With ``share`` values are shares of
    their sum over a port; ``finish`` is applied to them last.
    """

    by: dict[str, Column]
    aggregates: dict[str, Callable[[Column], Column]]
    label: str | None = None
    where: Column | None = None
    share: bool = False
    finish: Callable[[Column], Column] = lambda value: value


@dataclass(frozen=True)
class Measurement:
    name: str
    params: dict[str, Param]
    coordinates: tuple[str, ...]
    units: str | Callable[[dict], str]
    standard_name: str
    #: ``blocks``: func(blocks, capture, spec) returns capture_id, port, index columns, value. ``spectrogram``: it returns a :class:`Reduction`. ``pixels``: func(spectrogram, capture, spec), as for blocks.
    source: str
    func: Callable
    attributes: dict = field(default_factory=dict)


COORDINATES: dict[str, Coordinate] = {}
MEASUREMENTS: dict[str, Measurement] = {}


def coordinate(kind: str, units: str | Callable[[dict], str] | None = None, standard_name: str = "", name: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of capture and spec as a coordinate."""

    def put(f: Callable[[dict, dict], Column]) -> Callable[[dict, dict], Column]:
        key = name or f.__name__
        if key in COORDINATES:
            raise ValueError(f"there is a coordinate {key} already")
        COORDINATES[key] = Coordinate(key, kind, f, units, standard_name)
        return f

    return put


def measurement(params: dict[str, Param], coordinates: tuple[str, ...] = (), units: str | Callable[[dict], str] = "", standard_name: str = "", source: str = "blocks", name: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function as a measurement."""

    def put(f: Callable) -> Callable:
        key = name or f.__name__
        if key in MEASUREMENTS:
            raise ValueError(f"there is a measurement {key} already")
        if source not in ("blocks", "spectrogram", "pixels"):
            raise ValueError(f"a measurement is made from blocks, spectrogram or pixels, not {source}")
        unknown = [c for c in coordinates if c not in COORDINATES]
        if unknown:
            raise ValueError(f"coordinates that aren't registered: {unknown}")
        MEASUREMENTS[key] = Measurement(key, params, tuple(coordinates), units, standard_name, source, f)
        return f

    return put


# specs ------------------------------------------------------------------------------------------------------------------


def spec_type(names: tuple[str, ...] | None = None) -> StructType:
    """The struct of all measurements' parameters; a measurement that isn't asked for is null."""
    return StructType([StructField(m.name, StructType([StructField(p, q.kind, q.optional or q.default is not ...) for p, q in m.params.items()]), True) for m in MEASUREMENTS.values() if names is None or m.name in names])


def _json_type(kind: DataType) -> dict:
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": _json_type(kind.elementType)}
    return {"type": {DoubleType: "number", LongType: "integer", BooleanType: "boolean", StringType: "string"}[type(kind)]}


def json_schema(names: tuple[str, ...] | None = None) -> dict:
    """JSON Schema of an analysis."""
    out: dict = {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False, "properties": {}}
    for m in MEASUREMENTS.values():
        if names is not None and m.name not in names:
            continue
        properties = {}
        for p, q in m.params.items():
            one = _json_type(q.kind)
            if q.optional:
                one["type"] = [one["type"], "null"]
            if q.default is not ... and q.default not in (INF, -INF):
                one["default"] = list(q.default) if isinstance(q.default, tuple) else q.default
            properties[p] = one
        out["properties"][m.name] = {"type": ["object", "null"], "additionalProperties": False, "properties": properties, "required": [p for p, q in m.params.items() if q.default is ...], "description": m.standard_name}
    return out


def _coerced(value: object, kind: DataType, where: str) -> object:
    if isinstance(kind, ArrayType):
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{where} must be a list; got {value!r}")
        return tuple(_coerced(v, kind.elementType, where) for v in value)
    if isinstance(kind, BooleanType):
        if isinstance(value, bool):
            return value
    elif isinstance(kind, StringType):
        # Statistics are names or quantiles.
        if isinstance(value, (str, float)) or isinstance(value, int) and not isinstance(value, bool):
            return value
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if isinstance(kind, DoubleType):
            return float(value)
        if float(value).is_integer():
            return int(value)
    elif isinstance(value, str) and isinstance(kind, DoubleType) and value.lower() in ("inf", "-inf", ".inf"):
        return -INF if value.startswith("-") else INF
    raise ValueError(f"{where} must be {kind.simpleString()}; got {value!r}")


def validated(analysis: dict[str, dict | None]) -> dict[str, dict]:
    """The spec of every measurement asked for, with its defaults; what isn't known, is missing or has another type raises."""
    out = {}
    for name, given in analysis.items():
        if given is None:
            continue
        if name not in MEASUREMENTS:
            raise ValueError(f"there is no measurement {name}; known are {sorted(MEASUREMENTS)}")
        params = MEASUREMENTS[name].params
        unknown = sorted(set(given) - set(params))
        if unknown:
            raise ValueError(f"{name} has no parameters {unknown}")
        spec = {}
        for p, q in params.items():
            if p not in given and q.default is ...:
                raise ValueError(f"{name} needs {p}")
            value = given.get(p, q.default)
            if value is None and not q.optional:
                raise ValueError(f"{name}.{p} can't be null")
            spec[p] = value if value is None or p not in given else _coerced(value, q.kind, f"{name}.{p}")
        out[name] = spec
    return out


# evaluation -------------------------------------------------------------------------------------------------------------


def spectrogram_key(spec: dict) -> tuple:
    return tuple(spec[p] for p in SPECTROGRAM)


def spectrogram_of(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """The linear spectrogram that a spec's parameters name."""
    fs, band = capture["sample_rate"], capture.get("analysis_bandwidth", INF)
    aperture = None
    if spec["time_aperture"] is not None:
        aperture = whole(spec["time_aperture"] / _hop_period(capture, spec), "time_aperture over the hop")
    return spectrum.spectrogram(blocks, fs, spec["frequency_resolution"], spec["fractional_overlap"], spec["window_fill"], spec["window"], band if spec["trim_stopband"] else INF, spec["integration_bandwidth"], aperture, spec["lo_bandstop"])


def _reduced(pixels: DataFrame, reductions: list[Reduction]) -> DataFrame:
    """All reductions from one expansion and one aggregation: keys, ``m`` (the reduction's number), every index and label column, value."""
    indexes = list(dict.fromkeys(n for r in reductions for n in r.by))
    feeds, aggregates, pairs, value = [], [], None, F.col("value")
    for i, r in enumerate(reductions):
        group = F.struct(F.lit(i).alias("m"), *(r.by.get(n, F.lit(None)).cast("long").alias(n) for n in indexes))
        feeds.append(group if r.where is None else F.when(r.where, group))
        aggregates += [aggregate(F.when(F.col("m") == i, F.col("power"))).cast("double").alias(f"{i} {label}") for label, aggregate in r.aggregates.items()]
        mine = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"`{i} {label}`").alias("value")) for label in r.aggregates))
        pairs = F.when(F.col("m") == i, mine) if pairs is None else pairs.when(F.col("m") == i, mine)
    at = [F.col(n) for n in indexes]
    rows = pixels.select(*KEYS, "power", F.explode(F.filter(F.array(*feeds), lambda x: x.isNotNull())).alias("__f")).select(*KEYS, "power", "__f.*")
    long = rows.groupBy(*KEYS, "m", *at).agg(*aggregates).select(*KEYS, "m", *at, F.explode(pairs).alias("__p")).select(*KEYS, "m", *at, "__p.*")
    shares = [i for i, r in enumerate(reductions) if r.share]
    if shares:
        # The groups of other reductions are spread by their indexes, so that no task gathers a port's pixels.
        spread = F.when(F.col("m").isin(shares), F.lit(0)).otherwise(F.xxhash64(*at))
        long = long.withColumn("__total", F.sum("value").over(Window.partitionBy(*KEYS, "m", spread)))
    for i, r in enumerate(reductions):
        value = F.when(F.col("m") == i, r.finish(F.col("value") / F.col("__total") if r.share else F.col("value"))).otherwise(value)
    labels = list(dict.fromkeys(r.label for r in reductions if r.label))
    named = [F.when(F.col("m").isin([i for i, r in enumerate(reductions) if r.label == n]), F.col("label")).alias(n) for n in labels]
    return long.select(*KEYS, "m", *at, *named, value.alias("value"))


def evaluate(blocks: DataFrame, capture: dict, analysis: dict[str, dict | None]) -> DataFrame:
    """All measurements of ``analysis`` (by name, see :func:`validated`) for blocks with one sample rate and bandwidth (``capture``)."""
    specs = validated(analysis)
    if not specs:
        raise ValueError("no measurement is asked for")
    names = [c for c in COORDINATES if any(c in MEASUREMENTS[m].coordinates for m in specs)]
    units = {m: MEASUREMENTS[m].units(s) if callable(MEASUREMENTS[m].units) else MEASUREMENTS[m].units for m, s in specs.items()}

    def shaped(rows: DataFrame, members: list[str]) -> DataFrame:
        """Rows of the long table from index columns; of several measurements ``m`` tells which."""
        pick = lambda of: F.coalesce(*(F.when(F.col("m") == i, of(m)) for i, m in enumerate(members))) if len(members) > 1 else of(members[0])
        value = lambda c: lambda m: (COORDINATES[c].value(capture, specs[m]) if c in MEASUREMENTS[m].coordinates else F.lit(None)).cast(COORDINATES[c].kind)
        columns = [pick(value(c)).alias(c) for c in names]
        return rows.select(*KEYS, pick(F.lit).alias("measurement"), *columns, F.col("value").cast("double").alias("value"), pick(lambda m: F.lit(units[m])).alias("units"))

    parts, shared = [], {}
    for m, spec in specs.items():
        info = MEASUREMENTS[m]
        if info.source == "blocks":
            parts.append(shaped(info.func(blocks, capture, spec), [m]))
        else:
            shared.setdefault(spectrogram_key(spec), []).append(m)
    for members in shared.values():
        pixels = spectrogram_of(blocks, capture, specs[members[0]])
        reduced = [m for m in members if MEASUREMENTS[m].source == "spectrogram"]
        if reduced:
            parts.append(shaped(_reduced(pixels, [MEASUREMENTS[m].func(capture, specs[m]) for m in reduced]), reduced))
        parts += [shaped(MEASUREMENTS[m].func(pixels, capture, specs[m]), [m]) for m in members if m not in reduced]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = {c: specs[next(m for m in specs if c in MEASUREMENTS[m].coordinates)] for c in names}
    return out.select(*(F.col(c).alias(c, metadata=COORDINATES[c].metadata(first[c])) if c in names else F.col(c) for c in out.columns))


# coordinates ------------------------------------------------------------------------------------------------------------

DOUBLE, LONG, TEXT, FLAG, NUMBERS, LABELS = DoubleType(), LongType(), StringType(), BooleanType(), ArrayType(DoubleType()), ArrayType(StringType())
SPECTROGRAM = {
    "frequency_resolution": Param(DOUBLE),
    "fractional_overlap": Param(DOUBLE, 0.0),
    "window_fill": Param(DOUBLE, 1.0),
    "window": Param(TEXT, "hamming"),
    "integration_bandwidth": Param(DOUBLE, None, True),
    "time_aperture": Param(DOUBLE, None, True),
    "lo_bandstop": Param(DOUBLE, None, True),
    "trim_stopband": Param(FLAG, True),
}
BINS = {"power_low": Param(DOUBLE), "power_high": Param(DOUBLE), "power_resolution": Param(DOUBLE)}
SYNC = {
    "sample_rate": Param(DOUBLE),
    "subcarrier_spacing": Param(DOUBLE),
    "symbols": Param(ArrayType(LongType()), (2, 8)),
    "discovery_periodicity": Param(DOUBLE, 0.02),
    "max_lag_symbols": Param(LONG, 4),
    "frequency_offset": Param(DOUBLE, 0.0),
    "delay": Param(DOUBLE, 0.0),
}


def _nfft(capture: dict, spec: dict) -> int:
    return whole(capture["sample_rate"] / spec["frequency_resolution"], "sample_rate / frequency_resolution")


def _hop_period(capture: dict, spec: dict) -> float:
    nfft = _nfft(capture, spec)
    return (nfft - round(spec["fractional_overlap"] * nfft)) / capture["sample_rate"]


def _noise_bandwidth(spec: dict) -> float:
    return spec["integration_bandwidth"] or spec["frequency_resolution"]


def _per_bandwidth(unit: str) -> Callable[[dict], str]:
    return lambda spec: f"{unit}/{_noise_bandwidth(spec) / 1e3:g} kHz"


def _bin_center(spec: dict) -> Column:
    centers = stats.power_centers(spec["power_low"], spec["power_high"], spec["power_resolution"])
    return F.element_at(F.array(*map(F.lit, centers)), F.col("bin").cast("int") + 1)


@coordinate("double", "Hz", "Baseband frequency")
def baseband_frequency(capture: dict, spec: dict) -> Column:
    """Middle of a bin, or of the bins that were summed into one."""
    fs, nfft = capture["sample_rate"], _nfft(capture, spec)
    k = F.col("k").cast("double")
    if spec["integration_bandwidth"]:
        count = whole(spec["integration_bandwidth"] / spec["frequency_resolution"], "integration_bandwidth / frequency_resolution")
        band = capture.get("analysis_bandwidth", INF) if spec["trim_stopband"] else INF
        first, size = band_slice(nfft, fs, band) if band != INF else (0, nfft)
        start, _ = binned_layout(size, count, True)
        k = k * count + first + start + (count - 1) / 2
    return (k - nfft // 2) * F.lit(fs / nfft)


@coordinate("double", "s", "Time elapsed")
def spectrogram_time(capture: dict, spec: dict) -> Column:
    return F.col("frame") * F.lit(spec["time_aperture"] or _hop_period(capture, spec))


@coordinate("string", None, "Statistic over time")
def time_statistic(capture: dict, spec: dict) -> Column:
    return F.col("time_statistic")


@coordinate("double", _per_bandwidth("dBm"), "Spectrogram bin power")
def spectrogram_power_bin(capture: dict, spec: dict) -> Column:
    return _bin_center(spec)


@coordinate("double", _per_bandwidth("dB"), "Ratio of two ports' bin powers")
def spectrogram_ratio_power_bin(capture: dict, spec: dict) -> Column:
    return _bin_center(spec)


@coordinate("double", "dBm", "Channel power")
def channel_power_bin(capture: dict, spec: dict) -> Column:
    return _bin_center(spec)


@coordinate("string", None, "Power detector")
def power_detector(capture: dict, spec: dict) -> Column:
    return F.col("power_detector")


@coordinate("double", "s", "Time elapsed")
def time_elapsed(capture: dict, spec: dict) -> Column:
    return F.col("bin") * F.lit(spec["detector_period"])


@coordinate("string", None, "Cyclic statistic")
def cyclic_statistic(capture: dict, spec: dict) -> Column:
    return F.col("cyclic_statistic")


@coordinate("double", "s", "Cyclic lag")
def cyclic_lag(capture: dict, spec: dict) -> Column:
    return F.col("cyclic_lag") * F.lit(spec["detector_period"])


@coordinate("long", None, "Sample index")
def iq_index(capture: dict, spec: dict) -> Column:
    return F.col("n")


@coordinate("double", "s", "Time elapsed")
def iq_time(capture: dict, spec: dict) -> Column:
    return F.col("n") / F.lit(capture["sample_rate"])


@coordinate("string", None, "Part of a complex value")
def iq_part(capture: dict, spec: dict) -> Column:
    return F.col("part")


@coordinate("string", None, "Link direction")
def link_direction(capture: dict, spec: dict) -> Column:
    return F.col("link_direction")


@coordinate("double", "Hz", "Subcarrier spacing")
def subcarrier_spacing(capture: dict, spec: dict) -> Column:
    return F.col("subcarrier_spacing")


@coordinate("double", "s", "Cyclic sample lag")
def cyclic_sample_lag(capture: dict, spec: dict) -> Column:
    return F.col("j") / F.lit(capture["sample_rate"])


@coordinate("int", None, "Cell identity")
def cellular_cell_id(capture: dict, spec: dict) -> Column:
    return F.col("cell_id")


@coordinate("int", None, "SSB beam index")
def cellular_ssb_beam_index(capture: dict, spec: dict) -> Column:
    return F.col("beam")


@coordinate("double", "s", "Start of the discovery period")
def cellular_ssb_start_time(capture: dict, spec: dict) -> Column:
    return F.col("block") * F.lit(spec["discovery_periodicity"])


@coordinate("double", "s", "Symbol lag")
def cellular_ssb_lag(capture: dict, spec: dict) -> Column:
    return F.col("lag") / F.lit(spec["sample_rate"])


@coordinate("int", None, "SSB symbol index")
def cellular_ssb_symbol_index(capture: dict, spec: dict) -> Column:
    return F.col("symbol")


@coordinate("double", _per_bandwidth("dBm"), "Resource grid power")
def cellular_resource_power_bin(capture: dict, spec: dict) -> Column:
    return _bin_center(spec)


# measurements -----------------------------------------------------------------------------------------------------------

TO_DB = {"spectrogram": 2, "ssb": 3}


HALF = {"half_precision": Param(FLAG, False)}


def _stored(spec: dict) -> Callable[[Column], Column]:
    """Values in the precision that a spec asks for."""
    return to_half if spec["half_precision"] else lambda v: v


@measurement(SPECTROGRAM | HALF, ("spectrogram_time", "baseband_frequency"), _per_bandwidth("dBm"), "Power spectral density", "spectrogram")
def spectrogram(capture: dict, spec: dict) -> Reduction:
    """Every pixel in decibels."""
    stored = _stored(spec)
    return Reduction({"frame": F.col("frame"), "k": F.col("k")}, {"value": F.max}, finish=lambda v: stored(F.bround(pow_to_db(v, spectrum.EPS), TO_DB["spectrogram"])))


@measurement(SPECTROGRAM | HALF | {"time_statistic": Param(LABELS, ("mean",))}, ("time_statistic", "baseband_frequency"), _per_bandwidth("dBm"), "Power spectral density", "spectrogram")
def power_spectral_density(capture: dict, spec: dict) -> Reduction:
    """Statistics over time of every frequency's pixels."""
    kinds = [k if not isinstance(k, str) or k in stats.NAMED else float(k) for k in spec["time_statistic"]]
    return Reduction({"k": F.col("k")}, {stats.label(k): (lambda x, k=k: stats.statistic(k, x)) for k in kinds}, "time_statistic", finish=lambda v: _stored(spec)(pow_to_db(v, spectrum.EPS)))


def _decibels() -> Column:
    return F.bround(pow_to_db(F.col("power"), spectrum.EPS), TO_DB["spectrogram"])


@measurement(SPECTROGRAM | BINS, ("spectrogram_power_bin",), "", "Fraction of the pixels", "spectrogram")
def spectrogram_histogram(capture: dict, spec: dict) -> Reduction:
    """Share of a port's pixels in every power bin; pixels that are NaN don't count."""
    return Reduction({"bin": stats.bin_index(_decibels(), *(spec[p] for p in BINS))}, {"value": F.count}, where=~F.isnan("power"), share=True)


@measurement(SPECTROGRAM | BINS, ("spectrogram_ratio_power_bin",), "", "Fraction of the pixels", "pixels")
def spectrogram_ratio_histogram(pixels: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """Histogram of the difference between two ports' pixels, either way round."""
    return spectrum.ratio_histogram(spectrum.to_db(pixels, TO_DB["spectrogram"]), *(spec[p] for p in BINS)).withColumnRenamed("fraction", "value")


@measurement(SPECTROGRAM | BINS | {"subcarrier_spacing": Param(DOUBLE, 15e3), "frame_slots": Param(TEXT, "d"), "special_symbols": Param(TEXT, None, True)}, ("link_direction", "cellular_resource_power_bin"), "", "Fraction of the pixels", "pixels")
def cellular_resource_power_histogram(pixels: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """Histogram of a symbol-spaced spectrogram by link direction."""
    spacing = spec["subcarrier_spacing"]
    masks = ofdm.mask_table(pixels.sparkSession, spacing, spec["frame_slots"], spec["special_symbols"])
    symbols = ofdm.NORMAL_SYMBOLS * round(10 * spacing / 15e3)
    return spectrum.resource_histogram(pixels, masks, symbols, *(spec[p] for p in BINS)).withColumnsRenamed({"direction": "link_direction", "fraction": "value"})


@measurement(SPECTROGRAM | {"discovery_periodicity": Param(DOUBLE, 0.02), "subcarrier_spacing": Param(DOUBLE, 15e3), "band_start": Param(LONG, 0), "band_count": Param(LONG, 240)}, ("cellular_ssb_start_time", "cellular_ssb_symbol_index", "baseband_frequency"), _per_bandwidth("dBm"), "SSB spectrogram", "pixels")
def cellular_5g_ssb_spectrogram(pixels: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """The synchronisation blocks' part of a symbol-spaced spectrogram."""
    period = whole(spec["discovery_periodicity"] / _hop_period(capture, spec), "discovery_periodicity over the hop")
    out = spectrum.ssb_spectrogram(pixels, period, spec["subcarrier_spacing"], spec["band_start"], spec["band_count"])
    return out.withColumn("k", F.col("k") + spec["band_start"])


DETECTOR = {"detector_period": Param(DOUBLE), "power_detectors": Param(LABELS, ("rms", "peak"))}


def _detector_size(capture: dict, spec: dict) -> int:
    return whole(spec["detector_period"] * capture["sample_rate"], "detector_period * sample_rate")


@measurement(DETECTOR, ("power_detector", "time_elapsed"), "dBm", "Channel power")
def channel_power_time_series(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """Power readings over time."""
    rows = stats.binned(blocks, _detector_size(capture, spec), spec["power_detectors"], KEYS)
    return rows.withColumn("value", pow_to_db(F.col("value")))


@measurement(DETECTOR | BINS, ("power_detector", "channel_power_bin"), "", "Fraction of the readings")
def channel_power_histogram(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """Share of each detector's readings in every power bin."""
    rows = channel_power_time_series(blocks, capture, spec)
    by = (*KEYS, "power_detector")
    return stats.histogram(rows, "value", *(spec[p] for p in BINS), by, by).drop("value").withColumnRenamed("fraction", "value")


@measurement(DETECTOR | {"cyclic_period": Param(DOUBLE), "cyclic_statistics": Param(LABELS, ("min", "mean", "max"))}, ("power_detector", "cyclic_statistic", "cyclic_lag"), "dBm", "Cyclic channel power")
def cyclic_channel_power(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """Readings folded by a period, and statistics over the cycles."""
    bins = whole(spec["cyclic_period"] / spec["detector_period"], "cyclic_period / detector_period")
    return stats.cyclic_channel_power(blocks, _detector_size(capture, spec), bins, spec["power_detectors"], spec["cyclic_statistics"])


@measurement({"start_time_sec": Param(DOUBLE, 0.0), "stop_time_sec": Param(DOUBLE, INF)}, ("iq_index", "iq_time", "iq_part"), "√mW", "IQ waveform")
def iq_waveform(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """The samples of a stretch of time."""
    fs = capture["sample_rate"]
    kept = samples(blocks).where(F.col("n") >= int(spec["start_time_sec"] * fs))
    if spec["stop_time_sec"] != INF:
        kept = kept.where(F.col("n") < int(spec["stop_time_sec"] * fs))
    parts = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("value")) for p in ("re", "im")))).alias("p")
    return kept.select(*KEYS, "n", parts).select(*KEYS, "n", "p.*")


@measurement({"subcarrier_spacings": Param(NUMBERS, (15e3, 30e3, 60e3)), "frame_slots": Param(TEXT, None, True), "generation": Param(TEXT, "5G")}, ("link_direction", "subcarrier_spacing", "cyclic_sample_lag"), "mW", "Cyclic autocovariance")
def cellular_cyclic_autocorrelation(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    """Correlation of the cyclic prefixes with the symbols' ends, by link direction and spacing."""
    sets = ofdm.prefix_sets(capture["sample_rate"], spec["subcarrier_spacings"], spec["frame_slots"], spec["generation"])
    return stats.cyclic_autocorrelation(blocks, sets).withColumnRenamed("r", "value")


def _ssb(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    if capture["sample_rate"] == spec["sample_rate"] and not spec["frequency_offset"] and not spec["delay"]:
        return blocks
    return cellular.ssb_iq(blocks, capture["sample_rate"], spec["sample_rate"], spec["subcarrier_spacing"], spec["frequency_offset"], spec["delay"])


def _correlated(blocks: DataFrame, capture: dict, spec: dict, kind: str, mean: bool) -> DataFrame:
    rate, spacing = spec["sample_rate"], spec["subcarrier_spacing"]
    sizes = ofdm.sync_sizes(rate, spacing, spec["max_lag_symbols"])
    starts = tuple(s * sizes["symbol"] + (sizes["secondary"] if kind == "sss" else 0) for s in spec["symbols"])
    period, raw = round(spec["discovery_periodicity"] * rate), _ssb(blocks, capture, spec)
    if kind == "sss":
        return cellular.correlate_sss(raw, rate, spacing, starts, sizes["lags"], period, mean)
    return cellular.correlate_waves(raw, cellular.templates("pss", rate, spacing), starts, sizes["lags"], period, mean)


def _complex_rows(rows: DataFrame) -> DataFrame:
    parts = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("value")) for p in ("re", "im")))).alias("p")
    return rows.select("*", parts).select("*", "p.*")


CORRELATION = ("cellular_cell_id", "cellular_ssb_start_time", "cellular_ssb_beam_index", "cellular_ssb_lag", "iq_part")


@measurement(SYNC, CORRELATION, "√mW", "PSS cross-covariance")
def cellular_5g_pss_correlation(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    return _complex_rows(_correlated(blocks, capture, spec, "pss", False))


@measurement(SYNC, CORRELATION, "√mW", "SSS cross-covariance")
def cellular_5g_sss_correlation(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    return _complex_rows(_correlated(blocks, capture, spec, "sss", False))


def _delay(blocks: DataFrame, capture: dict, spec: dict, kind: str) -> DataFrame:
    found = cellular.sync(_correlated(blocks, capture, spec, kind, True), spec["sample_rate"], delay=round(spec["delay"] * spec["sample_rate"]) / spec["sample_rate"])
    return found.withColumnRenamed("delay", "value")


@measurement(SYNC, (), "s", "PSS synchronisation delay")
def cellular_5g_pss_sync(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    return _delay(blocks, capture, spec, "pss")


@measurement(SYNC, (), "s", "SSS synchronisation delay")
def cellular_5g_sss_sync(blocks: DataFrame, capture: dict, spec: dict) -> DataFrame:
    return _delay(blocks, capture, spec, "sss")


# bindings ---------------------------------------------------------------------------------------------------------------

#: Sources of blocks by the type that a sweep names.
SOURCES: dict[str, tuple[Callable[..., DataFrame], dict[str, Param]]] = {}


def register_source(name: str, params: dict[str, Param]) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Make a function of a session and parameters the source of a type."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in SOURCES:
            raise ValueError(f"there is a source {name} already")
        SOURCES[name] = (f, params)
        return f

    return put


def source_of(spark: SparkSession, spec: dict) -> DataFrame:
    """The blocks of ``{"type": ..., parameters}``; the type decides which parameters there are."""
    kind = spec.get("type")
    if kind not in SOURCES:
        raise ValueError(f"there is no source {kind}; known are {sorted(SOURCES)}")
    f, params = SOURCES[kind]
    given = {k: v for k, v in spec.items() if k != "type"}
    unknown, missing = sorted(set(given) - set(params)), [p for p, q in params.items() if q.default is ... and p not in given]
    if unknown or missing:
        raise ValueError(f"source {kind}: unknown parameters {unknown}, missing {missing}")
    return f(spark, **{p: _coerced(given[p], q.kind, f"{kind}.{p}") if p in given else q.default for p, q in params.items()})


def run_sweep(spark: SparkSession, spec: dict) -> DataFrame:
    """A whole spec: its source's blocks through its analysis."""
    return evaluate(source_of(spark, spec["source"]), spec["capture"], spec["analysis"])
