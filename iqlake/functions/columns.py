"""Power and decibel conversions, counting helpers and labels as Column expressions."""

from __future__ import annotations

import math
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boltzmann's constant in J/K (CODATA 2019, exact).
BOLTZMANN = 1.380649e-23
NEG_INF, NAN = float("-inf"), float("nan")


def pow_to_db(p: Column, eps: float = 0.0) -> Column:
    """10 log10(|p| + eps); zero power is minus infinity."""
    x = F.abs(p) + F.lit(eps)
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(10 * F.log10(x))


def db_to_pow(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def env_to_pow(re: Column, im: Column) -> Column:
    return re * re + im * im


def env_to_db(re: Column, im: Column, eps: float = 0.0) -> Column:
    x = F.hypot(re, im) + F.lit(eps)
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(20 * F.log10(x))


def db_linmean(x: Column) -> Column:
    """Aggregate: mean of decibel values in linear power."""
    return pow_to_db(F.avg(db_to_pow(x)))


def db_linsum(x: Column) -> Column:
    """Aggregate: sum of decibel values in linear power."""
    return pow_to_db(F.sum(db_to_pow(x)))


def is_round_mod(value: Column, div: Column, atol: float = 1e-6) -> Column:
    """True if value / div is whole within ``atol``."""
    q = value / div
    return F.abs(q - F.rint(q)) <= atol


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def whole(value: float, what: str) -> int:
    """A parameter ratio that must be a whole count."""
    n = round(value)
    if abs(value - n) > 1e-6:
        raise ValueError(f"{what} must be a whole count; got {value:g}")
    return n


def int16_to_float(x: Column) -> Column:
    """Full-scale voltage of an int16 sample."""
    return x.cast("float") / F.lit(32767.0)


def adc_headroom(limit: float, re: Column, im: Column) -> Column:
    """Aggregate: whole decibels between a limit and the peak envelope, within a signed byte's range of 100."""
    peak = pow_to_db(F.max(env_to_pow(re, im)))
    return F.greatest(F.least(F.floor(F.lit(limit) - peak), F.lit(100)), F.lit(-100)).cast("int")


def noise_power_db(noise_figure: Column, temperature: float = 290.0, bandwidth: float = 1.0) -> Column:
    """Noise power in dBm of a receiver's noise figure over a bandwidth."""
    return noise_figure + F.lit(10 * math.log10(BOLTZMANN * 1000 * temperature * bandwidth))


def relabel_unit(unit: Column, to: str) -> Column:
    """Units between decibel and linear form: ``linear`` turns dBm into mW, ``db`` the reverse."""
    if to == "linear":
        return F.regexp_replace(F.regexp_replace(unit, "^dBm", "mW"), "^dB(?!m)", "1")
    return F.regexp_replace(unit, "^mW", "dBm")


def si_format(x: Column, unit: str, places: int = 3) -> Column:
    """A number with the SI prefix of its magnitude."""
    steps = [(1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""), (1e-3, "m"), (1e-6, "µ"), (1e-9, "n")]
    out = F.concat(F.format_number(x, places), F.lit(f" {unit}"))
    for scale, prefix in reversed(steps):
        out = F.when(F.abs(x) >= scale, F.concat(F.format_number(x / scale, places), F.lit(f" {prefix}{unit}"))).otherwise(out)
    return out


def timestamp_suffix(ns: Column) -> Column:
    """File-name part for an epoch in nanoseconds."""
    return F.date_format(F.timestamp_micros((ns / 1000).cast("long")), "yyyyMMdd-HH'h'mm'm'ss")


def needs_resample(nfft: Column, nfft_out: Column, host_resample: Column) -> Column:
    """True where a capture is resampled after its acquisition."""
    return (nfft != nfft_out) & host_resample


def read_count(duration: Column, sample_rate: Column, nfft: Column, nfft_out: Column, host_resample: Column, backend_rate: Column, overlap: int = 0, holdoff: float | None = None, strobe: float = 0.0) -> Column:
    """Samples to read for a capture: its output at the backend's rate, an even overlap and, with ``holdoff`` seconds, room for transients and two strobes."""
    if overlap < 0 or overlap % 2:
        raise ValueError("the overlap must be even and not negative")
    whole = is_round_mod(duration * sample_rate, F.lit(1.0))
    out = F.when(whole, F.round(duration * sample_rate)).otherwise(F.raise_error(F.lit("the duration isn't a multiple of the sample period")).cast("double"))
    count = F.when(needs_resample(nfft, nfft_out, host_resample), F.ceil(out * nfft / nfft_out)).otherwise(out).cast("long") + overlap
    if holdoff is None:
        return count
    return count + F.ceil(F.when(host_resample, backend_rate).otherwise(sample_rate) * (holdoff + 2 * strobe))


def to_half(x: Column) -> Column:
    """The nearest number that half precision holds, ties to even; beyond its range infinite, under it subnormal or zero."""
    a = F.abs(x).cast("double")
    e = F.floor(F.log2(a))
    # The logarithm can be off by one beside a power of two.
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
    near = F.rint(a / step) * step
    near = F.when(F.isnan(a) | (a == -NEG_INF) | (a == 0), a).when(near >= 65520, F.lit(-NEG_INF)).otherwise(near)
    return F.when(x < 0, -near).otherwise(near)


def path_of(template: str, fields: dict[str, Column], exact: bool = True) -> Column:
    """A path from a template with ``{field}`` parts: names from the fields, timestamps as in :func:`timestamp_suffix`; null if a field is.

    A field that isn't known raises, or stays as it stands without ``exact``.
    """
    parts = []
    for text, name, form, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if name not in fields:
            if exact:
                raise ValueError(f"no field {name} for the path; there are {sorted(fields)}")
            parts.append(F.lit("{" + name + (f":{form}" if form else "") + "}"))
        else:
            parts.append(F.format_string(f"%{form}", fields[name]) if form else fields[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")
