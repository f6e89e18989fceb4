"""Y-factor calibration and the look-up of its results by exact keys and interpolation over frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BOLTZMANN, db_linmean, db_to_pow, noise_power_db, pow_to_db

MATCH = ("port", "gain", "lo_shift", "backend_sample_rate", "analysis_bandwidth")


def nyquist_bandwidth(bandwidth: Column, sample_rate: Column) -> Column:
    """The sample rate in place of an infinite bandwidth."""
    return F.when(F.abs(bandwidth) == float("inf"), sample_rate).otherwise(bandwidth)


def y_factor(power: DataFrame, keys: tuple[str, ...], enr_db: Column, t_ref: float = 290.0, bandwidth: Column | None = None) -> DataFrame:
    """Noise figure, temperature and power correction from linear power readings with the noise diode on and off.

    ``power`` has the keys, ``noise_diode_enabled`` and ``value`` (linear); one aggregation pivots both states.
    """
    on, off = F.col("noise_diode_enabled"), ~F.col("noise_diode_enabled")
    both = power.groupBy(*keys).agg(F.avg(F.when(on, F.col("value"))).alias("p_on"), F.avg(F.when(off, F.col("value"))).alias("p_off"), F.max(F.when(on, F.col("value"))).alias("peak_on"), F.max(F.when(off, F.col("value"))).alias("peak_off"))
    y = F.col("p_on") / F.col("p_off")
    nf = F.when(y > 1, enr_db - 10 * F.log10(y - 1))
    out = both.withColumn("noise_figure", nf).withColumn("temperature", t_ref * (db_to_pow(F.col("noise_figure")) - 1))
    enr = db_to_pow(enr_db)
    correction = F.lit(BOLTZMANN * 1000 * t_ref) * enr * (bandwidth if bandwidth is not None else F.lit(1.0)) / (F.col("p_on") - F.col("p_off"))
    papr = lambda peak, mean: pow_to_db(F.col(peak)) - pow_to_db(F.col(mean))
    return out.withColumn("power_correction", correction).withColumn("papr_on", papr("peak_on", "p_on")).withColumn("papr_off", papr("peak_off", "p_off"))


def interpolate(captures: DataFrame, grid: DataFrame, keys: tuple[str, ...], x: str, value: str, out: str, strict: bool = False) -> DataFrame:
    """Linear interpolation of ``value`` over ``x`` among grid rows with equal keys.

    Captures and grid points are united and ordered by x once per key; the last point at or before and the first at or after bracket a
    capture. That is one shuffle on the keys and no range join. Outside the grid the result is null, or an error if ``strict``.
    """
    point = F.struct(F.col(x).alias("x"), F.col(value).alias("y"))
    g = grid.select(*keys, F.col(x).alias("__x"), point.alias("__g"), F.lit(None).cast(captures.select(F.struct("*").alias("r")).schema["r"].dataType).alias("__row"))
    c = captures.select(*keys, F.col(x).alias("__x"), F.lit(None).cast(g.schema["__g"].dataType).alias("__g"), F.struct("*").alias("__row"))
    both = g.unionByName(c)
    before = Window.partitionBy(*keys).orderBy("__x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy("__x").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    bracket = both.withColumn("__lo", F.last("__g", ignorenulls=True).over(before)).withColumn("__hi", F.first("__g", ignorenulls=True).over(after)).where("__row is not null")
    lo, hi = F.col("__lo"), F.col("__hi")
    span = hi["x"] - lo["x"]
    v = F.when(lo.isNull() | hi.isNull(), F.lit(None)).when(span == 0, lo["y"]).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (F.col("__x") - lo["x"]) / F.when(span != 0, span))
    if strict:
        v = F.when(v.isNull(), F.raise_error(F.lit("no calibration at this frequency")).cast("double")).otherwise(v)
    return bracket.select("__row.*", v.cast("double").alias(out))


def missing_calibration(captures: DataFrame, grid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Captures without grid rows of equal keys."""
    return captures.join(grid.select(*keys).distinct(), list(keys), "left_anti")


def summarise(corrections: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Noise figure and correction at each key's largest gain."""
    best = F.max_by(F.struct("noise_figure", "power_correction"), "gain").alias("b")
    return corrections.groupBy(*keys).agg(F.max("gain").alias("gain"), best).select(*keys, "gain", "b.noise_figure", "b.power_correction").dropna()


def system_noise(noise_figure: Column, bandwidth: float, temperature: float = 290.0) -> Column:
    return noise_power_db(noise_figure, temperature, bandwidth)


def mean_db(x: Column) -> Column:
    return db_linmean(x)


def overload(captures: DataFrame, limit: float = 0.0) -> DataFrame:
    """Captures whose headroom is under a limit, with the intermodulation estimate at the largest gain per port and frequency."""
    top = captures.groupBy("port", "center_frequency").agg(F.max("gain").alias("gain_max"))
    im3 = F.col("headroom") + 2 / 3 * (F.col("gain") - F.col("gain_max"))
    return captures.join(top, ["port", "center_frequency"]).withColumn("im3_headroom", im3).where((F.col("headroom") < limit) | (F.col("im3_headroom") < limit))


def missing_keys(captures: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Which key fails a look-up: (key, value) for every value of a key that no row of the grid has. Nulls are misses too."""
    out = None
    for k in keys:
        miss = captures.select(k).distinct().join(grid.select(F.col(k).alias("__g")).distinct(), F.col(k).eqNullSafe(F.col("__g")), "left_anti")
        miss = miss.select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
        out = miss if out is None else out.unionByName(miss)
    return out
