"""Which samples a receiver acquires for each capture, what successive captures share, and what it passes over first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holdoff(start_ns: Column, fs: Column, overlap: Column, transient: float = 0.0, strobe: float | None = None, carried: Column | None = None) -> Column:
    """Samples from the stream's time ``start_ns`` to a capture's first one.

    They hold the overlap before it and, unless samples are ``carried`` over from the capture before, the receiver's transient. With ``strobe`` seconds the capture
    begins at a multiple of them, later by whole periods where that would cut into the rest; times are compared in nanoseconds.
    """
    settled = F.rint(transient * fs)
    least = overlap + (settled if carried is None else F.when(carried, 0).otherwise(settled))
    if not strobe:
        return least.cast("long")
    period_ns = round(strobe * 1e9)
    wait = F.rint(F.pmod(period_ns - F.pmod(start_ns, F.lit(period_ns)), F.lit(period_ns)) / 1e9 * fs)
    period = F.rint(strobe * fs)
    return F.when(wait < least, wait + F.ceil(least / period) * period).otherwise(wait).cast("long")


def plan_reads(captures: DataFrame, order: str, by: tuple[str, ...], settings: tuple[str, ...], size: str = "size", low: str = "overlap_low", high: str = "overlap_high") -> DataFrame:
    """The stretch of the stream that every capture needs, and what the one before leaves for it.

    Captures of a receiver (``by``) stand one behind the other in ``order``; where all ``settings`` stay equal the receiver runs on, so their own samples adjoin. Adds ``run`` (number of the
    stretch without a change of settings), ``start`` (first own sample in the run's stream), ``read_start`` and ``read_stop`` (with overlaps), ``shared`` (samples that the capture before has
    read too), ``fresh`` (samples still to read) and ``missing`` (samples of its overlap that lie before what the capture before holds; at a run's beginning none).
    """
    w = Window.partitionBy(*by).orderBy(order)
    same = F.lag(F.lit(True)).over(w).isNotNull()
    for s in settings:
        same = same & F.lag(s).over(w).eqNullSafe(F.col(s))
    out = captures.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w).cast("long") - 1).drop("__new")
    run = Window.partitionBy(*by, "run").orderBy(order)
    before = F.coalesce(F.sum(size).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("start", (F.first(low).over(run) + before).cast("long"))
    out = out.withColumns({"read_start": (F.col("start") - F.col(low)).cast("long"), "read_stop": (F.col("start") + F.col(size) + F.col(high)).cast("long")})
    held_from, held_to = F.lag("read_start").over(run), F.lag("read_stop").over(run)
    common = F.greatest(F.least(held_to, F.col("read_stop")) - F.greatest(held_from, F.col("read_start")), F.lit(0))
    gone = F.greatest(held_from - F.col("read_start"), F.lit(0))
    out = out.withColumns({n: F.when(held_from.isNull(), 0).otherwise(x).cast("long") for n, x in (("shared", common), ("missing", gone))})
    return out.withColumn("fresh", F.col("read_stop") - F.col("read_start") - F.col("shared") - F.col("missing"))
