"""Detectors, histograms, distribution functions and lagged products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.columns import NEG_INF, env_to_pow, pow_to_db
from .frames import KEYS, chunks, cyclic, tumbling

NAMED = {"min": F.min, "max": F.max, "peak": F.max, "mean": F.avg, "rms": F.avg, "median": F.median}


def statistic(kind: str | float, col: Column) -> Column:
    """Aggregate by name (min, max, peak, mean, rms, median) or exact quantile by number, linear between ranks."""
    return NAMED[kind](col) if isinstance(kind, str) else F.percentile(col, float(kind))


def label(kind: str | float) -> str:
    return kind if isinstance(kind, str) else f"{kind:g}"


def to_long(df: DataFrame, kinds: tuple, name: str, value: str = "value") -> DataFrame:
    """Columns of ``kinds`` as rows (name, value)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(label(k)).alias(name), F.col(f"`{label(k)}`").cast("double").alias(value)) for k in kinds))).alias("__p")
    keep = [c for c in df.columns if c not in {label(k) for k in kinds}]
    return df.select(*keep, pairs).select(*keep, f"__p.{name}", f"__p.{value}")


def bin_power(iq: DataFrame, size: int, detectors: tuple = ("rms", "peak"), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Power per tumbling bin and detector in linear units: keys, bin, power_detector, value."""
    p = env_to_pow(F.col("re"), F.col("im"))
    wide = iq.withColumn("__p", p).groupBy(*keys, tumbling(F.col("n"), size).cast("long").alias("bin")).agg(*(statistic(d, F.col("__p")).alias(label(d)) for d in detectors))
    return to_long(wide, detectors, "power_detector")


def block_power(blocks: DataFrame, size: int, detectors: tuple = ("rms", "peak")) -> DataFrame:
    """:func:`bin_power` from blocks of samples: a kernel leaves one partial row a bin and block, not a row a sample. Detectors are those that partials add up to."""
    parts = {"min": F.min("lo"), "max": F.max("hi"), "peak": F.max("hi"), "mean": F.sum("s") / F.sum("c"), "rms": F.sum("s") / F.sum("c")}
    if set(detectors) - set(parts):
        raise ValueError("medians and quantiles need the samples: use bin_power")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            re, im = (np.asarray(b.column(c).flatten().to_numpy(zero_copy_only=False), float) for c in (3, 4))
            if not len(re):
                continue
            p = re * re + im * im
            # All blocks of the batch side by side: a run is what one of them has of one bin.
            sizes = pc.fill_null(pc.list_value_length(b.column(3)), 0).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bins = (b.column(2).to_numpy()[row] + np.arange(len(p)) - begins[row]) // size
            at = np.flatnonzero((np.diff(bins, prepend=bins[0] - 1) != 0) | (np.diff(row, prepend=-1) != 0))
            mine = row[at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine)), b.column(1).take(pa.array(mine)), pa.array(bins[at]), pa.array(np.add.reduceat(p, at)), pa.array(np.diff(at, append=len(p))), pa.array(np.minimum.reduceat(p, at)), pa.array(np.maximum.reduceat(p, at))], names=[*KEYS, "bin", "s", "c", "lo", "hi"])

    rows = blocks.select(F.col("capture_id").cast("long"), F.col("port").cast("int"), F.col("n0").cast("long"), "re", "im")
    partial = rows.mapInArrow(run, "capture_id long, port int, bin long, s double, c long, lo double, hi double")
    return to_long(partial.groupBy(*KEYS, "bin").agg(*(parts[d].alias(d) for d in detectors)), detectors, "power_detector")


def binned(iq: DataFrame, size: int, detectors: tuple, keys: tuple[str, ...]) -> DataFrame:
    return block_power(iq, size, detectors) if isinstance(iq.schema["re"].dataType, ArrayType) else bin_power(iq, size, detectors, keys)


def channel_power_time_series(iq: DataFrame, size: int, period: float, detectors: tuple = ("rms", "peak"), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Power readings in dB over time, from samples (re, im) or blocks of them (re[], im[])."""
    bins = binned(iq, size, detectors, keys)
    return bins.select(*keys, "power_detector", (F.col("bin") * period).alias("time_elapsed"), pow_to_db(F.col("value")).alias("value"))


def cyclic_channel_power(iq: DataFrame, size: int, bins_per_cycle: int, detectors: tuple = ("rms", "peak"), stats: tuple = ("min", "mean", "max"), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Detector bins folded by a period, a statistic over cycles, in dB."""
    folded = binned(iq, size, detectors, keys).withColumn("cyclic_lag", cyclic(F.col("bin"), bins_per_cycle))
    wide = folded.groupBy(*keys, "power_detector", "cyclic_lag").agg(*(statistic(s, F.col("value")).alias(label(s)) for s in stats))
    return to_long(wide, stats, "cyclic_statistic").withColumn("value", pow_to_db(F.col("value")))


def power_centers(low: float, high: float, step: float) -> list[float]:
    """Bin centres with a catch-all on either side."""
    n = max(0, -int(-(high - low) / step // 1))
    inner = [low + i * step for i in range(n) if low + i * step < high - 1e-9]
    if not inner or high - inner[-1] > step / 2:
        inner.append(high)
    return [NEG_INF, *inner, -NEG_INF]


def bin_index(x: Column, low: float, high: float, step: float) -> Column:
    """Index among :func:`power_centers` of the bin that holds x: intervals are closed on the left."""
    last = len(power_centers(low, high, step)) - 1
    inner = F.floor((x - (low - step / 2)) / step) + 1
    return F.when(x < low - step / 2, F.lit(0)).when(x >= high + step / 2, F.lit(last)).otherwise(F.least(inner, F.lit(last - 1))).cast("long")


def bin_center(bin_: Column, low: float, high: float, step: float) -> Column:
    """Centre of a bin by its index; the catch-alls on either side are infinite."""
    return F.element_at(F.array(*map(F.lit, power_centers(low, high, step))), bin_.cast("int") + 1)


def histogram(df: DataFrame, value: str, low: float, high: float, step: float, by: tuple[str, ...] = (), normalise_by: tuple[str, ...] = (), drop_inf: bool = False) -> DataFrame:
    """Counts and fractions per bin; fractions are of the rows with equal ``normalise_by``. NaN is dropped."""
    ok = ~F.isnan(value)
    if drop_inf:
        ok = ok & (F.col(value) != -NEG_INF)
    counts = df.where(ok).groupBy(*by, bin_index(F.col(value), low, high, step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if normalise_by:
        total = F.sum("n").over(Window.partitionBy(*normalise_by))
        return counts.withColumn("fraction", F.col("n") / total)
    totals = counts.agg(F.sum("n").alias("__total"))  # one row
    return counts.crossJoin(F.broadcast(totals)).withColumn("fraction", F.col("n") / F.col("__total")).drop("__total")


def ccdf(df: DataFrame, value: str, edges: list[float], by: tuple[str, ...] = (), density: bool = True) -> DataFrame:
    """Share of values over each edge: bucket counts, then a running sum from the top; one pass over the rows."""
    spark = df.sparkSession
    place = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < F.col(value)))
    counts = df.where(~F.isnan(value)).groupBy(*by, place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.collect_list(F.struct("place", "n")).alias("c")).where("total is not null")  # one entry an edge
    table = edge_table(spark, edges)
    over = F.aggregate(F.filter("c", lambda x: x["place"] > F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = groups.crossJoin(F.broadcast(table)).select(*by, "edge", over.alias("n"), "total")
    return out.select(*by, "edge", (F.col("n") / F.col("total") if density else F.col("n")).alias("ccdf"))


def edge_table(spark: SparkSession, edges: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(sorted(edges))], "i int, edge double")


def lagged_product(iq: DataFrame, lag: int, indexes: list[int], lags: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """|mean over i in ``indexes`` of x[i + j] conj(x[i + j + lag])| for j < ``lags``; terms past the end count as zero."""
    spark = iq.sparkSession
    at = spark.createDataFrame([(i,) for i in indexes], "i long")
    want = at.crossJoin(spark.range(lags).withColumnRenamed("id", "j")).withColumn("n", F.col("i") + F.col("j"))
    a = iq.join(F.broadcast(want), "n")
    b = iq.select(*keys, (F.col("n") - lag).alias("n"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = a.join(b, [*keys, "n"], "left")
    re = F.coalesce(F.col("re") * F.col("re2") + F.col("im") * F.col("im2"), F.lit(0.0))
    im = F.coalesce(F.col("im") * F.col("re2") - F.col("re") * F.col("im2"), F.lit(0.0))
    return both.groupBy(*keys, "j").agg(F.hypot(F.sum(re), F.sum(im)).alias("s")).select(*keys, "j", (F.col("s") / len(indexes)).alias("r"))


def lagged_product_blocks(blocks: DataFrame, lag: int, indexes: list[int], lags: int, size: int = 1 << 18, one_block: bool = False) -> DataFrame:
    """:func:`lagged_product` from blocks: chunks with ``lag`` samples of context leave one partial row a lag."""
    from .filters import chunk_rows, chunk_samples

    at = np.asarray(sorted(indexes), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, parts = [], []
            for cap, port, k, pieces in chunk_rows(b):
                x, own, _ = chunk_samples(pieces, k * size, size, 0, lag)
                own = max(own, 0)
                product = x[:own] * np.conj(x[lag : lag + own])
                first = k * size
                # The indexes whose sample at lag j stands in this chunk are one run of the sorted list.
                lo, hi = np.searchsorted(at, first - np.arange(lags)), np.searchsorted(at, first + own - np.arange(lags))
                parts.append([product[at[s:e] + j - first].sum() for j, (s, e) in enumerate(zip(lo, hi, strict=True))])
                keys.append((cap, port))
            sums = np.array(parts, complex).ravel()
            full = lambda c, t: pa.array(np.repeat(np.array([x[c] for x in keys], np.int64), lags), t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([full(0, pa.int64()), full(1, pa.int64()).cast(pa.int32()), pa.array(np.tile(np.arange(lags, dtype=np.int64), len(keys))), pa.array(np.ascontiguousarray(sums.real)), pa.array(np.ascontiguousarray(sums.imag))], names=[*KEYS, "j", "re", "im"])

    rows = chunks(blocks, size, 0, lag, one_block=one_block).select(F.col("capture_id").cast("long"), F.col("port").cast("int"), "chunk", "pieces")
    partial = rows.where(F.col("chunk") <= (int(at.max()) + lags) // size).mapInArrow(run, "capture_id long, port int, j long, re double, im double")
    return partial.groupBy(*KEYS, "j").agg((F.hypot(F.sum("re"), F.sum("im")) / len(indexes)).alias("r"))


def cyclic_autocorrelation(blocks: DataFrame, sets: list[dict], size: int = 1 << 18, one_block: bool = False, measured_only: bool = False) -> DataFrame:
    """|mean of x[i + j] conj(x[i + j + nfft])| over the prefixes of each link direction and subcarrier spacing (``ofdm.prefix_sets``): keys, link_direction, subcarrier_spacing, j, r.

    All sets are taken in one pass over chunks. A set's prefixes are runs of samples, so a lag is a difference of running sums per run. The rows make a
    dense grid: r is null for the lags that a spacing hasn't and where a direction has no prefix; samples behind a capture's end count as zero.
    With ``measured_only`` r is null too where the capture has both samples of no product at all, as it ends before a direction's first slot.
    """
    from .filters import chunk_rows, chunk_samples

    used = [(k, s) for k, s in enumerate(sets) if len(s["indexes"])]
    most = max((s["nfft"] for _, s in used), default=0)
    plans = []
    for k, s in used:
        at = np.sort(np.asarray(s["indexes"], np.int64))
        begin = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
        plans.append((k, s["nfft"], s["lags"], at[begin], at[np.append(begin[1:], len(at)) - 1] + 1))
    last = max((int(end.max()) + lags for _, _, lags, _, end in plans), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cap, port, chunk, pieces in chunk_rows(b):
                x, own, _ = chunk_samples(pieces, chunk * size, size, 0, most)
                if own <= 0:
                    continue
                first, sums, pairs = chunk * size, {}, {}
                has = np.zeros(len(x), bool)
                for n0, re, _ in pieces:
                    has[max(0, n0 - first) : max(0, n0 - first + len(re))] = True
                for k, nfft, lags, begin, end in plans:
                    if nfft not in sums:
                        sums[nfft] = np.concatenate([[0], np.cumsum(x[:own] * np.conj(x[nfft : nfft + own]))])
                        pairs[nfft] = np.concatenate([[0], np.cumsum(has[:own] & has[nfft : nfft + own])])
                    near = (end + lags > first) & (begin < first + own)
                    if not near.any():
                        continue
                    j = np.arange(lags)
                    place = lambda a: np.clip(a[near][:, None] - first + j, 0, own)  # noqa: E731, B023
                    r = (sums[nfft][place(end)] - sums[nfft][place(begin)]).sum(axis=0)
                    if measured_only:
                        j = np.flatnonzero((pairs[nfft][place(end)] - pairs[nfft][place(begin)]).sum(axis=0))
                        r = r[j]
                    full = lambda v, t: pa.array(np.full(len(j), v), t)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([full(cap, pa.int64()), full(port, pa.int32()), full(k, pa.int32()), pa.array(j), pa.array(np.ascontiguousarray(r.real)), pa.array(np.ascontiguousarray(r.imag))], names=[*KEYS, "set", "j", "re", "im"])

    rows = chunks(blocks, size, 0, most, one_block=one_block).select(F.col("capture_id").cast("long"), F.col("port").cast("int"), "chunk", "pieces")
    partial = rows.where(F.col("chunk") <= last // size).mapInArrow(run, "capture_id long, port int, set int, j long, re double, im double")
    count = F.element_at(F.array(*(F.lit(max(1, len(s["indexes"]))) for s in sets)), F.col("set") + 1)
    found = partial.groupBy(*KEYS, "set", "j").agg((F.hypot(F.sum("re"), F.sum("im"))).alias("r")).withColumn("r", F.col("r") / count)
    lags = max(s["lags"] for s in sets)
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("set"), F.lit(s["direction"]).alias("link_direction"), F.lit(s["spacing"]).alias("subcarrier_spacing")) for k, s in enumerate(sets)))).alias("g")
    captures = blocks.select(F.col("capture_id").cast("long"), F.col("port").cast("int")).distinct()
    dense = captures.select(*KEYS, grid).select(*KEYS, "g.*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lags - 1).cast("long"))).alias("j"))
    held = F.element_at(F.array(*(F.lit(s["lags"] if len(s["indexes"]) else 0) for s in sets)), F.col("set") + 1)  # lags that the set has
    r = F.col("r") if measured_only else F.when(F.col("j") < held, F.coalesce("r", F.lit(0.0))).alias("r")
    return dense.join(found, [*KEYS, "set", "j"], "left").select(*KEYS, "link_direction", "subcarrier_spacing", "j", r)


def contiguous_segments(df: DataFrame, order: str, by: tuple[str, ...], threshold: float = 7.0, ties: tuple[str, ...] = ()) -> DataFrame:
    """``segment``: a new one where the step to the row before exceeds ``threshold`` times the median step of its series ``by``."""
    if not by:
        raise ValueError("a series needs a key: without one a single task would sort the whole table")
    w = Window.partitionBy(*by).orderBy(order, *ties)
    stepped = df.withColumn("__step", F.col(order) - F.lag(order).over(w))
    median = stepped.groupBy(*by).agg(F.median("__step").alias("__median"))
    joined = stepped.join(median, list(by))
    new = F.coalesce(F.col("__step") > threshold * F.col("__median"), F.lit(False)).cast("int")
    return joined.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w).cast("long")).drop("__step", "__median", "__new")


def trim_histogram(hist: DataFrame, bin_col: str, count_col: str, by: tuple[str, ...], pad_low: int = 12, pad_high: int = 3) -> DataFrame:
    """The bins around the mode of a histogram: those with counts, and some more on either side."""
    held = hist.where(F.col(count_col) > 0).groupBy(*by).agg(F.min(bin_col).alias("__lo"), F.max(bin_col).alias("__hi"))
    return hist.join(held, list(by)).where((F.col(bin_col) >= F.col("__lo") - pad_low) & (F.col(bin_col) <= F.col("__hi") + pad_high)).drop("__lo", "__hi")


def random_starts(lengths: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Starts of whole bins at random places of each capture, as many as would fit side by side: keys, bin, start.

    ``lengths`` has the samples of each capture (n). A start is a hash of seed, keys and bin, so a rerun task draws the same; a capture of one bin starts at 0.
    """
    rows = lengths.where(F.col("n") >= size).select(*KEYS, "n", F.posexplode(F.array_repeat(F.lit(0), F.floor(F.col("n") / size).cast("int"))).alias("bin", "__0"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), *KEYS, "bin")), 1, 8), 16, 10).cast("long")
    return rows.select(*KEYS, F.col("bin").cast("long").alias("bin"), F.pmod(drawn, F.greatest(F.col("n") - size, F.lit(1))).alias("start"))


def random_bin_power(iq: DataFrame, size: int, detectors: tuple = ("rms", "peak"), seed: int = 0) -> DataFrame:
    """:func:`bin_power` with bins at random starts; they may overlap. A capture's samples are numbered from zero without a gap."""
    lengths = iq.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    starts = random_starts(lengths, size, seed)
    wanted = starts.select(*KEYS, "bin", F.explode(F.sequence("start", F.col("start") + size - 1)).alias("n"))
    power = env_to_pow(F.col("re"), F.col("im"))
    rows = iq.join(wanted, [*KEYS, "n"]).withColumn("__p", power)
    wide = rows.groupBy(*KEYS, "bin").agg(*(statistic(d, F.col("__p")).alias(label(d)) for d in detectors))
    return to_long(wide, detectors, "power_detector")


def random_bin_power_blocks(blocks: DataFrame, size: int, detectors: tuple = ("rms", "peak"), seed: int = 0) -> DataFrame:
    """:func:`random_bin_power` from blocks: a kernel draws the starts again and leaves one partial row a bin and block, not a row a sample.

    Only the captures' lengths are aggregated before; Spark picks their join by size. Detectors are those that partials add up to.
    """
    parts = {"min": F.min("lo"), "max": F.max("hi"), "peak": F.max("hi"), "mean": F.sum("s") / F.sum("c"), "rms": F.sum("s") / F.sum("c")}
    if set(detectors) - set(parts):
        raise ValueError("medians and quantiles need the samples: use random_bin_power")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, values = [], []
            for i, (cap, port, n0, n) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 5)), strict=True)):
                re, im = (np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False), float) for c in (3, 4))
                p = re * re + im * im
                room = max(n - size, 1)
                for k in range(n // size):
                    start = int(hashlib.md5(f"{seed}-{cap}-{port}-{k}".encode()).hexdigest()[:8], 16) % room
                    some = p[max(0, start - n0) : max(0, start + size - n0)]
                    if len(some):
                        heads.append((cap, port, k))
                        values.append((some.sum(), len(some), some.min(), some.max()))
            columns = [*zip(*heads, strict=True)] or [()] * 3, [*zip(*values, strict=True)] or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns[0], *columns[1]], kinds, strict=True)], names=[*KEYS, "bin", "s", "c", "lo", "hi"])

    lengths = blocks.groupBy(*KEYS).agg(F.sum(F.size("re")).cast("long").alias("__n"))
    rows = blocks.join(lengths, list(KEYS)).select(F.col("capture_id").cast("long"), F.col("port").cast("int"), F.col("n0").cast("long"), "re", "im", "__n")
    partial = rows.mapInArrow(run, "capture_id long, port int, bin long, s double, c long, lo double, hi double")
    return to_long(partial.groupBy(*KEYS, "bin").agg(*(parts[d].alias(d) for d in detectors)), detectors, "power_detector")
