"""Framing of sample series: tumbling, hopping and cyclic frames, neighbour binning, overlap-add, band selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NAN

KEYS = ("capture_id", "port")


def samples(blocks: DataFrame) -> DataFrame:
    """Blocks of samples (n0, re[], im[]) as one row a sample: capture_id, port, n, re, im."""
    z = F.posexplode(F.arrays_zip("re", "im")).alias("i", "z")
    return blocks.select(*KEYS, "n0", z).select(*KEYS, (F.col("n0") + F.col("i")).cast("long").alias("n"), F.col("z.re").cast("double").alias("re"), F.col("z.im").cast("double").alias("im"))


def with_time(blocks: DataFrame, start_ns: Column, fs: float | Column, name: str = "time_ns") -> DataFrame:
    """Blocks with the time of their first sample in nanoseconds: the capture's own start and the sample's number, by a whole and a fractional part so that no nanosecond is lost."""
    fs = fs if isinstance(fs, Column) else F.lit(float(fs))
    seconds = F.floor(F.col("n0") / fs)
    return blocks.withColumn(name, (start_ns + seconds.cast("long") * 1_000_000_000 + F.rint((F.col("n0") - seconds * fs) / fs * 1e9).cast("long")).cast("long"))


def chunks(blocks: DataFrame, size: int | Column, left: int | Column = 0, right: int | Column = 0, keep: tuple[str, ...] = (), one_block: bool = False) -> DataFrame:
    """Blocks of any lengths as chunks of ``size`` samples with their context: capture_id, port, chunk, pieces of (n0, re[], im[]).

    Chunk k holds the samples from k * size - left up to (k + 1) * size + right that the capture has. A sample is sent to each chunk that
    needs it; a task holds the pieces of one chunk. ``size``, ``left`` and ``right`` may be columns, equal in all blocks of a capture, and the columns ``keep``,
    equal as well, come along. With ``one_block`` every capture is one block: its chunks are cut where it lies, and nothing is shuffled; a block that begins later than at 0 raises.

    ``blocks`` may be chunks already (``ranges.read_iq_chunks``): a source that read the context with the samples has nothing to be shuffled either. They must be as long as asked for, with
    as much context at least.
    """
    size, left, right = (F.lit(x) if isinstance(x, int) else x for x in (size, left, right))
    if "pieces" in blocks.columns:
        fits = (F.col("size") == size) & (F.col("left") >= left) & (F.col("right") >= right)
        chunk = F.when(fits, F.col("chunk")).otherwise(F.raise_error(F.lit("chunks of another length, or with too little context")).cast("long"))
        begin, end = F.col("chunk") * size - left, (F.col("chunk") + 1) * size + right

        def trimmed(p: Column) -> Column:
            lo = F.greatest(begin - p["n0"], F.lit(0)).cast("int")
            count = F.greatest(F.least(end - p["n0"], F.size(p["re"]).cast("long")) - lo, F.lit(0)).cast("int")
            return F.struct((p["n0"] + lo).cast("long").alias("n0"), F.slice(p["re"], lo + 1, count).alias("re"), F.slice(p["im"], lo + 1, count).alias("im"))

        return blocks.select(*KEYS, chunk.alias("chunk"), F.transform("pieces", trimmed).alias("pieces"), *keep)
    n0 = F.col("n0").cast("long")
    if one_block:
        n0 = F.when(n0 == 0, n0).otherwise(F.raise_error(F.lit("a capture has several blocks")).cast("long"))
    rows = blocks.where(F.size("re") > 0).select(*KEYS, *keep, n0.alias("n0"), "re", "im", size.cast("long").alias("__size"), left.cast("long").alias("__left"), right.cast("long").alias("__right"))
    first, last = F.floor((F.col("n0") - F.col("__right")) / F.col("__size")), F.floor((F.col("n0") + F.size("re") - 1 + F.col("__left")) / F.col("__size"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.greatest(last, F.lit(0)).cast("long"))))
    start = F.greatest(F.col("chunk") * F.col("__size") - F.col("__left") - F.col("n0"), F.lit(0)).cast("int")
    stop = F.least((F.col("chunk") + 1) * F.col("__size") + F.col("__right") - F.col("n0"), F.size("re").cast("long")).cast("int")
    cut = lambda c: F.slice(c, start + 1, stop - start).cast("array<double>").alias(c)
    rows = rows.where(stop > start).select(*KEYS, *keep, "chunk", F.struct((F.col("n0") + start).alias("n0"), cut("re"), cut("im")).alias("piece"))
    if one_block:
        return rows.select(*KEYS, "chunk", F.array("piece").alias("pieces"), *keep)
    return rows.groupBy(*KEYS, "chunk").agg(F.collect_list("piece").alias("pieces"), *(F.any_value(c).alias(c) for c in keep))


def tumbling(n: Column, size: int) -> Column:
    return F.floor(n / size)


def whole_frames(df: DataFrame, size: int, keys: tuple[str, ...] = KEYS, index: str = "n", strict: bool = False) -> DataFrame:
    """Rows of whole tumbling frames; ``strict`` raises where a series has a remainder."""
    count = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
    joined = df.join(count, list(keys))
    if strict:
        ok = F.when(F.col("__count") % size == 0, F.col("__count")).otherwise(F.raise_error(F.lit(f"the series isn't a multiple of {size} samples")).cast("long"))
        joined = joined.withColumn("__count", ok)
    return joined.where(F.col(index) < F.floor(F.col("__count") / size) * size).drop("__count")


def hopping(df: DataFrame, size: int, hop: int, index: str = "n", last: Column | None = None) -> DataFrame:
    """Each row once for every frame that it is in: adds ``frame`` and ``i``, its place there. ``last`` bounds the frame number."""
    n = F.col(index)
    lo = F.greatest(F.ceil((n - size + 1) / hop), F.lit(0)).cast("long")
    hi = F.floor(n / hop).cast("long")
    hi = F.least(hi, last) if last is not None else hi
    out = df.withColumn("__lo", lo).withColumn("__hi", hi).where("__lo <= __hi").withColumn("frame", F.explode(F.sequence("__lo", "__hi")))
    return out.withColumn("i", n - F.col("frame") * hop).drop("__lo", "__hi")


def cyclic(n: Column, period: int) -> Column:
    return F.pmod(n, F.lit(period))


def overlap_add(frames: DataFrame, hop: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sum of frame samples (frame, i, re, im) at their places in the series."""
    n = (F.col("frame") * hop + F.col("i")).cast("long").alias("n")
    return frames.select(*keys, n, "re", "im").groupBy(*keys, "n").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def binned_layout(size: int, count: int, centered: bool) -> tuple[int, int]:
    """First index and number of the bins of ``count`` neighbours; centred bins keep index size // 2 in a middle bin."""
    if not centered:
        return 0, size // count
    left = (size // 2 - count // 2) // count
    bins = 2 * left + 1
    return size // 2 - count * bins // 2, bins


def binned_mean(df: DataFrame, size: int, count: int, by: tuple[str, ...], index: str, value: str, centered: bool = True, trim_extremes: bool = False) -> DataFrame:
    """Mean of ``count`` neighbours that skips NaN; optionally without each bin's smallest and largest."""
    start, bins = binned_layout(size, count, centered)
    v = F.when(~F.isnan(value), F.col(value))
    at = F.floor((F.col(index) - start) / count)
    grouped = df.where((F.col(index) >= start) & (F.col(index) < start + bins * count)).groupBy(*by, at.cast("long").alias("bin"))
    if trim_extremes:
        n = F.count(v)
        return grouped.agg(F.when(n > 2, (F.sum(v) - F.min(v) - F.max(v)) / (n - 2)).otherwise(F.lit(NAN)).alias(value))
    return grouped.agg(F.coalesce(F.avg(v), F.lit(NAN)).alias(value))


def band_slice(nfft: int, fs: float, bandwidth: float, offset: float = 0.0) -> tuple[int, int]:
    """First bin and bin count of a band around an offset."""
    center = nfft * (0.5 + offset / fs)
    if abs(center - round(center)) > 1e-6:
        raise ValueError("the band's centre isn't on a bin")
    count = round(nfft * bandwidth / fs)
    first = round(center) - count // 2
    if first < 0 or first + count > nfft:
        raise ValueError("the band isn't inside the spectrum")
    return first, count


def trim_band(df: DataFrame, nfft: int, fs: float, bandwidth: float, offset: float = 0.0, index: str = "k") -> DataFrame:
    if bandwidth == float("inf"):
        return df
    first, count = band_slice(nfft, fs, bandwidth, offset)
    return df.where((F.col(index) >= first) & (F.col(index) < first + count))


def null_band(df: DataFrame, nfft: int, fs: float, bandwidth: float, offset: float = 0.0, index: str = "k", value: str = "power") -> DataFrame:
    """NaN in the bins of a band, as around a local oscillator."""
    first, count = band_slice(nfft, fs, bandwidth, offset)
    inside = (F.col(index) >= first) & (F.col(index) < first + count)
    return df.withColumn(value, F.when(inside, F.lit(NAN)).otherwise(F.col(value)))


def frequency(k: Column, nfft: int | Column, fs: float | Column) -> Column:
    """Baseband frequency of a centred bin; size and rate may be columns."""
    if isinstance(nfft, Column) or isinstance(fs, Column):
        nfft, fs = (x if isinstance(x, Column) else F.lit(x) for x in (nfft, fs))
        return (k - F.floor(nfft / 2)) * fs / nfft
    return (k - nfft // 2) * F.lit(fs / nfft)
