"""Synthetic waveforms: tone, pulse, ramp and seeded noise, as sample rows or blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(count).select(F.lit(0).cast("long").alias("capture_id"), F.lit(0).alias("port"), F.col("id").alias("n"))


def tone(spark: SparkSession, count: int, fs: float, frequency: float, amplitude: float = 1.0) -> DataFrame:
    phase = F.col("n") * F.lit(2 * math.pi * frequency / fs)
    return _rows(spark, count).withColumn("re", amplitude * F.cos(phase)).withColumn("im", amplitude * F.sin(phase))


def pulse(spark: SparkSession, count: int, fs: float, time: float, power_db: float = 0.0) -> DataFrame:
    at = round(time * fs)
    return _rows(spark, count).withColumn("re", F.when(F.col("n") == at, F.lit(10 ** (power_db / 20))).otherwise(1e-20)).withColumn("im", F.lit(0.0))


def sawtooth(spark: SparkSession, count: int, fs: float, period: float, power_db: float = 0.0) -> DataFrame:
    t = F.col("n") / fs
    return _rows(spark, count).withColumn("re", F.pmod(t, F.lit(period)) * F.lit(10 ** (power_db / 20) / period)).withColumn("im", F.lit(0.0))


def noise(spark: SparkSession, count: int, fs: float, psd: float, block: int = 1 << 16, seed: int = 0) -> DataFrame:
    """White Gaussian noise of a power spectral density, in blocks; each block is seeded by its own number."""
    scale = math.sqrt(psd * fs / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                n = min(block, count - i * block)
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([i * block], pa.int64()), pa.array([rng.normal(0, scale, n)], kind), pa.array([rng.normal(0, scale, n)], kind)], names=["capture_id", "port", "n0", "re", "im"])

    return spark.range(-(-count // block)).mapInArrow(run, "capture_id long, port int, n0 long, re array<double>, im array<double>")


#: Tasks a core that make waveforms.
TASKS_A_CORE = 3


def made_blocks(captures: DataFrame, make: Callable[[int, float], np.ndarray], value: str, block: int = 1 << 16) -> DataFrame:
    """Blocks of a waveform per capture: ``make(capture_id, value)`` gives its samples from the capture's own number, so a task that is run again makes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = make(i, v)
                for s in range(0, len(x), block):
                    y = x[s : s + block]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([0], pa.int32()), pa.array([s], pa.int64()), pa.array([y.real], kind), pa.array([y.imag], kind)], names=["capture_id", "port", "n0", "re", "im"])

    # A row makes a waveform many times its size, so a table of few bytes is dealt to all cores before that.
    rows = captures.select(F.col("capture_id").cast("long"), F.col(value).cast("double")).repartition(TASKS_A_CORE * captures.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(run, "capture_id long, port int, n0 long, re array<double>, im array<double>")


def noise_of(captures: DataFrame, count: int, fs: float, psd: str = "psd", seed: int = 0) -> DataFrame:
    """White Gaussian noise of each capture's own power spectral density."""

    def make(i: int, density: float) -> np.ndarray:
        rng = np.random.default_rng([seed, i])
        return (rng.normal(size=count) + 1j * rng.normal(size=count)) * math.sqrt(density * fs / 2)

    return made_blocks(captures, make, psd)


def placed(captures: DataFrame, wave: np.ndarray, count: int, delay: str = "delay", noise: float = 0.0, seed: int = 0, block: int = 1 << 16) -> DataFrame:
    """A wave at each capture's own delay (in samples), in noise of that amplitude."""

    def make(i: int, at: float) -> np.ndarray:
        rng = np.random.default_rng([seed, i])
        x = noise * (rng.normal(size=count) + 1j * rng.normal(size=count))
        x[int(at) : int(at) + len(wave)] += wave[: max(0, count - int(at))]
        return x

    return made_blocks(captures, make, delay, block)


def blocks_of(samples: DataFrame, size: int) -> DataFrame:
    """Sample rows gathered into blocks of ``size``."""
    parts = samples.groupBy("capture_id", "port", (F.floor(F.col("n") / size) * size).cast("long").alias("n0")).agg(F.array_sort(F.collect_list(F.struct("n", "re", "im"))).alias("z"))
    return parts.select("capture_id", "port", "n0", F.col("z.re").alias("re"), F.col("z.im").alias("im"))
