"""Waveform sources behind Spark's own reader: ``spark.read.format("iq_waveform")`` in batch, ``spark.readStream`` as a stream.

Options: ``kind`` (tone, pulse, sawtooth, noise), ``fs``, ``count`` (samples), ``block`` (samples a row), ``ports``, ``seed`` and the kind's own
parameters. A partition makes its blocks in Arrow batches from their numbers alone, so a lost task or a replayed micro-batch gives the
same samples. As a stream, an offset is a count of blocks and ``blocks_per_batch`` the rate; a live receiver fits the same contract.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "capture_id long, port int, n0 long, re array<double>, im array<double>"


@dataclass(frozen=True)
class Waveform:
    """What the options say; numbers in SI units, powers in decibels."""

    kind: str = "noise"
    fs: float = 1.0
    count: int = 1 << 16
    block: int = 1 << 16
    ports: int = 1
    seed: int = 0
    frequency: float = 0.0
    time: float = 0.0
    period: float = 1.0
    power: float = 0.0
    psd: float = 1.0

    @classmethod
    def of(cls, options: dict[str, str]) -> Waveform:
        given = {k.lower(): v for k, v in options.items()}
        kinds = {"kind": str} | dict.fromkeys(("count", "block", "ports", "seed"), int)
        made = cls(**{k: kinds.get(k, float)(given[k]) for k in cls.__dataclass_fields__ if k in given})
        if made.kind not in KINDS or min(made.block, made.ports) < 1 or made.fs <= 0 or made.count < 0:
            raise ValueError(f"kind must be one of {sorted(KINDS)}; block, ports and fs positive")
        return made

    @property
    def blocks(self) -> int:
        return -(-self.count // self.block)

    def samples(self, port: int, block: int) -> np.ndarray:
        n = np.arange(block * self.block, min((block + 1) * self.block, self.count))
        return KINDS[self.kind](self, port, block, n)


def _noise(w: Waveform, port: int, block: int, n: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng([w.seed, port, block])
    return (rng.normal(size=len(n)) + 1j * rng.normal(size=len(n))) * np.sqrt(w.psd * w.fs / 2)


#: Samples of each kind from the sample numbers.
KINDS = {
    "noise": _noise,
    "tone": lambda w, port, block, n: 10 ** (w.power / 20) * np.exp(2j * np.pi * (n * w.frequency / w.fs % 1)),
    "pulse": lambda w, port, block, n: np.where(n == round(w.time * w.fs), 10 ** (w.power / 20), 1e-20).astype(complex),
    "sawtooth": lambda w, port, block, n: ((n / w.fs) % w.period * 10 ** (w.power / 20) / w.period).astype(complex),
}


@dataclass
class Blocks(InputPartition):
    first: int
    end: int


def read_blocks(w: Waveform, part: Blocks) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for b in range(part.first, part.end):
        x = [w.samples(p, b) for p in range(w.ports)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * w.ports, pa.int64()), pa.array(range(w.ports), pa.int32()), pa.array([b * w.block] * w.ports, pa.int64()), pa.array([y.real for y in x], kind), pa.array([y.imag for y in x], kind)],
            names=["capture_id", "port", "n0", "re", "im"],
        )


def cut(first: int, end: int, parts: int) -> list[Blocks]:
    """Even runs of blocks, at least one (maybe empty)."""
    edges = np.linspace(first, end, max(1, min(parts, end - first)) + 1).astype(int).tolist()
    return [Blocks(a, b) for a, b in zip(edges, edges[1:], strict=False)]


class WaveformReader(DataSourceReader):
    def __init__(self, w: Waveform, parts: int):
        self.w, self.parts = w, parts

    def partitions(self) -> list[Blocks]:
        return cut(0, self.w.blocks, self.parts)

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        return read_blocks(self.w, partition)


class WaveformStream(DataSourceStreamReader):
    def __init__(self, w: Waveform, parts: int, rate: int):
        self.w, self.parts, self.rate, self.seen = w, parts, rate, 0

    def initialOffset(self) -> dict:
        return {"block": 0}

    def latestOffset(self) -> dict:
        self.seen = min(self.w.blocks, self.seen + self.rate)
        return {"block": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        self.seen = max(self.seen, end["block"])  # after a restart the stream goes on from its checkpoint
        return cut(start["block"], end["block"], self.parts)

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        return read_blocks(self.w, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a replay: blocks are made from their numbers."""


class WaveformSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "iq_waveform"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WaveformReader:
        return WaveformReader(Waveform.of(self.options), int(self.options.get("partitions", 8)))

    def streamReader(self, schema: object) -> WaveformStream:
        return WaveformStream(Waveform.of(self.options), int(self.options.get("partitions", 8)), int(self.options.get("blocks_per_batch", 1)))


def register(spark: SparkSession) -> None:
    """Make ``iq_waveform`` known to the session."""
    spark.dataSource.register(WaveformSource)
