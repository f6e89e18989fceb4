"""Streams of readings: gapless carry-over per source, gap and overflow flags, strobe windows and an idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def strobe_windows(stream: DataFrame, time_col: str, strobe: str, late: str = "10 seconds", *aggs) -> DataFrame:
    """Aggregates per strobe period of event time; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, strobe)).agg(*aggs)


def frames_with_carry(stream: DataFrame, size: int, on_gap: str = "restart") -> DataFrame:
    """Whole frames of ``size`` samples per source from rows (source_id, n, value) that arrive in any batches.

    Unused samples and the next expected number are the state. A gap in the numbers restarts the frame (``restart``), or fails the query
    (``except``); each frame says how many samples were lost before it, and how many came late or twice (``late``) and were passed over.
    """
    schema = "source_id string, frame_start long, power double, lost long, late long"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, expected, lost, late = state.get if state.exists else ([], -1, 0, 0)
        rows = pd.concat(list(parts))
        order = np.argsort(rows["n"].to_numpy(), kind="stable")
        n, value = rows["n"].to_numpy()[order], rows["value"].to_numpy(dtype=float)[order]
        fresh = n >= expected
        fresh[1:] &= n[1:] != n[:-1]
        late += int(len(n) - fresh.sum())
        n = np.concatenate([np.arange(expected - len(carry), expected), n[fresh]])
        value = np.concatenate([np.asarray(carry, float), value[fresh]])
        step = np.diff(n, prepend=n[:1])
        if len(n):  # what is carried adjoins; without it the first sample follows the last one seen, if there was one
            step[0] = n[0] - expected + 1 if expected >= 0 and not len(carry) else 1
        gaps = np.flatnonzero(step > 1)
        if len(gaps) and on_gap == "except":
            at = gaps[0]
            raise ValueError(f"samples {n[at] - step[at] + 1} to {n[at] - 1} of {key[0]} were lost")
        out = []
        for s, e in zip([0, *gaps], [*gaps, len(n)], strict=True):  # runs without a gap
            if s in gaps:
                lost += int(step[s] - 1)
            whole = (e - s) // size
            if whole:
                power = (value[s : s + whole * size].reshape(whole, size) ** 2).mean(axis=1)
                out += [(key[0], int(n[s + i * size]), float(p), 0 if i else lost, 0 if i else late) for i, p in enumerate(power)]
                lost = late = 0
            carry = value[s + whole * size : e].tolist()
        if len(n):
            expected = int(n[-1]) + 1
        state.update((carry, expected, lost, late))
        yield pd.DataFrame(out, columns=["source_id", "frame_start", "power", "lost", "late"])

    held = "carry array<double>, expected long, lost long, late long"
    return stream.select("source_id", "n", "value").groupBy("source_id").applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.NoTimeout)


def write_batches(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append micro-batches, each to a folder of its own number: a replayed batch overwrites its own output only."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
