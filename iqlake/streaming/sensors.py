"""Streams of a sensor: samples out of order with holdoff after a loss, readings of peripherals beside captures, calibrations that leave when they are whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def settled(n: int, holdoff: int, strobe: int) -> int:
    """The first sample from ``n`` on that counts: behind the holdoff, at a multiple of the strobe."""
    return -(-(n + holdoff) // strobe) * strobe


def acquired_frames(stream: DataFrame, size: int, holdoff: int = 0, strobe: int = 1, patience: int = 0, on_loss: str = "restart", idle_ms: int | None = None) -> DataFrame:
    """Whole frames of ``size`` samples per source from rows (source_id, n, value) in any order and any batches.

    Samples that come early wait: only when one ``patience`` samples or more beyond a gap is there, or nothing came for ``idle_ms``, the gap is lost. Behind a loss, and at the
    start, ``holdoff`` samples are passed over and the next frame begins at a multiple of ``strobe``; ``except`` fails the query instead. A frame tells the samples lost
    before it, and how many came late or twice (``late``). The state holds less than a frame and the samples within the patience, whatever comes.
    """
    schema = "source_id string, frame_start long, power double, lost long, late long"
    held = "position long, usable long, lost long, late long, carry array<double>, waiting_n array<long>, waiting array<double>"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position, usable, lost, late, carry, waiting_n, waiting = state.get if state.exists else (-1, -1, 0, 0, [], [], [])
        frames = [p for p in parts if len(p)]
        n = np.concatenate([np.asarray(waiting_n, np.int64), *(f["n"].to_numpy(np.int64) for f in frames)])
        value = np.concatenate([np.asarray(waiting, float), *(f["value"].to_numpy(float) for f in frames)])
        n, first = np.unique(n, return_index=True)
        late += len(value) - len(first)
        value = value[first]
        if position >= 0:
            fresh = n >= position
            late += int((~fresh).sum())
            n, value = n[fresh], value[fresh]
        elif len(n):
            position = int(n[0])
            usable = settled(position, holdoff, strobe)
        out: list[tuple] = []
        while len(n):
            gap = int(n[0]) - position
            if gap:
                if n[-1] - position < patience and not state.hasTimedOut:
                    break
                if on_loss == "except":
                    raise ValueError(f"samples {position} to {n[0] - 1} of {key[0]} were lost")
                lost, carry, position = lost + gap, [], int(n[0])
                usable = settled(position, holdoff, strobe)
            end = int(np.argmax(np.append(np.diff(n) != 1, True))) + 1
            skip = min(end, max(0, usable - position))
            ready = np.concatenate([carry, value[skip:end]])
            start = position + skip - len(carry)
            whole = len(ready) // size
            for i, p in enumerate((ready[: whole * size].reshape(whole, size) ** 2).mean(axis=1).tolist() if whole else []):
                out.append((key[0], start + i * size, p, 0 if i else lost, 0 if i else late))
                lost = late = 0
            carry = ready[whole * size :].tolist()
            position = int(n[end - 1]) + 1
            n, value = n[end:], value[end:]
        state.update((position, usable, lost, late, list(carry), n.tolist(), value.tolist()))
        if idle_ms is not None and len(n):
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source_id", "frame_start", "power", "lost", "late"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return stream.select("source_id", "n", "value").groupBy("source_id").applyInPandasWithState(run, schema, held, "append", timeout)


def merge_readings(captures: DataFrame, readings: DataFrame, keys: list[str], before: str = "5 seconds", after: str = "5 seconds", late: str = "10 seconds", time: str = "time", reading_time: str = "reading_time") -> DataFrame:
    """A stream of captures with a stream of peripheral readings taken from ``before`` to ``after`` each capture; null where there are none.

    Both streams have a watermark ``late``, so Spark drops a capture's state once no reading in time can come any more, and only then is a capture without one told.
    """
    clash = (set(captures.columns) & set(readings.columns)) - set(keys)
    if clash:
        raise ValueError(f"names that captures and readings share: {sorted(clash)}")
    left = captures.withWatermark(time, late).alias("c")
    right = readings.withWatermark(reading_time, late).select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in readings.columns if c not in keys)).alias("r")
    near = F.col(reading_time).between(F.expr(f"{time} - interval {before}"), F.expr(f"{time} + interval {after}"))
    on = near
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(right, on, "leftOuter").drop(*(f"__{k}" for k in keys))


def whole_groups(stream: DataFrame, keys: list[str], fields: list[str], points: list[tuple], value: str = "value") -> DataFrame:
    """Readings (keys, fields, value) of the groups that have all ``points`` (values of ``fields``), each group once, in the batch in which its last point comes.

    Points come in any order and batches; one that comes again before the group is whole takes the place of the first, one that comes after it, or isn't among the points, is
    passed over. A group's state ends with its number of points.
    """
    wanted = {tuple(map(str, p)): p for p in points}
    if len(wanted) != len(points):
        raise ValueError("a point is listed twice")
    kinds = {c: stream.schema[c].dataType.simpleString() for c in [*keys, *fields]}
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), f"{value} double"])
    columns = [*keys, *fields, value]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values, done = state.get if state.exists else ([], [], False)
        have, out = dict(zip(names, values, strict=True)), []
        for part in parts:
            for row in part[[*fields, value]].itertuples(index=False):
                point = tuple(str(x) for x in row[:-1])
                if point in wanted and not done:
                    have["\x1f".join(point)] = float(row[-1])
        if not done and len(have) == len(wanted):
            out = [(*key, *wanted[tuple(p.split("\x1f"))], v) for p, v in sorted(have.items())]
            have, done = {}, True
        state.update((list(have), list(have.values()), done))
        yield pd.DataFrame(out, columns=columns)

    return stream.select(*columns).groupBy(*keys).applyInPandasWithState(run, schema, "names array<string>, values array<double>, done boolean", "append", GroupStateTimeout.NoTimeout)
