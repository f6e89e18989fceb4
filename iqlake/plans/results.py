"""Queries over stored results: last sweep, uniqueness, unstacking, time concatenation."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pow_to_db


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that don't name one row, over all groups."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def last_match(df: DataFrame, order: str, field: str) -> DataFrame:
    """Rows whose field equals that of the last row in order, as for the last sweep."""
    last = df.agg(F.max_by(field, order).alias("__last"))  # one row
    return df.join(F.broadcast(last), F.col(field) == F.col("__last")).drop("__last")


def unstack(df: DataFrame, keys: list[str], column: str, value: str, values: list | None = None) -> DataFrame:
    return df.groupBy(*keys).pivot(column, values).agg(F.first(value))


def concat_outer(*frames: DataFrame) -> DataFrame:
    """Rows of all, columns of any."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def concat_time(df: DataFrame, order: list[str], by: list[str], step: float, name: str = "time") -> DataFrame:
    """A uniform time axis over successive captures of a series."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1) * step)


def select(df: DataFrame, query: str | None = None) -> DataFrame:
    """A boolean expression on columns."""
    return df.where(F.expr(query)) if query else df


def group_fields(pattern: str, loops: tuple[str, ...] = (), by: tuple[str, ...] = (), exclude: tuple[str, ...] = ("name",)) -> list[str]:
    """Columns that name a report's groups: those asked for, those in the file name's pattern, and the loops, each once and in this order."""
    named = [f for _, f, _, _ in Formatter().parse(pattern) if f is not None and f not in exclude]
    return list(dict.fromkeys([*by, *named, *loops]))


def group_rows(df: DataFrame, group: dict) -> DataFrame:
    """The rows of one group; a null value stands for null."""
    for name, value in group.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def strongest(df: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """Of each group, the rows of the label with the largest value; ties go to the smallest label. Nulls and NaN don't count."""
    peaks = df.where(~F.isnan(value)).groupBy(*by, label).agg(F.max(value).alias("__peak"))
    best = peaks.groupBy(*by).agg(F.max("__peak").alias("__peak")).join(peaks, [*by, "__peak"])
    best = best.groupBy(*by).agg(F.min(label).alias(label))
    return df.join(best, [*by, label])


def correlation_report(correlation: DataFrame, hue: str, keys: list[str]) -> DataFrame:
    """Power in dB of the first period per lag and ``hue`` (cell_id or beam), averaged over the other, and the floor of its axis: a fifth of the least median."""
    if hue not in ("cell_id", "beam"):
        raise ValueError("hue is cell_id or beam")
    power = correlation.where("block = 0").groupBy(*keys, hue, "lag").agg(F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("p"))
    each = [*keys, "beam"] if hue == "beam" else keys
    floor = power.groupBy(*each).agg(F.median("p").alias("m")).groupBy(*keys).agg((F.min("m") / 5).alias("floor"))
    return power.join(floor, keys).select(*keys, hue, "lag", pow_to_db(F.col("p")).alias("power"), pow_to_db(F.col("floor")).alias("floor"))


def nearest_slice(df: DataFrame, at: dict[str, float], by: list[str]) -> DataFrame:
    """Of each group, the rows at the values of the coordinates ``at`` that lie nearest to those asked for; ties go to the smaller value, null coordinates don't count."""
    for name, value in at.items():
        distance = F.abs(F.col(name) - F.lit(value))
        nearest = df.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))).groupBy(*by).agg(F.min_by(name, F.struct(distance, name)).alias("__at"))
        df = df.join(nearest, by).where(F.col(name) == F.col("__at")).drop("__at")
    return df


def drop_incomplete(df: DataFrame, coordinate: str, by: list[str], value: str = "value") -> DataFrame:
    """Without the coordinates at which a value of the group is missing or NaN, as trimmed frequencies are."""
    gone = df.where(F.col(value).isNull() | F.isnan(value)).select(*by, coordinate).distinct()
    return df.join(gone, [*by, coordinate], "left_anti")


def axis_label(df: DataFrame, column: str) -> str:
    """What an axis is called: the column's standard name (else its own) and its units, from its metadata."""
    about = df.schema[column].metadata
    name = about.get("standard_name") or column.replace("_", " ").capitalize()
    return f"{name} ({about['units']})" if about.get("units") else name
