"""Sweeps as relations: loops, per-source adjustments, label look-ups and ports expand captures into rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def range_points(start: float, stop: float, step: float) -> list[float]:
    """Both ends included."""
    n = int((stop - start) / step + 0.5) + 1
    return [start + i * step for i in range(n) if start + i * step <= stop + step / 2]


def bin_points(start: float, stop: float, step: float) -> list[float]:
    """A grid centred between the ends."""
    half = int((stop - start) / 2 / step)
    mid = (start + stop) / 2
    return [mid + i * step for i in range(-half, half + 1)]


def validate_loops(loops: list[dict]) -> None:
    fields = [x.get("field") for x in loops if x["kind"] != "repeat"]
    if any(x["kind"] == "repeat" for x in loops[1:]):
        raise ValueError("a repeat loop must come first")
    if len(fields) != len(set(fields)):
        raise ValueError("a field can be looped once")


def loop_points(loop: dict) -> list:
    kind = loop["kind"]
    if kind == "repeat":
        return list(range(loop["count"]))
    if kind == "list":
        return list(loop["values"])
    return (range_points if kind == "range" else bin_points)(loop["start"], loop["stop"], loop["step"])


def expand(captures: DataFrame, loops: list[dict], adjust: Callable[[DataFrame], DataFrame] | None = None, nyquist_only: bool = False, limit: int | None = None) -> DataFrame:
    """The product of captures and loop points. Precedence: loop, adjustment, capture. Points are literals, so no join is needed."""
    validate_loops(loops)
    out, names = captures, []
    for x in loops:
        name = "repeat_index" if x["kind"] == "repeat" else x["field"]
        names.append(name)
        out = out.withColumn(f"__{name}", F.explode(F.array(*(F.lit(p) for p in loop_points(x)))))
    put = lambda df: df.withColumns({n: F.col(f"__{n}") for n in names})
    out = put(out)
    if adjust:
        out = put(adjust(out))
    out = out.drop(*(f"__{n}" for n in names))
    if nyquist_only:
        out = out.where(F.col("sample_rate") >= F.col("analysis_bandwidth"))
    return out.limit(limit) if limit else out


def remap(captures: DataFrame, lookup: DataFrame, keys: list[str], value: str, field: str, default: Column | None = None, required: bool = False) -> DataFrame:
    """Field from a keyed look-up table; a miss takes the default, or raises if one is required."""
    joined = captures.join(lookup.select(*keys, F.col(value).alias("__v"), F.lit(True).alias("__hit")), keys, "left")
    miss = default if default is not None else (F.raise_error(F.lit(f"no {field} for this key")).cast(lookup.schema[value].dataType) if required else F.lit(None))
    return joined.withColumn(field, F.when(F.col("__hit"), F.col("__v")).otherwise(miss)).drop("__v", "__hit")


def split_ports(captures: DataFrame, fields: list[str]) -> DataFrame:
    """Array-valued port fields as a row per port."""
    z = F.posexplode(F.arrays_zip(*fields)).alias("port_index", "__z")
    rest = [c for c in captures.columns if c not in fields]
    return captures.select(*rest, z).select(*rest, F.col("port_index").cast("int").alias("port_index"), *(F.col(f"__z.{f}").alias(f) for f in fields))


def pairwise(captures: DataFrame, order: str, by: tuple[str, ...] = ("port",), fields: tuple[str, ...] = ()) -> DataFrame:
    """Each capture with the next one of its port."""
    w = Window.partitionBy(*by).orderBy(order)
    return captures.withColumns({f"next_{f}": F.lead(f).over(w) for f in (fields or (order,))})


def max_by_frequency(captures: DataFrame, field: str) -> DataFrame:
    return captures.groupBy("port", "center_frequency").agg(F.max(field).alias(field))


def sweep_index(captures: DataFrame, order: str, per_sweep: int) -> DataFrame:
    """Sweep and capture numbers of an ordered list; ``order`` is already a gapless number from zero."""
    return captures.withColumn("sweep_index", F.floor(F.col(order) / per_sweep).cast("long")).withColumn("capture_index", F.pmod(order, F.lit(per_sweep)).cast("long"))


INCLUDE = "$include"


def read_spec(path: str) -> dict:
    """A sweep in JSON, or in YAML where a YAML reader is installed.

    ``{"$include": "other.json"}`` (in YAML also ``!include other.yaml``) stands for what the other file holds, relative to the file that names it; keys beside
    it are laid over a mapping. A file that includes itself, through others too, raises.
    """
    return _read_spec(Path(path), ())


def _read_spec(path: Path, above: tuple[Path, ...]) -> object:
    path = path.resolve()
    if path in above:
        raise ValueError(f"{path} includes itself")
    text = path.read_text()
    if path.suffix == ".json":
        return _included(json.loads(text), path, above)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("reading YAML needs PyYAML; JSON works without it") from e

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!include", lambda loader, node: {INCLUDE: loader.construct_scalar(node)})
    return _included(yaml.load(text, Loader), path, above)  # noqa: S506


def _included(node: object, path: Path, above: tuple[Path, ...]) -> object:
    if isinstance(node, list):
        return [_included(x, path, above) for x in node]
    if not isinstance(node, dict):
        return node
    own = {k: _included(v, path, above) for k, v in node.items() if k != INCLUDE}
    if INCLUDE not in node:
        return own
    names = node[INCLUDE] if isinstance(node[INCLUDE], list) else [node[INCLUDE]]
    found = [_read_spec(path.parent / n, (*above, path)) for n in names]
    if len(found) == 1 and not own:
        return found[0]
    if not all(isinstance(x, dict) for x in found):
        raise ValueError(f"{path}: only mappings can be laid over each other")
    out: dict = {}
    for x in (*found, own):
        out |= x
    return out


def captures_of(spark: SparkSession, spec: dict) -> DataFrame:
    """The captures of a sweep as rows: defaults under each capture's own values."""
    defaults = spec.get("defaults", {})
    return spark.createDataFrame([defaults | c for c in spec["captures"]])


def distinct_values(captures: DataFrame, fields: list[str]) -> DataFrame:
    """Sorted distinct values per field, for a dry run's summary."""
    return captures.agg(*(F.array_sort(F.collect_set(f)).alias(f) for f in fields))


def merged(*maps: Column) -> Column:
    """One map of several, later ones first in precedence; a null map is empty."""
    out = maps[0]
    for m in maps[1:]:
        out = F.when(out.isNull(), m).when(m.isNull(), out).otherwise(F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(m, k)), m))  # noqa: B023
    return out


def adjust_analysis(captures: DataFrame, spec: str, overrides: str) -> DataFrame:
    """Parameters of the measurements in ``spec`` (a struct of structs) replaced by a capture's map ``overrides``, wherever the names match.

    ``unused_adjust`` lists the names that match no parameter. A null or empty map changes nothing; a null value sets null.
    """
    given = F.col(overrides)
    col, known = F.col(spec), set()
    for measurement in captures.schema[spec].dataType:
        for field in measurement.dataType:
            known.add(field.name)
            hit = F.coalesce(F.map_contains_key(given, F.lit(field.name)), F.lit(False))
            col = col.withField(f"{measurement.name}.{field.name}", F.when(hit, given[field.name].cast(field.dataType)).otherwise(F.col(f"{spec}.{measurement.name}.{field.name}")))
    unused = F.coalesce(F.array_sort(F.array_except(F.map_keys(given), F.array(*map(F.lit, sorted(known))))), F.array().cast("array<string>"))
    return captures.withColumns({spec: col, "unused_adjust": unused})


def checked_keys(lookup: DataFrame, captures: DataFrame, keys: list[str]) -> DataFrame:
    """The look-up table with its keys in the captures' types; a key that can't be one raises when it is read."""
    return lookup.withColumns({k: F.when(F.col(k).isNotNull() & F.col(k).try_cast(captures.schema[k].dataType).isNull(), F.raise_error(F.concat(F.lit(f"not a value of {k}: "), F.col(k).cast("string"))).cast(captures.schema[k].dataType)).otherwise(F.col(k).try_cast(captures.schema[k].dataType)) for k in keys})


def reusable(captures: DataFrame, order: str, by: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """``reusable``: the samples acquired for the capture before serve this one too, since all ``fields`` that bear on acquisition are equal."""
    w = Window.partitionBy(*by).orderBy(order)
    same = F.lag(F.lit(True)).over(w).isNotNull()
    for f in fields:
        same = same & F.lag(f).over(w).eqNullSafe(F.col(f))
    return captures.withColumn("reusable", same)


def merge_peripherals(captures: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Captures with their peripheral readings, null where there are none; works with a stream of captures against a stored table too."""
    clash = (set(captures.columns) & set(extra.columns)) - set(keys)
    if clash:
        raise ValueError(f"peripheral names that captures have: {sorted(clash)}")
    return captures.join(extra, keys, "left")
