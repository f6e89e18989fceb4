"""Registered queries of acquisition (reads that share samples, holdoff before a strobe) and of what is stored: precision, paths, slices; filters that ring on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import filters, frames
from ..sources.tables import read_table
from . import acquisition, results
from .catalog import IQ_SQL, blocks, r6, register


#: Runs by the classic difference of two row numbers' kind: a running count of changes; what two reads share as an overlap of intervals.
@register("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(5 + o_orderkey % 40 AS BIGINT) AS size, CAST(o_orderkey % 25 AS BIGINT) AS low, CAST(o_custkey % 30 AS BIGINT) AS high FROM orders),
n AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER w IS NOT DISTINCT FROM o_orderstatus AND lag(1) OVER w = 1 THEN 0 ELSE 1 END AS fresh_run FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT *, CAST(sum(fresh_run) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS run FROM n),
s AS (SELECT *, CAST(first_value(low) OVER w + sum(size) OVER w - size AS BIGINT) AS start FROM r WINDOW w AS (PARTITION BY o_custkey, run ORDER BY o_orderkey)),
i AS (SELECT *, start - low AS a, start + size + high AS b FROM s),
p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM i WINDOW w AS (PARTITION BY o_custkey, run ORDER BY o_orderkey)),
q AS (SELECT *, CASE WHEN pa IS NULL THEN 0 ELSE greatest(least(pb, b) - greatest(pa, a), 0) END AS shared, CASE WHEN pa IS NULL THEN 0 ELSE greatest(pa - a, 0) END AS missing FROM p)
SELECT o_orderkey, run, start, a AS read_start, b AS read_stop, CAST(shared AS BIGINT) AS shared, CAST(missing AS BIGINT) AS missing, CAST(b - a - shared - missing AS BIGINT) AS fresh FROM q""")
def read_plan(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", (5 + F.col("o_orderkey") % 40).cast("long").alias("size"), (F.col("o_orderkey") % 25).cast("long").alias("overlap_low"), (F.col("o_custkey") % 30).cast("long").alias("overlap_high"),
    )
    out = acquisition.plan_reads(orders, "o_orderkey", ("o_custkey",), ("o_orderstatus",))
    return out.select("o_orderkey", "run", "start", "read_start", "read_stop", "shared", "missing", "fresh")


@register("""WITH e AS (SELECT event_id, epoch_us(ts) * 1000 AS t, CAST(1e6 * (1 + event_id % 5) AS DOUBLE) AS fs, CAST(event_id % 60 AS BIGINT) AS overlap, event_id % 3 = 0 AS carried FROM events),
l AS (SELECT *, overlap + CASE WHEN carried THEN 0 ELSE CAST(round_even(0.0004 * fs, 0) AS BIGINT) END AS least, CAST(round_even((20000000 - t % 20000000) % 20000000 / 1e9 * fs, 0) AS BIGINT) AS wait, CAST(round_even(0.02 * fs, 0) AS BIGINT) AS period FROM e)
SELECT event_id, CAST(CASE WHEN wait < least THEN wait + ceil(least / CAST(period AS DOUBLE)) * period ELSE wait END AS BIGINT) AS holdoff FROM l""")
def strobe_holdoff(spark: SparkSession, d: str) -> DataFrame:
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    fs = F.lit(1e6) * (1 + F.col("event_id") % 5)
    wait = acquisition.holdoff(ns, fs, F.col("event_id") % 60, 0.0004, 0.02, F.col("event_id") % 3 == 0)
    return read_table(spark, d, "events").select("event_id", wait.alias("holdoff"))


#: The exponent by the same search, the rest by SQL's own rounding half to even.
@register("""WITH a AS (SELECT event_id, value / 7 - 20 AS x, abs(value / 7 - 20) AS a FROM events),
l AS (SELECT *, floor(log2(a)) AS e0 FROM a),
e AS (SELECT *, CASE WHEN pow(2, e0) > a THEN e0 - 1 WHEN pow(2, e0 + 1) <= a THEN e0 + 1 ELSE e0 END AS e FROM l),
s AS (SELECT *, pow(2, greatest(e, -14) - 10) AS step FROM e)
SELECT event_id, CASE WHEN a = 0 THEN 0 ELSE sign(x) * round_even(a / step, 0) * step END AS half FROM s""")
def half_precision(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", C.to_half(F.col("value") / 7 - 20).alias("half"))


@register("SELECT o_orderkey, 'out/' || o_orderstatus || '/' || printf('%06d', o_custkey) || '-' || o_orderpriority || '.parquet' AS path FROM orders")
def path_templates(spark: SparkSession, d: str) -> DataFrame:
    fields = {"status": F.col("o_orderstatus"), "customer": F.col("o_custkey"), "priority": F.col("o_orderpriority")}
    return read_table(spark, d, "orders").select("o_orderkey", C.path_of("out/{status}/{customer:06d}-{priority}.parquet", fields).alias("path"))


@register("""WITH n AS (SELECT p_brand, arg_min(p_size, abs(p_size - 20) * 1000 + p_size) AS size FROM part GROUP BY 1)
SELECT p_partkey, part.p_brand, p_size FROM part JOIN n ON part.p_brand = n.p_brand AND p_size = size""")
def nearest_slice(spark: SparkSession, d: str) -> DataFrame:
    return results.nearest_slice(read_table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), {"p_size": 20}, ["p_brand"])


_TAPS = [1.0, -2.0, 3.0, 0.5, 1.0, 4.0, 2.0]


@register(f"""WITH {IQ_SQL}, h(i, v) AS (VALUES {", ".join(f"({i}, {v})" for i, v in enumerate(_TAPS))})
SELECT capture_id, port, (i + 3 * n) // 2 AS n, round(sum(re * v), 6) + 0.0 AS re, round(sum(im * v), 6) + 0.0 AS im
FROM iq, h WHERE (i + 3 * n) % 2 = 0 AND (i + 3 * n) // 2 < 50 GROUP BY ALL""")
def upfirdn_full(spark: SparkSession, d: str) -> DataFrame:
    out = frames.samples(filters.upfirdn(blocks(spark, d), np.array(_TAPS), 3, 2, 10, full=True))
    return out.select("capture_id", "port", "n", (r6("re") + 0.0).alias("re"), (r6("im") + 0.0).alias("im"))
