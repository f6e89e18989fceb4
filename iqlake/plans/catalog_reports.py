"""Registered queries for planning captures and for the tables behind reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import calibration, cellular, filters, frames, stats
from ..sources.tables import read_table
from . import results, sweep
from .catalog import IQ_SQL, blocks, iq, r6, register
from .catalog_shapes import _WAVES, _correlation_sql

_TAPS = [1.0, 2.0, 3.0, 2.0, 1.0]


@register(f"""WITH {IQ_SQL}, h(i, v) AS (VALUES {", ".join(f"({i}, {v})" for i, v in enumerate(_TAPS))})
SELECT capture_id, port, (i + 3 * n) // 2 AS n, round(sum(re * v), 6) + 0.0 AS re, round(sum(im * v), 6) + 0.0 AS im
FROM iq, h WHERE (i + 3 * n) % 2 = 0 AND (i + 3 * n) // 2 < 48 GROUP BY ALL""")
def upfirdn(spark: SparkSession, d: str) -> DataFrame:
    out = frames.samples(filters.upfirdn(blocks(spark, d), np.array(_TAPS), 3, 2, size=8, one_block=True))
    return out.select("capture_id", "port", "n", (r6("re") + 0.0).alias("re"), (r6("im") + 0.0).alias("im"))


@register(f"""WITH {IQ_SQL}, b AS (SELECT DISTINCT capture_id, port, bin FROM iq, (SELECT unnest(range(4)) AS bin)),
s AS (SELECT *, CAST('0x' || substr(md5('7-' || capture_id || '-' || port || '-' || bin), 1, 8) AS BIGINT) % 24 AS start FROM b),
p AS (SELECT s.capture_id, s.port, bin, avg(re * re + im * im) AS rms, max(re * re + im * im) AS peak
  FROM s JOIN iq ON s.capture_id = iq.capture_id AND s.port = iq.port AND n >= start AND n < start + 8 GROUP BY ALL)
SELECT capture_id, port, bin, unnest(['rms', 'peak']) AS power_detector, round(unnest([rms, peak]), 9) AS value FROM p""")
def random_bin_power(spark: SparkSession, d: str) -> DataFrame:
    return stats.random_bin_power_blocks(blocks(spark, d), 8, seed=7).withColumn("value", r6("value", 9))


@register("""SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN ceil(p_size * 4 * 15 / 8.0) ELSE p_size * 4 END AS BIGINT) + 6 AS samples,
  CAST(CASE WHEN p_size % 2 = 0 THEN ceil(p_size * 4 * 15 / 8.0) ELSE p_size * 4 END AS BIGINT) + 6 + CAST(ceil(CASE WHEN p_size % 2 = 0 THEN 64.0 ELSE p_size END * 0.75) AS BIGINT) AS with_holdoff FROM part""")
def read_count(spark: SparkSession, d: str) -> DataFrame:
    rate = F.col("p_size").cast("double")
    args = (F.lit(4.0), rate, F.lit(15), F.lit(8), F.pmod("p_size", F.lit(2)) == 0, F.lit(64.0))
    return read_table(spark, d, "part").select("p_partkey", C.read_count(*args, overlap=6).alias("samples"), C.read_count(*args, overlap=6, holdoff=0.25, strobe=0.25).alias("with_holdoff"))


@register("""SELECT o_orderkey, coalesce(o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w AND o_orderpriority IS NOT DISTINCT FROM lag(o_orderpriority) OVER w AND row_number() OVER w > 1, false) AS reusable
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def reusable_captures(spark: SparkSession, d: str) -> DataFrame:
    return sweep.reusable(read_table(spark, d, "orders"), "o_orderkey", ("o_custkey",), ("o_orderstatus", "o_orderpriority")).select("o_orderkey", "reusable")


@register("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice ELSE 16 END AS psd_nfft, CAST(0.5 AS DOUBLE) AS psd_overlap,
  CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice ELSE 8 END AS spectrogram_nfft, CASE o_orderpriority WHEN '1-URGENT' THEN 'gain' ELSE '' END AS unused FROM orders""")
def adjust_analysis(spark: SparkSession, d: str) -> DataFrame:
    spec = F.struct(F.struct(F.lit(16.0).alias("nfft"), F.lit(0.5).alias("overlap")).alias("psd"), F.struct(F.lit(8.0).alias("nfft")).alias("spectrogram"))
    overrides = F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("nfft"), F.col("o_totalprice"), F.lit("gain"), F.lit(1.0)))
    out = sweep.adjust_analysis(read_table(spark, d, "orders").select("o_orderkey", spec.alias("analysis"), overrides.alias("adjust")), "analysis", "adjust")
    return out.select("o_orderkey", F.col("analysis.psd.nfft").alias("psd_nfft"), F.col("analysis.psd.overlap").alias("psd_overlap"), F.col("analysis.spectrogram.nfft").alias("spectrogram_nfft"), F.concat_ws(",", "unused_adjust").alias("unused"))


@register("""SELECT c_custkey, unnest(['gain', 'port', 'site']) AS field, unnest([c_mktsegment, '0', CASE WHEN c_acctbal > 0 THEN c_name ELSE 'here' END]) AS value FROM customer""")
def merge_updates(spark: SparkSession, d: str) -> DataFrame:
    defaults = F.create_map(*map(F.lit, ("gain", "0", "port", "0", "site", "here")))
    per_source = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("site"), F.col("c_name")))
    loop = F.create_map(F.lit("gain"), F.col("c_mktsegment"))
    return read_table(spark, d, "customer").select("c_custkey", F.explode(sweep.merged(defaults, per_source, loop)).alias("field", "value"))


@register("SELECT event_id, user_id, c_acctbal AS temperature FROM events LEFT JOIN customer ON user_id = c_custkey")
def merge_peripherals(spark: SparkSession, d: str) -> DataFrame:
    readings = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("temperature"))
    return sweep.merge_peripherals(read_table(spark, d, "events").select("event_id", "user_id"), readings, ["user_id"]).select("event_id", "user_id", "temperature")


@register("SELECT c_custkey, n_name AS site FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_keys(spark: SparkSession, d: str) -> DataFrame:
    captures = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    lookup = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("c_nationkey"), "n_name")
    return sweep.remap(captures, sweep.checked_keys(lookup, captures, ["c_nationkey"]), ["c_nationkey"], "n_name", "site", required=True).select("c_custkey", "site")


@register("""SELECT 'nation' AS key, CAST(c_nationkey AS VARCHAR) AS value FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
UNION ALL SELECT 'segment', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment <> 'BUILDING'""")
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    captures = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    grid = read_table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("nation"), F.lit("BUILDING").alias("segment"))
    return calibration.missing_keys(captures, grid, ["nation", "segment"])


@register("""WITH p AS (SELECT l_suppkey, l_linenumber, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY top DESC, l_linenumber) AS r FROM p)
SELECT l_suppkey AS port, l_linenumber AS spacing, l_orderkey, l_extendedprice AS value FROM lineitem JOIN b USING (l_suppkey, l_linenumber) WHERE r = 1""")
def strongest_spacing(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("port"), F.col("l_linenumber").alias("spacing"), "l_orderkey", F.col("l_extendedprice").alias("value"))
    return results.strongest(rows, ["port"], "spacing", "value").select("port", "spacing", "l_orderkey", "value")


@register(_correlation_sql("pss") + """,
p AS (SELECT capture_id, port, beam, lag, avg(re * re + im * im) AS p FROM c WHERE block = 0 GROUP BY ALL),
m AS (SELECT capture_id, port, beam, median(p) AS m FROM p GROUP BY ALL),
f AS (SELECT capture_id, port, min(m) / 5 AS f FROM m GROUP BY ALL)
SELECT p.capture_id, p.port, beam, lag, round(10 * log10(p), 6) AS power, round(10 * log10(f), 6) AS floor FROM p JOIN f ON p.capture_id = f.capture_id AND p.port = f.port""")
def pss_report(spark: SparkSession, d: str) -> DataFrame:
    out = results.correlation_report(cellular.correlate_waves(blocks(spark, d), _WAVES["pss"], (0, 4), 5, 16, one_block=True), "beam", ["capture_id", "port"])
    return out.withColumn("power", r6("power")).withColumn("floor", r6("floor"))


@register("SELECT event_type, user_id, count(*) AS n, round(max(value), 6) AS peak FROM events GROUP BY ALL")
def grouped_report(spark: SparkSession, d: str) -> DataFrame:
    fields = results.group_fields("{name} {event_type}.svg", loops=("user_id",))
    return read_table(spark, d, "events").groupBy(*fields).agg(F.count(F.lit(1)).alias("n"), r6(F.max("value")).alias("peak"))
