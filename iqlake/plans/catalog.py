"""The registered queries: each a Spark plan over the stored tables, with the same result in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ofdm
from ..functions.windows import window as make_window
from ..operators import calibration, cellular, frames, spectrum, stats
from ..sources.synthetic import noise_of, placed
from ..sources.tables import interleaved_blocks, read_table
from . import results, sweep

FS, NFFT, OVERLAP = 32.0, 16, 8
#: Rows of the SQL side: one per complex sample.
IQ_SQL = """iq AS (
  SELECT vec_id // 2 AS capture_id, CAST(vec_id % 2 AS INTEGER) AS port, i AS n,
         CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im
  FROM embeddings, (SELECT CAST(range AS BIGINT) AS i FROM range(32)))"""


def window_sql() -> str:
    w = make_window("hamming", NFFT) / NFFT
    return "w(i, w) AS (VALUES " + ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w.tolist())) + ")"


#: Power of a direct Fourier sum per frame and centred bin.
STFT_SQL = f"""{IQ_SQL}, {window_sql()},
fr AS (SELECT CAST(range AS BIGINT) AS frame FROM range({(32 - NFFT) // (NFFT - OVERLAP) + 1})),
ks AS (SELECT CAST(range AS BIGINT) AS k FROM range({NFFT})),
x AS (SELECT capture_id, port, frame, i, re * w AS re, im * w AS im FROM fr, w JOIN iq ON TRUE WHERE n = frame * {NFFT - OVERLAP} + i),
st AS (
  SELECT capture_id, port, frame, k,
         power_sum(sum(re * cos(a) + im * sin(a)), sum(im * cos(a) - re * sin(a))) AS power
  FROM (SELECT *, 2 * pi() * (k - {NFFT // 2}) * i / {NFFT}.0 AS a FROM x, ks) GROUP BY ALL)""".replace("power_sum(sum(re * cos(a) + im * sin(a)), sum(im * cos(a) - re * sin(a)))", "pow(sum(re * cos(a) + im * sin(a)), 2) + pow(sum(im * cos(a) - re * sin(a)), 2)")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return interleaved_blocks(read_table(spark, d, "embeddings"))


def iq(spark: SparkSession, d: str) -> DataFrame:
    return frames.samples(blocks(spark, d))


def stft(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.stft_power(blocks(spark, d), NFFT, OVERLAP)


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


@register("SELECT event_id, round(10 * log10(abs(value)), 6) AS value_db FROM events")
def pow_to_db(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", r6(C.pow_to_db(F.col("value"))).alias("value_db"))


@register("SELECT event_type, round(10 * log10(avg(pow(10, (10 * log10(value)) / 10))), 6) AS mean_db, round(10 * log10(sum(pow(10, (10 * log10(value)) / 10))), 6) AS sum_db FROM events GROUP BY event_type")
def db_linmean(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "events").select("event_type", C.pow_to_db(F.col("value")).alias("x"))
    return x.groupBy("event_type").agg(r6(C.db_linmean(F.col("x"))).alias("mean_db"), r6(C.db_linsum(F.col("x"))).alias("sum_db"))


@register(f"WITH {IQ_SQL} SELECT capture_id, port, n, round(re * re + im * im, 9) AS power FROM iq")
def env_power(spark: SparkSession, d: str) -> DataFrame:
    return iq(spark, d).select("capture_id", "port", "n", r6(C.env_to_pow(F.col("re"), F.col("im")), 9).alias("power"))


@register(f"""WITH {IQ_SQL}, b AS (SELECT capture_id, port, n // 8 AS bin, avg(re * re + im * im) AS rms, max(re * re + im * im) AS peak FROM iq GROUP BY ALL)
SELECT capture_id, port, 'rms' AS power_detector, CAST(bin * 0.25 AS DOUBLE) AS time_elapsed, round(10 * log10(rms), 6) AS value FROM b
UNION ALL SELECT capture_id, port, 'peak', CAST(bin * 0.25 AS DOUBLE), round(10 * log10(peak), 6) FROM b""")
def bin_power_rms_peak(spark: SparkSession, d: str) -> DataFrame:
    return stats.channel_power_time_series(blocks(spark, d), 8, 8 / FS).withColumn("value", r6("value"))


@register("SELECT l_orderkey % 100 AS grp, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1")
def bin_power_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select(F.pmod("l_orderkey", F.lit(100)).alias("grp"), "l_extendedprice")
    return rows.groupBy("grp").agg(r6(stats.statistic(0.5, F.col("l_extendedprice"))).alias("p50"), r6(stats.statistic(0.95, F.col("l_extendedprice"))).alias("p95"))


@register(f"""WITH {IQ_SQL}, b AS (SELECT capture_id, port, n // 4 AS bin, avg(re * re + im * im) AS rms, max(re * re + im * im) AS peak FROM iq GROUP BY ALL),
l AS (SELECT capture_id, port, 'rms' AS power_detector, bin % 4 AS cyclic_lag, rms AS v FROM b UNION ALL SELECT capture_id, port, 'peak', bin % 4, peak FROM b),
s AS (SELECT capture_id, port, power_detector, cyclic_lag, min(v) AS lo, avg(v) AS mid, max(v) AS hi FROM l GROUP BY ALL)
SELECT capture_id, port, power_detector, cyclic_lag, cyclic_statistic, round(10 * log10(v), 6) AS value
FROM (SELECT *, unnest(['min', 'mean', 'max']) AS cyclic_statistic, unnest([lo, mid, hi]) AS v FROM s)""")
def cyclic_power(spark: SparkSession, d: str) -> DataFrame:
    return stats.cyclic_channel_power(blocks(spark, d), 4, 4).withColumn("value", r6("value"))


def _hist_sql(rows: str, low: float, high: float, step: float, by: str, norm: str) -> str:
    last = len(stats.power_centers(low, high, step)) - 1
    edge = low - step / 2
    return f"""WITH r AS ({rows}),
h AS (SELECT {by}{', ' if by else ''}CAST(CASE WHEN x < {edge} THEN 0 WHEN x >= {high + step / 2} THEN {last} ELSE least(floor((x - {edge}) / {step}) + 1, {last - 1}) END AS BIGINT) AS bin FROM r),
c AS (SELECT {by}{', ' if by else ''}bin, count(*) AS n FROM h GROUP BY ALL)
SELECT *, round(n / sum(n) OVER ({'PARTITION BY ' + norm if norm else ''}), 9) AS fraction FROM c"""


@register(_hist_sql("SELECT event_type, 10 * log10(value) AS x FROM events", -20, 30, 0.5, "event_type", "event_type"))
def power_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "events").select("event_type", C.pow_to_db(F.col("value")).alias("x"))
    return stats.histogram(x, "x", -20, 30, 0.5, ("event_type",), ("event_type",)).withColumn("fraction", r6("fraction", 9))


@register(_hist_sql("SELECT 10 * log10(value) AS x FROM events", 0, 20, 1, "", ""))
def histogram_catchall(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "events").select(C.pow_to_db(F.col("value")).alias("x"))
    return stats.histogram(x, "x", 0, 20, 1).withColumn("fraction", r6("fraction", 9))


EDGES = [1.0, 5.0, 10.0, 50.0, 100.0, 200.0, 400.0]


@register("SELECT event_type, edge, round(avg(CASE WHEN value > edge THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS ccdf FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 200.0, 400.0])::DOUBLE AS edge) GROUP BY ALL")
def ccdf(spark: SparkSession, d: str) -> DataFrame:
    return stats.ccdf(read_table(spark, d, "events"), "value", EDGES, ("event_type",)).withColumn("ccdf", r6("ccdf", 9))


@register(f"WITH {STFT_SQL} SELECT capture_id, port, frame, k, round(power, 12) AS power FROM st")
def stft_power(spark: SparkSession, d: str) -> DataFrame:
    return stft(spark, d).withColumn("power", r6("power", 12))


@register(f"""WITH {STFT_SQL}, s AS (SELECT capture_id, port, k, avg(power) AS a, quantile_cont(power, 0.5) AS b, quantile_cont(power, 0.9) AS c, max(power) AS d FROM st GROUP BY ALL)
SELECT capture_id, port, k, unnest(['mean', '0.5', '0.9', 'max']) AS time_statistic, unnest([round(10 * log10(a + 1e-25), 6), round(10 * log10(b + 1e-25), 6), round(10 * log10(c + 1e-25), 6), round(10 * log10(d + 1e-25), 6)]) AS value FROM s""")
def psd_mean_quantile(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.block_psd(blocks(spark, d), NFFT, OVERLAP).withColumn("value", r6("value"))


@register(f"WITH {STFT_SQL} SELECT capture_id, port, frame, (k - 2) // 4 AS k, round(sum(power), 12) AS power FROM st WHERE k >= 2 AND k < 14 GROUP BY ALL")
def spectrogram_time_freq_bin(spark: SparkSession, d: str) -> DataFrame:
    out = spectrum.spectrogram(blocks(spark, d), FS, FS / NFFT, overlap=0.5, integrate=4 * FS / NFFT)
    return out.select("capture_id", "port", "frame", "k", r6("power", 12).alias("power"))


@register(f"WITH {STFT_SQL} SELECT capture_id, port, frame, k, round(CASE WHEN k IN (7, 8) THEN 0 ELSE power END, 12) AS power FROM st WHERE k >= 4 AND k < 12")
def lo_null_trim_band(spark: SparkSession, d: str) -> DataFrame:
    trimmed = frames.trim_band(frames.null_band(stft(spark, d), NFFT, FS, 4.0), NFFT, FS, 16.0)
    return trimmed.withColumn("power", r6(F.nanvl("power", F.lit(0.0)), 12))


_DB = "round_even(10 * log10(power + 1e-25), 2)"


@register(_hist_sql(f"WITH {STFT_SQL} SELECT capture_id % 10 AS grp, {_DB} AS x FROM st", -60, 0, 3, "grp", "grp"))
def spectrogram_histogram(spark: SparkSession, d: str) -> DataFrame:
    db = spectrum.to_db(stft(spark, d)).select(F.pmod("capture_id", F.lit(10)).alias("grp"), "power")
    return stats.histogram(db, "power", -60, 0, 3, ("grp",), ("grp",)).withColumn("fraction", r6("fraction", 9))


@register(_hist_sql(f"WITH {STFT_SQL}, e AS (SELECT *, {_DB} AS v FROM st) SELECT a.capture_id, a.port, a.v - b.v AS x FROM e a JOIN e b ON a.capture_id = b.capture_id AND a.frame = b.frame AND a.k = b.k AND a.port <> b.port", -50, 50, 5, "capture_id, port", "capture_id, port"))
def ratio_histogram(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.ratio_histogram(spectrum.to_db(stft(spark, d)), -50, 50, 5).withColumn("fraction", r6("fraction", 9))


@register(f"""WITH {IQ_SQL}, ij AS (SELECT i, j, i + j AS n FROM (SELECT unnest([0, 1, 10, 11])::BIGINT AS i), (SELECT CAST(range AS BIGINT) AS j FROM range(12)))
SELECT a.capture_id, a.port, j, round(sqrt(pow(sum(coalesce(a.re * b.re + a.im * b.im, 0)), 2) + pow(sum(coalesce(a.im * b.re - a.re * b.im, 0)), 2)) / 4, 9) AS r
FROM ij JOIN iq a ON a.n = ij.n LEFT JOIN iq b ON a.capture_id = b.capture_id AND a.port = b.port AND b.n = a.n + 8 GROUP BY ALL""")
def cyclic_autocorr(spark: SparkSession, d: str) -> DataFrame:
    return stats.lagged_product_blocks(blocks(spark, d), 8, [0, 1, 10, 11], 12, 16, one_block=True).withColumn("r", r6("r", 9))


@register(_hist_sql(f"WITH {STFT_SQL} SELECT port, CASE frame % 3 WHEN 0 THEN 'downlink' ELSE 'uplink' END AS direction, 10 * log10(power + 1e-25) AS x FROM st WHERE frame % 3 <> 1", -60, 0, 3, "port, direction", "port"))
def tdd_mask_histogram(spark: SparkSession, d: str) -> DataFrame:
    masks = spark.createDataFrame([(0, "downlink"), (2, "uplink")], "symbol int, direction string")
    spec = stft(spark, d).withColumn("capture_id", F.lit(0).cast("long"))
    out = spectrum.resource_histogram(spec, masks, 3, -60, 0, 3)
    return out.drop("capture_id").withColumn("fraction", r6("fraction", 9))


@register("SELECT o_orderkey, gain, center_frequency, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 20.0 ELSE 10.0 END AS DOUBLE) AS sample_rate FROM orders, (SELECT unnest([-10.0, 0.0, 10.0])::DOUBLE AS gain), (SELECT unnest([100.0, 150.0, 200.0])::DOUBLE AS center_frequency)")
def loop_expand(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("o_orderpriority") == "1-URGENT", 20.0).otherwise(10.0)
    captures = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    loops = [{"kind": "list", "field": "gain", "values": [-10.0, 0.0, 10.0]}, {"kind": "range", "field": "center_frequency", "start": 100.0, "stop": 200.0, "step": 50.0}]
    return sweep.expand(captures, loops, lambda df: df.withColumn("sample_rate", rate)).select("o_orderkey", "gain", "center_frequency", "sample_rate")


@register("SELECT o_orderkey, round(o_totalprice, 6) AS sample_rate, bw AS analysis_bandwidth FROM orders, (SELECT unnest([50000.0, 100000.0, 200000.0])::DOUBLE AS bw) WHERE o_totalprice >= bw")
def nyquist_filter(spark: SparkSession, d: str) -> DataFrame:
    captures = read_table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("sample_rate"))
    out = sweep.expand(captures, [{"kind": "list", "field": "analysis_bandwidth", "values": [50000.0, 100000.0, 200000.0]}], nyquist_only=True)
    return out.withColumn("sample_rate", r6("sample_rate"))


@register("SELECT c_custkey, coalesce(n_name, 'elsewhere') AS site FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def remap_lookup(spark: SparkSession, d: str) -> DataFrame:
    lookup = read_table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return sweep.remap(read_table(spark, d, "customer"), lookup, ["c_nationkey"], "n_name", "site", F.lit("elsewhere")).select("c_custkey", "site")


@register("SELECT event_id, CAST(unnest([0, 1]) AS INTEGER) AS port_index, unnest([value, value + 1]) AS gain FROM events")
def port_split(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("event_id", F.array(F.col("value"), F.col("value") + 1).alias("gain"))
    return sweep.split_ports(rows, ["gain"])


@register("SELECT l_linenumber AS port, l_suppkey AS center_frequency, max(l_quantity) AS gain FROM lineitem GROUP BY ALL")
def max_by_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select(F.col("l_linenumber").alias("port"), F.col("l_suppkey").alias("center_frequency"), F.col("l_quantity").alias("gain"))
    return sweep.max_by_frequency(rows, "gain")


_K = C.BOLTZMANN * 1000 * 290.0


@register(f"""WITH p AS (SELECT user_id, avg(CASE WHEN event_id % 2 = 0 THEN value * 10 END) AS p_on, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS p_off FROM events GROUP BY 1)
SELECT user_id, round(p_on, 6) AS p_on, round(p_off, 6) AS p_off,
  round(CASE WHEN p_on / p_off > 1 THEN 15 - 10 * log10(p_on / p_off - 1) END, 6) AS noise_figure,
  round(CASE WHEN p_on / p_off > 1 THEN 290 * (pow(10, (15 - 10 * log10(p_on / p_off - 1)) / 10) - 1) END, 4) AS temperature,
  round({_K!r} * pow(10, 1.5) * 1e17 / (p_on - p_off), 6) AS power_correction FROM p WHERE p_on IS NOT NULL AND p_off IS NOT NULL""")
def yfactor(spark: SparkSession, d: str) -> DataFrame:
    on = F.pmod("event_id", F.lit(2)) == 0
    rows = read_table(spark, d, "events").select("user_id", on.alias("noise_diode_enabled"), F.when(on, F.col("value") * 10).otherwise(F.col("value")).alias("value"))
    out = calibration.y_factor(rows, ("user_id",), F.lit(15.0), bandwidth=F.lit(1e17)).where("p_on is not null and p_off is not null")
    return out.select("user_id", r6("p_on").alias("p_on"), r6("p_off").alias("p_off"), r6("noise_figure").alias("noise_figure"), r6("temperature", 4).alias("temperature"), r6("power_correction").alias("power_correction"))


@register("""WITH g AS (SELECT p_brand, p_size * 1.0 AS x, avg(p_retailprice) AS y FROM part WHERE p_size % 3 = 0 GROUP BY 1, 2),
c AS (SELECT p_partkey, p_brand, p_size * 1.0 AS x FROM part),
b AS (SELECT p_partkey, c.x, max(g.x) FILTER (g.x <= c.x) AS lo, min(g.x) FILTER (g.x >= c.x) AS hi, arg_max(g.y, g.x) FILTER (g.x <= c.x) AS ylo, arg_min(g.y, g.x) FILTER (g.x >= c.x) AS yhi
  FROM c LEFT JOIN g ON c.p_brand = g.p_brand GROUP BY ALL)
SELECT p_partkey, round(CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN lo = hi THEN ylo ELSE ylo + (yhi - ylo) * (x - lo) / (hi - lo) END, 6) AS correction FROM b""")
def cal_interp(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part").withColumn("x", F.col("p_size").cast("double"))
    grid = part.where(F.pmod("p_size", F.lit(3)) == 0).groupBy("p_brand", "x").agg(F.avg("p_retailprice").alias("y"))
    out = calibration.interpolate(part.select("p_partkey", "p_brand", "x"), grid, ("p_brand",), "x", "y", "correction")
    return out.select("p_partkey", r6("correction").alias("correction"))


@register(f"WITH {IQ_SQL} SELECT capture_id, port, CAST(greatest(least(floor(0.0 - 10 * log10(max(re * re + im * im))), 100), -100) AS INTEGER) AS headroom FROM iq GROUP BY ALL")
def overload_headroom(spark: SparkSession, d: str) -> DataFrame:
    return iq(spark, d).groupBy("capture_id", "port").agg(C.adc_headroom(0.0, F.col("re"), F.col("im")).alias("headroom"))


@register("SELECT r_regionkey AS key, r_name, NULL AS n_name FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def concat_outer(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "region").select(F.col("r_regionkey").alias("key"), "r_name")
    b = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return results.concat_outer(a, b)


@register("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def index_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return results.duplicate_keys(read_table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@register("SELECT event_id, event_type FROM events WHERE event_type = (SELECT event_type FROM events ORDER BY event_id DESC LIMIT 1)")
def last_sweep(spark: SparkSession, d: str) -> DataFrame:
    return results.last_match(read_table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


@register("""SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value END), 6) AS click, round(sum(CASE WHEN event_type = 'view' THEN value END), 6) AS view, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 6) AS purchase FROM events GROUP BY 1""")
def unstack(spark: SparkSession, d: str) -> DataFrame:
    sums = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    out = results.unstack(sums, ["user_id"], "event_type", "v", ["click", "view", "purchase"])
    return out.select("user_id", *(r6(c).alias(c) for c in ("click", "view", "purchase")))


@register("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_id AS e, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS step FROM events),
m AS (SELECT user_id, median(step) AS med FROM s GROUP BY 1)
SELECT s.user_id, event_id, CAST(sum(CASE WHEN step > 3 * med THEN 1 ELSE 0 END) OVER (PARTITION BY s.user_id ORDER BY t, e) AS BIGINT) AS segment FROM s JOIN m ON s.user_id = m.user_id""")
def gap_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return stats.contiguous_segments(rows, "t", ("user_id",), 3.0, ties=("event_id",)).select("user_id", "event_id", "segment")


@register("""WITH h AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value > 100 AND value < 300 GROUP BY ALL),
f AS (SELECT t.event_type, b.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range(60)) b LEFT JOIN h ON h.event_type = t.event_type AND h.bin = b.bin),
e AS (SELECT event_type, min(bin) AS lo, max(bin) AS hi FROM f WHERE n > 0 GROUP BY 1)
SELECT f.event_type, bin, n FROM f JOIN e ON f.event_type = e.event_type WHERE bin >= lo - 2 AND bin <= hi + 3""")
def hist_trim(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    counts = events.where("value > 100 and value < 300").groupBy("event_type", F.floor(F.col("value") / 10).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = events.select("event_type").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))))
    hist = full.join(counts, ["event_type", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return stats.trim_histogram(hist, "bin", "n", ("event_type",), 2, 3)


@register("SELECT epoch_us(ts) // 3600000000 AS strobe, count(*) AS n, round(sum(value), 6) AS total, min((3600000000 - epoch_us(ts) % 3600000000) % 3600000000) AS holdoff FROM events GROUP BY 1")
def sessions_strobe(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = F.lit(3_600_000_000).cast("long")
    rows = read_table(spark, d, "events").select(F.floor(us / hour).cast("long").alias("strobe"), "value", F.pmod(hour - F.pmod(us, hour), hour).alias("h"))
    return rows.groupBy("strobe").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"), F.min("h").alias("holdoff"))


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def anti_missing_cal(spark: SparkSession, d: str) -> DataFrame:
    grid = read_table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return calibration.missing_calibration(read_table(spark, d, "lineitem"), grid, ("l_partkey",)).select("l_orderkey", "l_linenumber")


@register("WITH p(n_id2, i, d) AS (VALUES " + ", ".join(f"({n}, {i}, {int(v)})" for n in range(3) for i, v in enumerate(ofdm.pss(n)[:64])) + """)
SELECT vec_id, n_id2, round(sum(CAST(embedding[i + 1] AS DOUBLE) * d), 6) + 0.0 AS r FROM embeddings, p GROUP BY ALL""")
def pss_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the beginnings of the three primary sequences."""
    rows = read_table(spark, d, "embeddings")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n_id2"), F.array(*(F.lit(float(v)) for v in ofdm.pss(n)[:64])).alias("d")) for n in range(3)))).alias("p")
    product = F.aggregate(F.zip_with("embedding", "p.d", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", "embedding", each).select("vec_id", "p.n_id2", (r6(product) + 0.0).alias("r"))


@register("SELECT s_suppkey AS capture_id, TRUE AS near FROM supplier")
def noise_power(spark: SparkSession, d: str) -> DataFrame:
    """Noise of a density by capture has that density times the rate as its power, within seven deviations of 4096 samples."""
    captures = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("capture_id"), ((F.col("s_suppkey") % 100 + 1) * 1e-3).alias("psd"))
    made = noise_of(captures, 4096, 1e6)
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda s, x: s + x)
    mean = made.groupBy("capture_id").agg((F.sum(power) / F.sum(F.size("re"))).alias("power"))
    return mean.select("capture_id", (F.abs(F.col("power") / ((F.col("capture_id") % 100 + 1) * 1e-3 * 1e6) - 1) < 7 / 64).alias("near"))


@register("SELECT s_suppkey AS capture_id, CAST(0 AS INTEGER) AS port, CAST(s_suppkey * 7 % 500 AS BIGINT) AS lag, round(s_suppkey * 7 % 500 / 3.84e6, 12) AS delay FROM supplier")
def pss_sync(spark: SparkSession, d: str) -> DataFrame:
    """Delays of whole sequences placed in noise, a delay by capture, cut into blocks."""
    rate, spacing = 3.84e6, 30e3
    captures = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("capture_id"), (F.col("s_suppkey") * 7 % 500).alias("delay"))
    made = placed(captures, ofdm.sync_waveform(ofdm.pss(1), rate, spacing), 2000, noise=0.05, block=700)
    found = cellular.sync(cellular.correlate(made, "pss", rate, spacing, (0,), period=2000 / rate, mean=True), rate)
    return found.withColumn("delay", r6("delay", 12))


@register("""SELECT capture_id, port, n // 8 AS bin, round(avg(re), 9) AS mean_re FROM (WITH """ + IQ_SQL + """ SELECT * FROM iq) GROUP BY ALL""")
def tumbling_mean(spark: SparkSession, d: str) -> DataFrame:
    return iq(spark, d).groupBy("capture_id", "port", frames.tumbling(F.col("n"), 8).cast("long").alias("bin")).agg(r6(F.avg("re"), 9).alias("mean_re"))


@register(f"""WITH {IQ_SQL}, f AS (SELECT capture_id, port, n, CAST(range AS BIGINT) AS frame FROM iq, range(3) WHERE n >= range * 8 AND n < range * 8 + 16)
SELECT iq.capture_id, iq.port, iq.n, round(sum(re), 9) AS re, round(sum(im), 9) AS im FROM f JOIN iq USING (capture_id, port, n) GROUP BY ALL""")
def hop_overlap_add(spark: SparkSession, d: str) -> DataFrame:
    hopped = frames.hopping(iq(spark, d), 16, 8, last=F.lit(2).cast("long"))
    return frames.overlap_add(hopped, 8).withColumn("re", r6("re", 9)).withColumn("im", r6("im", 9))


@register("SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_o_orderkey FROM orders")
def pairwise_captures(spark: SparkSession, d: str) -> DataFrame:
    return sweep.pairwise(read_table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", ("o_custkey",))


@register(f"SELECT s_suppkey, round(abs(s_acctbal) / 1000 + {10 * math.log10(_K * 1e6)!r}, 6) AS noise_dbm FROM supplier")
def system_noise(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "supplier")
    return rows.select("s_suppkey", r6(calibration.system_noise(F.abs("s_acctbal") / 1000, 1e6)).alias("noise_dbm"))


