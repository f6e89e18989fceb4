"""Further registered queries: scalar functions, labels, dimension tables and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ofdm, windows
from ..operators import calibration, cellular, filters, frames, spectrum, stats
from ..sources.tables import read_table
from . import results, sweep
from .catalog import FS, IQ_SQL, NFFT, STFT_SQL, blocks, iq, r6, register, stft


@register(f"WITH {IQ_SQL} SELECT capture_id, port, n, round(20 * log10(sqrt(re * re + im * im) + 1e-12), 6) AS envelope_db FROM iq")
def env_to_db(spark: SparkSession, d: str) -> DataFrame:
    return iq(spark, d).select("capture_id", "port", "n", r6(C.env_to_db(F.col("re"), F.col("im"), 1e-12)).alias("envelope_db"))


@register("SELECT event_id, CASE event_type WHEN 'click' THEN 'mW' WHEN 'view' THEN '1/Hz' ELSE 'mW/kHz' END AS linear, CASE event_type WHEN 'click' THEN 'dBm' WHEN 'view' THEN 'dB/Hz' ELSE 'dBm/kHz' END AS db FROM events")
def unit_relabel(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("event_type") == "click", "dBm").when(F.col("event_type") == "view", "dB/Hz").otherwise("dBm/kHz")
    return read_table(spark, d, "events").select("event_id", C.relabel_unit(unit, "linear").alias("linear"), C.relabel_unit(F.when(F.col("event_type") == "click", "mW").when(F.col("event_type") == "view", "dB/Hz").otherwise("mW/kHz"), "db").alias("db"))


@register("SELECT p_partkey, p_size % 7 = 0 AS whole, CAST(ceil(p_size / 7.0) AS BIGINT) AS blocks FROM part")
def round_mod_ceil_div(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return read_table(spark, d, "part").select("p_partkey", C.is_round_mod(size, F.lit(7.0)).alias("whole"), C.ceil_div(size, F.lit(7.0)).cast("long").alias("blocks"))


@register("SELECT event_id, strftime(ts, '%Y%m%d-%Hh%Mm%S') AS suffix FROM events")
def timestamp_suffix(spark: SparkSession, d: str) -> DataFrame:
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return read_table(spark, d, "events").select("event_id", C.timestamp_suffix(ns).alias("suffix"))


@register("SELECT o_orderkey, concat_ws(', ', 'status=' || o_orderstatus, 'priority=' || o_orderpriority) AS description FROM orders")
def describe_capture(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.concat(F.lit(f"{n}="), F.col(c)) for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]
    return read_table(spark, d, "orders").select("o_orderkey", F.concat_ws(", ", *parts).alias("description"))


@register("SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NOT NULL AS numeric_head, try_cast(o_orderpriority AS DOUBLE) IS NOT NULL AS numeric_all FROM orders")
def numeric_labels(spark: SparkSession, d: str) -> DataFrame:
    ok = lambda c: c.try_cast("double").isNotNull()
    return read_table(spark, d, "orders").select("o_orderkey", ok(F.substring("o_orderpriority", 1, 1)).alias("numeric_head"), ok(F.col("o_orderpriority")).alias("numeric_all"))


@register("""WITH c AS (SELECT p_partkey, 8 + p_size % 9 AS nfft, CAST(p_size AS DOUBLE) AS fs FROM part)
SELECT p_partkey, CAST(k AS BIGINT) AS k, round((k - nfft // 2) * fs / nfft, 6) + 0.0 AS frequency FROM (SELECT *, unnest(range(nfft)) AS k FROM c)""")
def frequency_axis(spark: SparkSession, d: str) -> DataFrame:
    """The frequency axis of every capture, whose transform size and rate are its own."""
    c = read_table(spark, d, "part").select("p_partkey", (8 + F.col("p_size") % 9).alias("nfft"), F.col("p_size").cast("double").alias("fs"))
    rows = c.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nfft").cast("long") - 1)).alias("k"))
    return rows.select("p_partkey", "k", (r6(frames.frequency(F.col("k"), F.col("nfft"), F.col("fs"))) + 0.0).alias("frequency"))


@register(f"WITH {IQ_SQL} SELECT capture_id, port, n, CASE WHEN n % 2 = 1 THEN -re ELSE re END AS re, -im AS im FROM iq")
def shift_and_conjugate(spark: SparkSession, d: str) -> DataFrame:
    odd = F.pmod("n", F.lit(2)) == 1
    flipped = filters.conjugate(blocks(spark, d).withColumn("flip", F.lit(True)), "flip")
    return frames.samples(flipped).withColumn("re", F.when(odd, -F.col("re")).otherwise(F.col("re")))


@register("SELECT l_orderkey, l_linenumber, round(CAST(CAST(CAST(l_quantity * 600 AS INTEGER) AS FLOAT) / CAST(32767 AS FLOAT) AS DOUBLE), 5) AS volts FROM lineitem")
def int16_scale(spark: SparkSession, d: str) -> DataFrame:
    volts = C.int16_to_float((F.col("l_quantity") * 600).cast("int")).cast("double")
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(volts, 5).alias("volts"))


@register("SELECT event_id, event_id // 7 AS sweep_index, event_id % 7 AS capture_index FROM events")
def sweep_numbers(spark: SparkSession, d: str) -> DataFrame:
    return sweep.sweep_index(read_table(spark, d, "events").select("event_id"), "event_id", 7)


@register("SELECT DISTINCT l_linenumber AS port FROM lineitem")
def unique_ports(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(F.col("l_linenumber").alias("port")).distinct()


@register("SELECT array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS statuses, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities FROM orders")
def capture_values(spark: SparkSession, d: str) -> DataFrame:
    found = sweep.distinct_values(read_table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return found.select(F.array_join("o_orderstatus", "|").alias("statuses"), F.array_join("o_orderpriority", "|").alias("priorities"))


@register("SELECT event_type, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.99), 6) AS \"0.99\" FROM events GROUP BY 1")
def statistics(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("min", "max", "mean", "median", 0.99)
    return read_table(spark, d, "events").groupBy("event_type").agg(*(r6(stats.statistic(k, F.col("value"))).alias(stats.label(k)) for k in kinds))


@register(f"""WITH {STFT_SQL} SELECT capture_id, port, frame, (k - 2) // 4 AS bin, round((sum(power) - min(power) - max(power)) / 2, 12) AS power FROM st WHERE k >= 2 AND k < 14 GROUP BY ALL""")
def binned_mean_without_extremes(spark: SparkSession, d: str) -> DataFrame:
    out = frames.binned_mean(stft(spark, d), NFFT, 4, ("capture_id", "port", "frame"), "k", "power", trim_extremes=True)
    return out.withColumn("power", r6("power", 12))


@register("SELECT o_orderkey, lag(o_totalprice, 2, 0.0) OVER w AS before2, lag(o_totalprice, 1, 0.0) OVER w AS before1, o_totalprice AS now, lead(o_totalprice, 1, 0.0) OVER w AS after1 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def zip_offsets(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    x = "o_totalprice"
    return read_table(spark, d, "orders").select("o_orderkey", F.lag(x, 2, 0.0).over(w).alias("before2"), F.lag(x, 1, 0.0).over(w).alias("before1"), F.col(x).alias("now"), F.lead(x, 1, 0.0).over(w).alias("after1"))


@register("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * CAST(0.01 AS DOUBLE) AS time FROM events")
def concat_time(spark: SparkSession, d: str) -> DataFrame:
    return results.concat_time(read_table(spark, d, "events").select("user_id", "event_id"), ["event_id"], ["user_id"], 0.01)


@register(f"WITH {IQ_SQL} SELECT capture_id, port, n - 3 - port AS n, round(re, 9) AS re, round(im, 9) AS im FROM iq WHERE n >= 3 + port AND n < 3 + port + 20")
def align_by_trigger(spark: SparkSession, d: str) -> DataFrame:
    samples = iq(spark, d)
    shifts = samples.select("capture_id", "port").distinct().withColumn("lag", F.col("port") + 3)
    return cellular.align(samples, shifts, 20).select("capture_id", "port", "n", r6("re", 9).alias("re"), r6("im", 9).alias("im"))


@register("""WITH c AS (SELECT p_partkey, p_size % 2 AS port, CAST(p_size % 5 AS DOUBLE) AS center_frequency, p_retailprice / 100 AS gain, CAST(p_partkey % 12 AS INTEGER) AS headroom FROM part),
t AS (SELECT port, center_frequency, max(gain) AS gain_max FROM c GROUP BY ALL)
SELECT p_partkey, headroom, round(headroom + 2 * (gain - gain_max) / 3, 6) AS im3_headroom FROM c JOIN t USING (port, center_frequency) WHERE headroom < 2 OR headroom + 2 * (gain - gain_max) / 3 < 2""")
def adc_overload(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    c = part.select("p_partkey", F.pmod("p_size", F.lit(2)).alias("port"), F.pmod("p_size", F.lit(5)).cast("double").alias("center_frequency"), (F.col("p_retailprice") / 100).alias("gain"), F.pmod("p_partkey", F.lit(12)).cast("int").alias("headroom"))
    return calibration.overload(c, 2.0).select("p_partkey", "headroom", r6("im3_headroom").alias("im3_headroom"))


@register("SELECT p_brand, max(p_retailprice) AS gain, arg_max(p_partkey * 1.0::DOUBLE, p_retailprice) AS noise_figure, arg_max(p_size * 1.0::DOUBLE, p_retailprice) AS power_correction FROM (SELECT * FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_retailprice) = 1) GROUP BY 1")
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    single = part.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_retailprice"))).where("c = 1")
    rows = single.select("p_brand", F.col("p_retailprice").alias("gain"), F.col("p_partkey").cast("double").alias("noise_figure"), F.col("p_size").cast("double").alias("power_correction"))
    return calibration.summarise(rows, ("p_brand",))


@register(f"""WITH {STFT_SQL} SELECT capture_id, port, frame // 2 AS block, frame % 2 AS symbol, k - 4 AS k, round_even(10 * log10(power + 1e-25), 3) AS value FROM st WHERE k >= 4 AND k < 12""")
def ssb_spectrogram(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.ssb_spectrogram(stft(spark, d), 2, 15e3, 4, 8)


@register("SELECT event_id, CAST(event_id % 140 AS INTEGER) AS symbol, CASE WHEN event_id % 140 < 42 THEN 'downlink' ELSE 'uplink' END AS direction FROM events WHERE event_id % 140 < 42 OR event_id % 140 >= 98")
def tdd_masks(spark: SparkSession, d: str) -> DataFrame:
    """Readings by the link direction of their symbol; those of flexible slots belong to none."""
    events = read_table(spark, d, "events").select("event_id", (F.col("event_id") % 140).cast("int").alias("symbol"))
    return events.join(F.broadcast(ofdm.mask_table(spark, 15e3, "dddffffuuu")), "symbol").select("event_id", "symbol", "direction")


@register("""WITH x AS (SELECT event_id, 10 * log10(value) AS x FROM events),
b AS (SELECT event_id, CAST(CASE WHEN x < -10.25 THEN 0 WHEN x >= 10.25 THEN 42 ELSE least(floor((x + 10.25) / 0.5) + 1, 41) END AS BIGINT) AS bin FROM x)
SELECT event_id, bin, CASE bin WHEN 0 THEN CAST('-inf' AS DOUBLE) WHEN 42 THEN CAST('inf' AS DOUBLE) ELSE CAST(-10 + 0.5 * (bin - 1) AS DOUBLE) END AS center FROM b""")
def power_bins(spark: SparkSession, d: str) -> DataFrame:
    """The bin of every reading and its centre."""
    bins = (-10.0, 10.0, 0.5)
    rows = read_table(spark, d, "events").select("event_id", stats.bin_index(C.pow_to_db(F.col("value")), *bins).alias("bin"))
    return rows.withColumn("center", stats.bin_center(F.col("bin"), *bins))


@register("""WITH r AS (SELECT CAST(floor(min(value)) AS BIGINT) AS lo, CAST(ceil(max(value)) AS BIGINT) AS hi FROM events) SELECT CAST(unnest(range(lo, hi + 1, 10)) AS BIGINT) AS edge FROM r""")
def quantised_range(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "events").agg(F.floor(F.min("value")).cast("long").alias("lo"), F.ceil(F.max("value")).cast("long").alias("hi"))
    return r.select(F.explode(F.sequence("lo", "hi", F.lit(10).cast("long"))).alias("edge"))


@register(f"WITH {IQ_SQL} SELECT capture_id, port, n, round(re, 9) AS re, round(im, 9) AS im FROM iq WHERE n >= 8 AND n < 24")
def iq_waveform(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = int(0.25 * FS), int(0.75 * FS)
    return iq(spark, d).where((F.col("n") >= lo) & (F.col("n") < hi)).withColumn("re", r6("re", 9)).withColumn("im", r6("im", 9))


@register(f"""WITH {IQ_SQL}, h AS (
  SELECT CAST(range - 4 AS BIGINT) AS k, CASE WHEN range = 4 THEN 0.5 ELSE (cos(2 * pi() * 0.1875 * (range - 4)) - cos(2 * pi() * 0.3125 * (range - 4))) / (2 * pi() * pi() * (range - 4) * (range - 4) * 0.125) END AS h FROM range(9))
SELECT capture_id, port, n + k AS n, round(sum(re * h), 6) AS re, round(sum(im * h), 6) AS im FROM iq, h WHERE n + k >= 0 AND n + k < 32 GROUP BY ALL""")
def fir_filter(spark: SparkSession, d: str) -> DataFrame:
    out = frames.samples(filters.filtered(blocks(spark, d), 16.0, FS, 9, 4.0, 12, one_block=True))
    return out.select("capture_id", "port", "n", r6(F.col("re") + 0.0).alias("re"), r6(F.col("im") + 0.0).alias("im"))


@register("""WITH w AS (SELECT 'hamming' AS name, CAST(range AS INTEGER) AS i, round(0.54 - 0.46 * cos(2 * pi() * range / 64), 9) AS w FROM range(64)
UNION ALL SELECT 'blackman', CAST(range AS INTEGER), round(0.42 - 0.5 * cos(2 * pi() * range / 64) + 0.08 * cos(4 * pi() * range / 64), 9) FROM range(64)
UNION ALL SELECT 'taylor', CAST(i AS INTEGER), round((1 + 2 * sum(f * cos(2 * pi() * m * (i - 32) / 65.0))) / any_value(1 + 2 * total), 9)
FROM (SELECT range AS i FROM range(64)) AS i,
     (SELECT m, f, sum(f) OVER () AS total FROM (
        SELECT m, -pow(-1, m) * (SELECT product(1 - m * m / s / (a * a + (j - 0.5) * (j - 0.5))) FROM range(1, 4) AS t(j))
                  / (2 * (SELECT product(1 - m * m / CAST(j * j AS DOUBLE)) FROM range(1, 4) AS t(j) WHERE j <> m)) AS f
        FROM (SELECT a, 16 / (a * a + 12.25) AS s FROM (SELECT acosh(pow(10, 30 / 20.0)) / pi() AS a)), (SELECT range AS m FROM range(1, 4)))) AS f
GROUP BY i)
SELECT vec_id, name, round(sum(CAST(embedding[i + 1] AS DOUBLE) * w), 6) + 0.0 AS total FROM embeddings, w GROUP BY ALL""")
def window_values(spark: SparkSession, d: str) -> DataFrame:
    """Every vector under three windows, summed."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, windows.window(name, 64, normalise=False).tolist())).alias("w")) for name in ("hamming", "blackman", "taylor")))).alias("w")
    total = F.aggregate(F.zip_with("embedding", "w.w", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return read_table(spark, d, "embeddings").select("vec_id", "embedding", each).select("vec_id", "w.name", (r6(total) + 0.0).alias("total"))


def _overlap_sql(nfft_out: int, lo: float, hi: float) -> str:
    """Frames of 16 samples, 8 apart, over a capture with zeros around it: direct transform, bins of the band, direct inverse, sum over frames."""
    w = windows.window("hamming", NFFT, normalise=False)
    w = w / (w.sum() / 8)
    values = ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w.tolist()))
    hop = nfft_out // 2
    return f"""WITH {IQ_SQL}, w(j, w) AS (VALUES {values}),
fr AS (SELECT CAST(range AS BIGINT) - 1 AS frame FROM range(5)),
ks AS (SELECT CAST(range AS BIGINT) - {nfft_out // 2} AS k FROM range({nfft_out}) WHERE (range - {nfft_out // 2}) * {FS / NFFT} BETWEEN {lo!r} AND {hi!r}),
x AS (SELECT capture_id, port, frame, j, re * w AS re, im * w AS im FROM fr, w JOIN iq ON TRUE WHERE n = frame * 8 + j),
y AS (SELECT capture_id, port, frame, k, sum(re * cos(a) + im * sin(a)) AS re, sum(im * cos(a) - re * sin(a)) AS im
      FROM (SELECT *, 2 * pi() * k * j / {NFFT}.0 AS a FROM x, ks) GROUP BY ALL),
z AS (SELECT capture_id, port, frame * {hop} + i AS n, (re * cos(b) - im * sin(b)) / {NFFT} AS re, (re * sin(b) + im * cos(b)) / {NFFT} AS im
      FROM (SELECT *, 2 * pi() * k * i / {nfft_out}.0 AS b FROM y, (SELECT CAST(range AS BIGINT) AS i FROM range({nfft_out}))))
SELECT capture_id, port, n, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im FROM z WHERE n >= 0 AND n < {32 * nfft_out // NFFT} GROUP BY ALL"""


_EDGE = float(windows.noise_bandwidth("hamming", NFFT))


@register(_overlap_sql(NFFT, -8.0 + _EDGE, 10.0 - _EDGE))
def oa_filter(spark: SparkSession, d: str) -> DataFrame:
    out = frames.samples(filters.oa_filter(blocks(spark, d), FS, NFFT, (-8.0, 10.0), size=8, one_block=True))
    return out.select("capture_id", "port", "n", (r6("re") + 0.0).alias("re"), (r6("im") + 0.0).alias("im"))


@register(_overlap_sql(8, -6.0, 6.0))
def oa_resample(spark: SparkSession, d: str) -> DataFrame:
    out = frames.samples(filters.oa_resample(blocks(spark, d), FS, NFFT, 8, bandwidth=12.0, size=16, one_block=True))
    return out.select("capture_id", "port", "n", (r6("re") + 0.0).alias("re"), (r6("im") + 0.0).alias("im"))


#: Short beginnings of synchronisation sequences as waves, for captures of 32 samples: two periods of 16 with two beams.
_WAVES = {"pss": {i: ofdm.pss(i)[:8] for i in range(3)}, "sss": {i: ofdm.sss(i, i % 3)[:8] for i in range(4)}}


def _correlation_sql(kind: str) -> str:
    values = ", ".join(f"({i}, {j}, {int(v)})" for i, w in _WAVES[kind].items() for j, v in enumerate(w))
    return f"""WITH {IQ_SQL}, w(cell_id, j, v) AS (VALUES {values}),
spots AS (SELECT * FROM (SELECT unnest([0, 1]) AS block), (SELECT unnest([0, 1]) AS beam), (SELECT CAST(range AS BIGINT) AS lag FROM range(5))),
c AS (SELECT capture_id, port, CAST(cell_id AS INTEGER) AS cell_id, CAST(block AS INTEGER) AS block, CAST(beam AS INTEGER) AS beam, lag, sum(re * v) AS re, sum(im * v) AS im
  FROM spots, w, iq WHERE n = block * 16 + beam * 4 + lag + j AND n < block * 16 + 16 GROUP BY ALL)"""


@register(_correlation_sql("pss") + " SELECT capture_id, port, cell_id, block, beam, lag, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM c")
def pss_correlation(spark: SparkSession, d: str) -> DataFrame:
    out = cellular.correlate_waves(blocks(spark, d), _WAVES["pss"], (0, 4), 5, 16, one_block=True)
    return out.withColumn("re", r6("re") + 0.0).withColumn("im", r6("im") + 0.0)


@register(_correlation_sql("sss") + """,
m AS (SELECT capture_id, port, block, lag, avg(re * re + im * im) AS p FROM c GROUP BY ALL),
q AS (SELECT capture_id, port, lag, median(p) AS p FROM m GROUP BY ALL),
l AS (SELECT capture_id, port, median(p) AS mid, max(p) AS top FROM q GROUP BY ALL),
k AS (SELECT q.capture_id, q.port, lag, CASE WHEN p >= greatest(2 * mid, top / 2) THEN p ELSE 0 END AS p FROM q JOIN l ON q.capture_id = l.capture_id AND q.port = l.port),
s AS (SELECT a.capture_id, a.port, a.lag, sum(b.p * (1 - abs(a.lag - b.lag) / 5.0)) AS s FROM k a JOIN k b ON a.capture_id = b.capture_id AND a.port = b.port GROUP BY ALL),
r AS (SELECT capture_id, port, lag, row_number() OVER (PARTITION BY capture_id, port ORDER BY round(s, 12) DESC, lag) AS r FROM s)
SELECT capture_id, port, lag, round(lag / 32.0, 9) AS delay FROM r WHERE r = 1""")
def sss_sync(spark: SparkSession, d: str) -> DataFrame:
    out = cellular.sync(cellular.correlate_waves(blocks(spark, d), _WAVES["sss"], (0, 4), 5, 16, mean=True, one_block=True), FS)
    return out.select("capture_id", "port", "lag", r6("delay", 9).alias("delay"))


@register("""WITH c(ssb_case, period, low, high, bound, in_shared, offsets) AS (VALUES
  ('a', 14, [0, 1], [0, 1, 2, 3], 3e9::DOUBLE, [0, 1, 2, 3, 4], [2, 8]), ('b', 28, [0], [0, 1], 3e9, NULL, [4, 8, 16, 20]), ('c', 14, [0, 1], [0, 1, 2, 3], 1.88e9, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [2, 8]),
  ('d', 28, [0, 1, 2, 3, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 18], [0, 1, 2, 3, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 18], 0, NULL, [4, 8, 16, 20]),
  ('e', 56, [0, 1, 2, 3, 5, 6, 7, 8], [0, 1, 2, 3, 5, 6, 7, 8], 0, NULL, [8, 12, 16, 20, 32, 36, 40, 44]), ('f', 14, range(32), range(32), 0, NULL, [2, 9]), ('g', 14, range(32), range(32), 0, NULL, [2, 9])),
s AS (SELECT s_suppkey, substr('abcdefg', CAST(s_suppkey % 7 + 1 AS INTEGER), 1) AS ssb_case, s_nationkey * 2.5e8 AS frequency, s_suppkey % 2 = 0 AND s_suppkey % 7 IN (0, 2) AS shared FROM supplier),
n AS (SELECT s_suppkey, s.ssb_case, period, offsets, unnest(CASE WHEN shared THEN in_shared WHEN frequency <= bound THEN low ELSE high END) AS n FROM s JOIN c USING (ssb_case))
SELECT s_suppkey, ssb_case, CAST(period * n + o AS INTEGER) AS symbol FROM n, LATERAL (SELECT unnest(offsets) AS o)""")
def ssb_cases(spark: SparkSession, d: str) -> DataFrame:
    """First symbols of the synchronisation blocks of every capture, by its case, frequency and kind of spectrum."""
    key = F.col("s_suppkey")
    rows = read_table(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, "abcdefg")), (key % 7 + 1).cast("int")).alias("ssb_case"), (F.col("s_nationkey") * 2.5e8).alias("frequency"), ((key % 2 == 0) & (key % 7).isin(0, 2)).alias("shared"))
    return rows.select("s_suppkey", "ssb_case", F.explode(ofdm.ssb_symbols_of(F.col("ssb_case"), F.col("frequency"), F.col("shared"))).alias("symbol"))
