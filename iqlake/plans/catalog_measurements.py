"""Registered query of a whole analysis: measurements that share a spectrogram, and one of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType

from ..sources.tables import chained_blocks, interleaved_blocks, read_table
from . import measurements
from .catalog import FS, IQ_SQL, NFFT, STFT_SQL, r6, register

SPECTROGRAM = {"frequency_resolution": FS / NFFT, "fractional_overlap": 0.5}
ANALYSIS = {
    "spectrogram": SPECTROGRAM,
    "power_spectral_density": SPECTROGRAM | {"time_statistic": ["mean", "max", 0.5]},
    "spectrogram_histogram": SPECTROGRAM | {"power_low": -50, "power_high": 0, "power_resolution": 5},
    "channel_power_time_series": {"detector_period": 0.25},
}


@measurements.register_source("interleaved_table", {"folder": measurements.Param(StringType()), "table": measurements.Param(StringType(), "embeddings"), "ports": measurements.Param(LongType(), 2)})
def interleaved_table(spark: SparkSession, folder: str, table: str, ports: int) -> DataFrame:
    return interleaved_blocks(read_table(spark, folder, table), ports)


@register(f"""WITH {STFT_SQL},
px AS (SELECT *, round_even(10 * log10(power + 1e-25), 2) AS db FROM st),
stats AS (SELECT capture_id, port, k, avg(power) AS mean, max(power) AS top, quantile_cont(power, 0.5) AS mid FROM st GROUP BY ALL),
bins AS (SELECT capture_id, port, CAST(CASE WHEN db < -52.5 THEN 0 WHEN db >= 2.5 THEN 12 ELSE least(floor((db + 52.5) / 5) + 1, 11) END AS BIGINT) AS bin FROM px WHERE NOT isnan(power)),
counts AS (SELECT capture_id, port, bin, count(*) AS n FROM bins GROUP BY ALL),
d AS (SELECT capture_id, port, n // 8 AS bin, avg(re * re + im * im) AS rms, max(re * re + im * im) AS peak FROM iq GROUP BY ALL),
r AS (
  SELECT capture_id, port, 'spectrogram' AS measurement, (k - 8) * 2.0 AS baseband_frequency, frame * 0.25 AS spectrogram_time, NULL AS time_statistic, NULL AS spectrogram_power_bin, NULL AS power_detector, NULL AS time_elapsed, db AS value, 'dBm/0.002 kHz' AS units FROM px
  UNION ALL SELECT capture_id, port, 'power_spectral_density', (k - 8) * 2.0, NULL, s, NULL, NULL, NULL, 10 * log10(v + 1e-25), 'dBm/0.002 kHz' FROM (SELECT *, unnest(['mean', 'max', '0.5']) AS s, unnest([mean, top, mid]) AS v FROM stats)
  UNION ALL SELECT capture_id, port, 'spectrogram_histogram', NULL, NULL, NULL, CASE bin WHEN 0 THEN '-inf'::DOUBLE WHEN 12 THEN 'inf'::DOUBLE ELSE -50 + 5 * (bin - 1) END, NULL, NULL, n / sum(n) OVER (PARTITION BY capture_id, port), '' FROM counts
  UNION ALL SELECT capture_id, port, 'channel_power_time_series', NULL, NULL, NULL, NULL, s, bin * 0.25, 10 * log10(v), 'dBm' FROM (SELECT *, unnest(['rms', 'peak']) AS s, unnest([rms, peak]) AS v FROM d))
SELECT capture_id, port, measurement, CAST(baseband_frequency AS DOUBLE) AS baseband_frequency, CAST(spectrogram_time AS DOUBLE) AS spectrogram_time, time_statistic, CAST(spectrogram_power_bin AS DOUBLE) AS spectrogram_power_bin, power_detector, CAST(time_elapsed AS DOUBLE) AS time_elapsed, round(value, 6) AS value, units FROM r""")
def analysis_by_spec(spark: SparkSession, d: str) -> DataFrame:
    out = measurements.run_sweep(spark, {"source": {"type": "interleaved_table", "folder": d}, "capture": {"sample_rate": FS}, "analysis": ANALYSIS})
    return out.withColumn("value", r6("value"))


@measurements.register_source("chained_table", {"folder": measurements.Param(StringType()), "table": measurements.Param(StringType(), "embeddings"), "per_capture": measurements.Param(LongType())})
def chained_table(spark: SparkSession, folder: str, table: str, per_capture: int) -> DataFrame:
    return chained_blocks(read_table(spark, folder, table), per_capture)


CELLULAR = {
    "iq_waveform": {"stop_time_sec": 16.5 / 1.92e6},
    "cellular_cyclic_autocorrelation": {"subcarrier_spacings": [15e3], "generation": "4G"},
    "cellular_5g_pss_correlation": {"sample_rate": 1.92e6, "subcarrier_spacing": 15e3, "symbols": [0], "discovery_periodicity": 512 / 1.92e6, "max_lag_symbols": 1},
}


#: The sequences by their recursion, their symbols and the correlations by direct sums.
@register("""WITH RECURSIVE iq AS (SELECT vec_id // 16 AS capture_id, (vec_id % 16) * 32 + i AS n, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im FROM embeddings, (SELECT CAST(range AS BIGINT) AS i FROM range(32))),
cs AS (SELECT capture_id, count(*) AS own FROM iq GROUP BY 1),
g(i, a) AS (SELECT 7, [0, 1, 1, 0, 1, 1, 1] UNION ALL SELECT i + 1, list_append(a, (a[i - 2] + a[i - 6]) % 2) FROM g WHERE i < 127),
d AS (SELECT id, n, 1 - 2 * a[(n + 43 * id) % 127 + 1] AS d FROM (SELECT a FROM g WHERE i = 127), (SELECT CAST(range AS BIGINT) AS n FROM range(127)), (SELECT CAST(range AS BIGINT) AS id FROM range(3))),
w AS (SELECT id, t, sum(d * cos(2 * pi() * (n - 64) * t / 128)) / sqrt(127) AS re, sum(d * sin(2 * pi() * (n - 64) * t / 128)) / sqrt(127) AS im FROM d, (SELECT CAST(range AS BIGINT) AS t FROM range(128)) GROUP BY ALL),
r0 AS (SELECT capture_id, id, lag, sum(iq.re * w.re + iq.im * w.im) AS re, sum(iq.im * w.re - iq.re * w.im) AS im FROM iq, w, (SELECT CAST(range AS BIGINT) AS lag FROM range(137)) WHERE iq.n = lag + 9 + t GROUP BY ALL),
r AS (SELECT cs.capture_id, i.id, l.lag, coalesce(re, 0) AS re, coalesce(im, 0) AS im FROM cs, (SELECT CAST(range AS BIGINT) AS id FROM range(3)) i, (SELECT CAST(range AS BIGINT) AS lag FROM range(137)) l LEFT JOIN r0 ON r0.capture_id = cs.capture_id AND r0.id = i.id AND r0.lag = l.lag WHERE l.lag < own),
s AS (SELECT slot * 1920 + sym * 137 + CASE WHEN sym > 7 THEN 2 WHEN sym > 0 THEN 1 ELSE 0 END AS start FROM (SELECT CAST(range AS BIGINT) AS slot FROM range(10)), (SELECT CAST(range AS BIGINT) AS sym FROM range(14))),
i AS (SELECT start + c AS i FROM s, (SELECT CAST(range AS BIGINT) AS c FROM range(9))),
q AS (SELECT a.capture_id, a.n, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM iq a JOIN iq b ON a.capture_id = b.capture_id AND b.n = a.n + 128),
c AS (SELECT capture_id, j, sqrt(pow(sum(re), 2) + pow(sum(im), 2)) / 1260 AS r FROM i, (SELECT CAST(range AS BIGINT) AS j FROM range(137)) JOIN q ON TRUE WHERE q.n = i + j GROUP BY ALL),
o AS (
  SELECT capture_id, 'iq_waveform' AS measurement, n AS iq_index, n / 1.92e6 AS iq_time, part AS iq_part, NULL::VARCHAR AS link_direction, NULL::DOUBLE AS subcarrier_spacing, NULL::DOUBLE AS cyclic_sample_lag, NULL::BIGINT AS cellular_cell_id, NULL::BIGINT AS cellular_ssb_beam_index, NULL::DOUBLE AS cellular_ssb_start_time, NULL::DOUBLE AS cellular_ssb_lag, v AS value, '√mW' AS units
  FROM (SELECT capture_id, n, unnest(['re', 'im']) AS part, unnest([re, im]) AS v FROM iq WHERE n < 16)
  UNION ALL SELECT cs.capture_id, 'cellular_cyclic_autocorrelation', NULL, NULL, NULL, dir, 15e3, j.j / 1.92e6, NULL, NULL, NULL, NULL, CASE WHEN dir = 'downlink' THEN coalesce(c.r, 0) END, 'mW'
  FROM cs, (SELECT unnest(['downlink', 'uplink']) AS dir), (SELECT CAST(range AS BIGINT) AS j FROM range(137)) j LEFT JOIN c ON c.capture_id = cs.capture_id AND c.j = j.j
  UNION ALL SELECT capture_id, 'cellular_5g_pss_correlation', NULL, NULL, part, NULL, NULL, NULL, id, 0, 0, lag / 1.92e6, v, '√mW' FROM (SELECT capture_id, id, lag, unnest(['re', 'im']) AS part, unnest([re, im]) AS v FROM r))
SELECT capture_id, CAST(0 AS INTEGER) AS port, measurement, iq_index, CAST(iq_time AS DOUBLE) AS iq_time, iq_part, link_direction, CAST(subcarrier_spacing AS DOUBLE) AS subcarrier_spacing, CAST(cyclic_sample_lag AS DOUBLE) AS cyclic_sample_lag,
  CAST(cellular_cell_id AS INTEGER) AS cellular_cell_id, CAST(cellular_ssb_beam_index AS INTEGER) AS cellular_ssb_beam_index, CAST(cellular_ssb_start_time AS DOUBLE) AS cellular_ssb_start_time, CAST(cellular_ssb_lag AS DOUBLE) AS cellular_ssb_lag, round(value, 6) + 0.0 AS value, units FROM o""")
def analysis_cellular(spark: SparkSession, d: str) -> DataFrame:
    out = measurements.run_sweep(spark, {"source": {"type": "chained_table", "folder": d, "per_capture": 16}, "capture": {"sample_rate": 1.92e6}, "analysis": CELLULAR})
    return out.withColumn("value", r6("value") + 0.0)
