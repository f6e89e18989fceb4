"""Registered queries of corrections by spec, resampler designs and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows
from ..operators import cellular, corrections, frames
from ..sources.tables import chained_blocks, read_table
from .catalog import FS, NFFT, blocks, r6, register
from .catalog_shapes import _WAVES, _correlation_sql

#: Four specs by capture: rate kept, or halved with a band moved to zero by none, two and two and a half bins.
SPECS = [
    {"scale": 2.0, "conjugate": False, "nfft": 1, "nfft_out": 1, "shift": 0.0, "bandwidth": 16.0, "taps": 9},
    {"scale": 1.0, "conjugate": True, "nfft": 16, "nfft_out": 8, "shift": 0.0, "bandwidth": 12.0, "taps": 5},
    {"scale": 1.0, "conjugate": False, "nfft": 16, "nfft_out": 8, "shift": 4.0, "bandwidth": float("inf"), "taps": 5},
    {"scale": 0.5, "conjugate": False, "nfft": 16, "nfft_out": 8, "shift": 5.0, "bandwidth": 10.0, "taps": 5},
]
PER_CAPTURE = 4


def _correct_sql() -> str:
    """Direct sums per spec: overlapped frames with their bins for the resampled ones, then the low-pass's taps."""
    w = windows.window("hamming", NFFT, normalise=False)
    w = w / (w.sum() / 8)
    n = 32 * PER_CAPTURE
    values = ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w.tolist()))
    return f"""WITH w(j, w) AS (VALUES {values}),
s(spec, scale, sign, bins, rest, band, lo, hi, half) AS (VALUES (0, 2.0::DOUBLE, 1, 0, 0, 1e9::DOUBLE, 0.1875::DOUBLE, 0.3125::DOUBLE, 4), (1, 1.0, -1, 0, 0, 12, 0.25, 0.5, 2), (2, 1.0, 1, 2, 0, 1e9, NULL, NULL, 0), (3, 0.5, 1, 2, 1, 10, 0.1875, 0.4375, 2)),
iq AS (SELECT vec_id // {PER_CAPTURE} AS capture_id, (vec_id % {PER_CAPTURE}) * 32 + i AS n, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im
  FROM embeddings, (SELECT CAST(range AS BIGINT) AS i FROM range(32))),
x AS (SELECT capture_id, spec, n, scale * (re * cos(a) + im * sin(a)) AS re, scale * (im * cos(a) - re * sin(a)) AS im
  FROM (SELECT iq.*, s.spec, scale, 2 * pi() * rest * n / 32.0 AS a FROM iq JOIN s ON s.spec = capture_id % 4)),
fr AS (SELECT CAST(range AS BIGINT) - 1 AS frame FROM range({n // 8 + 1})),
ks AS (SELECT CAST(range AS BIGINT) - 4 AS k FROM range(8)),
f AS (SELECT capture_id, x.spec, frame, j, re * w AS re, im * w AS im FROM fr, w JOIN x ON x.spec > 0 WHERE n = frame * 8 + j),
y AS (SELECT capture_id, spec, frame, k, sum(re * cos(a) + im * sin(a)) AS re, sum(im * cos(a) - re * sin(a)) AS im
  FROM (SELECT f.*, k, 2 * pi() * (k + bins) * j / 16.0 AS a FROM f JOIN s USING (spec), ks WHERE abs(k * 2) <= band / 2) GROUP BY ALL),
z AS (SELECT capture_id, spec, frame * 4 + i AS n, (re * cos(b) - im * sin(b)) / 16 AS re, (re * sin(b) + im * cos(b)) / 16 AS im
  FROM (SELECT y.*, i, 2 * pi() * k * i / 8.0 AS b FROM y, (SELECT CAST(range AS BIGINT) AS i FROM range(8)))),
r AS (SELECT capture_id, spec, n, sum(re) AS re, sum(im) AS im FROM z WHERE n >= 0 AND n < {n // 2} GROUP BY ALL
  UNION ALL SELECT capture_id, spec, n, re, im FROM x WHERE spec = 0),
c AS (SELECT capture_id, spec, n, re, im * sign AS im, lo, hi, half FROM r JOIN s USING (spec)),
h AS (SELECT spec, k, CASE WHEN lo IS NULL THEN 1 WHEN k = 0 THEN lo + hi ELSE (cos(2 * pi() * lo * k) - cos(2 * pi() * hi * k)) / (2 * pi() * pi() * k * k * (hi - lo)) END AS h
  FROM s, (SELECT CAST(range AS BIGINT) - 4 AS k FROM range(9)) WHERE abs(k) <= half),
o AS (SELECT capture_id, spec, n + k AS n, sum(re * h) AS re, sum(im * h) AS im FROM c JOIN h USING (spec) GROUP BY ALL)
SELECT capture_id, CAST(0 AS INTEGER) AS port, n - 4 AS n, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM o WHERE n >= 4 AND n < 4 + CASE WHEN spec = 0 THEN 40 ELSE 24 END"""


@register(_correct_sql())
def correct_iq(spark: SparkSession, d: str) -> DataFrame:
    raw = chained_blocks(read_table(spark, d, "embeddings"), PER_CAPTURE)
    which = F.pmod("capture_id", F.lit(len(SPECS)))
    by_capture = {name: F.element_at(F.array(*(F.lit(s[name]) for s in SPECS)), (which + 1).cast("int")) for name in SPECS[0]}
    raw = raw.withColumn("spec", corrections.spec_column(fs=FS, transition=4.0, **by_capture))
    size = F.when(corrections.resampling(F.col("spec")), 24).otherwise(40)
    out = frames.samples(corrections.correct_iq(raw, F.lit(4), size, chunk=40))
    return out.select("capture_id", "port", "n", (r6("re") + 0.0).alias("re"), (r6("im") + 0.0).alias("im"))


@corrections.register_trigger("cellular_5g_pss_sync", "cellular_5g_pss_correlation", lambda **s: cellular.sync_sizes(s["sample_rate"], s["spacing"], s.get("max_lag_symbols", 4))["lags"] / s["sample_rate"])
def pss_trigger(raw: DataFrame, sample_rate: float, spacing: float, symbols: tuple[int, ...], **more: float) -> DataFrame:
    """Lags of the best primary synchronisation sequence."""
    return cellular.sync(cellular.correlate(raw, "pss", sample_rate, spacing, symbols, mean=True, **more), sample_rate)


@corrections.register_trigger("cellular_5g_sss_sync", "cellular_5g_sss_correlation", lambda **s: cellular.sync_sizes(s["sample_rate"], s["spacing"], s.get("max_lag_symbols", 4))["lags"] / s["sample_rate"])
def sss_trigger(raw: DataFrame, sample_rate: float, spacing: float, symbols: tuple[int, ...], **more: float) -> DataFrame:
    """Lags of the best secondary synchronisation sequence."""
    return cellular.sync(cellular.correlate(raw, "sss", sample_rate, spacing, symbols, mean=True, **more), sample_rate)


@corrections.register_trigger("wave_sync", "wave_correlation", lambda **s: s["lags"] / s["sample_rate"])
def wave_trigger(raw: DataFrame, waves: dict, starts: tuple[int, ...], lags: int, period: int, sample_rate: float) -> DataFrame:
    """Lags of the best of given waves."""
    return cellular.sync(cellular.correlate_waves(raw, waves, starts, lags, period, mean=True, one_block=True), sample_rate)


@register(_correlation_sql("pss") + """,
m AS (SELECT capture_id, port, block, lag, avg(re * re + im * im) AS p FROM c GROUP BY ALL),
q AS (SELECT capture_id, port, lag, median(p) AS p FROM m GROUP BY ALL),
l AS (SELECT capture_id, port, median(p) AS mid, max(p) AS top FROM q GROUP BY ALL),
k AS (SELECT q.capture_id, q.port, lag, CASE WHEN p >= greatest(2 * mid, top / 2) THEN p ELSE 0 END AS p FROM q JOIN l ON q.capture_id = l.capture_id AND q.port = l.port),
s AS (SELECT a.capture_id, a.port, a.lag, sum(b.p * (1 - abs(a.lag - b.lag) / 5.0)) AS s FROM k a JOIN k b ON a.capture_id = b.capture_id AND a.port = b.port GROUP BY ALL),
r AS (SELECT capture_id, port, lag FROM s QUALIFY row_number() OVER (PARTITION BY capture_id, port ORDER BY round(s, 12) DESC, lag) = 1)
SELECT iq.capture_id, iq.port, lag, n - lag AS n, round(iq.re, 9) AS re, round(iq.im, 9) AS im FROM iq JOIN r ON iq.capture_id = r.capture_id AND iq.port = r.port WHERE n >= lag AND n < lag + 24""")
def trigger_align(spark: SparkSession, d: str) -> DataFrame:
    analysis = {"wave_correlation": {"waves": _WAVES["pss"], "starts": (0, 4), "lags": 5, "period": 16, "sample_rate": FS}}
    how, spec = corrections.resolve_trigger("wave_sync", analysis)
    raw = blocks(spark, d)
    lags = how.lags(raw, **spec)
    out = frames.samples(corrections.aligned(raw, lags, 24))
    return out.join(lags.select("capture_id", "port", "lag"), ["capture_id", "port"]).select("capture_id", "port", "lag", "n", r6("re", 9).alias("re"), r6("im", 9).alias("im"))


#: Every size is tried; primes are what no product gives, fast lengths what products of small primes give.
@register("""WITH p AS (SELECT p_partkey, 1.92e6::DOUBLE * (p_size % 8 + 1) AS target, CASE WHEN p_size % 4 = 0 THEN 'inf'::DOUBLE ELSE 0.8::DOUBLE * (1.92e6 * (p_size % 8 + 1)) END AS band,
  CASE WHEN p_size % 4 = 0 OR p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN -1 ELSE 1 END AS side FROM part),
d AS (SELECT DISTINCT target, band, side FROM p),
f AS (SELECT *, 122.88e6::DOUBLE / floor(122.88e6::DOUBLE / CASE WHEN side = 0 THEN target ELSE target + 1.1 * band / 2 + 0.25e6 / 2 END) AS fs, CASE WHEN side = 0 THEN 0 ELSE side * (band + 0.25e6) / 2 END AS lo FROM d),
products AS (SELECT DISTINCT a * b AS n FROM (SELECT range AS a FROM range(2, 363)), (SELECT range AS b FROM range(2, 65537)) WHERE a * b <= 131072),
c AS (SELECT target, band, side, min(n) AS n FROM f, (SELECT range AS n FROM range(257, 131073)) AS t WHERE abs(round_even(fs / target * n, 0) - fs / target * n) <= 1e-6 AND n IN (SELECT n FROM products) GROUP BY ALL),
g AS (SELECT f.*, n, CAST(round_even(fs / target * n, 0) AS BIGINT) AS m FROM f JOIN c USING (target, band, side)),
h AS (SELECT *, CASE WHEN n % 2 > 0 OR m % 2 > 0 THEN 2 ELSE 1 END AS t FROM g),
i AS (SELECT *, m * t AS nfft, n * t AS nfft_out, m * t * CASE WHEN isinf(band) THEN 1 ELSE CAST(ceil(m * t / 2001.0) AS BIGINT) END AS block, CAST(round_even(0.01::DOUBLE * fs, 0) AS BIGINT) AS size FROM h),
smooth AS (SELECT CAST(pow(2, a) * pow(3, b) * pow(5, c) * pow(7, d) * pow(11, e) AS BIGINT) AS v FROM (SELECT range AS a FROM range(14)), (SELECT range AS b FROM range(9)), (SELECT range AS c FROM range(6)), (SELECT range AS d FROM range(5)), (SELECT range AS e FROM range(4))),
o AS (SELECT *, block * (SELECT min(v) FROM smooth WHERE v >= size // block + CAST(ceil(ceil(122.88e6::DOUBLE * 0.0005) / block) AS BIGINT) + 1) - size AS extra FROM i)
SELECT p_partkey, round(fs, 3) AS fs_sdr, CAST(nfft AS BIGINT) AS nfft, CAST(nfft_out AS BIGINT) AS nfft_out, round(lo, 3) AS lo_offset, CAST(extra // 2 AS BIGINT) AS overlap_low, CAST(extra - extra // 2 AS BIGINT) AS overlap_high
FROM p JOIN o USING (target, band, side)""")
def resampler_design(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    target = F.lit(1.92e6) * (size % 8 + 1)
    whole = size % 4 == 0
    captures = read_table(spark, d, "part").select(
        "p_partkey", F.lit(122.88e6).alias("master_clock_rate"), target.alias("sample_rate"), F.when(~whole, F.lit(0.8) * target).alias("analysis_bandwidth"),
        F.when(whole | (size % 3 == 0), "none").when(size % 3 == 1, "left").otherwise("right").alias("lo_shift"), F.lit(0.01).alias("duration"), F.lit(0.0005).alias("max_lag"),
    )
    out = corrections.designed(captures)
    return out.select("p_partkey", r6("fs_sdr", 3).alias("fs_sdr"), "nfft", "nfft_out", r6("lo_offset", 3).alias("lo_offset"), "overlap_low", "overlap_high")
