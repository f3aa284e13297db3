"""Queries of epoching, cleaning, spectra and connectivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavecohort.jobs.base import LONG, SAMPLES, query, r6, recording, rounded, samples, table
from wavecohort.operators import signal as S
from wavecohort.operators import spectral as P
from wavecohort.sources.tables import explode_samples
from wavecohort.streaming.epochs import epoch_summaries, good_epochs, windowed_epochs

BANDS = [("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0)]
BANDS_SQL = "b(band, fmin, fmax) AS (VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0))"

#: The discrete Fourier transform spelt out, bins 0..32 of 64 samples.
DFT = f"""WITH {LONG},
tw AS (SELECT k, n, cos(2 * pi() * k * n / 64) AS c, -sin(2 * pi() * k * n / 64) AS s FROM range(0, 33) x(k), range(0, 64) y(n)),
d AS (SELECT subject_id, grp, epoch_idx, channel, k AS freq, sum(value * c) AS re, sum(value * s) AS im FROM s JOIN tw ON n = sample_idx GROUP BY ALL),
psd AS (SELECT *, (re * re + im * im) / (64 * 64) * CASE WHEN freq IN (0, 32) THEN 1 ELSE 2 END AS power FROM d)"""


def _long(spark, sf_dir):
    return explode_samples(samples(spark, sf_dir))


# Recordings of one user as a regular grid: the order of the events is the sample number.
GRID = "g AS (SELECT user_id AS subject_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events)"


def _grid(spark, sf_dir):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), i.cast("long").alias("i"), "value")


def _digest(df):
    w = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return df.select("subject_id", "epoch_idx", F.size("samples").cast("long").alias("n"), r6(w, 4).alias("w"))


@query("fixed_length_epochs", f"""WITH {GRID} SELECT subject_id, i // 10 AS epoch_idx, count(*) AS n, round(sum(value * (i % 10 + 1)), 4) AS w FROM g GROUP BY ALL HAVING count(*) = 10""")
def fixed_length_epochs(spark, sf_dir):
    return _digest(S.fixed_length_epochs(_grid(spark, sf_dir), ["subject_id"], "i", "value", 10))


@query("overlapping_epochs", f"""WITH {GRID} SELECT subject_id, e AS epoch_idx, count(*) AS n, round(sum(value * (i - e * 5 + 1)), 4) AS w FROM g, range(0, 100000) r(e)
WHERE e <= i // 5 AND i < e * 5 + 10 AND e >= i // 5 - 1 GROUP BY ALL HAVING count(*) = 10""")
def overlapping_epochs(spark, sf_dir):
    return _digest(S.overlapping_epochs(_grid(spark, sf_dir), ["subject_id"], "i", "value", 10, 5))


@query("time_epochs", """SELECT user_id AS subject_id, ((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 86400000000)::BIGINT AS epoch_idx, event_id FROM events""")
def time_epochs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.time_epochs(e, ["subject_id"], "ts", 86400.0).select("subject_id", "epoch_idx", "event_id")


@query("windowed_epochs", """SELECT user_id AS subject_id, epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS start, count(*) AS n, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS ptp
FROM events GROUP BY ALL HAVING count(*) >= 2 AND max(value) - min(value) <= 50""")
def tumbling(spark, sf_dir):
    e = good_epochs(windowed_epochs(recording(spark, sf_dir), ["subject_id"], "ts", "value", "1 day"), 2, 50.0)
    return rounded(e.select("subject_id", F.unix_micros("start").alias("start"), "n", "mean", "ptp"), "mean", "ptp")


SLID = """e AS (SELECT user_id AS subject_id, epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) - k * 86400000000 AS start, count(*) AS n, avg(value) AS mean
  FROM events, range(0, 2) r(k) GROUP BY ALL HAVING count(*) >= 2 AND max(value) - min(value) <= 50),
g AS (SELECT *, (start + 2 * 86400000000 - 1) // (4 * 86400000000) * 4 * 86400000000 AS span FROM e)"""


@query("sliding_epochs", """SELECT user_id AS subject_id, epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) - k * 86400000000 AS start, count(*) AS n, round(avg(value), 6) AS mean
FROM events, range(0, 2) r(k) GROUP BY ALL""")
def sliding(spark, sf_dir):
    e = windowed_epochs(recording(spark, sf_dir), ["subject_id"], "ts", "value", "2 days", "1 day")
    return rounded(e.select("subject_id", F.unix_micros("start").alias("start"), "n", "mean"), "mean")


@query("stream_epochs", """WITH c AS (SELECT *, epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS start FROM events)
SELECT user_id AS subject_id, start, count(*) AS n, round(avg(value), 6) AS mean FROM c WHERE start + 86400000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events) GROUP BY ALL""")
def stream_epochs(spark, sf_dir):
    """The tumbling epochs as a stream in append mode: windows that the watermark has passed. The events are read as a
    stream from their folder, and the results from the folder that the stream wrote."""
    import uuid

    from wavecohort.functions.scratch import shared_dir
    from wavecohort.streaming.epochs import run_to_folder

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    live = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = live.select(F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    run_to_folder(windowed_epochs(rows, ["subject_id"], "ts", "value", "1 day", late="1 hour"), f"{at}/out", f"{at}/state")
    got = spark.read.parquet(f"{at}/out")
    return rounded(got.select("subject_id", F.unix_micros("start").alias("start"), "n", "mean"), "mean")


@query("sliding_epoch_summaries", f"""WITH {SLID} SELECT subject_id, span AS start, count(*) AS n_epochs, sum(n)::BIGINT AS n, round(sum(n * mean) / sum(n), 6) AS mean FROM g GROUP BY ALL""")
def sliding_epoch_summaries(spark, sf_dir):
    got = epoch_summaries(recording(spark, sf_dir), ["subject_id"], "ts", "value", "2 days", "1 day", 2, 50.0, "4 days")
    return rounded(got.select("subject_id", F.unix_micros("start").alias("start"), "n_epochs", "n", "mean"), "mean")


@query("stream_sliding_epochs", f"""WITH {SLID} SELECT subject_id, span AS start, count(*) AS n_epochs, sum(n)::BIGINT AS n, round(sum(n * mean) / sum(n), 6) AS mean FROM g WHERE span + 4 * 86400000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events) GROUP BY ALL""")
def stream_sliding_epochs(spark, sf_dir):
    """Sliding epochs, rejection and summaries of four days as one stream of two stateful steps in append mode: the spans
    that the watermark has passed."""
    import uuid

    from wavecohort.functions.scratch import shared_dir
    from wavecohort.streaming.epochs import run_to_folder

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    live = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = live.select(F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    run_to_folder(epoch_summaries(rows, ["subject_id"], "ts", "value", "2 days", "1 day", 2, 50.0, "4 days", late="1 hour"), f"{at}/out", f"{at}/state")
    got = spark.read.parquet(f"{at}/out")
    return rounded(got.select("subject_id", F.unix_micros("start").alias("start"), "n_epochs", "n", "mean"), "mean")


@query("align_epoch_length", "SELECT vec_id // 4 AS epoch_idx, 'c' || (vec_id % 4) AS channel, len(embedding[1:50])::INTEGER AS n, round(list_sum(list_transform(embedding[1:50], lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def align_epoch_length(spark, sf_dir):
    got = S.align_length(samples(spark, sf_dir), 50)
    return got.select("epoch_idx", "channel", F.size("samples").alias("n"), r6(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("detrend_linear", f"""WITH {LONG}, l AS (SELECT epoch_idx, channel, regr_slope(value, sample_idx) AS b, regr_intercept(value, sample_idx) AS a FROM s GROUP BY ALL)
SELECT epoch_idx, channel, sample_idx::INTEGER AS sample_idx, round(value - a - b * sample_idx, 6) + 0.0 AS value FROM s JOIN l USING (epoch_idx, channel)""")
def detrend_linear(spark, sf_dir):
    got = explode_samples(S.detrend_linear(samples(spark, sf_dir)))
    return got.select("epoch_idx", "channel", "sample_idx", r6("value").alias("value"))


@query("average_reference", f"""WITH {LONG} SELECT epoch_idx, channel, sample_idx::INTEGER AS sample_idx, round(value - avg(value) FILTER (channel <> 'c3') OVER (PARTITION BY epoch_idx, sample_idx), 6) + 0.0 AS value FROM s""")
def average_reference(spark, sf_dir):
    got = S.average_reference(_long(spark, sf_dir), ["epoch_idx", "sample_idx"], use=F.col("channel") != "c3")
    return got.select("epoch_idx", "channel", "sample_idx", r6("value").alias("value"))


@query("decimate", "SELECT vec_id // 4 AS epoch_idx, 'c' || (vec_id % 4) AS channel, round(list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 2 = 0), lambda x: x::DOUBLE)), 6) AS total, 32 AS n FROM embeddings")
def decimate(spark, sf_dir):
    got = S.decimate(samples(spark, sf_dir), 2)
    return got.select("epoch_idx", "channel", r6(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("samples").alias("n"))


@query("resample")
def resample(spark, sf_dir):
    got = S.resample(samples(spark, sf_dir), 32)
    return got.select("epoch_idx", "channel", r6(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("samples").alias("n"))


@query("fir_filter", f"""WITH {LONG} SELECT a.epoch_idx, a.channel, a.sample_idx::INTEGER AS sample_idx, round(sum(b.value) / 3, 6) + 0.0 AS value
FROM s a JOIN s b ON a.epoch_idx = b.epoch_idx AND a.channel = b.channel AND b.sample_idx BETWEEN a.sample_idx - 1 AND a.sample_idx + 1 GROUP BY ALL""")
def fir_filter(spark, sf_dir):
    got = explode_samples(S.fir_filter(samples(spark, sf_dir), [1 / 3, 1 / 3, 1 / 3]))
    return got.select("epoch_idx", "channel", "sample_idx", r6("value").alias("value"))


@query("evoked_average", f"""WITH {LONG} SELECT subject_id, channel, sample_idx::INTEGER AS sample_idx, round(avg(value), 6) + 0.0 AS value, count(*) AS n_epochs FROM s GROUP BY ALL""")
def evoked_average(spark, sf_dir):
    return rounded(S.evoked_average(samples(spark, sf_dir), ["subject_id", "channel"]), "value")


@query("global_field_power", f"""WITH {LONG}, e2 AS (SELECT subject_id, channel, sample_idx, avg(value) AS value FROM s GROUP BY ALL)
SELECT subject_id, sample_idx::INTEGER AS sample_idx, round(stddev_pop(value), 6) AS gfp FROM e2 GROUP BY ALL""")
def global_field_power(spark, sf_dir):
    ev = S.evoked_average(samples(spark, sf_dir), ["subject_id", "channel"])
    return rounded(S.global_field_power(ev, ["subject_id", "sample_idx"]), "gfp")


@query("peak_to_peak_reject", f"""WITH {SAMPLES}, p AS (SELECT subject_id, epoch_idx, sum(CASE WHEN list_max(samples) - list_min(samples) > 0.6 THEN 1 ELSE 0 END)::BIGINT AS n_bad, count(*) AS n_channels FROM e GROUP BY ALL)
SELECT subject_id, epoch_idx, n_bad, n_channels, c::DOUBLE AS consensus, n_bad / n_channels > c AS rejected FROM p, (VALUES (0.0), (0.3), (0.5)) g(c)""")
def peak_to_peak_reject(spark, sf_dir):
    return S.reject_epochs(samples(spark, sf_dir), ["subject_id", "epoch_idx"], 0.6, [0.0, 0.3, 0.5])


@query("adaptive_ptp_threshold")
def adaptive_ptp_threshold(spark, sf_dir):
    return rounded(S.adaptive_threshold(samples(spark, sf_dir), "channel", "epoch_idx", [0.4, 0.5, 0.6, 0.7, 0.8]), "error")


@query("retention_summary", """WITH b AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), a AS (SELECT user_id, count(*) AS n FROM events WHERE value <= 20 GROUP BY 1)
SELECT user_id, b.n AS n_original, coalesce(a.n, 0) AS n_clean, b.n - coalesce(a.n, 0) AS n_rejected, round(coalesce(a.n, 0) / b.n * 100, 6) AS retention FROM b LEFT JOIN a USING (user_id)""")
def retention_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(S.retention_summary(e, e.filter("value <= 20"), ["user_id"]), "retention")


@query("eog_artifact_score", f"""WITH RECURSIVE {LONG}, c AS (SELECT a.subject_id, a.channel, abs(corr(a.value, b.value)) AS score FROM s a JOIN s b USING (epoch_idx, sample_idx) WHERE a.channel <> 'c3' AND b.channel = 'c3' GROUP BY ALL),
it AS (SELECT subject_id, channel, score, 0.0::DOUBLE AS z, false AS flagged, 0 AS k FROM c UNION ALL
  SELECT subject_id, channel, score, x, flagged OR x > 1.2, k + 1 FROM (SELECT *, coalesce((score - avg(score) FILTER (NOT flagged) OVER w) / nullif(stddev_pop(score) FILTER (NOT flagged) OVER w, 0), 0) AS x FROM it WHERE k < 4 WINDOW w AS (PARTITION BY subject_id)))
SELECT subject_id, channel, round(score, 6) AS score, round(z, 4) + 0.0 AS z, flagged FROM it WHERE k = 4""")
def eog_artifact_score(spark, sf_dir):
    got = S.artifact_scores(_long(spark, sf_dir), ["subject_id"], ["epoch_idx", "sample_idx"], "channel", "value", "c3", 1.2)
    return got.withColumns({"score": r6("score"), "z": r6("z", 4)})


@query("eog_regress_out", f"""WITH {LONG}, j AS (SELECT a.subject_id, a.channel, a.epoch_idx, a.sample_idx, a.value, b.value AS eog FROM s a JOIN s b USING (epoch_idx, sample_idx) WHERE a.channel <> 'c3' AND b.channel = 'c3'),
r AS (SELECT subject_id, channel, regr_slope(value, eog) AS beta FROM j GROUP BY ALL)
SELECT epoch_idx, channel, sample_idx::INTEGER AS sample_idx, round(value - beta * eog, 6) + 0.0 AS value FROM j JOIN r USING (subject_id, channel)""")
def eog_regress_out(spark, sf_dir):
    got = S.regress_out(_long(spark, sf_dir), ["subject_id"], ["epoch_idx", "sample_idx"], "channel", "value", "c3")
    return got.select("epoch_idx", "channel", "sample_idx", r6("value").alias("value"))


@query("interpolate_bad_channels", f"""WITH {LONG} SELECT epoch_idx, sample_idx::INTEGER AS sample_idx, channel, round(value, 6) + 0.0 AS value FROM s WHERE channel <> 'c1'
UNION ALL SELECT epoch_idx, sample_idx::INTEGER, 'c1', round((sum(value) FILTER (channel = 'c0') * 2 + sum(value) FILTER (channel = 'c2')) / 3, 6) + 0.0 FROM s GROUP BY epoch_idx, sample_idx HAVING count(*) FILTER (channel IN ('c0', 'c2')) = 2""")
def interpolate_bad_channels(spark, sf_dir):
    """A vector that is missing or short has its samples as nulls, as in the SQL."""
    w = spark.createDataFrame([("c1", "c0", 2.0), ("c1", "c2", 1.0)], "bad string, good string, w double")
    cells = F.arrays_zip(F.sequence(F.lit(0), F.lit(63)).alias("sample_idx"), F.coalesce("samples", F.array().cast("array<double>")).alias("value"))
    long = samples(spark, sf_dir).select("epoch_idx", "channel", F.inline(cells))
    got = S.interpolate_channels(long, ["epoch_idx", "sample_idx"], "channel", "value", w)
    return rounded(got, "value")


@query("validate_epochs", f"""WITH {SAMPLES} SELECT subject_id, count(DISTINCT epoch_idx) AS n_epochs, count(DISTINCT channel) AS n_channels, max(len(samples))::INTEGER AS n_times, max(len(samples)) / 64.0::DOUBLE AS duration, max(len(samples)) = min(len(samples)) AS consistent FROM e GROUP BY 1""")
def validate_epochs(spark, sf_dir):
    return S.validate_epochs(samples(spark, sf_dir), ["subject_id"], "epoch_idx", "channel", 64.0)


@query("psd_periodogram", f"{DFT} SELECT epoch_idx, channel, freq::DOUBLE AS freq, round(power, 9) AS power FROM psd")
def psd_periodogram(spark, sf_dir):
    got = P.bins(P.psd_periodogram(samples(spark, sf_dir), 64.0))
    return got.select("epoch_idx", "channel", "freq", r6("power", 9).alias("power"))


@query("psd_welch", f"""WITH {LONG},
tw AS (SELECT k, n, cos(2 * pi() * k * n / 32) * (0.54 - 0.46 * cos(2 * pi() * n / 32)) AS c, sin(2 * pi() * k * n / 32) * (0.54 - 0.46 * cos(2 * pi() * n / 32)) AS s FROM range(0, 17) x(k), range(0, 32) y(n)),
u AS (SELECT sum((0.54 - 0.46 * cos(2 * pi() * n / 32)) ** 2) AS u FROM range(0, 32) y(n)),
d AS (SELECT epoch_idx, channel, sample_idx // 32 AS seg, k, sum(value * c) AS re, sum(value * tw.s) AS im FROM s JOIN tw ON n = sample_idx % 32 GROUP BY ALL)
SELECT epoch_idx, channel, k * 2.0::DOUBLE AS freq, round(avg((re * re + im * im) / (64 * u) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END), 9) AS power FROM d, u GROUP BY ALL""")
def psd_welch(spark, sf_dir):
    got = P.bins(P.psd_welch(samples(spark, sf_dir), 64.0, segment=32))
    return got.select("epoch_idx", "channel", "freq", r6("power", 9).alias("power"))


@query("psd_multitaper", f"""WITH {LONG},
tw AS (SELECT t, k, n, cos(2 * pi() * k * n / 64) * sqrt(2 / 65.0::DOUBLE) * sin(pi() * t * (n + 1) / 65) AS c, sin(2 * pi() * k * n / 64) * sqrt(2 / 65.0::DOUBLE) * sin(pi() * t * (n + 1) / 65) AS s FROM range(1, 4) z(t), range(0, 33) x(k), range(0, 64) y(n)),
d AS (SELECT epoch_idx, channel, t, k, sum(value * c) AS re, sum(value * tw.s) AS im FROM s JOIN tw ON n = sample_idx GROUP BY ALL)
SELECT epoch_idx, channel, k::DOUBLE AS freq, round(avg((re * re + im * im) / 64 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END), 9) AS power FROM d GROUP BY ALL""")
def psd_multitaper(spark, sf_dir):
    got = P.bins(P.psd_multitaper(samples(spark, sf_dir), 64.0, tapers=3))
    return got.select("epoch_idx", "channel", "freq", r6("power", 9).alias("power"))


def _psd(spark, sf_dir):
    return P.psd_periodogram(samples(spark, sf_dir), 64.0)


@query("band_power_epoch", f"{DFT}, {BANDS_SQL} SELECT subject_id, grp, epoch_idx, band, round(avg(power), 9) AS power FROM psd JOIN b ON freq >= fmin AND freq < fmax GROUP BY ALL")
def band_power_epoch(spark, sf_dir):
    return rounded(P.band_power(_psd(spark, sf_dir), ["subject_id", "grp", "epoch_idx"], BANDS), "power", digits=9)


@query("band_power_closed", f"{DFT}, {BANDS_SQL} SELECT subject_id, epoch_idx, band, round(avg(power), 9) AS power FROM psd JOIN b ON freq >= fmin AND freq <= fmax GROUP BY ALL")
def band_power_closed(spark, sf_dir):
    return rounded(P.band_power(_psd(spark, sf_dir), ["subject_id", "epoch_idx"], BANDS, closed=True), "power", digits=9)


@query("band_power_roi", f"{DFT}, {BANDS_SQL}, r(roi, channel) AS (VALUES ('front', 'c0'), ('front', 'c1'), ('mid', 'c1'), ('mid', 'c2'), ('none', 'c9')) SELECT subject_id, epoch_idx, roi, band, round(avg(power), 9) AS power FROM psd JOIN b ON freq >= fmin AND freq < fmax JOIN r USING (channel) GROUP BY ALL")
def band_power_roi(spark, sf_dir):
    rois = spark.createDataFrame([("front", "c0"), ("front", "c1"), ("mid", "c1"), ("mid", "c2"), ("none", "c9")], "roi string, channel string")
    return rounded(P.roi_band_power(_psd(spark, sf_dir), ["subject_id", "epoch_idx"], BANDS, rois), "power", digits=9)


@query("band_power_channel", f"{DFT}, {BANDS_SQL} SELECT subject_id, epoch_idx, channel, band, round(avg(power), 9) AS power FROM psd JOIN b ON freq >= fmin AND freq < fmax GROUP BY ALL")
def band_power_channel(spark, sf_dir):
    return rounded(P.band_power(_psd(spark, sf_dir), ["subject_id", "epoch_idx", "channel"], BANDS), "power", digits=9)


@query("subject_band_power", f"""{DFT}, {BANDS_SQL}, x AS (SELECT subject_id, epoch_idx, band, avg(power) AS power FROM psd JOIN b ON freq >= fmin AND freq < fmax GROUP BY ALL)
SELECT subject_id, band, round(avg(power), 9) AS power, count(*) AS n_epochs FROM x GROUP BY ALL""")
def subject_band_power(spark, sf_dir):
    per = P.band_power(_psd(spark, sf_dir), ["subject_id", "epoch_idx"], BANDS)
    return rounded(per.groupBy("subject_id", "band").agg(F.avg("power").alias("power"), F.count("*").alias("n_epochs")), "power", digits=9)


@query("snr_spectrum", f"""{DFT}, m AS (SELECT subject_id, freq, avg(power) AS power FROM psd GROUP BY ALL)
SELECT subject_id, freq::DOUBLE AS freq, round(power / ((coalesce(sum(power) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(power) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0)) / (count(power) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) + count(power) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))), 6) AS snr FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY freq)""")
def snr_spectrum(spark, sf_dir):
    m = P.bins(_psd(spark, sf_dir)).groupBy("subject_id", "freq").agg(F.avg("power").alias("power"))
    return P.snr_spectrum(m, ["subject_id"]).select("subject_id", "freq", r6("snr").alias("snr"))


CROSS = f"""{DFT}, {BANDS_SQL},
x AS (SELECT a.subject_id, a.channel AS ch1, b.channel AS ch2, a.freq, a.im * b.re - a.re * b.im AS im FROM d a JOIN d b ON a.epoch_idx = b.epoch_idx AND a.freq = b.freq AND a.channel < b.channel WHERE a.freq BETWEEN 1 AND 30),
y AS (SELECT subject_id, ch1, ch2, freq, sum(im) AS s_im, sum(abs(im)) AS s_abs, sum(sign(im)) AS s_sign, count(*) AS n FROM x GROUP BY ALL)"""


def _cross(spark, sf_dir):
    return P.cross_spectra(samples(spark, sf_dir), ["subject_id"], "epoch_idx", "channel", 64.0, 1.0, 30.0)


@query("wpli_connectivity", f"{CROSS} SELECT subject_id, band AS freq_band, ch1, ch2, round(avg(abs(s_im) / s_abs), 6) AS weight FROM y JOIN b ON freq >= fmin AND freq <= fmax GROUP BY ALL")
def wpli_connectivity(spark, sf_dir):
    return rounded(P.wpli(_cross(spark, sf_dir), ["subject_id"], BANDS), "weight")


@query("pli_connectivity", f"{CROSS} SELECT subject_id, band AS freq_band, ch1, ch2, round(avg(abs(s_sign) / n), 6) AS weight FROM y JOIN b ON freq >= fmin AND freq <= fmax GROUP BY ALL")
def pli_connectivity(spark, sf_dir):
    return rounded(P.pli(_cross(spark, sf_dir), ["subject_id"], BANDS), "weight")


@query("channel_pair_join", f"""WITH {LONG} SELECT a.subject_id, a.channel AS ch1, b.channel AS ch2, round(corr(a.value, b.value), 6) AS r FROM s a JOIN s b USING (epoch_idx, sample_idx) WHERE a.channel < b.channel GROUP BY ALL""")
def channel_pair_join(spark, sf_dir):
    s = _long(spark, sf_dir)
    a = s.select("subject_id", "epoch_idx", "sample_idx", F.col("channel").alias("ch1"), F.col("value").alias("x"))
    b = s.select("epoch_idx", "sample_idx", F.col("channel").alias("ch2"), F.col("value").alias("y"))
    return a.join(b, ["epoch_idx", "sample_idx"]).filter("ch1 < ch2").groupBy("subject_id", "ch1", "ch2").agg(r6(F.corr("x", "y")).alias("r"))
