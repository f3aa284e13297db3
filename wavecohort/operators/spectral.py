"""Spectra, band powers and connectivity of epochs, one row of ``samples`` for each epoch and channel.

Fourier transforms run on batches of rows, each on its own; what leaves a row is its spectrum or its band means.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.operators.select import range_join, small_side


def _spectra(df: DataFrame, power, samples: str) -> DataFrame:
    """``freq, power`` arrays in place of the samples; rows without samples go."""
    kept = [c for c in df.columns if c != samples]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = f[samples].map(lambda x: 0 if x is None else len(x)).to_numpy()
            for n in np.unique(sizes[sizes > 1]):
                part = f[sizes == n]
                freq, p = power(np.stack(part[samples].to_numpy()).astype(float))
                out = part[kept].copy()
                out["freq"], out["power"] = [freq] * len(part), list(p)
                yield out

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "freq array<double>, power array<double>"])
    return df.mapInPandas(run, schema)


def _one_sided(c: np.ndarray, sfreq: float, norm: float, n: int) -> np.ndarray:
    p = np.abs(c) ** 2 / (sfreq * norm)
    p[..., 1 : (n + 1) // 2] *= 2
    return p


def psd_welch(df: DataFrame, sfreq: float, segment: int = 256, overlap: int = 0, window: str = "hamming", samples: str = "samples") -> DataFrame:
    """Welch's estimate: the mean periodogram of windowed segments. An epoch shorter than a segment is one segment."""

    def power(x: np.ndarray):
        n = min(segment, x.shape[1])
        w = np.hamming(n + 1)[:-1] if window == "hamming" else np.ones(n)
        starts = range(0, x.shape[1] - n + 1, max(1, n - overlap))
        total = sum(_one_sided(np.fft.rfft(x[:, s : s + n] * w, axis=1), sfreq, (w**2).sum(), n) for s in starts)
        return np.fft.rfftfreq(n, 1 / sfreq), total / len(starts)

    return _spectra(df, power, samples)


def psd_periodogram(df: DataFrame, sfreq: float, samples: str = "samples") -> DataFrame:
    return psd_welch(df, sfreq, 1 << 60, 0, "boxcar", samples)


def psd_multitaper(df: DataFrame, sfreq: float, tapers: int = 4, samples: str = "samples") -> DataFrame:
    """The mean over sine tapers, which have a closed form."""

    def power(x: np.ndarray):
        n = x.shape[1]
        i = np.arange(1, n + 1)
        total = 0
        for k in range(1, tapers + 1):
            w = np.sqrt(2 / (n + 1)) * np.sin(np.pi * k * i / (n + 1))
            total = total + _one_sided(np.fft.rfft(x * w, axis=1), sfreq, 1.0, n)
        return np.fft.rfftfreq(n, 1 / sfreq), total / tapers

    return _spectra(df, power, samples)


def bins(psd: DataFrame, fmin: float | None = None, fmax: float | None = None) -> DataFrame:
    """One row for each frequency, of those between the limits."""
    rows = psd.select(*[c for c in psd.columns if c not in ("freq", "power")], F.explode(F.arrays_zip("freq", "power")).alias("z"))
    rows = rows.select(*[c for c in rows.columns if c != "z"], "z.freq", "z.power")
    return rows.filter((F.col("freq") >= (fmin or 0)) & (F.col("freq") <= (fmax if fmax is not None else float("inf"))))


def row_band_power(psd: DataFrame, bands: list[tuple[str, float, float]], closed: bool = False) -> DataFrame:
    """``band, power`` of every row: the mean over the band's bins, made inside the row, so that a row leaves a value for
    each band and not one for each bin."""

    def mean(low: float, high: float):
        inside = F.filter(F.arrays_zip("freq", "power"), lambda z: (z["freq"] >= low) & ((z["freq"] <= high) if closed else (z["freq"] < high)))
        return F.when(F.size(inside) > 0, F.aggregate(inside, F.lit(0.0), lambda a, z: a + z["power"]) / F.size(inside))

    cells = F.array(*[F.struct(F.lit(b).alias("band"), mean(lo, hi).alias("power")) for b, lo, hi in bands])
    rows = psd.select(*[c for c in psd.columns if c not in ("freq", "power")], F.explode(cells).alias("z"))
    return rows.select(*[c for c in rows.columns if c != "z"], "z.band", "z.power").filter(F.col("power").isNotNull())


def band_power(psd: DataFrame, keys: list[str], bands: list[tuple[str, float, float]], closed: bool = False) -> DataFrame:
    """``keys, band, power``: the mean over the rows of the keys. Rows have equal bins, so means of means are means."""
    return row_band_power(psd, bands, closed).groupBy(*keys, "band").agg(F.avg("power").alias("power"))


def roi_band_power(psd: DataFrame, keys: list[str], bands: list[tuple[str, float, float]], rois: DataFrame, channel: str = "channel", closed: bool = False) -> DataFrame:
    """The same for regions, ``rois``: ``roi, channel``, which may overlap and name channels that are not there."""
    rows = row_band_power(psd, bands, closed).join(small_side(rois), channel)
    return rows.groupBy(*keys, "roi", "band").agg(F.avg("power").alias("power"))


def snr_spectrum(psd_rows: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """``snr``: a bin's power over the mean of its ``k`` neighbours on either side."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("freq")  # the bins of one spectrum
    a, b = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    total = F.coalesce(F.sum("power").over(a), F.lit(0.0)) + F.coalesce(F.sum("power").over(b), F.lit(0.0))
    n = F.count("power").over(a) + F.count("power").over(b)
    return psd_rows.withColumn("snr", F.when((n > 0) & (total > 0), F.col("power") / (total / n)))


def cross_spectra(df: DataFrame, keys: list[str], epoch: str, channel: str, sfreq: float, fmin: float, fmax: float, samples: str = "samples") -> DataFrame:
    """``keys, ch1, ch2, freq, s_im, s_abs, s_sign, n``: for each pair of channels (ch1 < ch2) and bin, the sums over
    epochs of the imaginary cross-spectrum, its absolute value and its sign.

    The channels of an epoch meet in one group, a few rows of fixed length; its pairs leave it as sums over no more than
    that epoch, which Spark adds up.
    """
    types = dict(df.dtypes)

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(channel)
        x = np.stack(f[samples].to_numpy()).astype(float)
        names = f[channel].to_numpy()
        freq = np.fft.rfftfreq(x.shape[1], 1 / sfreq)
        at = np.flatnonzero((freq >= fmin) & (freq <= fmax))
        c = np.fft.rfft(x, axis=1)[:, at]
        i, j = np.triu_indices(len(names), 1)
        im = (c[i] * np.conj(c[j])).imag
        n = len(at)
        return pd.DataFrame(
            {k: [v] * (len(i) * n) for k, v in zip([*keys, epoch], key, strict=True) if k in keys}
            | {"ch1": np.repeat(names[i], n), "ch2": np.repeat(names[j], n), "freq": np.tile(freq[at], len(i)), "im": im.ravel()}
        )

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "ch1 string, ch2 string, freq double, im double"])
    rows = df.select(*keys, epoch, channel, samples).groupBy(*keys, epoch).applyInPandas(run, schema)
    return rows.groupBy(*keys, "ch1", "ch2", "freq").agg(F.sum("im").alias("s_im"), F.sum(F.abs("im")).alias("s_abs"), F.sum(F.signum("im")).alias("s_sign"), F.count("*").alias("n"))


def _connectivity(spectra: DataFrame, keys: list[str], bands: list[tuple[str, float, float]], value) -> DataFrame:
    table = spectra.sparkSession.createDataFrame(bands, "freq_band string, fmin double, fmax double")
    rows = range_join(spectra.withColumn("__w", value), table, "freq", closed=True)
    return rows.groupBy(*keys, "freq_band", "ch1", "ch2").agg(F.avg("__w").alias("weight"))


def wpli(spectra: DataFrame, keys: list[str], bands: list[tuple[str, float, float]]) -> DataFrame:
    """``keys, freq_band, ch1, ch2, weight``: the weighted phase lag index, the mean over a band's bins of
    |sum Im S| / sum |Im S|; 0 where nothing is imaginary."""
    return _connectivity(spectra, keys, bands, F.when(F.col("s_abs") > 0, F.abs("s_im") / F.col("s_abs")).otherwise(0.0))


def pli(spectra: DataFrame, keys: list[str], bands: list[tuple[str, float, float]]) -> DataFrame:
    """The phase lag index: |mean sign Im S|."""
    return _connectivity(spectra, keys, bands, F.abs("s_sign") / F.col("n"))
