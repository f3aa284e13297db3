"""Classification with cross-validation on subject-by-feature tables, by Spark's own estimators, and permutation tests."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.functions.scratch import written
from wavecohort.operators.permute import add_up, blocks, digests, label_cuts, labels


def pca_scores(df: DataFrame, features: str, k: int) -> tuple[DataFrame, list[float]]:
    """``scores`` of the first ``k`` principal components of the standardised array column, and the share of variance of
    each."""
    v = df.withColumn("__v", array_to_vector(features))
    model = Pipeline(stages=[StandardScaler(inputCol="__v", outputCol="__s", withMean=True), PCA(inputCol="__s", outputCol="__p", k=k)]).fit(v)
    got = model.transform(v).withColumn("scores", vector_to_array("__p")).drop("__v", "__s", "__p")
    return got, [float(x) for x in model.stages[-1].explainedVariance]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight`` = n / (classes * n of the class) on every row."""
    per = df.groupBy(label).agg(F.count("*").alias("__c"))  # a row for each class
    whole = per.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return df.join(F.broadcast(per.crossJoin(F.broadcast(whole))), label).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def cv_classify(df: DataFrame, features: str, label: str, fold: str, folds: int, model: str = "svc", k: int | None = None) -> DataFrame:
    """Every row with ``predicted``, by the model of the folds that the row is not in. Scaler, components and classifier
    are fitted on the training folds alone. ``label`` is 0 or 1; ``folds`` is a setting of a few."""
    rows = df.withColumn("__v", array_to_vector(features)).withColumn("__y", F.col(label).cast("double"))
    out = None
    for i in range(folds):
        stages = [StandardScaler(inputCol="__v", outputCol="__s", withMean=True)]
        if k:
            stages.append(PCA(inputCol="__s", outputCol="__p", k=k))
        kind = LinearSVC if model == "svc" else LogisticRegression
        stages.append(kind(featuresCol="__p" if k else "__s", labelCol="__y", weightCol="weight", maxIter=30, regParam=0.01))
        fitted = Pipeline(stages=stages).fit(class_weights(rows.filter(F.col(fold) != i), "__y"))
        part = fitted.transform(rows.filter(F.col(fold) == i)).select(*df.columns, F.col("prediction").cast("int").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("truth"), F.col(predicted).alias("guess")).agg(F.count("*").alias("n"))


def accuracies(df: DataFrame, label: str, predicted: str, fold: str) -> DataFrame:
    """``accuracy, accuracy_sd, balanced, balanced_sd``: means and population deviations over folds; balanced is the mean
    recall of the classes."""
    hit = (F.col(label) == F.col(predicted)).cast("double")
    per = df.groupBy(fold, label).agg(F.avg(hit).alias("recall"), F.count("*").alias("n"), F.sum(hit).alias("hits"))
    per = per.groupBy(fold).agg((F.sum("hits") / F.sum("n")).alias("acc"), F.avg("recall").alias("bal"))
    return per.agg(F.avg("acc").alias("accuracy"), F.stddev_pop("acc").alias("accuracy_sd"), F.avg("bal").alias("balanced"), F.stddev_pop("bal").alias("balanced_sd"))


#: Features of the discriminant at most (their products are a matrix in each task), and MB of its coefficients for the
#: permutations that are judged at once.
MAX_FEATURES, COEFFICIENTS_MB = 1000, 16


@dataclass
class _Folds:
    """What the features alone decide, for the rows outside each fold: their number, mean, scale, and the Cholesky factor
    of the standardised covariance plus ``ridge``. Every shuffle of the labels shares it."""

    n: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    factor: np.ndarray
    shift: np.ndarray

    def discriminants(self, ones: np.ndarray, sums: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and thresholds of discriminants with equal priors, from the number of rows of class 1 and the sums
        of their features (fold, shuffle, feature). ``total``: sums of all rows. A fold whose training rows are of one
        class says that class."""
        n, zeros = self.n[:, None], self.n[:, None] - ones
        one, zero = np.maximum(ones, 1)[..., None], np.maximum(zeros, 1)[..., None]
        m1, m0 = sums / one, (total[:, None, :] - sums) / zero
        gap = ((m1 - m0) / self.scale[:, None, :]).transpose(0, 2, 1)
        half = np.linalg.solve(self.factor, gap)
        w = np.linalg.solve(self.factor.transpose(0, 2, 1), half).transpose(0, 2, 1) / self.scale[:, None, :]
        cut = np.einsum("fpd,fpd->fp", w, m1 + m0) / 2
        single = (ones == 0) | (ones == n)
        return np.where(single[..., None], 0.0, w), np.where(single, np.where(ones == 0, np.inf, -np.inf), cut)


def _arrays(f: pd.DataFrame, shift: np.ndarray | None = None) -> np.ndarray:
    x = np.array(f["x"].tolist(), float).reshape(len(f), -1)
    return x if shift is None else x - shift


def _prepared(rows: DataFrame, folds: list, ridge: float) -> tuple[_Folds, np.ndarray]:
    """The shared part of all fits, and the features' sums over the rows outside each fold."""
    d = rows.agg(F.max(F.size("x")).alias("d")).first()["d"]
    if d > MAX_FEATURES:
        raise ValueError(f"{d} features: more than {MAX_FEATURES}; reduce them first, as by pca_scores")
    place = {v: i for i, v in enumerate(folds)}

    def sums(shift):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, s, a = np.zeros(len(folds)), np.zeros((len(folds), d)), np.zeros((len(folds), d, d))
            for f in frames:
                x, at = _arrays(f, shift), f["f"].map(place).to_numpy()
                for i in np.unique(at):
                    own = x[at == i]
                    n[i] += len(own)
                    s[i] += own.sum(axis=0)
                    if shift is not None:
                        a[i] += own.T @ own
            yield pd.DataFrame({"v": [np.concatenate([n, s.ravel(), a.ravel() if shift is not None else []]).tobytes()]})

        got = add_up(rows.mapInPandas(run, "v binary"), [], ["v"]).first()["v"]
        return np.frombuffer(bytes(got), float)

    k = len(folds)
    first = sums(None)
    shift = first[k:].reshape(k, d).sum(axis=0) / first[:k].sum()
    v = sums(shift)
    n, s, a = v[:k], v[k : k + k * d].reshape(k, d), v[k + k * d :].reshape(k, d, d)
    n, s, a = n.sum() - n, s.sum(axis=0) - s, a.sum(axis=0) - a  # outside each fold
    size = np.maximum(n, 1)[:, None]
    mean = s / size
    cov = a / size[..., None] - mean[:, :, None] * mean[:, None, :]
    var = np.einsum("fii->fi", cov)
    scale = np.where(var > 1e-12 * (1 + mean**2), np.sqrt(np.maximum(var, 0)), 1.0)
    z = cov / (scale[:, :, None] * scale[:, None, :]) + ridge * np.eye(d)
    return _Folds(n, mean, scale, np.linalg.cholesky(z), shift), s


def _discriminant_rows(df: DataFrame, features: str, label: str, fold: str, row: str) -> DataFrame:
    rows = df.select(F.col(row).cast("string").alias("__id"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), F.col(fold).alias("f"))
    return written(rows.filter("x IS NOT NULL AND y IN (0, 1) AND f IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v))"), "labelled")


def permutation_accuracy(df: DataFrame, features: str, label: str, fold: str, row: str, n_perms: int, seed: int = 42, ridge: float = 0.1) -> DataFrame:
    """``perm, accuracy, balanced`` (perm -1: the true labels) of a cross-validated linear discriminant under shuffles of
    the labels by the md5 of (seed, permutation, row): class 1 goes to as many rows as have it.

    The discriminant has equal priors: coefficients are (C + ``ridge``)^-1 times the difference of the class means, C the
    covariance of the training rows' standardised features; the threshold is midway between the means. C does not depend on
    labels, so every shuffle shares its factor for each fold. A shuffle only changes the sums of class 1: tasks add these
    up where rows are, as a product of labels and features, coefficients come back for a block of shuffles, and each task
    judges its rows by all of them. No task holds the table. Rows with a null label, fold or feature have no part;
    ``balanced`` is the mean recall of both classes. ``row`` tells rows apart.
    """
    spark = df.sparkSession
    rows = _discriminant_rows(df, features, label, fold, row)
    whole = rows.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    schema = "perm int, accuracy double, balanced double"
    if not whole["n"] or whole["n1"] in (0, whole["n"]):
        return spark.createDataFrame([], schema)
    n, n1 = whole["n"], int(whole["n1"])
    folds = sorted(r["f"] for r in rows.select("f").distinct().collect())  # a setting of a few
    shared, total = _prepared(rows, folds, ridge)
    cuts = label_cuts(rows, [], "__id", {(): (n, n1)}, n_perms, seed)[()] if n_perms else None
    place, k, d = {v: i for i, v in enumerate(folds)}, len(folds), len(shared.shift)
    at_once = max(1, int(COEFFICIENTS_MB * 2**20 / (8 * k * (d + 1))))

    def labelled(f: pd.DataFrame, perms: range) -> Iterator[tuple[range, np.ndarray]]:
        """Labels (shuffle, row) of a batch, some shuffles at a time."""
        if perms.start < 0:
            yield range(0, 1), f["y"].to_numpy(float)[None, :]
            return
        ids = [x.encode() for x in f["__id"]]
        for some in blocks(len(perms)):
            real = range(perms.start + some.start, perms.start + some.stop)
            hi, lo = digests(seed, real, ids)
            yield some, labels(hi, lo, cuts, real)

    def class_sums(perms: range):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((k, len(perms), d + 1))
            for f in frames:
                x, at = np.c_[np.ones(len(f)), _arrays(f, shared.shift)], f["f"].map(place).to_numpy()
                for some, y in labelled(f, perms):
                    for i in np.unique(at):
                        out[i, some.start : some.stop] += y[:, at == i] @ x[at == i]
            yield pd.DataFrame({"v": [out.tobytes()]})

        return run

    def judged(perms: range, w: np.ndarray, cut: np.ndarray):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hits = np.zeros((2, len(perms)))
            for f in frames:
                x, at = _arrays(f, shared.shift), f["f"].map(place).to_numpy()
                for some, y in labelled(f, perms):
                    for i in np.unique(at):
                        guess = x[at == i] @ w[i, some.start : some.stop].T > cut[i, some.start : some.stop]
                        true = y[:, at == i].T > 0
                        hits[0, some.start : some.stop] += (guess & true).sum(axis=0)
                        hits[1, some.start : some.stop] += (~guess & ~true).sum(axis=0)
            yield pd.DataFrame({"perm": np.arange(perms.start, perms.stop, dtype=np.int32), "h1": hits[0], "h0": hits[1]})

        return run

    out = None
    for perms in [range(-1, 0), *(range(i, min(n_perms, i + at_once)) for i in range(0, n_perms, at_once))]:
        sums = np.frombuffer(bytes(add_up(rows.mapInPandas(class_sums(perms), "v binary"), [], ["v"]).first()["v"]), float).reshape(k, len(perms), d + 1)
        sums = sums.sum(axis=0) - sums
        w, cut = shared.discriminants(sums[:, :, 0], sums[:, :, 1:], total)
        one = rows.mapInPandas(judged(perms, w, cut), "perm int, h1 double, h0 double").groupBy("perm").agg(F.sum("h1").alias("h1"), F.sum("h0").alias("h0"))
        out = one if out is None else out.unionByName(one)
    return out.select("perm", ((F.col("h1") + F.col("h0")) / n).alias("accuracy"), ((F.col("h1") / n1 + F.col("h0") / (n - n1)) / 2).alias("balanced"))


def permutation_p(null: DataFrame) -> DataFrame:
    """``accuracy, balanced, n_perms, p, p_balanced``: p = (#{shuffled >= true} + 1) / (n + 1)."""
    true = null.filter("perm = -1").select(F.col("accuracy").alias("a"), F.col("balanced").alias("b"))
    got = null.filter("perm >= 0").crossJoin(F.broadcast(true)).groupBy("a", "b")  # one row
    share = lambda x, y: ((F.count_if(F.col(x) >= F.col(y)) + 1) / (F.count("*") + 1))
    return got.agg(F.count("*").alias("n_perms"), share("accuracy", "a").alias("p"), share("balanced", "b").alias("p_balanced")).withColumnsRenamed({"a": "accuracy", "b": "balanced"})
