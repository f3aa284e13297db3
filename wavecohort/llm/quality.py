"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words hashed into ``WORDS`` buckets (square roots of counts, unit length), statistics of its
structure cut into steps, each step a feature, and how the stated ``n_chars`` compares with the text. The score is the
logistic function of ``w0 + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2)``: linear time in the number of features.

The model is fitted on the driver on about ``train_rows`` labelled rows (those of the smallest hashes of their ids),
whose features, not texts, are collected; that bound holds whatever the number of labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.llm.common import crc_part, inside, table, text_buffers, unit, words_of

WORDS = 1 << 15
STEPS = 12
FACTORS = 8
TRAIN_ROWS = 8000
_NEWLINES = np.zeros(256, bool)
_NEWLINES[10] = True
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 end of sentence, 5 comma etc., 6 symbol, 7 new line, 8 other
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[10] = 1, 2, 3, 7
_CLASS[[ord(c) for c in ".?"]], _CLASS[[ord(c) for c in ",;:'\"()-"]] = 4, 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]], _CLASS[128:] = 6, 8
N_STATS = 12
SIZE = WORDS + N_STATS * STEPS


def _stats(col: pa.Array, n_chars: np.ndarray, words_at: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Rows of statistics, each scaled to 0..1."""
    data, offs = text_buffers(col)
    n = len(offs) - 1
    out = np.zeros((n, N_STATS))
    lines, lines_at = words_of(col, _NEWLINES)
    for i in range(n):
        part = _CLASS[data[offs[i] : offs[i + 1]]]
        c = np.bincount(part, minlength=9).astype(float)
        size, letters, words = max(len(part), 1), max(c[1] + c[2] + c[8], 1), max(words_at[i + 1] - words_at[i], 1)
        own = lines[lines_at[i] : lines_at[i + 1]]
        long = c[1:].sum() - c[7]
        told = n_chars[i]
        chars = len(part) - c[8] / 2
        out[i] = [
            np.log1p(len(part)) / 16, c[1] / letters, c[3] / size * 5, c[4] / words * 4, c[5] / words * 2, c[6] / size * 4,
            np.log1p(c[6]) / 10, distinct[i] / words, len(np.unique(own)) / max(len(own), 1), long / words / 16, np.log1p(words / max(len(own), 1)) / 8,
            0.5 if np.isnan(told) else 0.5 + np.clip(np.log((told + 1) / (chars + 1)), -0.5, 0.5),
        ]
    return np.clip(out, 0, 1)


def features(col: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and n+1 offsets of the rows of a string column."""
    words, at = words_of(col)
    told = np.array([np.nan if x is None else float(x) for x in n_chars.to_pylist()])
    slot = (words >> np.uint64(17)).astype(np.int64) % WORDS
    ids, values, distinct, size = [], [], np.zeros(len(at) - 1), np.zeros(len(at) - 1, np.int64)
    for i in range(len(at) - 1):
        distinct[i] = len(np.unique(words[at[i] : at[i + 1]]))
        k, c = np.unique(slot[at[i] : at[i + 1]], return_counts=True)
        v = np.sqrt(c)
        ids.append(k)
        values.append(v / max(np.linalg.norm(v), 1e-9))
    step = np.minimum((_stats(col, told, at, distinct) * STEPS).astype(np.int64), STEPS - 1) + np.arange(N_STATS) * STEPS + WORDS
    for i in range(len(ids)):
        ids[i] = np.concatenate([ids[i], step[i]])
        values[i] = np.concatenate([values[i], np.full(N_STATS, 0.5)])
        size[i] = len(ids[i])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)
    return np.concatenate(ids), np.concatenate(values), np.concatenate([[0], np.cumsum(size)])


class FactorisationMachine:
    """Second-order, fitted by AdaGrad on the logistic loss."""

    def __init__(self, size: int = SIZE, factors: int = FACTORS, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.03, (size, factors))

    def raw(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of v x. Every row has a feature."""
        if len(at) < 2:
            return np.zeros(0), np.zeros((0, self.v.shape[1]))
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, at[:-1], axis=0)
        pair = 0.5 * (s**2 - np.add.reduceat(vx**2, at[:-1], axis=0)).sum(axis=1)
        return self.w0 + np.add.reduceat(self.w[ids] * x, at[:-1]) + pair, s

    def score(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, x, at)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        if not len(y):
            return self
        rng = np.random.default_rng(seed)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.w0 = float(np.log(share / (1 - share)))
        g0, gw, gv = 1e-6, np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for b in range(0, len(y), batch):
                pick = order[b : b + batch]
                ids, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                n = np.array([len(rows[i][0]) for i in pick])
                at = np.concatenate([[0], np.cumsum(n)])
                raw, s = self.raw(ids, x, at)
                err = (1 / (1 + np.exp(-raw)) - y[pick]) / len(pick)
                each = np.repeat(err, n)
                one, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, each * x) + decay * self.w[one]
                grad = (each * x)[:, None] * (np.repeat(s, n, axis=0) - self.v[ids] * x[:, None])
                dv = np.stack([np.bincount(back, grad[:, f]) for f in range(grad.shape[1])], axis=1) + decay * self.v[one]
                gw[one] += dw**2
                gv[one] += dv**2
                g0 += err.sum() ** 2
                self.w[one] -= rate * dw / np.sqrt(gw[one])
                self.v[one] -= rate * 0.3 * dv / np.sqrt(gv[one])
                self.w0 -= rate * 0.1 * err.sum() / np.sqrt(g0)
        return self


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, x, at = features(batch.column("t"), batch.column("c"))
        cut = [(ids[at[i] : at[i + 1]].astype(np.uint16).tobytes(), x[at[i] : at[i + 1]].astype(np.float32).tobytes()) for i in range(batch.num_rows)]
        yield pa.record_batch([pa.array([a for a, _ in cut], pa.binary()), pa.array([b for _, b in cut], pa.binary()), *[batch.column(c) for c in "yuh"]], names=["ids", "x", "y", "u", "h"])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """A model fitted on about ``train_rows`` of the labelled rows. Null labels, ids and texts have no part; an id
    labelled more than once has its largest label; without a labelled row every text gets the same score."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    n = own.count()
    own = own.withColumn("u", unit(F.lit("quality"), F.col("i"))).filter(F.col("u") < F.lit(train_rows / max(n, 1)))
    told = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), told.alias("c"))
    rows = texts.join(F.broadcast(own), "i").select("t", "c", "y", "u", F.xxhash64("t").alias("h"))
    got = rows.mapInArrow(_packed, "ids binary, x binary, y int, u double, h long").orderBy("u", "h").limit(2 * train_rows).toArrow()  # where ids repeat, no more than twice as many
    rows = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(b, np.float32).astype(float)) for a, b in zip(got["ids"].to_pylist(), got["x"].to_pylist(), strict=True)]
    y = np.array(got["y"].to_pylist(), float)
    if len(rows):  # one order, whatever the partitions were
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0].tobytes(), rows[i][1].tobytes(), y[i]))
        rows, y = [rows[i] for i in order], y[order]
    return FactorisationMachine().fit(rows, y)


def score(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``score`` and ``predicted``. A null text is scored as an
    empty one; columns of ``docs`` with the two names are replaced."""
    kept = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    w0, w, v = model.w0, model.w.astype(np.float32), model.v.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = FactorisationMachine(1)
        fm.w0, fm.w, fm.v = w0, w, v
        for batch in batches:
            got = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got.append(fm.score(*features(part.column(0), part.column(1))))
            s = np.concatenate(got) if got else np.zeros(0)
            columns = [batch.column(j + 2) for j in range(len(kept))]
            yield pa.record_batch([*columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*kept, "score", "predicted"])

    told = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "score double", "predicted int"])
    text, chars = inside(docs, "text_", "told")
    return docs.select(F.col(text_col).alias(text), told.alias(chars), *[F.col(c) for c in kept]).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_part(doc_id, 5) == 0, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"))))
    got = score(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
