"""Language ID with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 (from a hash of its code point, so that no table of letters is
kept). A letter trigram binds the three vectors, each permuted by its place, by multiplication; a text bundles its
trigrams by addition; a language's prototype bundles the unit vectors of its learnt texts. A text gets the language
whose prototype has the largest cosine with it.

Prototypes are learnt from ``per_language`` texts of each language at most, those of the smallest hashes of their ids;
they are whole texts, and their partial sums are added up by Spark. The model has one vector for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.llm.common import crc_part, inside, mix64, table, unit

DIM = 1024
PER_LANGUAGE = 2000
MAX_LANGUAGES = 2000
#: Unrelated hypervectors have cosines of standard deviation DIM ** -0.5: a best cosine below three of them is chance.
CHANCE = 3 * DIM**-0.5
#: A text of fewer trigrams gives too little evidence to be rejected by its cosine.
EVIDENCE = 30
_CHUNK = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The +1/-1 vector of each code point; 0, the gap between words, is a letter like any other."""
    words = mix64(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIM // 64 + 1, dtype=np.uint64))
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << 21) - 1)
    parts = [codes >> np.uint64(42), (codes >> np.uint64(21)) & low, codes & low]
    out = None
    for turn, part in zip((2, 1, 0), parts, strict=True):
        one, back = np.unique(part, return_inverse=True)
        v = np.roll(letter_vectors(one), turn, axis=1)[back]
        out = v if out is None else out * v
    return out


def bundles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, bundled vector and number of trigrams of every text, in order; long texts are bundled in chunks."""
    rows, size, held = [], 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if size + len(t) > _CHUNK and rows:
            yield from zip(rows, *_bundle(held), strict=True)
            rows, size, held = [], 0, []
        rows.append(i)
        held.append(t)
        size += len(t)
    if rows:
        yield from zip(rows, *_bundle(held), strict=True)


def _bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    total, grams = np.zeros((len(texts), DIM), np.float64), np.zeros(len(texts), np.int64)
    if len(texts) == 1 and len(texts[0]) > _CHUNK:
        for at in range(0, len(texts[0]), _CHUNK):  # two letters on either side belong to both chunks' trigrams
            v, n = _bundle_once([texts[0][max(0, at - 2) : at + _CHUNK]])
            total += v
            grams += n
        return total, grams
    return _bundle_once(texts)


def _bundle_once(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    total, grams = np.zeros((len(texts), DIM), np.float64), np.zeros(len(texts), np.int64)
    lowered = [t.lower() for t in texts]
    code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    code = np.where(_is_letter()[code], code, 0)
    keep = code > 0
    keep[1:] |= code[:-1] > 0  # one gap after each word
    code, doc = code[keep].astype(np.uint64), doc[keep]
    if len(code) < 2:
        return total, grams
    code, doc = np.concatenate([[np.uint64(0)], code]), np.concatenate([doc[:1], doc])
    mid = np.flatnonzero(code[1:-1] > 0) + 1
    tri = (code[mid - 1] << np.uint64(42)) | (code[mid] << np.uint64(21)) | code[mid + 1]
    kinds, back = np.unique(tri, return_inverse=True)
    cell, count = np.unique(doc[mid] * len(kinds) + back, return_counts=True)
    row, kind = cell // len(kinds), cell % len(kinds)
    present, first = np.unique(row, return_index=True)
    bounds = [*first, len(row)]
    vectors = trigram_vectors(kinds)
    for j, r in enumerate(present):
        part = slice(bounds[j], bounds[j + 1])
        total[r] = count[part].astype(np.float32) @ vectors[kind[part]].astype(np.float32)
        grams[r] = count[part].sum()
    return total, grams


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, v, n in bundles(batch.column("t").to_pylist()):
            if n:
                sums[langs[i]] = sums.get(langs[i], 0) + v / np.linalg.norm(v)
    yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes (unit vectors) by language. Rows with a null language or text have no part; no row gives no prototype.
    More than ``MAX_LANGUAGES`` languages raise an error."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), unit(F.lit("learn"), F.col(id_col)).alias("h"))
    # The hash below which a language has about per_language rows, from its count alone.
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share"))
    if share.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: prototypes of all would not fit a worker")
    picked = rows.join(F.broadcast(share), "lang").filter("h < share").select("lang", "t")
    got = picked.mapInArrow(_partial, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    got = got.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    out = {}
    for r in got.select("lang", "v.x").sort("lang").collect():  # one row for each language, MAX_LANGUAGES at most
        v = np.array(r["x"])
        out[r["lang"]] = v / max(np.linalg.norm(v), 1e-12)
    return out


def _guesses(texts: list[str | None], prototypes: dict[str, np.ndarray]) -> tuple[list[str], list[float], list[int]]:
    """Language, cosine cut to 0..1 and number of trigrams of every text."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names])
    langs, scores, grams = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
    for i, v, n in bundles(texts):
        grams[i] = int(n)
        if n and names:
            cos = matrix @ v / max(np.linalg.norm(v), 1e-12)
            best = int(cos.argmax())
            langs[i], scores[i] = names[best], float(np.clip(cos[best], 0, 1))
    return langs, scores, grams


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``lang_pred`` and ``score``, the cosine cut to 0..1.

    A null text or one without a letter, or any text where nothing was learnt, is ``und`` with score 0. Of languages
    with equal cosines the first in the alphabet wins. Columns of ``docs`` with the two names are replaced.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, _ = _guesses(batch.column(0).to_pylist(), prototypes)
            columns = [batch.column(j + 1) for j in range(len(kept))]
            yield pa.record_batch([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "lang_pred string", "score double"])
    return docs.select(F.col(text_col).alias(inside(docs, "text_")[0]), *[F.col(c) for c in kept]).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_part(doc_id, 4) == 2, F.lit(False))


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray], languages: list[str] | None = None, min_score: float = CHANCE, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of no language (a null text or one without a letter), of another than ``languages``
    (default: all that were learnt), or of ``EVIDENCE`` trigrams or more and a cosine below ``min_score``: a text in a
    script or language that was not learnt. A shorter text is not rejected by its cosine. Rows that stay keep all their
    columns, whatever their names; repeated rows fare alike. Where nothing was learnt, nothing is known of any row: all
    are kept. An empty table gives no row."""
    if not prototypes:
        return docs

    def stays(texts: pa.Array) -> pa.Array:
        rows = zip(*_guesses(texts.to_pylist(), prototypes), strict=True)
        return pa.array([lang != "und" and (languages is None or lang in languages) and (score >= min_score or grams < EVIDENCE) for lang, score, grams in rows], pa.bool_())

    # Workers get the text alone and give back a flag, so that no text goes to Python twice or comes back.
    return docs.filter(F.arrow_udf(stays, "boolean")(F.col(text_col)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    got = predict(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
