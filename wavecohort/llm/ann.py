"""Approximate nearest neighbours by Euclidean distance: inverted lists and an adaptive dimension scan.

The index: vectors are dealt to the nearest of a number of centres, which are fitted on a sample of at most ``SAMPLE``
rows; every row is indexed. A list is cut into blocks of about ``BLOCK`` rows by a hash, so that a vector that a third of
all rows repeat fills many blocks of the usual size. A block is one written row: ids, the vectors turned by one random
rotation and stored column by column (a component of all rows together), and the original vectors.

A search probes each query's nearest lists. How many is read off the sample: as many as hold ``recall`` of the sample's own
nearest neighbours of ``JUDGES`` of its rows, which lie further off than those in the whole table. The nearest list comes
first, and the kth distance in it is the query's first limit in all others. Within a block the columns are read
``STEP`` at a time. After d of D components the partial squared distance, times D / d, is an estimate of the whole; a
candidate whose estimate passes limit * (1 + EPSILON / sqrt(d)) ** 2 is abandoned: by the rotation, the chance that it is
a neighbour falls exponentially with EPSILON squared. Those that stay to the last column get their distance from the
original vectors, in double precision. The limit falls as a block is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecohort.functions.scratch import written
from wavecohort.llm.common import inside, table, unit

#: Rows that centres and the number of probes are fitted on, at most; and rows for each centre at least.
SAMPLE, PER_CENTRE, ROUNDS = 16_384, 16, 10
JUDGES = 400
BLOCK, QUERY_BLOCK = 4096, 512
STEP, EPSILON, AT_ONCE = 16, 2.1, 1024


def rotation(d: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :], 0)


def centres_of(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Centres by k-means on rows; one that no row is nearest to stays where it is."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        near = squared(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """How many nearest lists hold ``recall`` of the ``k`` nearest rows of some rows of ``x``."""
    asked = x[: min(JUDGES, len(x))]
    d = squared(asked, x)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, : min(k, len(x) - 1)]
    if not near.size:
        return len(c)
    of_row = squared(x, c).argmin(axis=1)
    place = squared(asked, c).argsort(axis=1).argsort(axis=1)
    need = np.sort(np.take_along_axis(place, of_row[near], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def scan(query: np.ndarray, turned: np.ndarray, columns: np.ndarray, rows: np.ndarray, limit: float, k: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and squared distances of at least the ``k`` nearest rows of a block, those beyond ``limit`` or
    abandoned left out. ``mine``: rows that are the query itself."""
    d = len(columns)
    at, dist = np.zeros(0, np.int64), np.zeros(0)
    for begin in range(0, columns.shape[1], AT_ONCE):
        alive = np.flatnonzero(~mine[begin : begin + AT_ONCE]) + begin
        part = np.zeros(len(alive), np.float32)
        for j in range(0, d, STEP):
            e = min(j + STEP, d)
            block = columns[j:e, begin : begin + AT_ONCE] if len(alive) == AT_ONCE else columns[j:e][:, alive]
            part = part + ((block - turned[j:e, None]) ** 2).sum(axis=0)
            if np.isfinite(limit) and e < d:
                stay = part <= limit * (e / d) * (1 + EPSILON / e**0.5) ** 2
                alive, part = alive[stay], part[stay]
            if not len(alive):
                break
        alive = alive[part <= limit * 1.0001] if np.isfinite(limit) else alive
        exact = ((rows[alive] - query) ** 2).sum(axis=1)
        stay = exact <= limit
        at, dist = np.r_[at, alive[stay]], np.r_[dist, exact[stay]]
        if len(at) >= k:
            limit = min(limit, float(np.partition(dist, k - 1)[k - 1]))
    return at, dist


def usable(vectors: DataFrame, id_col: str, vector_col: str, asked: str) -> DataFrame:
    """``id, x, asked`` of rows with an id and a vector of finite numbers that are not all 0."""
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("x"), F.col(asked).alias("asked"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return rows.filter(finite & F.exists("x", lambda e: e != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _pack(turn: np.ndarray):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f["x"])
        columns = np.ascontiguousarray((x @ turn.T).T.astype("<f4"))
        return pd.DataFrame({"list": [key[0]], "part": [key[1]], "ids": [f["id"].to_numpy("<i8").tobytes()], "columns": [columns.tobytes()], "rows": [x.astype("<f8").tobytes()]})

    return run


def _pack_queries(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"list": [key[0]], "q_ids": [f["id"].to_numpy("<i8").tobytes()], "q": [_matrix(f["x"]).astype("<f8").tobytes()], "limits": [f["limit"].to_numpy("<f8").tobytes()]})


def _scan_pairs(turn: np.ndarray, k: int):
    d = len(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)  # noqa: B023, E731
                ids, columns, rows = get("ids", "<i8"), get("columns", "<f4").reshape(d, -1), get("rows", "<f8").reshape(-1, d)
                q_ids, q, limits = get("q_ids", "<i8"), get("q", "<f8").reshape(-1, d), get("limits", "<f8")
                turned = (q @ turn.T).astype(np.float32)
                out: list[list[np.ndarray]] = [[], [], []]
                for i in range(len(q)):
                    at, dist = scan(q[i], turned[i], columns, rows, limits[i], k, ids == q_ids[i])
                    order = np.lexsort((ids[at], dist))[:k]
                    for o, v in zip(out, (np.full(len(order), q_ids[i]), ids[at[order]], np.sqrt(dist[order])), strict=True):
                        o.append(v)
                yield pa.record_batch([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    return run


def _searched(queries: DataFrame, blocks: DataFrame, parts: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the nearest of each probed block. ``queries``: ``list, id, x, limit``, a row a probe."""
    dealt = queries.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("n"))
    dealt = queries.join(F.broadcast(dealt), "list").withColumn("qp", F.pmod(F.xxhash64("id", "x"), F.col("n")))  # a row a list
    packed = dealt.groupBy("list", "qp").applyInPandas(_pack_queries, "list int, q_ids binary, q binary, limits binary")
    packed = packed.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = blocks.join(packed, ["list", "part"]).select("ids", "columns", "rows", "q_ids", "q", "limits")
    return pairs.mapInArrow(_scan_pairs(turn, k), "query_id long, vec_id long, score double")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the ``k`` nearest rows found among those of
    another id, by Euclidean distance in double precision; ties go to the smaller id.

    Rows without an id, or whose vector is null, empty, zero or holds a null or non-finite component, take no part. A
    shorter vector is taken with zeros at its end. Rows that repeat an id are candidates each; as queries they share one
    ranking. If fewer than ``k`` candidates lie in the probed lists, the query is searched in all. No query, or no row,
    gives no row.
    """
    spark = vectors.sparkSession
    asked = inside(vectors, "asked")[0]
    rows = written(usable(vectors.withColumn(asked, F.coalesce(is_query, F.lit(False))), id_col, vector_col, asked), "vectors")
    held = rows.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    if not held["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(held["d"]) - F.size("x"))))
    drawn = unit(F.lit("sample"), F.col("id"))
    sample = rows.filter(drawn <= F.lit(min(1.0, 2 * SAMPLE / held["n"]))).orderBy(drawn, "id", "x").limit(SAMPLE).select("x").toPandas()
    known = _matrix(sample["x"]) if len(sample) else np.zeros((1, held["d"]))
    centres = centres_of(known, int(min(max(1, held["n"] ** 0.5), max(1, len(known) // PER_CENTRE))))
    probes, turn = probes_for(known, centres, k, recall), rotation(held["d"])

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            near = squared(_matrix(f["x"]), centres).argmin(axis=1) if len(f) else []
            yield f.assign(list=np.asarray(near, np.int32))[["list", "id", "x"]]

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            order = squared(_matrix(f["x"]), centres).argsort(axis=1) if len(f) else np.zeros((0, 1))
            yield f.assign(lists=[o.astype(np.int32) for o in order])[["id", "x", "lists"]]

    listed = written(rows.select("id", "x").mapInPandas(deal, "list int, id long, x array<double>"), "listed")
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # a row for each centre
    cut = listed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts")).cast("int"))
    blocks = written(cut.groupBy("list", "part").applyInPandas(_pack(turn), "list int, part int, ids binary, columns binary, rows binary"), "blocks")
    queries = written(rows.filter("asked").select("id", "x").mapInPandas(probe, "id long, x array<double>, lists array<int>"), "queries")

    def step(lists: Column, limits: DataFrame | None) -> DataFrame:
        q = queries if limits is None else queries.join(limits, queries["id"] == limits["query_id"], "left")
        limit = F.lit(float("inf")) if limits is None else F.coalesce("limit", F.lit(float("inf")))
        return _searched(q.select(F.explode(lists).alias("list"), "id", "x", limit.alias("limit")), blocks, parts, turn, k)

    def kth(found: DataFrame) -> DataFrame:
        """Squared distance of the kth, a hair more for rounding."""
        return found.filter(F.col("rank") == k).select("query_id", (F.col("score") * F.col("score") * (1 + 1e-12)).alias("limit"))

    near = written(_first(step(F.slice("lists", 1, 1), None), k), "nearest-lists")
    found = near.drop("rank")
    if probes > 1:
        found = found.unionByName(step(F.slice("lists", 2, probes - 1), kth(near)))
    found = written(_first(found, k), "probed")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    if probes < len(centres) and held["n"] > k:
        short = queries.join(full, "id", "left_anti").select(F.explode(F.slice("lists", probes + 1, len(centres))).alias("list"), "id", "x", F.lit(float("inf")).alias("limit"))
        found = _first(found.drop("rank").unionByName(_searched(short, blocks, parts, turn, k)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
