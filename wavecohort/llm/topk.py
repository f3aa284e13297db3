"""Exact top-k inner-product search with dual cover trees.

Vectors are dealt into cells by their nearest pivot and each cell into blocks of at most ``BLOCK`` rows by a hash, so
that a vector that a third of all rows repeat fills many blocks of the usual size. Queries are dealt by a hash into
blocks of about ``QUERY_BLOCK``, so that a data block is sent about once for as many queries. A pair of a query block and a data block is searched only if its bound, from the
blocks' centres and covering radii, reaches the worst kth score that the queries of the block are already sure of
(from a fixed sample of the data). In each pair that is left, one task builds a cover tree over both sides and walks
the two trees together: a pair of nodes is pruned when its bound is below the worst kth score of the query node's
queries. Nothing but exact integer scores decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecohort.functions.scratch import written
from wavecohort.llm.common import inside, table, unit

SCALE = 1024
PIVOTS = 16
SAMPLE = 1024
BLOCK, QUERY_BLOCK, LEAF, QUERY_LEAF, WIDE = 4096, 2048, 256, 64, 32
#: Summaries of query blocks (a vector each) that are broadcast; more meet the data blocks without.
MAX_BROADCAST_BLOCKS = 20_000
#: No score.
NONE = np.iinfo(np.int64).min


class CoverTree:
    """Nodes of points within a radius of a centre, a point of the set; a child's radius is half its parent's at most.
    A node of ``leaf`` points or fewer, or one that ``WIDE`` such children do not cover, is a leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.points: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.root = self._node(np.arange(len(x))) if len(x) else -1

    def _node(self, own: np.ndarray) -> int:
        k = len(self.centre)
        part = self.x[own]
        centre = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmin()]
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        radius = float(away.max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.points.append(None)
        self.children.append([])
        seeds, near, label = 1, away.copy(), np.zeros(len(own), np.int64)
        while len(own) > self.leaf and near.max() > radius / 2 and seeds < WIDE:
            d = np.sqrt(((part - part[int(near.argmax())]) ** 2).sum(axis=1))
            label[d < near] = seeds
            near = np.minimum(near, d)
            seeds += 1
        if len(own) <= self.leaf or radius == 0 or near.max() > radius / 2:
            self.points[k] = own
            return k
        for s in range(seeds):
            if (label == s).any():
                self.children[k].append(self._node(own[label == s]))
        return k


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: as floats where no partial sum can reach 2**53, else in 64-bit
    integers. Raises an error where a sum may pass 2**63."""
    most = float(np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((b.astype(float) ** 2).sum(axis=1).max(initial=0)))
    if most < 2.0**52:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most > 2.0**62:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    return a @ b.T


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the k best of ``data`` for each query (fewer if there are fewer), without rows
    of the query's own id; ties go to the smaller id. ``floor``: scores that the kth best is known to reach."""
    nq = len(queries)
    best = np.full((nq, k), NONE)
    ids = np.full((nq, k), np.iinfo(np.int64).max)
    qt, dt = CoverTree(queries.astype(float), QUERY_LEAF), CoverTree(data.astype(float))
    worst = floor.copy()
    under: dict[int, np.ndarray] = {}

    def rows(n: int) -> np.ndarray:
        if n not in under:
            under[n] = qt.points[n] if qt.points[n] is not None else np.concatenate([rows(c) for c in qt.children[n]])
        return under[n]

    def bound(a: int, b: int) -> float:
        ca, cb, ra, rb = qt.centre[a], dt.centre[b], qt.radius[a], dt.radius[b]
        na, nb = float(np.sqrt(ca @ ca)), float(np.sqrt(cb @ cb))
        return float(ca @ cb) + ra * nb + rb * na + ra * rb + 1e-9 * (na + ra) * (nb + rb) + 1  # rounding is far below

    stack = [(bound(qt.root, dt.root), qt.root, dt.root)] if nq and len(data) else []
    while stack:
        top, a, b = stack.pop()
        if top < worst[rows(a)].min():
            continue
        qa, db = qt.points[a], dt.points[b]
        if qa is not None and db is not None:
            s = products(queries[qa], data[db])
            r, c = np.nonzero((s >= worst[qa][:, None]) & (query_ids[qa][:, None] != data_ids[db][None, :]))
            if not len(r):
                continue
            old_r, old_c = np.nonzero(best[qa] > NONE)
            all_r = np.concatenate([old_r, r])
            all_s, all_i = np.concatenate([best[qa][old_r, old_c], s[r, c]]), np.concatenate([ids[qa][old_r, old_c], data_ids[db][c]])
            order = np.lexsort((all_i, -all_s, all_r))
            all_r, all_s, all_i = all_r[order], all_s[order], all_i[order]
            place = np.arange(len(all_r)) - np.searchsorted(all_r, all_r)
            keep = place < k
            best[qa[all_r[keep]], place[keep]], ids[qa[all_r[keep]], place[keep]] = all_s[keep], all_i[keep]
            worst[qa] = np.maximum(worst[qa], best[qa][:, -1])
            continue
        if db is None and (qa is not None or dt.radius[b] >= qt.radius[a]):
            pairs = [(a, c) for c in dt.children[b]]
        else:
            pairs = [(c, b) for c in qt.children[a]]
        stack += sorted(((bound(x, y), x, y) for x, y in pairs), key=lambda p: p[0])  # the most promising is popped first
    row, col = np.nonzero(best > NONE)
    return row, ids[row, col], best[row, col]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, asked: str) -> DataFrame:
    """``id, x, asked``: each component x as floor(1024 * x). Vectors that are null, empty, of null or of non-finite
    components, or without an id, are left out."""
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.col(asked).alias("asked"))
    return rows.filter((F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))).select(
        "id", F.transform("v", lambda e: F.floor(e * SCALE).cast("long")).alias("x"), "asked"
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _celled(rows: DataFrame, pivots: np.ndarray, most: int) -> DataFrame:
    """``id, x, block``: a block of about ``most`` rows at most among those with the same nearest pivot."""
    pivots = pivots.astype(float)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = np.zeros(0, np.int32)
            if len(f):
                cell = ((pivots**2).sum(axis=1)[None, :] - 2 * _matrix(f["x"]).astype(float) @ pivots.T).argmin(axis=1).astype(np.int32)
            yield f.assign(cell=cell)[["id", "x", "cell"]]

    celled = written(rows.mapInPandas(near, "id long, x array<long>, cell int"), "cells")
    size = celled.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))  # a row for each pivot
    dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts"))  # rows that repeat an id spread, too
    return celled.join(F.broadcast(size), "cell").select("id", "x", F.concat_ws("-", "cell", dealt).alias("block"))


def _balls(side: DataFrame) -> DataFrame:
    """``block, centre, radius, low``: one row for each block of about 4096 rows at most; written."""

    def ball(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f["x"]).astype(float)
        centre = x.mean(axis=0)
        return pd.DataFrame({"block": [key[0]], "centre": [centre], "radius": [float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))], "low": [f["low"].min()]})

    return written(side.groupBy("block").applyInPandas(ball, "block string, centre array<double>, radius double, low long"), "block-balls")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where the condition ``is_query`` holds, the ``k`` highest integer
    inner products with all rows of another id, fewer if there are fewer; ties go to the smaller id.

    Rows without a usable vector (see :func:`quantised`) are neither queries nor candidates. A shorter vector is taken
    with zeros at its end. Rows that repeat an id are candidates each; as queries they share one ranking, that of their
    scores together. No query, or no row, gives no row. Components so large that a score may pass 2**62 raise an error.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors.withColumn(inside(vectors, "asked")[0], F.coalesce(is_query, F.lit(False))), id_col, vector_col, inside(vectors, "asked")[0])
    rows = written(rows, "vectors")
    found = rows.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not found["q"]:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(found["d"]) - F.size("x"))))
    share = SAMPLE * 4 / found["n"]
    sample = rows.filter(unit(F.lit("pivot"), F.col("id")) < F.lit(share)).orderBy(unit(F.lit("pivot"), F.col("id")), "id", "x").limit(SAMPLE).toPandas()
    if not len(sample):
        sample = rows.orderBy("id", "x").limit(1).toPandas()
    known, known_ids = _matrix(sample["x"]), sample["id"].to_numpy()
    data = written(_celled(rows.select("id", "x"), known[:PIVOTS], BLOCK).withColumn("low", F.lit(0).cast("long")), "data-blocks")
    queries = rows.filter("asked").withColumn("block", F.concat(F.lit("q"), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(-(-found["q"] // QUERY_BLOCK))).cast("string")))

    def floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            low = np.zeros(0, np.int64)
            if len(f):
                s = products(_matrix(f["x"]), known)
                s[f["id"].to_numpy()[:, None] == known_ids[None, :]] = NONE
                low = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(f), NONE)
            yield f.assign(low=low)[["id", "x", "block", "low"]]

    queries = written(queries.mapInPandas(floors, "id long, x array<long>, block string, low long"), "query-blocks")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, e: s + e)
    norm = lambda a: F.sqrt(dot(a, a))
    q = _balls(queries).select(F.col("block").alias("qb"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), norm("centre").alias("qn"), "low")
    d = _balls(data).select(F.col("block").alias("db"), F.col("centre").alias("dc"), F.col("radius").alias("dr"), norm("centre").alias("dn"))
    # Blocks of the stated query set against blocks of all rows: one row for each block on either side.
    reach = dot("qc", "dc") + F.col("qr") * F.col("dn") + F.col("dr") * F.col("qn") + F.col("qr") * F.col("dr")
    slack = (F.col("qn") + F.col("qr")) * (F.col("dn") + F.col("dr")) * 1e-9 + 1
    q = F.broadcast(q) if q.count() <= MAX_BROADCAST_BLOCKS else q
    pairs = written(d.join(q, reach + slack >= F.col("low")).select("qb", "db"), "block-pairs")
    left = queries.withColumnRenamed("block", "qb").join(pairs, "qb").select(F.concat_ws("|", "qb", "db").alias("pair"), "id", "x", "low", F.lit(True).alias("q"))
    right = data.withColumnRenamed("block", "db").join(pairs, "db").select(F.concat_ws("|", "qb", "db").alias("pair"), "id", "x", "low", F.lit(False).alias("q"))

    def search(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["q"]], f[~f["q"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        row, ids, s = dual_search(_matrix(a["x"]), a["id"].to_numpy(), _matrix(b["x"]), b["id"].to_numpy(), k, a["low"].to_numpy())
        return pd.DataFrame({"query_id": a["id"].to_numpy()[row], "vec_id": ids, "score": s})

    found = left.unionByName(right).groupBy("pair").applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
