"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

:func:`build_index` goes over the documents twice: once for the number of documents N and of terms L, once to write shards.
A shard holds about ``POSTINGS`` postings of consecutive documents of a task, as a CSR matrix: sorted terms, where the
postings of each begin, the documents' places in the shard and their impacts, which are integers and depend on nothing but
the document and the corpus. Nothing is shuffled, and a shard is one row of the written index.

:func:`search` takes blocks of ``QUERY_BLOCK`` queries. Document frequencies come from the shards' sorted terms alone (the
other columns are not read). Then each task goes over its shards term at a time: the weighted impacts of a term's postings
are added to a dense array of the shard's documents. A partition of that array finds its kth score, all documents that
reach it are kept, ties included, and sorted; a task merges its shards' best k and sends k rows a query at most. The tasks'
lists are merged in two steps, so that no task gets all of them.

Terms are compared by 64-bit hashes: with V terms in the corpus and Q in the queries, a pair of different terms is taken
for one with probability V * Q / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecohort.functions.scratch import written
from wavecohort.llm.common import table
from wavecohort.llm.words import byte_set, slices, words

#: ASCII but for digits and letters.
SEPARATORS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Postings of a shard, about, and its documents at most.
POSTINGS, DOCUMENTS = 1_000_000, 65_536
#: Queries, and terms of these, that are searched at once.
QUERY_BLOCK, QUERY_TERMS = 2_000, 200_000
#: Shards that are read at once.
SHARDS_AT_ONCE = 4
SHARD = "n_docs int, ids binary, terms binary, starts binary, docs binary, impacts binary"


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in slices(batches, 0):
        size = np.diff(words(batch.column(0), SEPARATORS).rows)
        n, total = n + int((size > 0).sum()), total + int(size.sum())
    yield pa.record_batch([pa.array([n]), pa.array([total])], names=["n", "l"])


def impacts_of(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 20 * m) with m = 50 + (50 * length * n) div total."""
    m = 100 - 50 + (50 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _shards(n: int, total: int):
    def shard(ids: list, codes: list, tfs: list, sizes: list) -> pa.RecordBatch:
        """From the documents' distinct terms, their occurrences, and how many there are of each document."""
        term, tf, size = np.concatenate(codes), np.concatenate(tfs), np.concatenate(sizes)
        doc = np.repeat(np.arange(len(size)), size)
        length = np.bincount(doc, weights=tf, minlength=len(size)).astype(np.int64)
        order = np.argsort(term, kind="stable")
        term, doc = term[order], doc[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        impact = impacts_of(tf[order], length[doc], n, total)
        parts = (np.concatenate(ids).astype("<i8"), term[first], np.r_[first, len(term)].astype("<u4"), doc.astype("<u2"), impact.astype("<u4"))
        return pa.record_batch([pa.array([len(size)], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["n_docs", "ids", "terms", "starts", "docs", "impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        postings = documents = 0
        for batch in slices(batches, 1, 4 << 20):
            w = words(batch.column(1), SEPARATORS)
            row = np.repeat(np.arange(batch.num_rows), np.diff(w.rows))
            order = np.lexsort((w.hashes, row))
            h, r = w.hashes[order], row[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[new, len(h)])
            size = np.bincount(r[new], minlength=batch.num_rows)
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(size)]
            at = 0
            while at < batch.num_rows:  # as many documents as fill the shard
                stop = int(np.searchsorted(ends, ends[at] + max(POSTINGS - postings, 1)))
                stop = max(at + 1, min(stop, at + DOCUMENTS - documents, batch.num_rows))
                for to, x in zip(held, (doc_ids[at:stop], h[new[ends[at] : ends[stop]]], tf[ends[at] : ends[stop]], size[at:stop]), strict=True):
                    to.append(x)
                postings, documents, at = postings + int(ends[stop] - ends[at]), documents + stop - at, stop
                if postings >= POSTINGS or documents >= DOCUMENTS:
                    yield shard(*held)
                    held, postings, documents = ([], [], [], []), 0, 0
        if documents:
            yield shard(*held)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The written shards of all documents, and the number of documents with a term.

    Terms are runs of ASCII digits and letters and of all characters beyond ASCII, A-Z lower-cased, from whole texts; a
    null text has none. Documents without a term, or without an id, count as they are (the former not at all, the latter
    in all statistics) and are never listed. Ids are integers; rows that repeat an id are documents of their own.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    whole = texts.select("t").mapInArrow(_lengths, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n, total = whole["n"] or 0, whole["l"] or 0
    marked = texts.select(F.coalesce("id", F.lit(np.iinfo(np.int64).min).cast("long")).alias("id"), "t")
    return written(marked.mapInArrow(_shards(n, max(total, 1)), SHARD), "shards"), n


def _document_frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                have, begin = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(starts.as_py(), "<u4")
                at = np.minimum(np.searchsorted(have, terms), max(len(have) - 1, 0))
                hit = np.flatnonzero(have[at] == terms) if len(have) else np.zeros(0, np.int64)
                df[hit] += begin[at[hit] + 1].astype(np.int64) - begin[at[hit]]
        yield pa.record_batch([pa.array(np.arange(len(terms))[df > 0]), pa.array(df[df > 0])], names=["term", "df"])

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0 and their ids, equal scores by ascending id."""
    hit = np.flatnonzero(scores > 0)
    if len(hit) > k:
        least = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
        hit = hit[scores[hit] >= least]  # all that are equal to the kth
    order = hit[np.lexsort((ids[hit], -scores[hit]))][:k]
    return scores[order], ids[order]


def _ranked(starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int):
    """``starts``: where the terms of each query begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (len(starts) - 1)
        none = np.iinfo(np.int64).min
        for batch in slices_of_rows(batches, SHARDS_AT_ONCE):
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)  # noqa: B023, E731
                have, begin, docs, impacts, ids = get("terms", np.uint64), get("starts", "<u4"), get("docs", "<u2"), get("impacts", "<u4").astype(np.int64), get("ids", "<i8")
                if not len(have):
                    continue
                at = np.minimum(np.searchsorted(have, terms), len(have) - 1)
                there = have[at] == terms
                total = np.zeros(len(ids), np.int64)
                for q in range(len(starts) - 1):
                    total[:] = 0
                    for t in np.flatnonzero(there[starts[q] : starts[q + 1]]) + starts[q]:
                        a, b = begin[at[t]], begin[at[t] + 1]
                        total[docs[a:b]] += weights[t] * impacts[a:b]  # a document has a term once
                    total[ids == none] = 0
                    s, i = best(total, ids, k)
                    if len(s):
                        s, i = np.r_[held[q][0], s], np.r_[held[q][1], i]
                        order = np.lexsort((i, -s))[:k]
                        held[q] = s[order], i[order]
        query = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
        join = lambda j: np.concatenate([x[j] for x in held]) if held else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(query), pa.array(join(1)), pa.array(join(0))], names=["query", "doc_id", "score"])

    return run


def slices_of_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _query_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """``(item_id, terms)`` of all items, in blocks of a bounded number of items and terms."""
    made = items.groupBy("item_id").agg(F.collect_list("t").alias("ts"))
    block, size = [], 0
    for r in made.toLocalIterator():
        terms = np.unique(np.concatenate([words(pa.array([t], pa.large_string()), SEPARATORS).hashes for t in r["ts"]] or [np.zeros(0, np.uint64)]))
        if block and (len(block) >= QUERY_BLOCK or size + len(terms) > QUERY_TERMS):
            yield block
            block, size = [], 0
        block.append((r["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def search(index: DataFrame, n: int, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest scores above 0 for each item, fewer if there are
    fewer; equal scores by ascending document id. A score sums weight * impact over the item's distinct terms, with weight
    floor(1000 * ln((2N + 2) / (2df + 1))).

    Rows that repeat an item's id are one query with the terms of all; rows without an id are none. Items without a term,
    or whose terms no document has, give no row. Very long items count whole; a block of queries holds one at least.
    """
    spark = index.sparkSession
    rows = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(text_col).alias("t"))
    kind = rows.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _query_blocks(rows):
        terms = np.unique(np.concatenate([t for _, t in block]))
        found = index.select("terms", "starts").mapInArrow(_document_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = {r["term"]: r["df"] for r in found.collect()}  # of one block's terms
        weight = {int(terms[t]): int(np.floor(1000 * np.log((2 * n + 2) / (2 * d + 1)))) for t, d in df.items()}
        own = [np.array([t for t in terms_of.tolist() if weight.get(t)], np.uint64) for _, terms_of in block]
        starts = np.r_[0, np.cumsum([len(x) for x in own])]
        flat = np.concatenate(own)
        got = index.mapInArrow(_ranked(starts, flat, np.array([weight[t] for t in flat.tolist()], np.int64), k), "query long, doc_id long, score long")
        names = spark.createDataFrame(pd.DataFrame({"query": range(len(block)), "item_id": [i for i, _ in block]}), f"query long, item_id {kind}")
        order = [F.desc("score"), "doc_id"]
        got = got.withColumn("s", F.spark_partition_id() % 64)
        got = got.withColumn("o", F.row_number().over(Window.partitionBy("query", "s").orderBy(*order))).filter(F.col("o") <= k)
        got = got.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        out = out.unionByName(got.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # one block's names
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n = build_index(table(spark, sf_dir, "documents"))
    return search(index, n, table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

SQL = f"""
WITH x AS MATERIALIZED (SELECT doc_id, {_TERMS.format(t='text')} FROM documents),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM d),
m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // l AS m FROM d, c),
q AS (SELECT DISTINCT item_id, {_TERMS.format(t='text')} FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""
