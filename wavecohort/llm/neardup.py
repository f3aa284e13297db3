"""MinHash near-dedup with HyperMinHash registers.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes), of which three things are kept: the set's
   size, a 128-bit digest of the set, and ``REGISTERS`` compressed registers. A shingle's hash chooses a register; the
   register holds the leading-zero count and ``MANTISSA`` further bits of the smallest hash that chose it. Empty
   registers borrow from a register picked by a fixed hash sequence.
2. Texts with equal digests are one class and one node of the graph: exact copies never meet in a join. A class has a
   number of its own, so that an id that holds several texts is in as many classes.
3. Bands of ``ROWS`` registers deal the nodes into buckets. Each bucket first links its members with its hub alone (a
   star), the member with the most bucket mates over all bands, so a bucket of thousands of copies of a text costs
   thousands of pairs. The members of buckets that are then not all in one component meet once more, across components
   alone, in an exact prefix join on their rarest shingles, which leaves out pairs that cannot reach the threshold.
4. A pair must pass the length bound and, if both sets are large, a collision-corrected Jaccard estimate from the
   registers that is not more than ``MARGIN`` below the threshold; what is left is verified on the full sets.
5. Components come from alternating star rounds on the verified edges.

At the threshold of 0.75 a pair shares at least one of the 40 bands of 5 with probability 1 - 2e-5; above 0.8 it is
1 - 1e-7. ``MARGIN`` is seven standard deviations of the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.functions.scratch import forget, written
from wavecohort.llm.common import mix64, shingles_of, table, words_of
from wavecohort.operators.components import connected_components

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets of fewer shingles go to verification without the estimate.
ESTIMATE_FROM = 256
MARGIN = 0.22
#: Node ids (8 bytes each) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_NODES = 500_000

_ARANGE = np.arange(REGISTERS, dtype=np.uint64)


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """``REGISTERS`` compressed registers (16 bits: 6 of leading zeros, ``MANTISSA`` of mantissa) of a non-empty set."""
    h = mix64(shingles ^ np.uint64(0xA0761D6478BD642F))
    slot = ((h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    rest = mix64(h)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, slot, rest)
    filled = np.zeros(REGISTERS, bool)
    filled[slot] = True
    # Leading zeros and the bits after the first one; float64's exponent gives the bit length.
    top = low >> np.uint64(11)  # 53 bits, exact as a float
    length = np.frexp(top.astype(np.float64))[1]  # 0 for 0
    zeros = np.minimum(53 - length, 63).astype(np.uint64)
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    code = (zeros << np.uint64(MANTISSA)) | ((top >> shift) & np.uint64((1 << MANTISSA) - 1))
    full, turn = filled.copy(), 1
    while not filled.all():  # borrow: the same sequence of places for every text
        want = np.flatnonzero(~filled)
        give = (mix64(_ARANGE[want] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(REGISTERS)).astype(np.int64)
        ok = full[give]
        code[want[ok]] = code[give[ok]]
        filled[want[ok]] = True
        turn += 1
    return code.astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: its number and its registers."""
    r = registers.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0xE7037ED1A0B428DB) + r[:, i])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarities from rows of registers, corrected for registers that agree by chance: two different minima
    with equal leading zeros agree in the mantissa once in 2**MANTISSA, and leading zeros agree once in three."""
    chance = 1 / 3 / 2**MANTISSA
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, to bound what a worker holds at once; an empty batch stays one."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n", "lo", "hi", "bands", "sig"]
    for batch in _slices(batches):
        words, at = words_of(batch.column(1))
        n, lo, hi, bands, sigs = [], [], [], [], []
        for i in range(batch.num_rows):
            s = shingles_of(words[at[i] : at[i + 1]])
            n.append(len(s))
            if not len(s):
                lo.append(0), hi.append(0), bands.append(None), sigs.append(None)
                continue
            lo.append(int(np.add.reduce(mix64(s)).astype(np.int64)))
            hi.append(int(np.bitwise_xor.reduce(mix64(s + np.uint64(0x632BE59BD9B4E019))).astype(np.int64)))
            r = registers_of(s)
            bands.append(band_keys(r).view(np.int64))
            sigs.append(r.tobytes())
        yield pa.record_batch(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=names,
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        words, at = words_of(batch.column(1))
        sets = [shingles_of(words[at[i] : at[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
        lo = [int(np.add.reduce(mix64(s.view(np.uint64))).astype(np.int64)) for s in sets]
        yield pa.record_batch([batch.column(0), pa.array(lo, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "lo", "s"])


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sig1", "sig2"))
            e = estimate(a, b)
        else:
            e = np.zeros(0)
        yield pa.record_batch([batch.column("a"), batch.column("b"), batch.column("n1"), batch.column("n2"), pa.array(e, pa.float64())], names=["a", "b", "n1", "n2", "e"])


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` that pass the length bound and the estimate."""
    left = nodes.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("sig").alias("sig1"))
    right = nodes.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))
    got = pairs.join(left, "a").join(right, "b")
    got = got.filter(f"100 * least(n1, n2) >= {threshold} * greatest(n1, n2)").select("a", "b", "n1", "n2", "sig1", "sig2")
    got = got.mapInArrow(_estimates, "a long, b long, n1 long, n2 long, e double")
    got = got.filter((F.col("e") >= threshold / 100 - MARGIN) | (F.least("n1", "n2") < ESTIMATE_FROM)).select("a", "b")
    return written(got, "pairs")


def _full_sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, s``: the shingle sets of the nodes named, made anew from the text of each one's smallest document."""
    want = nodes.join(ids, "id", "left_semi").select("id", "doc", "lo")
    few = ids.limit(MAX_BROADCAST_NODES + 1).count() <= MAX_BROADCAST_NODES
    named = want.select(F.col("doc").alias("id"))
    texts = docs.join(F.broadcast(named) if few else named, "id", "left_semi").select("id", "t")
    sets = texts.mapInArrow(_sets, "id long, lo long, s array<long>").withColumnRenamed("id", "doc").join(want, ["doc", "lo"])
    return written(sets.groupBy("doc", "lo", "id").agg(F.first("s").alias("s")).select("id", "s"), "sets")  # repeated rows


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have 100 * intersection >= threshold * union."""
    one, two = sets.select(F.col("id").alias("a"), F.col("s").alias("s1")), sets.select(F.col("id").alias("b"), F.col("s").alias("s2"))
    both = F.size(F.array_intersect("s1", "s2")).cast("long")
    true = pairs.join(one, "a").join(two, "b").filter(both * 100 >= (F.size("s1") + F.size("s2") - both) * threshold)
    return written(true.select("a", "b").distinct(), "links")


def _across(sets: DataFrame, comp: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a < b`` of sets of different components that can reach the threshold: an exact prefix join.

    Shingles are ordered from rare to frequent among these sets. A link takes an intersection of t / (100 + t) of the two
    sizes, so two linked sets share a shingle in their prefixes, and the first one that they share leaves enough behind
    it in both. A pair comes out once, at that shingle.
    """
    cell = sets.select("id", F.explode("s").alias("h"))
    df = cell.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = cell.join(df, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"))  # a text's own
    size = sets.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("c"), F.size("s").alias("n"))
    # Shingles that one set alone holds come first: they only move the others back.
    ranked = ranked.join(size, "id").withColumn("p0", F.col("n") - F.size("r"))
    reach = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) / 100).cast("int") + 1 - F.col("p0")
    ranked = ranked.filter(reach > 0).select("id", "c", "n", "p0", F.transform(F.slice("r", F.lit(1), F.greatest(reach, F.lit(0))), lambda x: x["h"]).alias("pre"))
    posts = ranked.select("id", "c", "n", "p0", "pre", F.posexplode("pre").alias("i", "h"))
    posts = written(posts, "prefixes")
    side = lambda x, k: posts.select("h", F.col("id").alias(x), *[F.col(v).alias(f"{v}{k}") for v in ("c", "n", "p0", "pre", "i")])
    can = f"""a < b AND c1 <> c2 AND 100 * least(n1, n2) >= {threshold} * greatest(n1, n2)
        AND {100 + threshold} * least(n1 - p01 - i1, n2 - p02 - i2) >= {threshold} * (n1 + n2)
        AND NOT arrays_overlap(slice(pre1, 1, i1), slice(pre2, 1, i2))"""
    return side("a", 1).join(side("b", 2), "h").filter(can).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id that links of 100 * Jaccard >= ``threshold`` reach, the row's own included;
    ``kept`` says that this is the row's own. A null or empty text, or one of white space, has no shingle, is linked
    with nothing and kept. Texts are whole, whatever their length. Rows that repeat an id with the same text give equal
    rows; if one id holds different texts, each row has the links of its own text. A row with a null id is linked with
    nothing: its ``component_id`` is null and it is kept. Ids are integers. An empty table gives no row.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    made = base.mapInArrow(_sketch, "id long, n long, lo long, hi long, bands array<long>, sig binary")
    sketch = written(made, "sketch")
    classes = sketch.filter("n > 0 AND id IS NOT NULL").groupBy("lo", "hi", "n").agg(F.min("id").alias("id"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = sketch.join(classes, ["id", "lo", "hi", "n"]).groupBy("node", "id", "lo", "hi", "n").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))  # equal in all rows of a digest
    nodes = written(nodes.select(F.col("node").alias("id"), F.col("id").alias("doc"), "lo", "n", "bands", "sig"), "nodes")
    rows = nodes.select("id", F.explode("bands").alias("k"))
    sizes = written(rows.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1"), "bucket-sizes")
    members = members_ = written(rows.join(sizes, "k").select("k", "id", "m"), "members")
    degree = members.groupBy("id").agg(F.sum("m").alias("d"))
    hub = members.select("k", "id").join(degree, "id").groupBy("k").agg(F.max(F.struct("d", (-F.col("id")).alias("i"))).alias("h"))
    hub = written(hub.select("k", (-F.col("h.i")).alias("a")), "hubs")  # read back, so that the join on a hot bucket can be split
    members = members.select("k", "id")
    tried = members.join(hub, "k").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    tried = written(tried, "stars")
    plain = base.filter("id IS NOT NULL")
    likely = _likely(tried, nodes, threshold)
    named = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    first = _full_sets(named, nodes, plain)
    links = _verified(likely, first, threshold)
    comp = written(connected_components(links, "a", "b"), "comp")

    # Members of buckets with more than one component: the pairs across components that can reach the threshold.
    known = members.join(comp.withColumnRenamed("node", "id"), "id", "left")
    known = known.withColumn("c", F.coalesce("component", "id")).select("k", "id", "c")
    open_ = known.groupBy("k").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("k")
    open_ = written(open_, "open-buckets")
    sets = _full_sets(known.join(open_, "k", "left_semi").select("id").distinct(), nodes, plain)
    more = _across(sets, comp, threshold)
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(more.join(done, ["a", "b"], "left_anti"), "across")
    if more.limit(1).count():
        links = links.unionByName(_verified(_likely(more, nodes, threshold), sets, threshold))
        forget(docs.sparkSession, comp)
        comp = written(connected_components(links, "a", "b"), "comp")
    for done_with in (nodes, sizes, members_, hub, tried, likely, first, open_, sets, more):
        forget(docs.sparkSession, done_with)
    of_class = classes.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = of_class.groupBy("c").agg(F.min("id").alias("component"))
    of_class = of_class.select("lo", "hi", "n", "c").join(least, "c").drop("c")
    got = sketch.select("id", "n", "lo", "hi").join(of_class, ["lo", "hi", "n"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))  # a row without shingles has no class
    return got.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the smallest id; of repeated rows each stays. An id of
    several texts goes if one of them does."""
    gone = near_duplicates(docs, threshold, id_col, text_col).filter("NOT kept").select(F.col(id_col).alias("__gone")).distinct()
    gone = written(gone, "gone")  # counted, so that texts are not sent about for a few ids
    few = gone.limit(MAX_BROADCAST_NODES + 1).count() <= MAX_BROADCAST_NODES
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone["__gone"], "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
