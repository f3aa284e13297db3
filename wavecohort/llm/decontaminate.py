"""Benchmark decontamination: windows of training words looked up in a broadcast hash set of test n-grams.

DataFrame functions only. The benchmark's distinct windows are broadcast when their number and bytes are
within stated bounds, and joined by a shuffle on the window's hash beyond them; the ids of their items are joined to
what was hit alone. Texts are scanned whole, however long; a document's hits meet in a group, as many as its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.functions.scratch import written
from wavecohort.llm.common import ascii_lower, inside, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct windows, and bytes of their words, that are broadcast; more are joined by a shuffle on the window's hash.
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_BYTES = 500_000, 64 << 20


def words(text: Column) -> Column:
    """The normalised words of a text; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``h, g, window, item``: each window of ``n`` words with two hashes of it, once for each item that holds it; a
    shorter item, if it has a word, is one window."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    wins = items.select("item", "w", at.alias("i")).select("item", F.expr(f"slice(w, i, {n})").alias("window")).distinct()
    return wins.select(F.xxhash64("window").alias("h"), F.xxhash64(F.lit(1), "window").alias("g"), "window", "item")


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    keys: list[str],
    n: int = 10,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_broadcast_windows: int = MAX_BROADCAST_WINDOWS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``keys, at, len, h, g`` for each place (1-based word position) where a benchmark window occurs, verified word by
    word after the hash matched, and ``h, g, item``, the windows' items. Documents are read and split once for all
    lengths of windows. No window or no document gives no row."""
    wins = written(benchmark_windows(benchmark, n, item_id, item_text), "windows")
    distinct = wins.select("h", "g", "window").distinct()
    size = distinct.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("window", " ")) + 16 * F.size("window")).alias("b"), F.collect_set(F.size("window")).alias("k")).first()  # n lengths at most
    few = size["n"] <= max_broadcast_windows and (size["b"] or 0) <= max_broadcast_bytes
    lengths = F.array(*[F.lit(k) for k in sorted(size["k"]) or [n]])
    had = docs.select(*keys, words(F.col(text_col)).alias("w"))
    scan = had.select(*keys, "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))).alias("at"))
    scan = scan.select(*keys, "w", "at", F.explode(lengths).alias("len")).filter(F.col("at") + F.col("len") - 1 <= F.size("w"))
    scan = scan.select(*keys, "at", "len", F.slice("w", F.col("at"), F.col("len")).alias("seen")).withColumn("h", F.xxhash64("seen"))
    hit = scan.join(F.broadcast(distinct) if few else distinct, "h").filter("seen = window")
    return hit.select(*keys, "at", "len", "h", "g"), wins.select("h", "g", "item")


def covered(spans: Column) -> Column:
    """Number of word positions in the union of ``array<struct<at, len>>``."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(s["at"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["at"] + s["len"]).alias("end"),
        ),
    )
    return step["n"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str], str]:
    """``docs`` with two columns that tell rows apart by id and text, their names, and that of the id's text."""
    names = inside(docs, "own_id", "own_text")
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(text_col)
    return docs.withColumns(dict(zip(names, own, strict=True))), names, text_col


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a benchmark window, ``items_sha256`` is over the ids of the
    items found, sorted as strings and comma-joined. A null or empty text has no words and no hit; repeated rows and
    rows that share an id are judged by the hits of all rows of that id and text; an empty benchmark hits nothing; a
    null id is an id like any other; other columns play no part, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("d"), F.xxhash64(text_col).alias("t"))
    hits, items = find_hits(base, benchmark, ["d", "t"], n, "text", **how)
    hits = written(hits, "hits")
    spans = hits.groupBy("d", "t").agg(F.collect_set(F.struct("at", "len")).alias("spans"))
    held = hits.select("d", "t", "h", "g").distinct().join(items, ["h", "g"]).groupBy("d", "t").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    got = base.select("id", "d", "t", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(spans.join(held, ["d", "t"]), ["d", "t"], "left")
    return got.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit("")), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window; all columns stay as they are."""
    keyed, keys, text = _keyed(docs, id_col, text_col)
    bad = find_hits(keyed, benchmark, keys, n, text, **how)[0].select(*keys).distinct()
    return keyed.join(bad, keys, "left_anti").select(*docs.columns) if docs.columns else docs


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the hit words cut out of the texts, each with the separators after it; a text without a hit stays
    as it is, and so does every other column."""
    keyed, keys, text = _keyed(docs, id_col, text_col)
    (cuts,) = inside(keyed, "spans")
    per = find_hits(keyed, benchmark, keys, n, text, **how)[0].groupBy(*keys).agg(F.collect_set(F.struct("at", "len")).alias(cuts))
    joined = keyed.join(per, keys, "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lead = F.regexp_extract(text_col, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    parts = F.regexp_extract_all(F.col(text_col), F.lit(word + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    hit = F.array_distinct(F.flatten(F.transform(cuts, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(parts)), hit), lambda i: F.element_at(parts, i))
    cut = F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(kept, "")))
    return joined.withColumn(text_col, cut).select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
