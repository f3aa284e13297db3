"""Phrase collocations by suffix-sigma: phrases of a language whose words go together more than apart.

1. Every word of every text is counted for each language. A word is a 64-bit hash from here on; if a word that is
   frequent enough shares its hash with another word, everything starts again with other hashes, so counts are exact.
2. Every word position gives one suffix: the words from there to the end of its piece, ``max_n`` at most. Words below
   ``min_count`` end a suffix, since no candidate holds one: a fixed table of ``FILTER_BITS`` bits knows the others (a
   false hit costs work, not exactness). Equal suffixes of a task are added up before anything is sent.
3. Suffixes are dealt by language and first word. A first word that is hot (more than a quarter of an even share of a
   bucket's words) is dealt by its second word too, that by its third if it is hot as well, and so on: no bucket gets
   more than its share, whatever word, pair or passage is repeated.
4. A bucket sorts its suffixes in reverse lexicographical order and counts all prefixes in one run over them: a prefix
   ends where neighbours have less than its length in common. Prefixes of hot words alone lie in several buckets; their
   parts are joined afterwards.
5. Parts of candidates, longer candidates and texts of words come from joins on the table of frequent phrases.

A null text is empty, a null language ``und``. Repeated rows count each. An empty table gives no row. Texts are handled a
megabyte at a time, whatever their length. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecohort.functions.scratch import forget, written
from wavecohort.llm.common import mix64, table
from wavecohort.llm.words import byte_set, slices, words

BREAKS = byte_set(*b".,;:!?", (0x0A, 0x0D))
SEPARATORS = BREAKS | byte_set(0x20, 0x09)
#: Bits of the table of frequent words (8 MB), and of one of its segments.
FILTER_BITS, SEGMENT = 26, 17
#: Word positions that a bucket gets at most on average.
BUCKET = 2_000_000
#: Bytes of text that a task takes at once, to count words and to make suffixes.
WORDS_SLICE, SLICE = 3 << 20, 2 << 20
#: Different words, and different suffixes, of slices that a task adds up before it sends them.
HELD_WORDS, HELD = 600_000, 1_200_000
#: Buckets for each shuffle partition at least, so that partitions are even.
EACH = 2


def _of_lang(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "big"))


def _coded(col: pa.Array) -> tuple[list[str], np.ndarray]:
    """Names of the languages of a batch, and the number of each row's."""
    d = col.dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _count_words(seed: int):
    """Different words of some slices with their hashes and counts. Two hashes tell words apart here, so that words that
    share the first stay two rows."""

    def merged(held: list[tuple], names: list[str]) -> pa.RecordBatch:
        lang, h, check, c = (np.concatenate([x[i] for x in held]) for i in range(4))
        texts = pa.concat_arrays([x[4] for x in held])
        held.clear()
        order = np.lexsort((check, h, lang))
        new = np.flatnonzero(np.r_[True, np.logical_or.reduce([np.diff(x[order]) != 0 for x in (lang, h, check)])])
        first = order[new]
        codes = pa.DictionaryArray.from_arrays(pa.array(lang[first], pa.int32()), pa.array(names, pa.string()))
        return pa.record_batch([codes.dictionary_decode(), pa.array(h[first].view(np.int64)), texts.take(pa.array(first)).cast(pa.string()), pa.array(np.add.reduceat(c[order], new))], names=["lang", "h", "w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple] = []
        for batch in slices(batches, 1, WORDS_SLICE):
            names, code = _coded(batch.column(0))
            place = np.array([langs.setdefault(x, len(langs)) for x in names], np.int32)
            check = words(batch.column(1), SEPARATORS, seed=seed + 1).hashes
            w = words(batch.column(1), SEPARATORS, seed=seed)
            if not len(check):
                continue
            lang = place[np.repeat(code, np.diff(w.rows))]
            order = np.lexsort((check, w.hashes, lang))
            new = np.flatnonzero(np.r_[True, np.logical_or.reduce([np.diff(x[order]) != 0 for x in (lang, w.hashes, check)])])
            first = order[new]
            held.append((lang[first], w.hashes[first], check[first], np.diff(np.r_[new, len(order)]), w.texts(first)))
            if sum(len(x[0]) for x in held) >= HELD_WORDS:
                yield merged(held, list(langs))
        if held:
            yield merged(held, list(langs))

    return run


def _vocabulary(base: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """``lang, h, w, n`` of words with n >= ``min_count``, with a row of null h for the sum of the others of a language;
    and the seed of the hashes that tell these words from all others."""
    for seed in range(16):
        found = base.mapInArrow(_count_words(seed * 0x5851F42D), "lang string, h long, w string, c long")
        each = found.repartition("lang", "h").groupBy("lang", "h", "w").agg(F.sum("c").alias("c"))
        one = each.groupBy("lang", "h").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.first("w").alias("w"))
        kept = F.col("n") >= min_count
        got = one.groupBy("lang", F.when(kept, F.col("h")).alias("h"), F.when(kept, F.col("w")).alias("w"), F.when(kept, F.col("k")).alias("k")).agg(F.sum("n").alias("n"))
        got = written(got, "vocabulary")
        if not got.filter("k > 1").limit(1).count():
            return got.drop("k"), seed * 0x5851F42D
        forget(base.sparkSession, got)
    raise ValueError("no seed tells the words apart")


def _spots(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix64(h ^ lang)


def _filter_table(frequent: DataFrame) -> np.ndarray:
    """One bit for each place that a frequent word of some language has: ``2 ** FILTER_BITS`` bits, as bytes."""
    size = 1 << (SEGMENT - 3)

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for f in frames:
            for lang, g in f.groupby("lang"):
                at = _spots(g["h"].to_numpy(np.int64).view(np.uint64), _of_lang(lang)) >> np.uint64(64 - FILTER_BITS)
                for s in np.unique(at >> np.uint64(SEGMENT)):
                    bit = (at[(at >> np.uint64(SEGMENT)) == s] & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)
                    np.bitwise_or.at(held.setdefault(int(s), np.zeros(size, np.uint8)), bit >> 3, (128 >> (bit & 7)).astype(np.uint8))
        yield pd.DataFrame({"segment": list(held), "bits": [b.tobytes() for b in held.values()]})

    def merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        got = np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in f["bits"]]))
        return pd.DataFrame({"segment": [key[0]], "bits": [got.tobytes()]})

    rows = frequent.select("lang", "h").mapInPandas(mark, "segment int, bits binary").groupBy("segment").applyInPandas(merge, "segment int, bits binary")
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows.collect():  # a fixed size, whatever the corpus
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _packed(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of numbers below 2 ** bits as few columns of 64 bits, first ones highest."""
    per = max(1, 64 // bits)
    out = []
    for i in range(0, len(ids), per):
        x = np.zeros(len(ids[0]), np.uint64)
        for c in ids[i : i + per]:
            x = (x << np.uint64(bits)) | c.astype(np.uint64)
        out.append(x)
    return out


def _sorted(ids: list[np.ndarray], bits: int) -> np.ndarray:
    """Row numbers in lexicographical order of the columns."""
    keys = _packed(ids, bits)
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _kind(n: int) -> str:
    """What references to n words, none included, are written as."""
    return "<u1" if n <= 1 << 8 else "<u2" if n <= 1 << 16 else "<u4"


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all lowest bytes first, so that the higher ones, mostly alike, cost little."""
    return pa.compress(x.view(np.uint8).reshape(x.size, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _restored(b: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _summed(cols: list[np.ndarray], counts: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns once, in lexicographical order, with the sums of their counts."""
    order = _sorted(cols, width)
    cols = [x[order] for x in cols]
    new = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in cols])])
    return [x[new] for x in cols], np.add.reduceat(counts[order], new)


def _suffixes(seed: int, max_n: int, n_buckets: int, bits: np.ndarray, hot: np.ndarray):
    """Suffixes of some slices with their counts, one blob for each bucket and language: the hashes of its words, references
    to them (1 and up, 0 for none) word by word, and counts."""

    def of_slice(batch: pa.RecordBatch, langs: dict[str, int]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray] | None:
        """The hashes of its known words; language and word references of each suffix; counts."""
        names, code = _coded(batch.column(0))
        own = np.array([_of_lang(x) for x in names], np.uint64)
        place = np.array([langs.setdefault(x, len(langs)) for x in names], np.int32)
        w = words(batch.column(1), SEPARATORS, BREAKS, seed)
        w.begins = w.ends = w.data = None  # not needed here
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(w.rows))
        of = code[row].astype(np.int32)
        spot = _spots(w.hashes, own[of]) >> np.uint64(64 - FILTER_BITS)
        known = (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (spot & np.uint64(7)).astype(np.uint8))) & 1 > 0
        at = np.flatnonzero(known)
        if not len(at):
            return None
        vocab, inverse = np.unique(w.hashes[at], return_inverse=True)
        ids = np.zeros(len(known) + max_n, np.int32)
        ids[at] = inverse + 1
        end = np.ones(len(known) + max_n, bool)  # no word of the same piece before it
        end[1 : len(known)] = (row[1:] != row[:-1]) | (w.piece[1:] != w.piece[:-1])
        cols, live = [place[of[at]], ids[at]], np.ones(len(at), bool)
        for k in range(1, max_n):
            live = live & ~end[at + k] & (ids[at + k] > 0)
            cols.append(np.where(live, ids[at + k], 0).astype(np.int32))
        cols, c = _summed(cols, np.ones(len(at), np.int32), max(int(len(vocab)).bit_length(), len(langs).bit_length()))
        return vocab, cols, c

    def sent(held: list[tuple], langs: dict[str, int]) -> pa.RecordBatch:
        vocab = np.unique(np.concatenate([v for v, _, _ in held]))
        parts = [[], *([] for _ in range(max_n))]
        for v, cols, _ in held:
            back = np.r_[0, np.searchsorted(vocab, v) + 1].astype(np.int32)
            for i, x in enumerate(cols):
                parts[i].append(back[x] if i else x)
        cols, c = _summed([np.concatenate(x) for x in parts], np.concatenate([c for _, _, c in held]), max(int(len(vocab)).bit_length(), len(langs).bit_length()))
        held.clear()
        names = list(langs)
        own = np.array([_of_lang(x) for x in names], np.uint64)
        lang, cols, hashes = cols[0], cols[1:], np.r_[np.uint64(0), vocab]
        to, deeper = own[lang], np.ones(len(lang), bool)
        for x in cols:  # a word more as long as all before it are hot
            to = np.where(deeper, mix64(to * np.uint64(0xD6E8FEB86659FD93) + hashes[x]), to)
            deeper &= np.isin(_spots(hashes[x], own[lang]), hot)
        to = (to % np.uint64(n_buckets)).astype(np.int64)
        both = to * len(names) + lang
        order = np.argsort(both, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(both[order]) != 0, True])
        out: list[list] = [[], [], [], [], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = order[a:b]
            some, ref = np.unique(np.stack([x[i] for x in cols]), return_inverse=True)
            if some[0]:
                some, ref = np.r_[0, some], ref + 1
            small = _kind(len(some))
            for o, v in zip(out, (int(to[i[0]]), names[lang[i[0]]], b - a, len(some) - 1, _squeezed(hashes[some[1:]]), _squeezed(ref.astype(small).ravel()), _squeezed(c[i].astype("<u4"))), strict=True):
                o.append(v)
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["bucket", "lang", "size", "n_words", "words", "refs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple] = []
        for batch in slices(batches, 1, SLICE):
            got = of_slice(batch, langs)
            if got:
                held.append(got)
            if sum(len(c) for _, _, c in held) >= HELD:
                yield sent(held, langs)
        if held:
            yield sent(held, langs)

    return run


def count_prefixes(suffixes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length k the row where every prefix of it begins and its count, from rows of word numbers (0 for none) in
    reverse lexicographical order. This is the stack of suffix-sigma for all rows at once: a prefix is popped where the
    next row has fewer than k words in common with it."""
    m, width = suffixes.shape
    differs = np.ones(m, bool)
    common = np.zeros(m, np.int64)
    differs[1:] = False
    for k in range(1, width + 1):
        differs[1:] |= suffixes[1:, k - 1] != suffixes[:-1, k - 1]
        common[~differs] = k
        new = np.flatnonzero(common < k)
        total = np.add.reduceat(counts, new)
        full = suffixes[new, k - 1] > 0
        yield k, new[full], total[full]


def _count_bucket(max_n: int, min_count: int, hot: np.ndarray):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, g in f.groupby("lang"):
            dicts = [_restored(x, n, "<u8") for x, n in zip(g["words"], g["n_words"], strict=True)]
            vocab = np.unique(np.concatenate(dicts))
            ids = []
            for d, refs, size in zip(dicts, g["refs"], g["size"], strict=True):
                back = np.r_[0, np.searchsorted(vocab, d) + 1]
                ids.append(back[_restored(refs, max_n * size, _kind(len(d) + 1)).astype(np.int64)].reshape(max_n, size))
            ids = np.concatenate(ids, axis=1)
            counts = np.concatenate([_restored(x, n, "<u4") for x, n in zip(g["counts"], g["size"], strict=True)]).astype(np.int64)
            order = _sorted(list(ids), int(len(vocab)).bit_length())[::-1]
            rows, counts = np.ascontiguousarray(ids.T[order]), counts[order]
            hashes = np.r_[np.uint64(0), vocab]
            is_hot = np.isin(_spots(hashes, _of_lang(lang)), hot)
            is_hot[0] = False
            for k, at, total in count_prefixes(rows, counts):
                part = is_hot[rows[at, :k]].all(axis=1) if k < max_n else np.zeros(len(at), bool)
                keep = part | (total >= min_count)
                keys = hashes[rows[at[keep], :k]].astype(">u8")
                out.append(pd.DataFrame({"lang": lang, "k": k, "key": [x.tobytes() for x in keys], "f": total[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "k": [], "key": [], "f": []})

    return run


def phrase_counts(base: DataFrame, vocabulary: DataFrame, seed: int, max_n: int, min_count: int) -> DataFrame:
    """``lang, k, key, f`` of all phrases of ``max_n`` words or fewer with f >= ``min_count``; a key is the hashes of the
    words, 8 bytes each."""
    spark = base.sparkSession
    frequent = vocabulary.filter("h IS NOT NULL")
    total = vocabulary.agg(F.sum("n").alias("n")).first()["n"] or 0
    n_buckets = max(EACH * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    # Fewer than 4 * n_buckets words can have more than this share of all words.
    rows = frequent.filter(F.col("n") > total / (4 * n_buckets)).select("lang", "h").collect()
    hot = np.array([_spots(np.array([r["h"]]).view(np.uint64), _of_lang(r["lang"]))[0] for r in rows], np.uint64)
    suffixes = base.mapInArrow(_suffixes(seed, max_n, n_buckets, _filter_table(frequent), hot), "bucket int, lang string, size int, n_words int, words binary, refs binary, counts binary")
    counted = suffixes.groupBy("bucket").applyInPandas(_count_bucket(max_n, min_count, hot), "lang string, k int, key binary, f long")
    counted = counted.groupBy("lang", "k", "key").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
    return written(counted, "phrases")


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, max_n: int = 4, min_count: int = 30, cover: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``max_n`` words.

    a is a phrase's count within pieces, n its language's number of words. Cut after its first words, l and r are the counts
    of both parts, and floor(2000000 * a / (l + r)) of the worst cut is the score (ties: the shortest first part). A phrase
    that lies in a longer one with 100 * count >= ``cover`` * a goes. Order: score and a descending, phrase ascending.
    """
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("t"))
    vocabulary, seed = _vocabulary(base, min_count)
    docs.sparkSession._jvm.System.gc()  # Spark's cleaner then drops the shuffle files of the words' count
    counts = phrase_counts(base, vocabulary, seed, max_n, min_count)
    found = counts.filter("k > 1")
    part = lambda a, b: F.substring("key", a * 8 + 1, b * 8) if isinstance(a, int) else F.substr("key", a * 8 + 1, b * 8)

    cut = found.select("lang", "k", "key", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumns({"k1": part(F.lit(0), F.col("cut")), "k2": part(F.col("cut"), F.col("k") - F.col("cut"))})
    one, two = counts.select("lang", F.col("key").alias("k1"), F.col("f").alias("l")), counts.select("lang", F.col("key").alias("k2"), F.col("f").alias("r"))
    cut = cut.join(one, ["lang", "k1"]).join(two, ["lang", "k2"])
    score = F.expr("CAST((CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(8,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    least = cut.withColumn("score", score).groupBy("lang", "k", "key", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))

    inside = [F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for k in range(3, max_n + 1) for n in range(2, k) for i in range(k - n + 1)]
    longer = [F.when(F.col("k") == k, F.array(*[part(i, n) for n in range(2, k) for i in range(k - n + 1)])) for k in range(3, max_n + 1)]
    if inside:
        held = found.filter("k > 2").select("lang", F.explode(F.coalesce(*longer)).alias("key"), "f").groupBy("lang", "key").agg(F.max("f").alias("most"))
        least = least.join(held, ["lang", "key"], "left").filter(F.col("most").isNull() | (_exact(F.col("most")) * 100 < _exact(F.col("a")) * cover))

    # All that may be listed, ties at the end included, in two steps: no task gets more than ``top`` of each part of a language.
    order = [F.desc("x.score"), F.desc("a")]
    spread = F.pmod(F.xxhash64("key"), F.lit(64))
    short = least.withColumn("s", spread).withColumn("o", F.rank().over(Window.partitionBy("lang", "s").orderBy(*order))).filter(F.col("o") <= top)
    short = written(short.withColumn("o", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("o") <= top).drop("o", "s"), "listed")
    at = short.select("lang", "key", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).withColumn("word", part(F.col("i"), F.lit(1)))
    text = vocabulary.filter("h IS NOT NULL").select("lang", F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("word"), "w")
    phrase = at.join(text, ["lang", "word"]).groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("ws"))
    phrase = phrase.select("lang", "key", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("phrase"))
    whole = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    got = short.join(phrase, ["lang", "key"]).join(whole, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    got = got.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return got.select("lang", "rank", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
q AS MATERIALIZED (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (
  SELECT lang, 1 AS k, ws[i] AS ph FROM q
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM q WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM q WHERE i + 2 <= len(ws)
  UNION ALL SELECT lang, 4, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FROM q WHERE i + 3 <= len(ws)),
f AS MATERIALIZED (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
w AS (SELECT lang, count(*) AS n FROM q GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, ph, string_split(ph, ' ') AS ws, f FROM f WHERE k > 1),
x AS (SELECT lang, k, ph, ws, f AS a, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT lang, k, ph, a, cut, array_to_string(ws[1 : cut], ' ') AS p1, array_to_string(ws[cut + 1 : k], ' ') AS p2 FROM x),
s AS (
  SELECT y.*, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM y JOIN f l ON l.lang = y.lang AND l.ph = y.p1 JOIN f r ON r.lang = y.lang AND r.ph = y.p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
m AS (
  SELECT lang, f, array_to_string(ws[i : i + n - 1], ' ') AS sub
  FROM (SELECT lang, f, ws, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT lang, f, ws, k, unnest(range(2, k)) AS n FROM c WHERE k > 2))),
h AS (SELECT lang, sub, max(f) AS most FROM m GROUP BY ALL),
o AS (SELECT b.lang, ph AS phrase, a, l, r, score FROM b LEFT JOIN h ON h.lang = b.lang AND h.sub = b.ph WHERE most IS NULL OR 100 * most < 80 * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN w USING (lang) QUALIFY rank <= 2000
"""
