"""Line dedup: an exact set-similarity join over the lines of all documents; later matches go.

DataFrame functions only. A line is a set of tokens (words between white space, letters lower-cased), split and hashed
once. Lines with equal text are folded first, by partial aggregation, so that a line which a third of all documents
repeat is one row in the join. The rest is a prefix-filter join: tokens are ordered from rare to frequent by a frequency
class counted over all lines, every line posts its first ``n - ceil(t * n) + 1`` tokens, and lines meet in a posted token
under the length, the positional and a parity filter. The positional one holds for the first token that a pair shares:
all of the overlap lies at and after it, in either line. A pair that is left is verified on its real tokens. Families of
copies are thinned first: a line that matches one of a few early lines of its posted tokens is gone and need not meet the
others. The class table has ``BUCKETS`` numbers (8 MB) whatever the input; the order only steers the work, so hashing
tokens into buckets costs no exactness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.functions.scratch import forget, written
from wavecohort.llm.common import inside, table

BUCKETS = 1 << 20
#: Tokens of this frequency class (2^16 occurrences) and above are hot: their join is split, for each doubling once more.
HOT = 48
#: Lines of so many tokens have parities twice: two sets of this size differ in more bits than 64 parities tell.
LONG = 64
#: Of so many tokens at either end of its prefix a line meets early lines in the first pass.
STARS = 2
#: The early lines of a token are the earliest one of each of so many parts, dealt by a hash.
LEADERS = 4
#: So many of the early lines whose parities are nearest to a line's are verified.
GUESSES = 2
#: Rows of ids and hashes that are broadcast (about 50 bytes each); more rows are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    """Marked for broadcasting if it is counted to have few rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))


def _split(texts: DataFrame) -> DataFrame:
    """``d, i, line``: all lines as they are, numbered from 0 in their document."""
    return texts.select("d", F.posexplode(F.split("t", "\n")).alias("i", "line"))


def _spaced(text: Column) -> Column:
    """White space within lines as spaces; lines with no other sort are left as they are."""
    other = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    return F.when(other, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _tokens(line: Column) -> Column:
    return F.split(F.lower(_spaced(line)), " ")


def _hashed(texts: DataFrame) -> DataFrame:
    """``d, i, h1, h2, s``: lines with a token, two hashes of their text and those of their distinct tokens."""
    lines = _split(texts).filter(F.trim("line", F.lit(" \t\x0b\x0c\r")) != "")
    tokens = F.array_remove(F.array_distinct(F.transform(_tokens(F.col("line")), _hash)), _hash(F.lit("")))
    return lines.select("d", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), tokens.alias("s"))


def _rarity(lines: DataFrame) -> DataFrame:
    """One row, ``classes array<bigint>`` of ``BUCKETS`` numbers: by bucket of token hashes, a frequency class (of the
    number of lines that hold them), in the top byte."""
    spark = lines.sparkSession
    counts = lines.select(F.explode("s").alias("w")).groupBy(_bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))
    counts = counts.unionByName(every).groupBy("b").agg(F.sum("n").alias("n"))
    cls = F.least(F.floor(F.log2(F.greatest("n", F.lit(1)).cast("double")) * 3), F.lit(120))
    cls = F.shiftleft(cls.cast("long"), 56)
    low = F.col("b").bitwiseAND(1023)
    rows = counts.groupBy(F.shiftright("b", 10).alias("hi")).agg(F.array_sort(F.collect_list(F.struct(low.alias("lo"), cls.alias("c")))).alias("cells"))
    rows = rows.select("hi", F.col("cells.c").alias("c"))
    return rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("hi", "c"))).alias("r")).select(F.flatten("r.c").alias("classes"))  # BUCKETS / 1024 rows


def _hash(word: Column) -> Column:
    """56 bits."""
    return F.shiftrightunsigned(F.xxhash64(word), 8)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _keys(hashes: Column, classes: Column) -> Column:
    """Keys of distinct tokens, rare ones first: frequency class in the top byte, hash in the rest."""
    cls = lambda h: F.coalesce(F.get(classes, _bucket(h)), F.lit(0).cast("long"))  # noqa: E731  arrays without nulls are sorted as plain numbers
    return F.sort_array(F.transform(hashes, lambda h: cls(h).bitwiseOR(h)))


def _parities(keys: Column) -> Column:
    """64 bits, each the parity of the number of tokens whose hash falls on it: two sets differ in as many tokens at
    least as their parities in bits."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit(k)))


def _halves(keys: Column) -> Column:
    """The parities of those tokens of a long line whose hash has a further bit, else 0. With :func:`_parities` they
    give the parities of the other tokens too."""
    bit = lambda k: F.call_function("shiftleft", F.shiftright(k, 6).bitwiseAND(1), k.bitwiseAND(63).cast("int"))
    odd = F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit(k)))
    return F.when(F.size(keys) >= LONG, odd).otherwise(F.lit(0).cast("long"))


def _alike(t: float) -> Column:
    """The length filter on two sizes; it loses no pair of similarity ``t``."""
    return (F.col("n1") >= F.col("n2") * t - 1e-9) & (F.col("n2") >= F.col("n1") * t - 1e-9)


def _prefix(n: Column, t: float) -> Column:
    return n - F.ceil(n * F.lit(t) - 1e-9).cast("int") + 1


def _marks(k: Column, t: float) -> Column:
    """Of a line's keys: their number, the parities and the prefix. Made within a generator, so that the keys are made
    once and not for each mark."""
    return F.struct(F.size(k).alias("n"), _parities(k).alias("b"), _halves(k).alias("h"), F.slice(k, F.lit(1), _prefix(F.size(k), t)).alias("pre"))


def later_matches(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d, i``: document and number (from 0) of every line that equals, or has a Jaccard similarity of ``threshold``
    or more with, a line that comes before it in the order of (id, line number), whether that one goes or stays.

    Blank lines never match. Rows with a null id or text have no part; of rows that share an id, lines of the same
    number are alike in place, so equal ones count once. A long text is many lines and a long line one row; nothing of
    either is cut. No row gives no row.
    """
    t = float(threshold)
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    place = F.struct("d", "i")
    lines = written(_hashed(texts), "line-tokens")
    hashed = lines.select("d", "i", "h1", "h2")
    twice = written(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "repeated-lines")
    again = _few(written(hashed.join(_few(twice), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(place).alias("first")), "first-lines"))
    seen = lines.join(again, ["h1", "h2"], "left")

    # The postings of lines that are the first of their text; other lines have a row without a key.
    head = F.col("first").isNull() | (place == F.col("first"))
    classes = written(_rarity(lines), "rarity")
    keyed = seen.withColumn("classes", classes.scalar()).select("d", "i", F.when(head, _keys(F.col("s"), F.col("classes"))).alias("keys"))
    marked = keyed.select("d", "i", F.inline(F.transform(F.array("keys"), lambda k: _marks(k, t))))
    # A token of class 0 is in one line alone, so that no line can meet another in it.
    posts = marked.select("d", "i", "n", "b", "h", F.posexplode_outer("pre").alias("p", "k")).filter(F.col("k").isNull() | (_class(F.col("k")) > 0))
    both = written(posts, "postings")
    forget(spark, lines)
    same = written(both.filter("k IS NULL").select("d", "i"), "repeats")
    posts = both.filter("k IS NOT NULL")
    forget(spark, classes)

    # First pass: against a few early lines of some of the line's tokens, the rarest and, since copies differ in rare
    # words, the last ones of its prefix. Lines of one family of copies go here, a few comparisons each, however many
    # they are; what is no copy of those lines waits for the second pass.
    gone = _verified(_guesses(posts, t), texts, t)

    # Second pass: the lines that are left, against all earlier lines, in narrow rows: size and place are one number,
    # below 0 where the line is gone. Both sides of the join on tokens that are not hot read one exchange.
    size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("p").cast("long"))
    held = posts.join(_few(gone.withColumn("g", F.lit(True))), ["d", "i"], "left").select("k", "d", "i", "b", "h", F.when(F.col("g"), -size).otherwise(size).alias("np"))
    cold, hot = held.filter(_class(F.col("k")) < HOT), held.filter(_class(F.col("k")) >= HOT)
    parts = F.call_function("shiftleft", F.lit(1), F.floor((_class(F.col("k")) - HOT) / 3).cast("int"))
    split = [hot.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), hot.withColumn("part", F.pmod(F.xxhash64("d", "i"), parts).cast("int"))]
    pairs = _meet(cold, cold, ["k"], t).unionByName(_meet(*split, ["k", "part"], t))
    pairs = written(pairs.groupBy("d1", "i1", "d2", "i2").agg(F.count("*").alias("c")), "line-pairs")
    forget(spark, both)
    # The likeliest pair of each line first, then the others of the lines that are still there.
    likely = pairs.groupBy("d2", "i2").agg(F.max(F.struct("c", "d1", "i1")).alias("s")).select(F.col("s.d1").alias("d1"), F.col("s.i1").alias("i1"), "d2", "i2")
    more = _verified(likely, texts, t)
    rest = pairs.join(more.select(F.col("d").alias("d2"), F.col("i").alias("i2")), ["d2", "i2"], "left_anti").join(likely, ["d1", "i1", "d2", "i2"], "left_anti")
    last = _verified(rest.select("d1", "i1", "d2", "i2"), texts, t)
    forget(spark, pairs)
    return same.unionByName(gone).unionByName(more).unionByName(last).distinct()


def _guesses(posts: DataFrame, t: float) -> DataFrame:
    """``d1, i1, d2, i2``: for each line the early lines, ``GUESSES`` at most, that parities say are nearest to it."""
    ends = posts.filter((F.col("p") < STARS) | (F.col("p") >= _prefix(F.col("n"), t) - STARS)).select("k", "d", "i", "n", "b")
    # Sent once, for the early lines and for all: where no null is left, neither side gets a filter of its own.
    rare = ends.filter(" AND ".join(f"{c} IS NOT NULL" for c in ends.columns)).repartition("k")
    part = F.pmod(F.xxhash64("d", "i"), F.lit(LEADERS)).cast("int")
    # A line of the same document may lend its marks to another one; this costs a guess and no match.
    leaders = rare.groupBy("k", part.alias("part")).agg(F.min("d").alias("d1"), *[F.min_by(c, "d").alias(f"{c}1") for c in ("i", "n", "b")]).drop("part")
    two = rare.select("k", *[F.col(c).alias(f"{c}2") for c in ("d", "i", "n", "b")])
    apart = F.bit_count(F.col("b1").bitwiseXOR(F.col("b2")))
    near = two.join(leaders, "k").filter("d1 < d2 OR (d1 = d2 AND i1 < i2)").filter(_alike(t) & (apart <= F.col("n1") + F.col("n2") - 2 * _least(t)))
    near = near.groupBy("d2", "i2").agg(F.collect_set(F.struct((apart / (F.col("n1") + F.col("n2"))).alias("a"), "d1", "i1")).alias("s"))  # 2 * STARS * LEADERS at most
    return near.select("d2", "i2", F.inline(F.slice(F.array_sort("s"), 1, GUESSES))).select("d1", "i1", "d2", "i2")


def _class(key: Column) -> Column:
    return F.shiftrightunsigned(key, 56).cast("int")


def _least(t: float) -> Column:
    """The overlap that a pair of sizes ``n1, n2`` needs."""
    return (F.col("n1") + F.col("n2")) * (t / (1 + t)) - 1e-9


def _unpacked(df: DataFrame) -> DataFrame:
    size = {f"n{j}": F.shiftright(F.abs(f"np{j}"), 32).cast("int") for j in (1, 2)}
    return df.withColumns(size | {f"p{j}": F.abs(f"np{j}").bitwiseAND((1 << 32) - 1).cast("int") for j in (1, 2)})


def _meet(a: DataFrame, b: DataFrame, on: list[str], t: float) -> DataFrame:
    """``d1, i1, d2, i2`` of postings that meet under the filters, the second line later and not gone; a pair that can reach
    ``t`` comes out at the first token that it shares, and at few others."""
    one = a.select(*on, *[F.col(c).alias(f"{c}1") for c in ("d", "i", "np", "b", "h")])
    two = b.select(*on, *[F.col(c).alias(f"{c}2") for c in ("d", "i", "np", "b", "h")])
    got = one.join(two, on)
    # Most pairs end here: a looser form of the last filter below, on the size of one line alone.
    got = got.filter(F.bit_count(F.col("b1").bitwiseXOR(F.col("b2"))) <= F.shiftright(F.abs("np1"), 32) * F.lit((1 - t) / t) + 1e-6)
    got = got.filter("d1 < d2 OR (d1 = d2 AND i1 < i2)")
    # In terms of both sides, so that it stays in the join and the two sides are alike: the second line is not gone.
    got = _unpacked(got.filter((F.col("np2") >= 0) | (F.col("d1") > F.col("d2"))))
    whole, half = F.col("b1").bitwiseXOR(F.col("b2")), F.col("h1").bitwiseXOR(F.col("h2"))
    apart = F.when(F.least("n1", "n2") >= LONG, F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))).otherwise(F.bit_count(whole))
    # The first token that a pair shares has all of the overlap at and after it, in either line: later tokens that leave
    # too few say nothing of the pair, and a pair that meets in such tokens alone is none.
    rest = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    got = got.filter(_alike(t) & (rest >= _least(t)) & (apart <= F.col("n1") + F.col("n2") - 2 * _least(t)))
    return got.select("d1", "i1", "d2", "i2")


def _verified(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """``d, i`` of the later lines of the pairs whose real tokens have the similarity ``t``; written."""
    spark = texts.sparkSession
    pairs = written(pairs, "candidates")
    named = pairs.select(F.col("d1").alias("d"), F.col("i1").alias("i")).unionByName(pairs.select(F.col("d2").alias("d"), F.col("i2").alias("i"))).distinct()
    named = written(named, "candidate-places")
    held = texts.join(_few(named.select("d").distinct()), "d", "left_semi")  # other texts are not split
    found = _split(held).join(_few(named), ["d", "i"], "left_semi")
    lines = written(found.select("d", "i", F.array_remove(F.array_distinct(_tokens(F.col("line"))), "").alias("s")), "candidate-lines")
    one, two = (lines.select(*[F.col(c).alias(f"{c}{j}") for c in ("d", "i", "s")]) for j in (1, 2))
    sets = pairs.join(one, ["d1", "i1"]).join(two, ["d2", "i2"])
    # both >= t * (all of the two sets), with what they share named once
    true = sets.filter(F.size(F.array_intersect("s1", "s2")) * F.lit(1 + t) >= (F.size("s1") + F.size("s2")) * F.lit(t) - 1e-9)
    true = written(true.select(F.col("d2").alias("d"), F.col("i2").alias("i")).distinct(), "matches")
    forget(spark, pairs)
    forget(spark, lines)
    return true


def _removed(docs: DataFrame, threshold: float, id_col: str, text_col: str, key: str, value: str) -> DataFrame:
    gone = later_matches(docs, threshold, id_col, text_col)
    return gone.groupBy(F.col("d").alias(key)).agg(F.sort_array(F.collect_list("i")).alias(value))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every later match cut out of its text; all rows and other columns stay. A null text stays null, a
    row with a null id as it is; rows that repeat an id lose the same line numbers."""
    d, out = inside(docs, "d", "gone")
    gone = _removed(docs, threshold, id_col, text_col, d, out)
    lines = F.split(text_col, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out))
    cut = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    got = docs.join(gone, F.col(id_col) == F.col(d), "left")
    return got.withColumn(text_col, F.when(F.col(out).isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)


def annotate_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_lines, n_removed, removed`` (line numbers from 0, ascending)."""
    gone = _removed(docs, threshold, id_col, text_col, "d", "gone")
    breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n"))
    got = base.join(gone, F.col("id") == F.col("d"), "left")
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return got.select(F.col("id").alias(id_col), F.greatest("n", F.lit(0)).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = annotate_lines(table(spark, sf_dir, "documents"))
    return got.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))
