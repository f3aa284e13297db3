"""Token-ID output in training order.

1. Texts become token ids of a given vocabulary file; each document ends with ``end_id``. Documents are dealt by a hash
   into packing blocks, whose number follows from the texts' total length; a block's documents, in the order of their
   ids, are one stream, cut into sequences of ``seq_len`` ids. The last sequence of a block is padded with ``pad_id``.
2. Sequences are numbered 0..N-1 by block and place. A keyed Feistel permutation of the next power of four, walked
   along its cycle until it falls below N, gives every sequence its slot in the training order: no sort on a random
   column, no table of slots, and any slot can be computed from its number alone.
3. Ranges of slots are shards. A shard is one row whose ``payload`` holds its sequences at a fixed stride, so that a
   reader goes to shard ``slot // per_shard`` and offset ``slot % per_shard * stride`` and can resume anywhere.

Streams are packed and shards filled row by row, so memory is bounded by a document and a shard.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecohort.functions.scratch import written
from wavecohort.llm.common import mix64, table

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the vocabulary's texts are cut before merging (a fixed value that belongs to the file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
SEQ_LEN, PER_SHARD = 2048, 256
CHARS_PER_BLOCK, MAX_BLOCKS = 8_000_000, 100_000
_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a ``.tiktoken`` file, made once in each worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode(text: str, path: str) -> list[int]:
    return encoder(path).encode_ordinary(text)


# --- the permutation ------------------------------------------------------------------------------------------------


def _rounds(x: np.ndarray, half: int, key: int, forward: bool, rounds: int = 6) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    a, b = x >> h, x & mask
    for r in range(rounds) if forward else reversed(range(rounds)):
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64)
        if forward:
            a, b = b, a ^ (mix64(b + salt) & mask)
        else:
            a, b = b ^ (mix64(a + salt) & mask), a
    return (a << h) | b


def permuted(x: np.ndarray, n: int, key: int, forward: bool = True) -> np.ndarray:
    """The slot of each sequence number below ``n`` (or, backwards, the number in each slot)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _rounds(np.asarray(x, np.uint64), half, key, forward)
    while len(out) and (out >= n).any():
        over = out >= np.uint64(n)
        out[over] = _rounds(out[over], half, key, forward)
    return out.astype(np.int64)


# --- the jobs -------------------------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``id, h, ids``: the token ids of each row, with ``end_id`` at the end, as 32-bit numbers in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [np.array([*encode(t or "", path), end_id], np.uint32).tobytes() for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["id", "h", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, h long, ids binary")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, path: str = VOCABULARY, end_id: int = END_ID, pad_id: int | None = None) -> DataFrame:
    """``block, place, n, payload``: sequences of ``seq_len`` ids of 16 bits (32 if an id needs it), ``n`` of them not
    padding. A null or empty text gives its end id alone; rows with a null id come first in their block; repeated rows
    are packed one after another; an empty table gives no sequence."""
    chars = docs.agg(F.sum(F.length(text_col)).alias("c"), F.count("*").alias("n")).first()
    blocks = int(min(MAX_BLOCKS, max(1, -(-((chars["c"] or 0) + chars["n"]) // CHARS_PER_BLOCK))))
    pad = end_id if pad_id is None else pad_id
    kind = np.uint16 if max(end_id, pad) < 2**16 else np.uint32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, held, size = None, 0, [], 0

        def cut(rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal place, held, size
            stream = np.concatenate(held) if held else np.zeros(0, np.uint32)
            full = len(stream) // seq_len
            rows = [stream[i * seq_len : (i + 1) * seq_len] for i in range(full)]
            stream = stream[full * seq_len :]
            if rest and len(stream):
                rows.append(stream)
                stream = stream[:0]
            held, size = [stream.copy()], len(stream)
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                whole = [np.concatenate([r, np.full(seq_len - len(r), pad, np.uint32)]).astype(kind).tobytes() for r in part]
                places = np.arange(place, place + len(part))
                place += len(part)
                yield pa.record_batch(
                    [pa.array(np.full(len(part), block), pa.int32()), pa.array(places, pa.int64()), pa.array([len(r) for r in part], pa.int32()), pa.array(whole, pa.binary())],
                    names=["block", "place", "n", "payload"],
                )

        for batch in batches:
            for b, ids in zip(batch.column("block").to_pylist(), batch.column("ids"), strict=True):
                if b != block:
                    if block is not None:
                        yield from cut(True)
                    block, place, held, size = b, 0, [], 0
                held.append(np.frombuffer(ids.as_buffer(), np.uint32))
                size += len(held[-1])
                if size >= 64 * seq_len:
                    yield from cut(False)
        if block is not None:
            yield from cut(True)

    tokens = tokenized(docs, id_col, text_col, path, end_id)
    rows = tokens.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int"))
    rows = rows.repartition("block").sortWithinPartitions("block", "id", "h").select("block", "ids")
    return rows.mapInArrow(pack, "block int, place long, n int, payload binary")


def training_order(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = 2024, path: str = VOCABULARY, end_id: int = END_ID, pad_id: int | None = None
) -> DataFrame:
    """``shard, first_slot, n_sequences, n_tokens, stride, sha256, payload``: the shards of the training order. All but
    the last hold ``per_shard`` sequences; ``n_tokens`` leaves padding out."""
    spark = docs.sparkSession
    rows = written(packed(docs, id_col, text_col, seq_len, path, end_id, pad_id), "sequences")
    counts = rows.groupBy("block").agg(F.count("*").alias("m"))  # MAX_BLOCKS rows at most
    offsets = counts.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("before"))
    total = int(rows.count())
    wide = 2 if max(end_id, end_id if pad_id is None else pad_id) < 2**16 else 4

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permuted(batch.column("number").to_numpy(), total, key)
            yield pa.record_batch([pa.array(slot // per_shard), pa.array(slot), batch.column("n"), batch.column("payload")], names=["shard", "slot", "n", "payload"])

    numbered = rows.join(F.broadcast(offsets), "block").select((F.col("before") + F.col("place")).alias("number"), "n", "payload")
    placed = numbered.mapInArrow(slots, "shard long, slot long, n int, payload binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(parts, "shard").sortWithinPartitions("shard", "slot")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tokens = None, [], 0

        def one() -> pa.RecordBatch:
            data = b"".join(held)
            return pa.record_batch(
                [pa.array([shard], pa.int64()), pa.array([shard * per_shard], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([tokens], pa.int64()), pa.array([seq_len * wide], pa.int32()), pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())],
                names=["shard", "first_slot", "n_sequences", "n_tokens", "stride", "sha256", "payload"],
            )

        for batch in batches:
            for s, n, p in zip(batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if s != shard:
                    if held:
                        yield one()
                    shard, held, tokens = s, [], 0
                held.append(p)
                tokens += n
        if held:
            yield one()

    return placed.mapInArrow(fill, "shard long, first_slot long, n_sequences int, n_tokens long, stride int, sha256 string, payload binary")


def write_shards(shards: DataFrame, path: str) -> None:
    """Shards as Parquet, by ranges of slots; Spark's committer leaves no half-written file of a lost task."""
    shards.write.parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, n: int, per_shard: int = PER_SHARD, bits: int = 16) -> list[np.ndarray]:
    """``n`` sequences from a slot on: a reader that resumes. Only their shards are read."""
    rows = spark.read.parquet(path).filter(F.col("shard").between(slot // per_shard, (slot + n - 1) // per_shard)).orderBy("shard")
    out = []
    for r in rows.toLocalIterator():
        for i in range(r["n_sequences"]):
            if slot <= r["first_slot"] + i < slot + n:
                out.append(np.frombuffer(r["payload"][i * r["stride"] : (i + 1) * r["stride"]], np.uint16 if bits == 16 else np.uint32))
    return out


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"))
