"""Token-id files by a static range asymmetric numeral system (rANS) with one frequency table for all blocks.

A folder holds two tables. ``frequencies`` is the shared table: symbols, and their shares of 2**scale. ``blocks`` has
one row for each block of whole documents: the number of the first token in the corpus, the documents' ids and
lengths, and the coded tokens. Token i of a block belongs to lane i mod LANES; lanes share one stream of 32-bit words.
Every CHECKPOINT tokens the lanes' states and the place in the stream are stored, so that a reader may start there.
Checksums cover the stored bytes and the ids. Blocks are independent, so they are written and read in parallel.

Defined cases: a null text is empty and has the end id alone; null document ids come first; rows repeated or with the
same id follow one another, by text; a text longer than a block gets a block of its own; an empty table gives an
empty file; other columns are ignored. Memory of a task: one block, its longest document at least.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, tidy
from .tokens import GROUP, encoder

MAGIC = b"RANS0001"
HEADER = struct.Struct("<8sQIIIIII")  # magic, tokens, lanes, checkpoint steps, checkpoints, words, crc of ids, crc of the rest
LANES, CHECKPOINT, BLOCK_TOKENS = 1024, 1 << 18, 1 << 19
LOW = 1 << 31


def scaled(counts: np.ndarray, scale: int) -> np.ndarray:
    """Shares of 2**scale, at least 1 for each symbol; what rounding leaves over goes to or comes from the largest."""
    total = int(counts.sum())
    shares = np.maximum(1, (counts.astype(object) * (1 << scale) // total).astype(np.int64)) if total else np.zeros(0, np.int64)
    order = np.argsort(-shares, kind="stable")
    excess = int(shares.sum()) - (1 << scale)
    if len(shares) and excess < 0:
        shares[order[0]] -= excess
    for i in order:
        if excess <= 0:
            break
        take = min(excess, int(shares[i]) - 1)
        shares[i] -= take
        excess -= take
    return shares


def scale_of(n_symbols: int) -> int:
    return min(28, max(16, int(n_symbols).bit_length() + 4))


class Coder:
    """Encodes and decodes blocks with a shared table of symbols and shares."""

    def __init__(self, symbols: np.ndarray, shares: np.ndarray, scale: int):
        self.scale = scale
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.share, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.share[symbols] = shares
        self.start[symbols] = np.cumsum(shares) - shares
        self.symbol_at = np.repeat(symbols, shares).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> bytes:
        n, k = len(ids), np.uint64(self.scale)
        share, start = self.share[ids], self.start[ids]
        state, words, marks, sent = np.full(LANES, LOW, np.uint64), [], [], 0
        each, half, low = CHECKPOINT // LANES, np.uint64(32), np.uint64(0xFFFFFFFF)
        room = np.uint64(63 - self.scale)
        for step in range(-(-n // LANES) - 1, -1, -1):
            f, c = share[step * LANES : (step + 1) * LANES], start[step * LANES : (step + 1) * LANES]
            x = state[: len(f)]
            full = (x >> room) >= f
            if full.any():
                out = x[full]
                words.append((out & low).astype("<u4"))
                sent += len(out)
                x[full] = out >> half
            q = x // f
            state[: len(f)] = (q << k) + (x - q * f) + c
            if step % each == 0 and step:
                marks.append((sent, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        marks = [(sent - s, x) for s, x in marks[::-1]]
        body = state.astype("<u8").tobytes() + b"".join(struct.pack("<Q", s) + x.astype("<u8").tobytes() for s, x in marks) + stream.tobytes()
        return HEADER.pack(MAGIC, n, LANES, each, len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
        """The ids of a block; first: the number of a checkpoint to start from, count: of checkpoints to read."""
        magic, n, lanes, each, n_marks, n_words, crc_ids, crc = HEADER.unpack_from(block)
        view = memoryview(block)[HEADER.size :]
        if magic != MAGIC or zlib.crc32(view) != crc:
            raise ValueError("a block's bytes do not match their checksum")
        mark = 8 + 8 * lanes
        stream = np.frombuffer(view, "<u4", n_words, 8 * lanes + n_marks * mark)
        at, state = 0, np.frombuffer(view, "<u8", lanes).astype(np.uint64)
        if first:
            place = 8 * lanes + (first - 1) * mark
            at, state = struct.unpack_from("<Q", view, place)[0], np.frombuffer(view, "<u8", lanes, place + 8).astype(np.uint64)
        steps, stop = -(-n // lanes), n
        if count is not None:
            steps = min(steps, (first + count) * each)
            stop = min(n, steps * lanes)
        out = np.empty(max(0, stop - first * each * lanes), np.uint32)
        k, mask, half, low = np.uint64(self.scale), np.uint64((1 << self.scale) - 1), np.uint64(32), np.uint64(LOW)
        done = 0
        for step in range(first * each, steps):
            x = state[: min(lanes, n - step * lanes)]
            slot = x & mask
            ids = self.symbol_at[slot]
            y = self.share[ids] * (x >> k) + slot - self.start[ids]
            short = np.flatnonzero(y < low)
            if len(short):
                y[short] = (y[short] << half) | stream[at : at + len(short)]
                at += len(short)
            state[: len(x)] = y
            out[done : done + len(ids)] = ids
            done += len(ids)
        if not first and stop == n and zlib.crc32(out.astype("<u4").tobytes()) != crc_ids:
            raise ValueError("a block's ids do not match their checksum")
        return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about GROUP bytes of text, at least one row each, so that a task does not hold the ids of a whole batch."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, side="right")))
        yield batch.slice(at, to - at)
        at = to


def staged_tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of whole documents in ascending order of their ids, and a histogram of the ids for each partition."""
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("symbols", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def tokenize(batches):
        encode, part = encoder(path).encode_many, TaskContext.get().partitionId()
        start, keys, lengths, parts, size, histogram = 0, [], [], [], 0, np.zeros(0, np.int64)
        end = np.asarray([end_id], np.uint32)

        def row(**values):
            return pa.RecordBatch.from_pylist([values], schema=schema)

        def block():
            nonlocal histogram
            ids = np.concatenate(parts)
            seen = np.bincount(ids, minlength=len(histogram))
            seen[: len(histogram)] += histogram
            histogram = seen
            return row(part=part, start=start, n=size, doc_ids=keys, lengths=lengths, ids=ids.astype("<u4", copy=False).tobytes())

        for batch in batches:
            for some in slices(batch):
                for key, ids in zip(some["doc_id"].to_pylist(), encode([t or "" for t in some["text"].to_pylist()]), strict=True):
                    keys.append(key)
                    lengths.append(len(ids) + 1)
                    parts += (ids, end)
                    size += len(ids) + 1
                    if size >= BLOCK_TOKENS:
                        yield block()
                        start, keys, lengths, parts, size = start + size, [], [], [], 0
        if keys:
            yield block()
        if found := np.flatnonzero(histogram).tolist():
            yield row(part=part, n=0, symbols=found, counts=histogram[found].tolist())
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(tokenize, "part int, start long, n long, doc_ids array<long>, lengths array<long>, ids binary, symbols array<long>, counts array<long>")


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Encodes whole texts with the vocabulary file at path, end_id after each document, into the two tables of folder."""
    scratch = Scratch(spark, "tokens")
    staged = scratch.write(staged_tokens(docs, path, end_id), "staged")
    tidy(spark)
    base, total = {}, 0
    for r in sorted(staged.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base[r.part] = total
        total += r.n
    counts = staged.filter("symbols is not null").select(F.explode(F.arrays_zip("symbols", "counts")).alias("x")).groupBy("x.symbols").agg(F.sum("x.counts").alias("n")).collect()
    counts = sorted((r.symbols, r.n) for r in counts)
    symbols, shares = np.asarray([s for s, _ in counts], np.int64), np.asarray([n for _, n in counts], np.int64)
    scale = scale_of(len(symbols))
    shares = scaled(shares, scale)
    table = [(scale, symbols.astype("<u4").tobytes(), shares.astype("<u4").tobytes(), total)]
    spark.createDataFrame(table, "scale int, symbols binary, shares binary, n_tokens long").coalesce(1).write.parquet(f"{folder}/frequencies")

    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])

    def encode(batches):
        coder = Coder(symbols, shares, scale)
        for batch in batches:
            for i in range(len(batch)):
                part = batch["part"][i].as_py()
                data = coder.encode(np.frombuffer(batch["ids"][i].as_buffer(), "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([base[part] + batch["start"][i].as_py()], pa.int64()), batch["doc_ids"].slice(i, 1), batch["lengths"].slice(i, 1), pa.array([data], pa.binary())], schema=schema)

    blocks = staged.filter("ids is not null").select("part", "start", "doc_ids", "lengths", "ids")
    blocks.mapInArrow(encode, "part int, start long, doc_ids array<long>, lengths array<long>, data binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    scratch.drop("staged")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    table = spark.read.parquet(f"{folder}/frequencies").first()
    scale, symbols, shares = table.scale, np.frombuffer(table.symbols, "<u4").astype(np.int64), np.frombuffer(table.shares, "<u4").astype(np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches):
        coder = Coder(symbols, shares, scale)
        for batch in batches:
            for i in range(len(batch)):
                ids = coder.decode(batch["data"][i].as_buffer()).astype("<u4", copy=False)
                lengths = np.asarray(batch["lengths"][i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                offsets = np.concatenate([[0], 4 * ends])
                if offsets[-1] < 2**31:
                    column = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                else:
                    column = pa.array([ids[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_ids"][i].values.cast(pa.int64()), pa.array(batch["start"][i].as_py() + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), column], schema=schema)

    blocks = spark.read.parquet(f"{folder}/blocks").select("start", "doc_ids", "lengths", "data")
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def stored_tokens(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the documents' tokens into the shared folder and reads them back."""
    folder = Scratch(spark, "token-files").path
    write_tokens(spark, docs, folder, path, end_id)
    tidy(spark)
    return read_tokens(spark, folder)
