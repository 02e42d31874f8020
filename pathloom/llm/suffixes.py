"""Removal of repeated passages by a distributed difference-cover suffix sort over a locally parsed text.

A passage is a string of ``length`` bytes that also starts anywhere else. Texts are parsed at anchors: the k-gram with
the smallest hash in each window of ``window`` k-grams (the rightmost of equals). The bytes from an anchor to the end
of the next anchor's k-gram are a symbol. Every string of ``length`` bytes has one anchor of its own, that of the
window it starts with; equal strings have the same anchor at the same place, and the same symbols after it. So
repeated strings are found among anchors whose following symbols agree:

1. Symbols that occur once end a match; what is left are runs of repeated symbols.
2. Suffixes of the runs are sorted by the difference cover {1, 2} modulo 3: distinct triples of symbols at sampled
   places are sorted and named, the names make shorter runs that are sorted in the same way, and the remaining
   suffixes are merged in by their first symbol and the rank that follows. Recursion ends when a name covers as many
   symbols as any anchor needs, a constant of the parameters.
3. Adjacent suffixes are compared on the symbols that an anchor's strings have in common; equal ones form a class.
4. Within a class, anchors whose whole surroundings are equal repeat all their strings. Surroundings that occur once
   in a class with others are resolved string by string.

Strings may be of words instead of bytes: then a text is the sequence of its words' 64-bit hashes, white space does not count,
and the rest is the same. Both lengths may be given; what is removed is then what either removes, both judged on the input.

All steps exchange packed arrays of distinct values between chunks of documents and buckets of values, so a passage
with thousands of copies costs a chunk one entry. Symbols, surroundings and strings are compared by 64-bit XXH3.

Defined cases: a null text is empty; texts shorter than ``length`` have no strings and stay whole; repeated rows are
documents of their own, and repeat each other; null ids are kept; an empty table gives no rows; other columns are
ignored. Whole texts are read, as UTF-8 bytes; strings never cross documents and are judged on the input. A text of any
length is parsed in one piece, at some 80 bytes of memory a byte while it is; runs of one byte, or of a short period, have
an anchor at every period, so a text of many millions of blanks costs far more than prose of its length.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import Scratch, pack, release, tidy, unpack

LENGTH, GRAM, WINDOW = 400, 32, 128
CHUNK_BYTES, BATCH_BYTES = 8 << 20, 1 << 18
#: Buckets hold about so many bytes' anchors; at least LEAST buckets.
BUCKET_BYTES, LEAST = 16 << 20, 64
#: The same for strings of words: with these, strings of 49 words and more.
WORD_GRAM, WORD_WINDOW = 4, 23
ROWS = "bucket long, chunk long, data binary"
#: Low bits of a k-gram's ordering value hold its place, the others its hash.
PLACE_BITS = 40


def freeze(value) -> bytes:
    """A value of plain Python and arrays as bytes; arrays are packed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(packed(value), protocol=5))


def thaw(data):
    import zstandard

    return unpacked(pickle.loads(zstandard.ZstdDecompressor().decompress(data)))


class Packed:
    def __init__(self, values: np.ndarray):
        self.shape, self.data = values.shape, pack(values)


def packed(v):
    if isinstance(v, np.ndarray):
        return Packed(v) if v.dtype.kind in "iu" and v.size else v
    if isinstance(v, dict):
        return {k: packed(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return type(v)(packed(x) for x in v)
    return v.mapped(packed) if isinstance(v, Runs) else v


def unpacked(v):
    if isinstance(v, Packed):
        return unpack(v.data).reshape(v.shape)
    if isinstance(v, dict):
        return {k: unpacked(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return type(v)(unpacked(x) for x in v)
    return v.mapped(unpacked) if isinstance(v, Runs) else v


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, ends: np.ndarray, gram: int, window: int, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of documents that lie one after another in data: places, and the first and last start of the windows they are the anchor of. Places count units of width bytes, 1 or 8."""
    n = len(data) // width
    if n < gram + window - 1:
        return (np.zeros(0, np.int64),) * 3
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    units = table[np.frombuffer(data, np.uint8)] if width == 1 else mixed(np.frombuffer(data, np.uint64))
    h, covered, factor = units, 1, np.uint64(0x9E3779B97F4A7C15)
    while covered < gram:  # a k-gram's hash from those of its parts
        step = min(covered, gram - covered)
        h = h[: len(h) - step] * factor + h[step:]
        covered += step
        factor = factor * factor + np.uint64(2)
    h = mixed(h)
    places = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    h = (h & ~low) | (low - (places & low))  # of equal hashes the rightmost is smallest
    covered = 1
    while covered < window:
        step = min(covered, window - covered)
        h = np.minimum(h[: len(h) - step], h[step:])
        covered += step
    starts = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(n + 1, np.int64)
    np.add.at(whole, starts, 1)
    np.add.at(whole, np.maximum(ends - (gram + window - 2), starts), -1)
    own = np.flatnonzero(np.cumsum(whole[: len(h)]) > 0)  # starts whose window lies in one document
    at = (low - (h[own] & low)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(at)]])[: len(new)] - 1
    return at[new], own[new], own[last]


def parsed(data: bytes, ends: np.ndarray, length: int, gram: int, window: int, width: int = 1) -> dict[str, np.ndarray]:
    """Anchors of some documents: place, lo and hi (first and last start of their strings; none if hi < lo), symbol, around (hash of all that their strings cover), need (symbols that their strings have in common), doc."""
    import xxhash

    place, lo, hi = anchors(data, ends, gram, window, width)
    doc = np.searchsorted(ends, place, side="right")
    end = ends[doc] if len(doc) else doc
    hi = np.minimum(hi, end - length)
    final = np.concatenate([doc[1:] != doc[:-1], [True]])[: len(doc)]
    to = np.where(final, np.minimum(place + gram, end), np.concatenate([place[1:], [0]])[: len(place)] + gram)
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
    symbol = np.fromiter((digest(view[a:b]) for a, b in zip((width * place).tolist(), (width * to).tolist(), strict=True)), np.uint64, len(place))
    around = np.fromiter((digest(view[width * a : width * (b + length)], p - a) if b >= a else 0 for a, b, p in zip(lo.tolist(), hi.tolist(), place.tolist(), strict=True)), np.uint64, len(place))
    common = length - window + 1
    need = np.searchsorted(place, np.minimum(place + common - window - gram, end - 1), side="right") - np.arange(len(place))
    return {"place": place, "lo": lo, "hi": hi, "symbol": np.maximum(symbol, 1), "around": around, "need": np.where(hi >= lo, np.maximum(need, 1), 0), "doc": doc}


def bodies(data: bytes, sizes: list[int]) -> list[bytes]:
    """The texts of a chunk."""
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [data[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def word_hashes(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The 64-bit hashes of the words of texts, one after another, and each text's end among them."""
    import xxhash

    words = [t.split() for t in texts]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*words)}
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.fromiter((known[w] for some in words for w in some), np.uint64, int(ends[-1]) if len(ends) else 0).tobytes(), ends


def word_chunks(chunks: DataFrame, made: Callable[[bytes, np.ndarray], object]) -> DataFrame:
    """Rows of an exchange: for each chunk what is made (frozen) of its words."""

    def read(batches):
        for batch in batches:
            for chunk, sizes, data in zip(*(batch[c].to_pylist() for c in ("chunk", "sizes", "text")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([chunk]), pa.array([freeze(made(*word_hashes(bodies(thaw(data), sizes))))])], names=["bucket", "chunk", "data"])
        release()

    return chunks.select("chunk", "sizes", "text").mapInArrow(read, ROWS)


def in_bytes(data: bytes, sizes: list[int], start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a chunk's words as runs of its bytes, with the white space up to the text's next word."""
    if not len(start):
        return start, stop
    b = np.frombuffer(data, np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(len(b) + 1, bool)  # words do not go on in the next text
    edge[np.cumsum(sizes)] = edge[0] = True
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    first = np.flatnonzero(word & (~before | edge[:-1]))
    last = np.flatnonzero(word & (~after | edge[1:])) + 1
    text = np.searchsorted(np.cumsum(sizes), first, side="right")
    follows = np.minimum(stop, len(first) - 1)
    goes_on = (stop < len(first)) & (text[follows] == text[stop - 1])
    return first[start], np.where(goes_on, first[follows], last[stop - 1])


def union_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that some intervals cover."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    if not len(a):
        return a, b
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[new], b[np.concatenate([new[1:] - 1, [len(b) - 1]])]


def chunks_of(docs: DataFrame, text: str, length: int, gram: int, window: int) -> DataFrame:
    """chunk, rows (the other columns, as a compressed Arrow stream), sizes, text (all bytes), anchors (frozen), n_bytes, need (most symbols that any anchor needs)."""

    def read(batches):
        part, number = TaskContext.get().partitionId(), 0
        rows, texts, found, held, base, size = [], [], [], [], 0, 0

        def parse():
            nonlocal base
            if held:
                data = b"".join(held)
                x = parsed(data, np.cumsum([len(t) for t in held]), length, gram, window)
                for name in ("place", "lo", "hi"):
                    x[name] = x[name] + base
                x["doc"] = x["doc"] + len(texts) - len(held)
                found.append(x)
                base += len(data)
                held.clear()

        def chunk():
            nonlocal number, base, size
            parse()
            x = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            sizes = [len(t) for t in texts]
            row = pa.RecordBatch.from_arrays([pa.array([(part << 32) | number]), pa.array([stored(rows)]), pa.array([sizes], pa.list_(pa.int64())), pa.array([freeze(b"".join(texts))]), pa.array([freeze(x)]), pa.array([sum(sizes)]), pa.array([int(x["need"].max(initial=0))])], names=["chunk", "rows", "sizes", "text", "anchors", "n_bytes", "need"])
            number, base, size = number + 1, 0, 0
            for v in (rows, texts, found):
                v.clear()
            return row

        for batch in batches:
            others, from_ = batch.select([i for i in range(batch.num_columns) if i != at]), 0
            for i, body in enumerate(batch.column(at)):
                body = (body.as_py() or "").encode()
                if held and (len(body) > BATCH_BYTES or sum(map(len, held)) > BATCH_BYTES):
                    parse()
                texts.append(body)
                held.append(body)
                size += len(body)
                if size >= CHUNK_BYTES:
                    rows.append(others.slice(from_, i + 1 - from_))
                    from_ = i + 1
                    yield chunk()
            if from_ < len(batch):
                rows.append(others.slice(from_))
        if texts:
            yield chunk()
        release()

    at = docs.columns.index(text)
    return docs.mapInArrow(read, "chunk long, rows binary, sizes array<long>, text binary, anchors binary, n_bytes long, need long")


def stored(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for b in batches:
            writer.write_batch(b)
    return sink.getvalue().to_pybytes()


def distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in lexicographic order, and each row's place among them."""
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return [c[new] for c in ordered], place


def bucket_of(values: np.ndarray, level: int, buckets: int) -> np.ndarray:
    """Buckets are ranges of values: of hashes at level 0, of names (bucket << 32 | number) above."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) if not level else values >> np.uint64(32)).astype(np.int64)


class Runs:
    """Strings of symbols of one level, one after another."""

    def __init__(self, values: np.ndarray, first: np.ndarray):
        self.values = values
        n = len(values)
        run = np.cumsum(first) - 1
        start = np.flatnonzero(first)
        self.at = np.arange(n) - start[run] if n else np.zeros(0, np.int64)
        self.left = (np.concatenate([start[1:], [n]])[run] - np.arange(n)) if n else np.zeros(0, np.int64)

    def mapped(self, f) -> Runs:
        """The same runs with f applied to their arrays."""
        out = Runs.__new__(Runs)
        out.values, out.at, out.left = f(self.values), f(self.at), f(self.left)
        return out

    def shifted(self, values: np.ndarray, by: int) -> np.ndarray:
        """The value so many places on; 0 beyond the end of a run."""
        out = np.zeros(len(values), np.uint64)
        if by < len(values):
            out[: len(values) - by] = values[by:]
        out[self.left <= by] = 0
        return out

    def sampled(self) -> np.ndarray:
        """Places of the difference cover: those at 1 modulo 3, then those at 2, each in order."""
        return np.concatenate([np.flatnonzero(self.at % 3 == 1), np.flatnonzero(self.at % 3 == 2)])

    def triples(self) -> list[np.ndarray]:
        at = self.sampled()
        return [self.shifted(self.values, d)[at] for d in range(3)]

    def named(self, names: np.ndarray) -> Runs:
        """The runs of the next level: each run's names at 1 modulo 3, and at 2."""
        at = self.sampled()
        return Runs(names, self.at[at] < 3)

    def merge_keys(self, ranks: np.ndarray) -> list[np.ndarray]:
        """For each place its class modulo 3, symbol, next symbol, and ranks that follow and are known, and its own."""
        full = np.zeros(len(self.values), np.uint64)
        full[self.sampled()] = ranks
        kind = (self.at % 3).astype(np.uint64)
        zero = np.uint64(0)
        one, two, following = self.shifted(full, 1), self.shifted(full, 2), self.shifted(self.values, 1)
        return [self.values, kind, np.where(kind == 1, zero, following), np.where(kind == 2, zero, one), np.where(kind == 1, zero, two), full]


def merged(kind, symbol, following, one, two, own) -> np.ndarray:
    """Order of distinct suffixes (equal at least as far as ranks tell): how many are smaller. Those at 0 modulo 3 compare with 1 by (symbol, rank), with 2 by (symbol, symbol, rank)."""
    out = np.zeros(len(kind), np.int64)
    zero, sampled = kind == 0, kind != 0

    def smaller(keys: list[np.ndarray], of: np.ndarray, among: np.ndarray) -> np.ndarray:
        _, code = distinct(*keys)
        return np.searchsorted(np.sort(code[among]), code[of], side="left")

    out[sampled] += smaller([own], sampled, sampled)
    out[zero] += smaller([symbol, one, two], zero, zero)
    for k, keys in ((1, [symbol, one]), (2, [symbol, following, two])):
        other = kind == k
        out[zero] += smaller(keys, zero, other)
        out[other] += smaller(keys, other, zero)
    return out


def classes(rank: np.ndarray, need: np.ndarray, prefixes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes (from 1) of suffixes that agree on the symbols they need: neighbours in the order of ranks are compared; 0 for a class with one member."""
    out = np.zeros(len(rank), np.int64)
    made = 0
    for m in np.unique(need).tolist():
        at = np.flatnonzero(need == m)
        at = at[np.argsort(rank[at], kind="stable")]
        p = prefixes[at, :m]
        number = np.cumsum(np.concatenate([[True], (p[1:] != p[:-1]).any(axis=1)])) - 1
        total = np.bincount(number, counts[at])
        out[at] = np.where(total[number] > 1, made + 1 + number, 0)
        made += int(number[-1]) + 1
    return out


class Exchange:
    """Rounds between chunks and buckets. A round's ask(state, replies) gives a chunk's new state and its requests by bucket; answer(bucket, requests) gives a reply to each request, in order."""

    def __init__(self, spark: SparkSession, scratch: Scratch, state: DataFrame, name: str = ""):
        self.spark, self.scratch, self.rounds, self.name = spark, scratch, 0, name
        self.state, self.replies = state, spark.createDataFrame([], ROWS)

    def round(self, ask: Callable, answer: Callable, text: DataFrame | None = None) -> None:
        """text: rows like the state's with the chunks' bytes, which the round's states hold as "text"."""
        plain = text is None

        def ask_all(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            replies = {r["bucket"]: thaw(r["data"]) for r in right.sort_by("bucket").to_pylist()}
            for r in left.to_pylist():
                state = thaw(r["data"]) if plain else replies.pop(-2) | {"text": thaw(r["data"])}
                state, requests = ask(state, replies)
                out.append((-1, r["chunk"], freeze(state)))
                out += [(b, r["chunk"], freeze(q)) for b, q in requests.items()]
            return rows_table(out)

        def answer_all(table: pa.Table) -> pa.Table:
            rows = table.sort_by("chunk").to_pylist()
            answers = answer(rows[0]["bucket"], [thaw(r["data"]) for r in rows]) if rows else []
            return rows_table([(r["bucket"], r["chunk"], freeze(a)) for r, a in zip(rows, answers, strict=True)])

        k = self.rounds = self.rounds + 1
        left, right = self.state, self.replies
        if not plain:  # bytes move once: the small state goes with the replies
            left, right = text, right.unionByName(left.withColumn("bucket", F.lit(-2).cast("long")))
        sent = self.scratch.write(left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(ask_all, ROWS), f"{self.name}sent{k}")
        self.state = sent.filter("bucket < 0")
        self.replies = self.scratch.write(sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(answer_all, ROWS), f"{self.name}replies{k}")
        self.drop(k - 1)
        tidy(self.spark)

    def drop(self, k: int) -> None:
        self.scratch.drop(f"{self.name}sent{k}")
        self.scratch.drop(f"{self.name}replies{k}")


def rows_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "chunk", "data"])


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
    """Rows that are ordered by bucket, cut at the buckets."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
    return {int(bucket[a]): [c[a:b] for c in columns] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def joined(replies: dict[int, np.ndarray], dtype) -> np.ndarray:
    return np.concatenate([replies[b] for b in sorted(replies)]) if replies else np.zeros(0, dtype)


def split(values: np.ndarray, requests: list) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(r[0]) for r in requests])[:-1])


def repeated_passages(spark: SparkSession, docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, window: int = WINDOW, words: int = 0) -> tuple[DataFrame, DataFrame]:
    """The chunks of the documents, and for each chunk (frozen) the starts and ends of what to remove, in its bytes, as data; both written, other tables dropped. With words also those of repeated strings of so many words, in the chunk's words, as words."""
    if length < 2 * window + gram - 1 or words and words < 2 * WORD_WINDOW + WORD_GRAM - 1:
        raise ValueError("length is too small for the window")
    scratch = Scratch(spark, "suffixes")
    chunks = scratch.write(chunks_of(docs, text, length, gram, window), "chunks")
    tidy(spark)
    n_bytes, need = chunks.agg(F.sum("n_bytes"), F.max("need")).first()
    buckets, depth = max(LEAST, -(-(n_bytes or 0) // BUCKET_BYTES)), 1
    while 3**depth < (need or 0):
        depth += 1
    rows = lambda c: chunks.select(F.lit(-1).cast("long").alias("bucket"), "chunk", F.col(c).alias("data"))
    found = repeated_spans(Exchange(spark, scratch, rows("anchors")), rows("text"), "spans", length, buckets, depth).select("chunk", "data")
    if words:
        depth, at = 1, (words, WORD_GRAM, WORD_WINDOW)
        while 3**depth < words - 2 * WORD_WINDOW - WORD_GRAM + 2:  # the most symbols that strings of an anchor have in common
            depth += 1
        exchange = Exchange(spark, scratch, word_chunks(chunks, lambda data, ends: parsed(data, ends, *at, width=8)), "word-")
        of_words = repeated_spans(exchange, word_chunks(chunks, lambda data, _: data), "word-spans", words, buckets, depth, width=8)
        found = found.join(of_words.select("chunk", F.col("data").alias("words")), "chunk")
    scratch.keep("chunks", "spans", "word-spans")
    return chunks, found


def repeated_spans(exchange: Exchange, texts: DataFrame, target: str, length: int, buckets: int, depth: int, width: int = 1) -> DataFrame:
    """For each chunk (frozen) the starts and ends of the runs that repeated strings of length units cover; written as the target. texts: rows like the state's with the chunks' units."""

    def ask_symbols(x, _):
        (symbols,), x["of"] = distinct(x["symbol"])
        counts = np.minimum(np.bincount(x["of"], minlength=len(symbols)), 2).astype(np.uint8)
        return x, by_bucket(bucket_of(symbols, 0, buckets), [symbols, counts])

    def repeated(_, requests):
        values, counts = np.concatenate([r[0] for r in requests]), np.concatenate([r[1] for r in requests])
        _, place = distinct(values)
        return split(np.bincount(place, counts)[place] > 1, requests)

    exchange.round(ask_symbols, repeated)

    def ask_names(level: int):
        def ask(x, replies):
            if level == 0:
                again = joined(replies, bool)[x["of"]]
                n = len(again)
                once = np.concatenate([[0], np.cumsum(~again)])
                to = np.minimum(np.arange(n) + x["need"], n)
                live = np.flatnonzero((x["need"] > 0) & (once[to] == once[:-1]))
                span = np.zeros(n + 1, np.int64)
                np.add.at(span, live, 1)
                np.add.at(span, to[live], -1)
                used = np.flatnonzero(np.cumsum(span[:n]) > 0)
                first = np.ones(len(used), bool)
                if len(used):
                    first[1:] = (np.diff(used) > 1) | (x["doc"][used[1:]] != x["doc"][used[:-1]])
                x = {k: x[k][live] for k in ("place", "lo", "hi", "around", "need")} | {"at": np.searchsorted(used, live), "runs": [Runs(x["symbol"][used], first)]}
            else:
                x["runs"].append(x["runs"][-1].named(joined(replies, np.uint64)[x.pop("of")]))
            triples, x["of"] = distinct(*x["runs"][-1].triples())
            return x, by_bucket(bucket_of(triples[0], level, buckets), triples)

        return ask

    def name(bucket, requests):
        _, place = distinct(*(np.concatenate([r[i] for r in requests]) for i in range(3)))
        return split(place.astype(np.uint64) + np.uint64((bucket << 32) + 1), requests)

    for level in range(depth):
        exchange.round(ask_names(level), name)

    def ask_merge(level: int):
        def ask(x, replies):
            ranks = joined(replies, np.uint64)[x.pop("of")]
            keys, x["of"] = distinct(*x["runs"][level].merge_keys(ranks))
            del x["runs"][level + 1 :]
            return x, by_bucket(bucket_of(keys[0], level, buckets), keys)

        return ask

    def merge(bucket, requests):
        keys, place = distinct(*(np.concatenate([r[i] for r in requests]) for i in range(6)))
        symbol, kind, following, one, two, own = keys
        return split((merged(kind, symbol, following, one, two, own)[place] + (bucket << 40) + 1).astype(np.uint64), requests)

    for level in range(depth - 1, -1, -1):  # ranks of a whole level are those of the sample of the level before
        exchange.round(ask_merge(level), merge)

    def ask_classes(x, replies):
        ranks, runs = joined(replies, np.uint64)[x.pop("of")], x.pop("runs")[0]
        at, m = x.pop("at"), x["need"].astype(np.uint64)
        symbols = runs.values[at]
        (symbol, rank, m), x["of"] = distinct(symbols, ranks[at], m)
        first = np.full(len(rank), -1, np.int64)
        first[x["of"][::-1]] = at[::-1]
        most = int(m.max(initial=1))
        prefixes = np.stack([np.where(d < m, runs.values[np.minimum(first + d, len(runs.values) - 1)], np.uint64(0)) for d in range(most)], axis=1) if len(m) else np.zeros((0, 1), np.uint64)
        return x, by_bucket(bucket_of(symbol, 0, buckets), [rank, m.astype(np.int64), prefixes, np.bincount(x["of"], minlength=len(rank))])

    def classify(bucket, requests):
        most = max(r[2].shape[1] for r in requests)
        wide = np.concatenate([np.pad(r[2], ((0, 0), (0, most - r[2].shape[1]))) for r in requests])
        found = classes(np.concatenate([r[0] for r in requests]), np.concatenate([r[1] for r in requests]), wide, np.concatenate([r[3] for r in requests]))
        return split(np.where(found > 0, (bucket << 32) + found, 0), requests)

    exchange.round(ask_classes, classify)

    def ask_around(x, replies):
        of_class = joined(replies, np.int64)[x.pop("of")]
        live = of_class > 0
        x = {k: x[k][live] for k in ("place", "lo", "hi", "around")}
        (group, around), x["of"] = distinct(of_class[live].astype(np.uint64), x.pop("around"))
        return x, by_bucket((group >> np.uint64(32)).astype(np.int64), [group, around, np.bincount(x["of"], minlength=len(group))])

    def compare(_, requests):
        """1: all strings repeat, 2: its strings are to be compared, 3: both (one chunk sends them for all)."""
        group, around, counts = (np.concatenate([r[i] for r in requests]) for i in range(3))
        (groups, _), place = distinct(group, around)
        total = np.bincount(place, counts)
        _, of = distinct(groups)
        single = np.bincount(of, total == 1)[of] > 0
        several = np.bincount(of)[of] > 1
        sends = np.zeros(len(place), bool)
        sends[np.unique(place, return_index=True)[1]] = True
        again, open_ = (total > 1)[place], (single & several)[place] & sends
        return split(np.where(again, 1, 0) + np.where(open_, 2, 0), requests)

    exchange.round(ask_around, compare)

    def ask_strings(x, replies):
        import xxhash

        of = x.pop("of")
        verdict = joined(replies, np.int64)[of]
        data, digest = memoryview(x.pop("text")), xxhash.xxh3_64_intdigest
        whole = verdict % 2 == 1
        x["from"], x["to"] = x["lo"][whole], x["hi"][whole] + length
        open_ = np.unique(of, return_index=True)[1]  # of anchors with equal surroundings one is enough
        open_ = open_[verdict[open_] >= 2]
        starts = np.concatenate([np.arange(x["lo"][i], x["hi"][i] + 1) for i in open_]) if len(open_) else np.zeros(0, np.int64)
        known = np.concatenate([np.full(x["hi"][i] - x["lo"][i] + 1, 2 if whole[i] else 1) for i in open_]) if len(open_) else np.zeros(0, np.int64)
        values = np.fromiter((digest(data[width * s : width * (s + length)]) for s in starts.tolist()), np.uint64, len(starts))
        (value,), of = distinct(values)
        counts = np.minimum(np.bincount(of, known, len(value)), 2).astype(np.uint8)
        return {"from": x["from"], "to": x["to"], "starts": starts.astype(np.int64), "of": of}, by_bucket(bucket_of(value, 0, buckets), [value, counts])

    exchange.round(ask_strings, repeated, texts)

    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = {r["bucket"]: thaw(r["data"]) for r in right.to_pylist()}
        for r in left.to_pylist():
            x = thaw(r["data"])
            hit = x["starts"][joined(replies, bool)[x["of"]]] if len(x["starts"]) else x["starts"]
            out.append((-1, r["chunk"], freeze(union_of(np.concatenate([x["from"], hit]), np.concatenate([x["to"], hit + length])))))
        return rows_table(out)

    found = exchange.state.groupBy("chunk").cogroup(exchange.replies.groupBy("chunk")).applyInArrow(spans, ROWS)
    found = exchange.scratch.write(found, target)
    exchange.drop(exchange.rounds)
    return found


def deduplicated(spark: SparkSession, docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Every row with its other columns, and n_bytes, spans (start and end of each removed run, in bytes) and kept (the remaining bytes), which replace columns of these names."""
    docs = docs.drop(*(c for c in ("n_bytes", "spans", "kept") if c != text))
    types = {"n_bytes": (pa.int64(), S.LongType()), "spans": (pa.list_(pa.list_(pa.int64())), S.ArrayType(S.ArrayType(S.LongType()))), "kept": (pa.binary(), S.BinaryType())}

    def finished(rows: pa.Table, sizes, spans, kept) -> pa.Table:
        for (name, (kind, _)), values in zip(types.items(), (sizes, spans, kept), strict=True):
            rows = rows.append_column(name, pa.array(values, kind))
        return rows

    return cut_documents(spark, docs, text, finished, {k: t for k, (_, t) in types.items()}, **options)


def cut_documents(spark: SparkSession, docs: DataFrame, text: str, finished: Callable, added: dict[str, S.DataType], **options) -> DataFrame:
    """Rows that finished(other columns, sizes, spans, kept bytes) makes of each chunk: the columns but the text, and those added."""
    chunks, found = repeated_passages(spark, docs, text, **options)
    schema = S.StructType([f for f in docs.schema.fields if f.name != text])
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def cut(batches):
        for batch in batches:
            for rows, sizes, body, data, *words in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                body, (a, b) = thaw(body), thaw(data)
                for some in words:
                    start, stop = in_bytes(body, sizes, *thaw(some))
                    a, b = union_of(np.concatenate([a, start]), np.concatenate([b, stop]))
                ends = np.cumsum(sizes)
                doc = np.searchsorted(ends, a, side="right")
                of = [[] for _ in sizes]
                # runs of neighbouring documents may touch in the chunk's bytes
                for i, s, e in [(i, int(s), int(e)) for i, s, e in zip(doc, a, b, strict=True)]:
                    while s < e:
                        stop = min(e, int(ends[i]))
                        base = int(ends[i]) - sizes[i]
                        if stop > s:
                            of[i].append([s - base, stop - base])
                        s, i = stop, i + 1
                kept = []
                for i, runs in enumerate(of):
                    at = base = int(ends[i]) - sizes[i]
                    parts = []
                    for s, e in runs:
                        parts.append(body[at : base + s])
                        at = base + e
                    kept.append(b"".join([*parts, body[at : int(ends[i])]]))
                yield from finished(pa.ipc.open_stream(rows).read_all(), sizes, of, kept).to_batches()
        release()

    both = chunks.select("chunk", "rows", "sizes", "text").join(found, "chunk")
    return both.select("rows", "sizes", "text", *found.columns[1:]).mapInArrow(cut, schema)


def without_passages(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents without repeated passages, other columns as they were; a character that loses a byte goes, n_chars follows the text, and documents that keep no word go."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns may have any names
    text = names[docs.columns.index("text")]

    def finished(rows: pa.Table, sizes, spans, kept) -> pa.Table:
        texts = [k.decode(errors="ignore") for k in kept]
        keep = [bool(t.encode().split()) for t in texts]
        return rows.append_column("kept", pa.array(texts, pa.string())).filter(pa.array(keep, pa.bool_()))

    renamed = docs.toDF(*names)
    cleaned = cut_documents(spark, renamed.withColumn(text, F.col(text).cast("string")), text, finished, {"kept": S.StringType()}, **options)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return cleaned.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
