"""Katz backoff language model over words: Good-Turing discounted bigram counts, exactly normalised backoff weights.

Documents are cut into chunks of about ``CHUNK`` tokens, kept as arrays of local word numbers. Counts never travel a
row at a time: each chunk sends, for every bucket of a hash, one packed array of its distinct words (later word pairs)
with its counts; the bucket's task adds them up over all chunks and replies to each chunk with an array in the same
order. First words get numbers and counts, then pairs get counts and each context the sums that its backoff weight
needs. Contexts with more than a fixed share of the tokens are spread over several buckets (at most ``SPREAD`` such
contexts, whose sums alone reach the driver). The replies are the model's tables, partitioned by bucket.

P(w|v) = d(c) c(v,w) / c(v) for pairs seen in training, else a(v) P(w); P(w) = (c + 0.1) / (N + 0.1 (V + 1)), where
unseen words share one class. a(v) makes the sum over the vocabulary and that class exactly 1. The end of a text is a
token, and the context of the first word. Where no follower of a context is discounted, one more count is added to
c(v), so that something is left to back off to. Discounts d(r) for r up to 5 are Katz's; where count-of-counts do not
allow them, (r - 0.5) / r.

Defined cases: a null text is empty and has the end alone; a null id counts as the empty string, which is held out;
repeated rows are documents of their own; a text of any length is read whole, and ends its chunk where that is full; an
empty table gives no rows; other columns are ignored. Words are told apart by 64 bits of XXH64 and numbered by 64 bits;
inside a chunk or bucket, words and contexts go by their places in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pack, tidy, unpack

CHUNK = 2_000_000
#: Buckets hold about so many tokens' words or pairs; at least LEAST buckets.
BUCKET_TOKENS, LEAST = 1 << 20, 64
#: At most so many contexts are spread over buckets, each with over 1 / SPREAD of the tokens.
SPREAD, SPREAD_TOKENS = 16_384, 65_536
TOP = 5
FLOOR = 0.1
END = b"\n"
#: What the backoff weight of a context needs: numbers of followers with counts 1 to TOP, sum of larger counts, number of followers seen, sum of the followers' own counts.
SUMS = TOP + 3


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t, bits in (("<u1", 8), ("<u2", 16), ("<u4", 32), ("<u8", 64)) if most < 1 << bits))


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def batch(names: str, *rows: tuple) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if isinstance(c[0], bytes) else None) for c in columns], names=names.split())


class Chunk:
    """Documents' tokens as places in the chunk's sorted array of word hashes (stored in the order of first use)."""

    def __init__(self, ids, lengths, words, tokens):
        order = np.argsort(words)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        self.ids, self.lengths, self.words, self.tokens = ids, lengths, words[order], place[tokens]
        self.held = np.array([held_out(i) for i in ids], bool)
        self.train = np.repeat(~self.held, lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context, word) pairs of places among the chunk's words as context << 32 | word, sorted, and each token's place among them."""
        words = self.tokens.astype(np.uint64)
        ends = np.cumsum(self.lengths) - 1
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[np.concatenate([[0], ends[:-1] + 1])] = words[ends[0]]
        return np.unique(before << np.uint64(32) | words, return_inverse=True)


def chunked(docs: DataFrame) -> DataFrame:
    """chunk (its number), docs, lengths, words, tokens, n (tokens) and train (tokens learned from)."""

    def read(batches):
        import xxhash

        part, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {END: 0}
        ids, lengths, places = [], [], []

        def chunk():
            nonlocal number
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            tokens = np.concatenate(places)
            train = sum(n for i, n in zip(ids, lengths, strict=True) if not held_out(i))
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) | number]), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(np.array(lengths, "<u8"))]), pa.array([pack(words)]), pa.array([pack(tokens)]), pa.array([len(tokens)]), pa.array([train])], names=["chunk", "docs", "lengths", "words", "tokens", "n", "train"])
            number += 1
            known.clear()
            known[END] = 0
            for x in (ids, lengths, places):
                x.clear()
            return out

        size = 0
        for rows in batches:
            for key, text in zip(rows["doc_id"].to_pylist(), rows["text"], strict=True):
                words = (text.as_py() or "").encode().lower().split()
                words.append(END)
                places.append(np.array([known.setdefault(w, len(known)) for w in words], np.uint32))
                ids.append(key)
                lengths.append(len(words))
                size += len(words)
                if size >= CHUNK:
                    yield chunk()
                    size = 0
        if ids:
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "chunk long, docs array<long>, lengths binary, words binary, tokens binary, n long, train long")


def opened(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Chunk]]:
    for r in rows.select(["chunk", "docs", "lengths", "words", "tokens"]).to_pylist():
        yield r["chunk"], Chunk(r["docs"], unpack(r["lengths"]).astype(np.int64), unpack(r["words"]), unpack(r["tokens"]))


REQUEST = "bucket long, chunk long, a binary, b binary, c binary, d binary"
REPLY = "chunk long, kind long, bucket long, a binary, b binary"


def word_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for rows in batches:
            for number, chunk in opened(rows):
                counts = np.bincount(chunk.tokens[chunk.train], minlength=len(chunk.words))
                cuts = np.searchsorted(chunk.words, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)).tolist()
                for b, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(chunk.words)], strict=True)):
                    if j > i:
                        yield batch("bucket chunk a b c d", (b, number, pack(chunk.words[i:j]), pack(narrow(counts[i:j])), b"", b""))

    return chunks.mapInArrow(ask, REQUEST)


def word_replies(requests: DataFrame, buckets: int) -> DataFrame:
    """For each chunk the numbers and training counts of its words in the bucket; kind 1: in b, how many words are known."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words, counts = [unpack(r["a"]) for r in rows], [unpack(r["b"]).astype(np.int64) for r in rows]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
        numbers = np.empty(len(distinct), np.int64)
        numbers[np.argsort(-total, kind="stable")] = np.arange(len(distinct)) * buckets + rows[0]["bucket"]
        out, at = [(-1, 1, rows[0]["bucket"], b"", pack(np.array([(total > 0).sum()])))], 0
        for r, w in zip(rows, words, strict=True):
            p = place[at : at + len(w)]
            out.append((r["chunk"], 0, r["bucket"], pack(numbers[p].astype("<u8")), pack(narrow(total[p]))))
            at += len(w)
        return pa.Table.from_batches([batch("chunk kind bucket a b", *out)])

    return requests.groupBy("bucket").applyInArrow(add, REPLY)


def of_kind(replies: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in replies.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])


def numbered(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a chunk's words, in the order of their hashes."""
    rows = of_kind(replies, 0)
    return np.concatenate([unpack(r["a"]) for r in rows]), np.concatenate([unpack(r["b"]).astype(np.int64) for r in rows])


def bucketed(contexts: np.ndarray, words: np.ndarray, context_counts: np.ndarray, buckets: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's bucket, by its context's number; contexts with over share tokens are spread by the word. Also which are spread."""
    spread = -(-context_counts // share)
    wide = context_counts > share
    return ((mix(contexts) + np.where(wide, mix(words) % np.maximum(spread, 1).astype(np.uint64), 0).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), wide


class Placed:
    """A chunk's pairs with the numbers and counts of their contexts and words: ``order`` has them by bucket, cut at ``cuts``; ``place`` is each token's pair."""

    def __init__(self, chunk: Chunk, numbers: np.ndarray, counts: np.ndarray, buckets: int, share: int):
        pairs, self.place = chunk.pairs()
        self.context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.numbers, self.word, self.word_count = numbers, numbers[word], counts[word]
        bucket, self.wide = bucketed(numbers[self.context], self.word, counts[self.context], buckets, share)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def of_bucket(self, b: int) -> np.ndarray:
        return self.order[self.cuts[b] : self.cuts[b + 1]]


def pair_requests(chunks: DataFrame, replies: DataFrame, buckets: int, share: int) -> DataFrame:
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for number, chunk in opened(left):
            x = Placed(chunk, *numbered(right), buckets, share)
            counts = np.bincount(x.place[chunk.train], minlength=len(x.word))
            for b in np.flatnonzero(np.diff(x.cuts)).tolist():
                at = x.of_bucket(b)
                contexts, first, runs = np.unique(x.context[at], return_index=True, return_counts=True)
                out.append((b, number, pack(np.stack([v.astype("<u8") for v in (x.numbers[contexts], runs, x.wide[at][first])])), pack(x.word[at].astype("<u8")), pack(narrow(counts[at])), pack(narrow(x.word_count[at]))))
        return pa.Table.from_batches([batch("bucket chunk a b c d", *out)])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(ask, REQUEST)


def context_sums(context: np.ndarray, counts: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """SUMS for each of n contexts from their distinct followers' counts and the followers' own counts."""
    out = np.zeros((n, SUMS), np.int64)
    for r in range(1, TOP + 1):
        out[:, r - 1] = np.bincount(context[counts == r], minlength=n)
    big = counts > TOP
    out[:, TOP] = np.bincount(context[big], counts[big], n)
    seen = counts > 0
    out[:, TOP + 1] = np.bincount(context[seen], minlength=n)
    out[:, TOP + 2] = np.bincount(context[seen], words[seen], n)
    return out


def pair_replies(requests: DataFrame, share: int) -> DataFrame:
    """For each chunk its pairs' training counts (a) and its contexts' sums (b), kind 2; kind 3: numbers of pairs with count 1 to TOP + 1; kind 4: contexts (a) and sums (b) that must be added up over buckets."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        heads, runs, tails, counts, words, spread = [], [], [], [], [], set()
        for r in rows:
            contexts, run, wide = unpack(r["a"]).reshape(3, -1)
            spread.update(contexts[wide > 0].tolist())
            heads.append(contexts)
            runs.append(run.astype(np.int64))
            tails.append(unpack(r["b"]))
            counts.append(unpack(r["c"]).astype(np.int64))
            words.append(unpack(r["d"]).astype(np.int64))
        contexts, head = np.unique(np.concatenate(heads), return_inverse=True)
        _, tail = np.unique(np.concatenate(tails), return_inverse=True)
        pairs = np.repeat(head.astype(np.uint64), np.concatenate(runs)) << np.uint64(32) | tail.astype(np.uint64)
        distinct, first, place = np.unique(pairs, return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
        sums = context_sums((distinct >> np.uint64(32)).astype(np.int64), total, np.concatenate(words)[first], len(contexts))
        bucket, part = rows[0]["bucket"], np.isin(contexts, np.array(sorted(spread), np.uint64))
        out = [(-1, 3, bucket, b"", pack(np.array([(total == r).sum() for r in range(1, TOP + 2)]))), (-1, 4, bucket, pack(contexts[part]), pack(sums[part]))]
        at, from_ = np.cumsum([0, *(len(t) for t in tails)]), np.cumsum([0, *(len(h) for h in heads)])
        for i, r in enumerate(rows):
            own = head[from_[i] : from_[i + 1]]
            out.append((r["chunk"], 2, bucket, pack(narrow(total[place[at[i] : at[i + 1]]])), pack(narrow(sums[own].T))))
        return pa.Table.from_batches([batch("chunk kind bucket a b", *out)])

    return requests.groupBy("bucket").applyInArrow(add, REPLY)


def discounts(numbers: np.ndarray) -> np.ndarray:
    """Katz's discounts for counts 0 to TOP (0 unused) from the numbers of pairs with counts 1 to TOP + 1."""
    n, out = np.concatenate([[0], numbers]).astype(float), np.ones(TOP + 1)
    cut = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    """The small part of the model: totals and discounts; pairs and contexts come from the tables."""

    def __init__(self, tokens: int, words: int, d: np.ndarray):
        self.tokens, self.words, self.d = tokens, words, d
        self.whole = tokens + FLOOR * (words + 1)

    def word(self, counts: np.ndarray) -> np.ndarray:
        return (counts + FLOOR) / self.whole

    def weights(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each context what its followers' discounted counts are divided by, and its backoff weight."""
        r = np.arange(1, TOP + 1)
        few, total = sums[:, :TOP].sum(axis=1), sums[:, :TOP] @ r + sums[:, TOP]
        divisor = np.where(few > 0, total, total + 1).astype(float)
        left = np.where(few > 0, sums[:, :TOP] @ (r * (1 - self.d[1:])), 1.0) / np.maximum(divisor, 1)
        unseen = 1 - (sums[:, TOP + 2] + FLOOR * sums[:, TOP + 1]) / self.whole
        return divisor, np.where(total > 0, left / unseen, 1.0)

    def pair(self, counts: np.ndarray, words: np.ndarray, divisor: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The probability of a pair: its own if it was seen, else the context's weight times the word's."""
        d = np.where(counts > TOP, 1.0, self.d[np.minimum(counts, TOP)])
        return np.where(counts > 0, d * counts / np.maximum(divisor, 1), weight * self.word(words))


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    scratch = Scratch(spark, "katz")
    chunks = scratch.write(chunked(docs), "chunks")
    n, train = chunks.agg(F.sum("n"), F.sum("train")).first()
    buckets, share = max(LEAST, -(-(n or 0) // BUCKET_TOKENS)), max(SPREAD_TOKENS, (train or 0) // SPREAD)
    words = scratch.write(word_replies(word_requests(chunks, buckets), buckets), "words")
    tidy(spark)
    known = int(summed(words.filter("kind = 1"), 1)[0])
    pairs = scratch.write(pair_replies(pair_requests(chunks, words.filter("kind = 0"), buckets, share), share), "pairs")
    tidy(spark)
    d = discounts(summed(pairs.filter("kind = 3"), TOP + 1))
    model, wide = Model(train or 0, known, d), wide_contexts(pairs)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for _, chunk in opened(left):
            numbers, counts = numbered(right)
            x = Placed(chunk, numbers, counts, buckets, share)
            found = np.empty(len(x.word))
            for r in of_kind(right, 2):
                at = x.of_bucket(r["bucket"])
                contexts, of = np.unique(x.context[at], return_inverse=True)
                sums = unpack(r["b"]).reshape(SUMS, -1).T.astype(np.int64)
                if x.wide[at].any():
                    for i, c in enumerate(numbers[contexts].tolist()):
                        if c in wide:
                            sums[i] = wide[c]
                divisor, weight = model.weights(sums)
                found[at] = model.pair(unpack(r["a"]).astype(np.int64), x.word_count[at], divisor[of], weight[of])
            starts = np.cumsum(chunk.lengths) - chunk.lengths
            add = lambda x: np.add.reduceat(x, starts)
            own = counts[chunk.tokens]
            out.append(pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.lengths), pa.array(add((own > 0).astype(np.int64))), pa.array(np.full(len(starts), model.tokens)), pa.array(add(np.log10(model.word(own)))), pa.array(add(np.log10(found)[x.place]))], schema=schema))
        return pa.concat_tables(out)

    replies = words.filter("kind = 0").unionByName(pairs.filter("kind = 2"))
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the packed arrays b, of which there is one for each bucket."""

    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for b in batch["b"].to_pylist():
                total += unpack(b).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["sums"])

    found = rows.select("b").mapInArrow(add, "sums array<long>").agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(size)]).first()
    return np.array(found, np.float64)


def wide_contexts(pairs: DataFrame) -> dict[int, np.ndarray]:
    """Sums over all buckets of the contexts that are spread, of which there are SPREAD at most."""

    def wide(batches):
        for rows in batches:
            for r in rows.to_pylist():
                contexts, sums = unpack(r["a"]), unpack(r["b"]).reshape(-1, SUMS)
                if len(contexts):
                    yield pa.RecordBatch.from_arrays([pa.array(contexts.astype(np.int64)), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["context", "sums"])

    rows = pairs.filter("kind = 4").select("a", "b").mapInArrow(wide, "context long, sums array<long>")
    found = rows.groupBy("context").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(SUMS)]).collect()
    return {r.context: np.array([r[f"s{i}"] for i in range(SUMS)], np.int64) for r in found}
