"""Packing documents into sequences by linear grouping, with best fit for the small ones.

Only 1 to ``capacity`` tokens occur as lengths of pieces, so the whole problem is a histogram of that many counts,
whatever the size of the corpus. Pieces above a share ``small`` of it are ordered by length and cut into groups of equal
cardinality; every length in a group is rounded up to the group's largest. For these few sizes the number of
sequences of each configuration is optimised by a linear program over columns (generated by a knapsack over the
dual prices) and rounded down. Then the actual pieces take the places of the rounded ones, group by group and longest
first, which frees the difference; what rounding down left over, and the small pieces, follow by best fit in
descending length. Sequences with equal contents are held as runs, so the plan is a table of intervals of ranks, of a
size that depends on ``capacity`` and ``groups`` alone; each piece finds its place by its rank among its length.

Defined cases: a null text is empty and has the end id alone; a document longer than ``capacity`` is cut into pieces
of ``capacity`` tokens and a rest (a text of any length is encoded whole); repeated rows are documents of their own; null ids are kept; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, tidy
from .tokens import encoder


def grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths in descending order cut into groups of equal cardinality: lists of [length, count]."""
    total = sum(counts.values())
    out, at, filled = [[] for _ in range(min(groups, total))], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = (at + 1) * total // len(out) - filled
            if not room:
                at += 1
                continue
            take = min(room, left)
            out[at].append([length, take])
            left, filled = left - take, filled + take
    return out


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The multiset of sizes within capacity with the highest sum of prices (unbounded knapsack)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for room in range(smallest, capacity + 1):
        fits = sizes <= room
        value = np.where(fits, best[np.where(fits, room - sizes, 0)] + prices, -1.0)
        i = int(value.argmax())
        if value[i] > best[room - 1]:
            best[room], choice[room] = value[i], i
        else:
            best[room], choice[room] = best[room - 1], -1
    counts, room = [0] * len(sizes), capacity
    while room >= smallest:
        if choice[room] < 0:
            room -= 1
            continue
        counts[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used: column generation with revised simplex steps, rounded down."""
    s, d, m = np.asarray(sizes), np.asarray(demand, float), len(sizes)
    basis = np.diag([float(capacity // x) for x in sizes])
    columns = [tuple(int(v) for v in basis[:, j]) for j in range(m)]
    inverse = np.linalg.inv(basis)
    amount = inverse @ d
    for step in range(rounds):
        prices = inverse.sum(axis=0)
        value, found = best_configuration(s, prices, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ np.asarray(found, float)
        up = direction > 1e-10
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = amount[up] / direction[up]
        out = int(ratio.argmin())
        columns[out] = tuple(found)
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        if step % 50 == 49:
            inverse = np.linalg.inv(np.asarray(columns, float).T)
        amount = np.maximum(inverse @ d, 0)
    used = [(c, int(a + 1e-7)) for c, a in zip(columns, amount, strict=True)]
    return [(c, a) for c, a in used if a > 0]


class Plan:
    """Runs of sequences with equal contents, and where the pieces of each length go by their rank."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rank: dict[int, int] = defaultdict(int)
        self.entries: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, pieces in each, offset

    def place(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        self.entries.append((length, self.rank[length], pieces, sequence, each, offset))
        self.rank[length] += pieces

    def configured(self, slots: list[list[tuple[int, int]]], times: int) -> None:
        """times new sequences; each slot has (length, count) in order, counts adding up to times at most."""
        first, done, used = self.sequences, 0, [0] * len(slots)
        heads = [[*s] for s in slots]
        self.sequences += times
        while done < times:
            run = min([times - done, *(h[0][1] for h in heads if h)])
            offset = 0
            for h in heads:
                if h:
                    length, count = h[0]
                    self.place(length, run, first + done, 1, offset)
                    offset += length
                    h[0] = (length, count - run)
                    if count == run:
                        h.pop(0)
            self.free[self.capacity - offset].append((first + done, run))
            done += run

    def best_fit(self, length: int, pieces: int) -> None:
        """Pieces of one length into the fullest sequences that take them, then into new ones."""
        for room in sorted(r for r in self.free if r >= length):
            runs, self.free[room] = self.free[room], []
            each = room // length
            for i, (sequence, count) in enumerate(runs):
                if not pieces:
                    self.free[room] += runs[i:]
                    break
                whole = min(count, pieces // each)
                if whole:
                    self.place(length, whole * each, sequence, each, self.capacity - room)
                    self.free[room - each * length].append((sequence, whole))
                    pieces -= whole * each
                if whole < count and pieces:  # fewer than each are left
                    self.place(length, pieces, sequence + whole, pieces, self.capacity - room)
                    self.free[room - pieces * length].append((sequence + whole, 1))
                    whole, pieces = whole + 1, 0
                if whole < count:
                    self.free[room].append((sequence + whole, count - whole))
            if not pieces:
                return
        if pieces:
            new = -(-pieces // (self.capacity // length))
            self.free[self.capacity].append((self.sequences, new))
            self.sequences += new
            self.best_fit(length, pieces)


def planned(counts: dict[int, int], capacity: int, groups: int = 64, small: tuple[float, ...] = (1 / 8, 1 / 3, 1 / 2)) -> Plan:
    """Counts of pieces by length to the plan of their places: of the bounds between small and large, the one that needs the fewest sequences."""
    return min((planned_with(counts, capacity, groups, x) for x in small), key=lambda p: p.sequences)


def planned_with(counts: dict[int, int], capacity: int, groups: int, small: float) -> Plan:
    plan = Plan(capacity)
    left = dict(counts)
    large = {n: c for n, c in counts.items() if n > capacity * small}
    if large:
        cut = grouped(large, groups)
        used = configurations([g[0][0] for g in cut], [sum(c for _, c in g) for g in cut], capacity)
        for configuration, times in used:
            slots = []
            for g, places in enumerate(configuration):
                for _ in range(places):
                    need, slot = times, []
                    while need and cut[g]:
                        length, count = cut[g][0]
                        take = min(need, count)
                        slot.append((length, take))
                        left[length] -= take
                        need -= take
                        cut[g][0] = [length, count - take]
                        if take == count:
                            cut[g].pop(0)
                    if slot:
                        slots.append(slot)
            if slots:
                plan.configured(slots, max(sum(c for _, c in s) for s in slots))
    for length in sorted(left, reverse=True):
        if left[length]:
            plan.best_fit(length, left[length])
    return plan


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of whole documents: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        encode, end = encoder(path).encode, np.asarray([end_id], np.uint32)
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((key, i, at, len(part), zlib.crc32(part.tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds part and rank: the pieces in the order of lengths, numbered within each length of each partition."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def number(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            lengths = batch["length"].to_numpy()
            rank = np.empty(len(lengths), np.int64)
            cuts = np.flatnonzero(np.diff(lengths)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
                if b > a:
                    n = int(lengths[a])
                    rank[a:b] = seen[n] + np.arange(b - a)
                    seen[n] += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)], names=[*names, "part", "rank"])

    order = ["length", "doc_id", "piece", "ids_crc32"]
    return pieces.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def packed(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, **options) -> DataFrame:
    """Every piece with its sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    rows = scratch.write(ranked(scratch.write(pieces_of(docs, path, end_id, capacity), "pieces")), "ranked")
    scratch.drop("pieces")
    tidy(spark)
    # at most capacity lengths, and one more row for each partition that a length is spread over
    base, counts = {}, defaultdict(int)
    for r in sorted(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).collect()):
        base[r.part, r.length] = counts[r.length]
        counts[r.length] += r.n
    plan = planned(dict(counts), capacity, **options)
    table = np.asarray(sorted(plan.entries) or [(0, 0, 0, 0, 1, 0)], np.int64)
    keys = (table[:, 0] << 48) + table[:, 1]

    def look_up(batches):
        for batch in batches:
            length, part, rank = (batch[c].to_numpy() for c in ("length", "part", "rank"))
            pairs, at = np.unique((part.astype(np.int64) << 32) | length, return_inverse=True)
            rank = rank + np.asarray([base[int(p >> 32), int(p & 0xFFFFFFFF)] for p in pairs], np.int64)[at] if len(rank) else rank
            entry = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            i = rank - entry[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(entry[:, 3] + i // entry[:, 4]), pa.array(entry[:, 5] + i % entry[:, 4] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
