"""Transcripts of conversations parsed by a hidden Markov model and rendered as canonical turns.

A state is a role together with whether a line starts a turn or goes on with one. A line is seen through its speaker
marker (``User:``, ``[AI]>``, ...), its length and how it ends. Start, transition and emission probabilities are
smoothed counts over labelled conversations; Viterbi recovers the states of a transcript's lines.

Lines are sorted over the cluster and cut into segments of ``SEGMENT`` lines of one conversation. Most conversations
are one segment. For longer ones each segment gives a states-by-states matrix of best scores; these are chained for
each conversation, which fixes the state before and at the end of every segment, and then the segments are decoded
independently, with the same result as one pass over the whole conversation. No task holds more than a segment's
lines, however long a conversation is; only a turn's own text is put together from several segments.

A turn is rendered as ``<|role|>``, its lines without the speaker marker, and ``<|end|>``, each on a line of its own; the
texts of a conversation's turns, one after another, are its canonical rendering.

Defined cases: a null text is one empty line; null and unknown roles are not learned from; a null conversation id is
a conversation of its own; rows repeated or with the same turn follow one another; a line may be of any length; without any labelled rows all
probabilities are equal and the first role wins ties; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

ROLES = ("system", "user", "assistant")
MARKERS = {"system": ("system", "sys"), "user": ("user", "human", "q", "customer", "you"), "assistant": ("assistant", "ai", "a", "bot", "model")}
STYLES = (("System: ", "User: ", "Assistant: "), ("[sys]> ", "[human]> ", "[ai]> "), ("### System: ", "### Human: ", "### Assistant: "), ("system: ", "Q: ", "A: "), ("", "", ""))
SEGMENT = 4096
LENGTHS = 12
MARKER = re.compile(r"\s{0,3}[#*\[]{0,3}\s?(" + "|".join(sorted((m for x in MARKERS.values() for m in x), key=len, reverse=True)) + r")[\]*]{0,3}\s?[:>]+\s?", re.IGNORECASE)
CLASS = {m: 1 + i for i, r in enumerate(ROLES) for m in MARKERS[r]}
STATES = 2 * len(ROLES)  # 2 * role: starts a turn, 2 * role + 1: goes on with it
ENDINGS = "?.:!|"


def observation(line: str) -> tuple[int, int, int]:
    """Class of the speaker marker (0: none), bucket of the length, and the ending."""
    found = MARKER.match(line)
    return CLASS[found[1].lower()] if found else 0, min(LENGTHS - 1, len(line).bit_length()), 1 + ENDINGS.find(line.rstrip()[-1:]) if line.strip() else 0


def transcript_lines(conversations: DataFrame, seed: int = 7, dropped: int = 3) -> DataFrame:
    """Raw transcripts of labelled conversations, one row for each line, with the markers of a style for each conversation, missing on ``dropped`` of 10 turns: conv_id, turn, row, at, role, line."""
    style = F.pmod(F.xxhash64("conv_id", F.lit(seed)), F.lit(len(STYLES)))
    marker: Column = F.lit("")
    for i, texts in enumerate(STYLES):
        for role, text in zip(ROLES, texts, strict=True):
            if text:
                marker = F.when((style == i) & (F.col("role") == role), text).otherwise(marker)
    shown = F.pmod(F.xxhash64("conv_id", "turn", F.lit(seed + 1)), F.lit(10)) >= dropped
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(F.concat(F.when(shown, marker).otherwise(""), "text"), "\n")).alias("at", "line"))
    return rows.select("conv_id", "turn", "row", "at", "role", "line")


def learned(spark: SparkSession, lines: DataFrame, smoothing: float = 0.5) -> dict[str, np.ndarray]:
    """Log probabilities from labelled lines: start, move, marker, length and ending; counts only come to the driver."""
    known = lines.filter(F.col("role").isin(*ROLES))
    names = ["s", "m", "l", "e", "n"]

    def observed(batches):  # by the same function that sees the lines of transcripts
        for batch in batches:
            seen = Counter((2 * ROLES.index(role) + (at > 0), *observation(line)) for role, at, line in zip(*(batch[c].to_pylist() for c in ("role", "at", "line")), strict=True))
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)

    seen = known.select("role", "at", "line").mapInArrow(observed, ", ".join(f"{n} long" for n in names)).groupBy(*names[:4]).agg(F.sum("n").alias("n")).collect()
    turns = known.groupBy("conv_id", "turn").agg(F.max_by("role", F.struct("row", "at")).alias("role"), F.max("at").alias("at"))
    follows = turns.alias("a").join(turns.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn"))).groupBy(F.col("a.role").alias("x"), F.col("b.role").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    first = turns.groupBy("conv_id").agg(F.min_by("role", "turn").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {"marker": np.zeros((STATES, 1 + len(ROLES))), "length": np.zeros((STATES, LENGTHS)), "ending": np.zeros((STATES, 2 + len(ENDINGS)))}
    lines_of = np.zeros(STATES)
    for r in seen:
        lines_of[r.s] += r.n
        for name, at in (("marker", r.m), ("length", r.l), ("ending", r.e)):
            counts[name][r.s, at] += r.n
    start, move = np.full(STATES, 1e-12), np.full((STATES, STATES), 1e-12)
    turn_to = np.full((len(ROLES), len(ROLES)), smoothing)
    for r in follows:
        turn_to[ROLES.index(r.x), ROLES.index(r.y)] += r.n
    turn_to /= turn_to.sum(axis=1, keepdims=True)
    opening = np.full(len(ROLES), smoothing)
    for r in first:
        opening[ROLES.index(r.x)] += r.n
    start[::2] = opening / opening.sum()
    for i in range(len(ROLES)):
        turns_of, more = lines_of[2 * i], lines_of[2 * i + 1]
        goes_on = (more + smoothing) / (more + turns_of + 2 * smoothing)  # of lines of this role, those with a further line after them
        for s in (2 * i, 2 * i + 1):
            move[s, 2 * i + 1] = goes_on
            move[s, ::2] = (1 - goes_on) * turn_to[i]
    model = {"start": np.log(start), "move": np.log(move)}
    for name, n in counts.items():
        n = n + smoothing
        model[name] = np.log(n / n.sum(axis=1, keepdims=True))
    return model


def emissions(model: dict[str, np.ndarray], lines: list[str]) -> np.ndarray:
    seen = np.array([observation(x) for x in lines], np.int64).reshape(-1, 3)
    return (model["marker"][:, seen[:, 0]] + model["length"][:, seen[:, 1]] + model["ending"][:, seen[:, 2]]).T


def best_scores(model: dict[str, np.ndarray], emitted: np.ndarray, first: bool) -> np.ndarray:
    """Best score for each state before a segment (row) and at its end (column); the first segment has one row."""
    score = (model["start"] + emitted[0])[None, :] if first else model["move"] + emitted[0][None, :]
    for e in emitted[1:]:
        score = (score[:, :, None] + model["move"][None, :, :]).max(axis=1) + e[None, :]
    return score


def best_states(model: dict[str, np.ndarray], emitted: np.ndarray, before: int | None, end: int | None) -> np.ndarray:
    """Viterbi over a segment, from the state before it (None: it is the first) to the state at its end (None: any)."""
    score = (model["start"] if before is None else model["move"][before]) + emitted[0]
    back = np.zeros(emitted.shape, np.int64)
    for t in range(1, len(emitted)):
        step = score[:, None] + model["move"]
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + emitted[t]
    states = np.empty(len(emitted), np.int64)
    states[-1] = int(score.argmax()) if end is None else end
    for t in range(len(emitted) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def chained(start: np.ndarray, matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of each segment on the best path through their score matrices."""
    score, back = matrices[0][0], []
    for m in matrices[1:]:
        step = score[:, None] + m
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    ends = [int(score.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    return ends[::-1]


def segments(lines: DataFrame) -> DataFrame:
    """conv_id, seg (in order), lines: at most SEGMENT lines of one conversation in the order of turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("lines", pa.list_(pa.string()))])

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        key, held, begun, ready = None, [], False, []

        def flush():
            nonlocal number, held
            if held:
                ready.append((key, (part << 32) | number, held))
                number, held = number + 1, []

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), schema.types, strict=True)], schema=schema)
            ready.clear()
            return out

        for batch in batches:
            for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if not begun or conv != key or len(held) >= SEGMENT:
                    flush()
                    key, begun = conv, True
                held.append(line)
            if len(ready) > 256:
                yield batch_of()
        flush()
        if ready:
            yield batch_of()

    order = ["conv_id", "turn", "row", "at"]
    return lines.select(*order, "line").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "conv_id long, seg long, lines array<string>")


def recovered_parts(spark: SparkSession, lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """What each segment holds of turns: conv_id, seg, nth (part of the segment), started (turns started in the segment so far), role, lines, and long, whether the conversation has other segments."""
    cut = Scratch(spark, "chat").write(segments(lines), "segments")
    long_ones = cut.groupBy(F.col("conv_id").alias("long_id")).agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("first")).filter("n > 1")
    pieces = cut.join(long_ones, F.col("conv_id").eqNullSafe(F.col("long_id"))).select("conv_id", "seg", "lines", (F.col("seg") == F.col("first")).alias("first"))

    def scores(batches):
        for batch in batches:
            for conv, seg, text, first in zip(*(batch[c].to_pylist() for c in ("conv_id", "seg", "lines", "first")), strict=True):
                m = best_scores(model, emissions(model, text), first)
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([seg], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([m.ravel().tolist()])], names=["conv_id", "seg", "n", "m"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        ends = chained(model["start"], [np.array(x).reshape(-1, STATES) for x in table["m"].to_pylist()])
        return pa.table({"conv_id": table["conv_id"], "seg": table["seg"], "before": pa.array([None, *ends[:-1]], pa.int32()), "end": pa.array(ends, pa.int32())})

    borders = pieces.mapInArrow(scores, "conv_id long, seg long, n long, m array<double>").groupBy("conv_id").applyInArrow(chain, "conv_id long, seg long, before int, end int").drop("conv_id")
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("nth", pa.int64()), ("started", pa.int64()), ("role", pa.string()), ("lines", pa.list_(pa.string())), ("long", pa.bool_())])

    def decode(batches):
        for batch in batches:
            out = []
            for conv, seg, text, before, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "seg", "lines", "before", "end")), strict=True):
                started, nth = 0, -1
                for line, s in zip(text, best_states(model, emissions(model, text), before, end).tolist(), strict=True):
                    starts = s % 2 == 0
                    if starts or nth < 0:
                        started, nth = started + starts, nth + 1
                        out.append((conv, seg, nth, started, ROLES[s // 2], [], end is not None))
                    out[-1][5].append(line[found.end() :] if starts and (found := MARKER.match(line)) else line)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return cut.join(borders, "seg", "left").select("conv_id", "seg", "lines", "before", "end").mapInArrow(decode, "conv_id long, seg long, nth long, started long, role string, lines array<string>, long boolean")


def recovered_turns(spark: SparkSession, lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Every turn in its canonical form: conv_id, turn_no (from 0), role, n_lines, text."""
    parts = recovered_parts(spark, lines, model)
    number = lambda base: F.greatest(base + F.col("started") - 1, F.lit(0))
    short = parts.filter("not long").select("conv_id", number(F.lit(0)).alias("turn_no"), "role", "lines")
    parts = Scratch(spark, "chat-long").write(parts.filter("long"), "parts")
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("conv_id", "seg").agg(F.max("started").alias("n")).select("seg", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    of = F.array_sort(F.collect_list(F.struct("seg", "nth", "role", "lines")))
    whole = parts.join(base, "seg").groupBy("conv_id", number(F.col("base")).alias("turn_no")).agg(of.alias("p"))
    whole = whole.select("conv_id", "turn_no", F.col("p.role")[0].alias("role"), F.flatten("p.lines").alias("lines"))
    text = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.array_join("lines", "\n"), F.lit("\n<|end|>\n"))
    return short.unionByName(whole).select("conv_id", "turn_no", "role", F.size("lines").cast("long").alias("n_lines"), text.alias("text"))


def parsed_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Learns from the conversations outside every fifth (by hash) and recovers the turns of all raw transcripts."""
    lines = Scratch(spark, "chat-lines").write(transcript_lines(conversations), "lines")
    model = learned(spark, lines.filter(F.pmod(F.xxhash64("conv_id", F.lit(3)), F.lit(5)) > 0))
    return recovered_turns(spark, lines, model)
