from itertools import groupby, product

import numpy as np
from pathloom.llm import chat, queries
from pathloom.llm.common import Scratch
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, line string, seg long"


def model_of(seed=1):
    r = np.random.default_rng(seed)
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return {"start": norm(r.random(chat.STATES)), "move": norm(r.random((chat.STATES, chat.STATES))), "marker": norm(r.random((chat.STATES, 4))), "length": norm(r.random((chat.STATES, chat.LENGTHS))), "ending": norm(r.random((chat.STATES, 2 + len(chat.ENDINGS))))}


def test_viterbi_is_the_best_path():
    m = model_of()
    e = chat.emissions(m, ["User: hi?", "what", "", "Assistant: yes."])
    score = lambda p: m["start"][p[0]] + sum(e[i][s] for i, s in enumerate(p)) + sum(m["move"][a, b] for a, b in zip(p, p[1:], strict=False))
    best = max(product(range(chat.STATES), repeat=4), key=score)
    assert tuple(chat.best_states(m, e, None, None)) == best
    ends = chat.chained(m["start"], [chat.best_scores(m, e[:1], True), chat.best_scores(m, e[1:3], False), chat.best_scores(m, e[3:], False)])
    assert ends == [best[0], best[2], best[3]]


def test_observations():
    assert [chat.observation(x)[0] for x in ("User: a", "[ai]> b", "### Human: c", "Q: d", "plain", "", "Quite: no")] == [2, 3, 2, 2, 0, 0, 0]


ROWS = [(1, 0, "system", "Be brief."), (1, 1, "user", "one\ntwo?"), (1, 2, "assistant", "A long answer. " * 30), (2, 0, "user", None), (2, 1, None, "x"), (2, 1, "tool", "y"), (None, 0, "user", "no id"), (3, 0, "user", ""), (3, 0, "user", "")]


def lines_of(turns):
    """(conv_id, turn_no, role, line, whether it is the turn's first) of rendered turns."""
    out = []
    for r in turns.collect():
        head, *body, end, rest = r.text.split("\n")
        assert (head, end, rest, len(body)) == (f"<|{r.role}|>", "<|end|>", "", r.n_lines)
        out += [(r.conv_id, r.turn_no, i, r.role, x) for i, x in enumerate(body)]
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:3]))


def test_segments_agree_with_one_pass(spark, monkeypatch):
    rows = [(9, t, ("user", "assistant")[t % 2], "\n".join(f"line {t} {i}{'?' * (t % 2)}" * (1 + 9 * (t % 2)) for i in range(1 + t % 3 + 20 * (t == 5)))) for t in range(40)] + ROWS
    lines = Scratch(spark, "t").write(chat.transcript_lines(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)), "lines")
    model = chat.learned(spark, lines)
    whole = lines_of(chat.recovered_turns(spark, lines, model))
    monkeypatch.setattr(chat, "SEGMENT", 7)
    assert lines_of(chat.recovered_turns(spark, lines, model)) == whole
    assert len(whole) == sum((r[3] or "").count("\n") + 1 for r in rows)


def test_empty_and_unlabelled(spark):
    assert chat.parsed_conversations(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    got = chat.parsed_conversations(spark, spark.createDataFrame([(1, 0, None, "a\nb\t\u00a0\r", "", 0)], SCHEMA))
    assert [x[4] for x in lines_of(got)] == ["a", "b\t\u00a0\r"]


def test_query_against_one_pass_per_conversation_and_the_truth(spark, sf_dir):
    got = lines_of(queries.op9_chat_format(spark, sf_dir))
    truth = chat.transcript_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    model = chat.learned(spark, truth.filter(F.pmod(F.xxhash64("conv_id", F.lit(3)), F.lit(5)) > 0))
    rows = sorted(truth.collect(), key=lambda r: (r.conv_id, r.turn, r.row, r.at))
    want, right, marked, plain, last = [], [], [], [], {}
    for conv, group in groupby(rows, key=lambda r: r.conv_id):
        group, turn, place = list(group), -1, 0
        states = chat.best_states(model, chat.emissions(model, [r.line for r in group]), None, None).tolist()
        for r, s in zip(group, states, strict=True):
            turn, place = (turn + 1, 0) if s % 2 == 0 else (turn, place + 1)
            seen = chat.MARKER.match(r.line)
            want.append((conv, turn, place, chat.ROLES[s // 2], r.line[seen.end() :] if seen and s % 2 == 0 else r.line))
            right.append(chat.ROLES[s // 2] == r.role and (s % 2 == 0) == (r["at"] == 0))
            if seen:
                last[conv] = chat.ROLES[chat.observation(r.line)[0] - 1]
                marked.append(right[-1])
            plain.append(last.get(conv, "user") == r.role and bool(seen) == (r["at"] == 0))  # markers alone
    assert got == want
    assert np.mean(right) > np.mean(plain) + 0.05 and np.mean(marked) > 0.97
