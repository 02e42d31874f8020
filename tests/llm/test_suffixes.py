import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pathloom.llm import queries, suffixes

from .fixtures import TEXTS, documents


def brute(rows, length):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (key, _), b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((key, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    for r in rows:
        assert r.n_spans == len(r.spans) and r.n_removed == sum(b - a for a, b in r.spans)
        assert "\ufffd" in r.kept_text or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    return sorted((tuple(r)[:5] for r in rows), key=str)


def awkward():
    r = random.Random(7)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, long = prose(40), prose(700)
    rows = [(i, prose(30) + shared[i % 5 :] + prose(20)) for i in range(12)] + [(100 + i, shared) for i in range(9)]
    rows += [(200 + i, long[: 900 + 100 * i] + prose(9) + long[1500 + 7 * i :]) for i in range(8)]
    rows += [(300, "a" * 700), (301, "a" * 90 + "b" + "a" * 90), (302, "ab" * 300), (303, "abc" * 100 + prose(5)), (304, "b" + "abc" * 60), (305, "é" * 80 + "ü" * 100)]
    edits = [(400 + i, prose(120)) for i in range(3)]
    rows += edits + [(410 + k, " ".join(w if r.random() > 0.04 else "zz" for w in t.split(" "))) for k, (_, t) in enumerate(edits * 6)]
    return rows + [(i, t) for i, t, _ in TEXTS if t is None or len(t) < 5000]


@pytest.mark.parametrize(("length", "gram", "window"), [(60, 8, 20), (40, 5, 3), (25, 4, 11)])
def test_against_all_strings(spark, monkeypatch, length, gram, window):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 9000)
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 2000)
    monkeypatch.setattr(suffixes, "LEAST", 5)
    rows = awkward()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, kept string").repartition(3)
    got = queries.passage_digests(suffixes.deduplicated(spark, frame, length=length, gram=gram, window=window))
    assert found(got) == brute(rows, length)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = found(queries.op2_suffix_dedup(spark, sf_dir))
    assert got == brute(rows, 400) and any(r[2] for r in got)


def test_documents_and_empty(spark):
    docs = documents(spark)
    out = suffixes.without_passages(spark, docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {0, 7, 9, None}  # copies lose all, empty texts have no word
    assert suffixes.deduplicated(spark, documents(spark, [])).count() == 0


def test_ranks_follow_the_order_of_suffixes():
    r = random.Random(1)
    for _ in range(30):
        strings = [[r.randint(1, 3) << 60 for _ in range(r.randint(1, 12))] for _ in range(6)]
        values = np.array([v for s in strings for v in s], np.uint64)
        runs = suffixes.Runs(values, np.array([i == 0 for s in strings for i in range(len(s))]))
        every = [s[i:] for s in strings for i in range(len(s))]
        order = sorted(map(tuple, every))
        exact = np.array([order.index(tuple(s)) + 1 for s in every], np.uint64)
        symbol, kind, following, one, two, own = runs.merge_keys(exact[runs.sampled()])
        (a, b, c, d, e, f), place = suffixes.distinct(symbol, kind, following, one, two, own)
        got = suffixes.merged(b, a, c, d, e, f)[place]
        assert (np.argsort(got, kind="stable") == np.argsort(exact, kind="stable")).all()


def brute_words(rows, length):
    """The words that stay, by row."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_passages_of_over_50_words(spark, monkeypatch):
    """51 words repeat in less than 400 bytes, whatever white space lies between them; 50 do not."""
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(suffixes, "LEAST", 5)
    r = random.Random(4)
    prose = lambda n: [f"{r.choice('abcdefgh')}{r.randint(0, 999)}" for _ in range(n)]
    at, near, long = prose(51), prose(50), prose(130)
    shared = [at, near, long, long[20:95], ["x"] * 60]
    rows = [(i, r.choice([" ", "\n", "  "]).join([*prose(r.choice([0, 7, 60])), *r.choice(shared), *prose(r.choice([0, 3, 55]))])) for i in range(120)]
    rows += [(200, None), (201, " "), (202, " ".join(at)), (203, "  " + "\n".join(at)), (204, "\t".join(at) + " ")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = {x.doc_id: x.text for x in suffixes.without_passages(spark, frame, length=5000, words=51).collect()}
    want = {i: kept for (i, _), kept in zip(rows, brute_words(rows, 51), strict=True) if kept}
    assert {i: t.encode().split() for i, t in got.items()} == want and len(want) < len(rows)
    assert max(len(" ".join(s)) for s in (at, near)) < 400 and any(set(near) <= {w.decode() for w in kept} for kept in want.values())
    both = {x.doc_id: x.text.encode().split() for x in suffixes.without_passages(spark, frame, words=51).collect()}
    assert all(len(both.get(i, [])) <= len(kept) for i, kept in want.items())
