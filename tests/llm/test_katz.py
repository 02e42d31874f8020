import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pathloom.llm import katz, queries

from .fixtures import TEXTS, documents

END = b"\n"


class Brute:
    def __init__(self, rows):
        self.docs = [(i, (t or "").encode().lower().split() + [END]) for i, t in rows]
        self.words, self.pairs = Counter(), Counter()
        for i, w in self.docs:
            if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
                self.words.update(w)
                self.pairs.update(zip([END, *w], w, strict=False))
        self.n, self.v = sum(self.words.values()), len(self.words)
        by = Counter(self.pairs.values())
        self.d = {}
        cut = 6 * by[6] / by[1] if by[1] else 1
        for r in range(1, 6):
            x = ((r + 1) * by[r + 1] / (r * by[r]) - cut) / (1 - cut) if by[r] and cut < 1 else 0
            self.d[r] = x if 0 < x < 1 else (r - 0.5) / r
        self.after = defaultdict(dict)
        for (a, b), c in self.pairs.items():
            self.after[a][b] = c

    def word(self, w):
        return (self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def pair(self, a, w):
        seen = self.after.get(a)
        if not seen:
            return self.word(w)
        total = sum(seen.values()) + all(c > 5 for c in seen.values())
        p = {b: self.d.get(c, 1) * c / total for b, c in seen.items()}
        return p[w] if w in p else (1 - sum(p.values())) / (1 - sum(map(self.word, seen))) * self.word(w)

    def rows(self):
        return sorted(
            ((i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, len(w), sum(self.words[x] > 0 for x in w), self.n, sum(log10(self.word(x)) for x in w), sum(log10(self.pair(a, x)) for a, x in zip([END, *w], w, strict=False))) for i, w in self.docs),
            key=lambda r: (str(r[0]), r[2]),
        )


def check(got, rows):
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: (str(r[0]), r[2]))
    want = Brute(rows).rows()
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_query(spark, sf_dir):
    check(queries.op5_lm_score(spark, sf_dir), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_chunks_and_spread_contexts(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 3000)
    monkeypatch.setattr(katz, "LEAST", 7)
    monkeypatch.setattr(katz, "SPREAD_TOKENS", 20)
    monkeypatch.setattr(katz, "SPREAD", 10**9)
    check(katz.scored(spark, documents(spark)), [(i, t) for i, t, _ in TEXTS])


def test_empty(spark):
    assert katz.scored(spark, documents(spark, [])).count() == 0


def test_probabilities_add_up_to_one():
    rows = [(i, " ".join(np.random.default_rng(i).choice(list("abcdefgh"), 40, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.04, 0.01]))) for i in range(12)] + [(20, "x y " * 9)]
    b = Brute(rows)
    vocabulary = [*b.words, b"never"]
    for context in [*b.words, b"other"]:
        assert sum(b.pair(context, w) for w in vocabulary) == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_words_alone(spark, sf_dir):
    got = queries.op5_lm_score(spark, sf_dir).filter("held_out").groupBy().sum("base_score", "score").first()
    assert got[1] > got[0]
