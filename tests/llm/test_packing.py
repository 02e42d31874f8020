import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pathloom.llm import packing, queries, tokens

from .fixtures import TEXTS, documents


def spread(plan):
    seqs, got = defaultdict(list), Counter()
    for length, _, n, sequence, each, offset in plan.entries:
        got[length] += n
        for i in range(n):
            seqs[sequence + i // each].append((offset + i % each * length, length))
    return seqs, got


CASES = {
    "mixed": lambda r: Counter(min(2048, int(r.lognormvariate(6.5, 1.2)) + 1) for _ in range(3000)),
    "uniform": lambda r: Counter(r.randint(1, 2048) for _ in range(500)),
    "few sizes": lambda r: Counter(r.choice([700, 1400, 683, 1, 2, 3]) for _ in range(3000)),
    "one": lambda r: Counter([5]),
    "full": lambda r: Counter([2048, 2048, 1]),
    "none": lambda r: Counter(),
}


@pytest.mark.parametrize("case", CASES)
def test_plan(case):
    counts = CASES[case](random.Random(1))
    plan = packing.planned(dict(counts), 2048)
    seqs, got = spread(plan)
    assert got == counts and sorted(seqs) == list(range(plan.sequences))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    best = packing.planned_with(dict(counts), 2048, 64, 1.0).sequences  # best fit alone
    assert plan.sequences <= best * 1.01 + 1


def test_groups_have_equal_cardinality():
    cut = packing.grouped({5: 7, 4: 3, 3: 10, 2: 4}, 6)
    assert [sum(c for _, c in g) for g in cut] == [4] * 6
    assert [n for g in cut for n, _ in g] == sorted((n for g in cut for n, _ in g), reverse=True)


def brute(rows):
    library, out = tokens.PieceEncoder(tokens.vocabulary("word_bpe_49k.json")), []
    for i, t in rows:
        ids = np.asarray([*library.whole(t or ""), 0], "<u4")
        out += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    return sorted(out, key=str)


def check(df, rows):
    got = df.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.op7_packing(spark, sf_dir), rows)


def test_awkward_rows(spark):
    path = tokens.vocabulary("word_bpe_49k.json")
    check(packing.packed(spark, documents(spark), path), [(i, t) for i, t, _ in TEXTS])
    assert packing.packed(spark, documents(spark, []), path).count() == 0
