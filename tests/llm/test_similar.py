import random
from collections import Counter

import numpy as np
from pathloom.llm import similar

from .fixtures import TEXTS, documents


def jaccard(a, b, words=5):
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if sets[0] or sets[1] else 1.0


def corpus():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    rows, truth = [], []
    for i in range(60):
        text = [r.choice(words) for _ in range(r.choice([80, 200, 500]))]
        rows.append((1000 * i, " ".join(text), "s"))
        for k in range(r.choice([0, 0, 1, 3])):
            copy = [w if r.random() > 0.012 * (k + 1) else r.choice(words) for w in text]
            rows.append((1000 * i + k + 1, " ".join(copy), "s"))
    texts = {i: t for i, t, _ in rows}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and jaccard(texts[a], texts[b]) >= 0.8:
                truth.append((a, b))
    for _ in range(20):
        for a, b in truth:
            root[a] = root[b] = min(root[a], root[b])
    return rows, {x for x in root.values()}


def test_one_of_each_group_stays(spark):
    rows, want = corpus()
    got = [r.doc_id for r in similar.first_of_each(spark, documents(spark, rows)).collect()]
    assert len(got) == len(set(got)) and want <= set(got)  # no document without a similar one goes
    assert len(set(got) - want) <= 0.05 * (len(rows) - len(want))


def test_awkward_rows(spark):
    docs = documents(spark)
    out = similar.first_of_each(spark, docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, 0, 1, 3, 5, 7, 8]
    assert len(TEXTS) > 7 and similar.first_of_each(spark, documents(spark, [])).count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 100).astype(np.uint64)])
    differ = int(np.bitwise_count(similar.sketch(np.unique(a)) ^ similar.sketch(np.unique(b))).sum())
    shared = np.cos(np.pi * differ / similar.BITS) * 900
    assert abs(shared / (1800 - shared) - 0.8) < 0.1


def test_bands_meet_as_often_as_computed():
    r, met = np.random.default_rng(2), 0
    for _ in range(300):
        a = r.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate([a[:160], r.integers(0, 2**63, 20).astype(np.uint64)])  # 160 of 200
        met += bool((similar.band_keys(a) == similar.band_keys(b)).any())
    assert met / 300 >= 0.965  # 0.988 expected, standard error 0.006


def family(members=1000, planted=60, length=400):
    """Texts of one template, each with 8 words of its own (similarities near 0.68), and for some a copy with 6 more (near 0.86)."""
    r = random.Random(5)
    template = [f"t{i}" for i in range(length)]

    def changed(text, k, own):
        out = list(text)
        for place in r.sample(range(0, length, 10), k):
            out[place] = f"{own}x{place}"
        return out

    texts = [changed(template, 8, f"m{i}") for i in range(members)]
    copies = [changed(texts[i], 6, f"c{i}") for i in range(planted)]
    rows = [(i, " ".join(t), "s") for i, t in enumerate([*texts, *copies])]
    return rows, members


def test_blocks_of_a_crowd_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    rows, members = family(300, 30)
    got = {r.doc_id for r in similar.first_of_each(spark, documents(spark, rows)).collect()}
    assert len([i for i in got if i >= members]) <= 2


def test_a_large_family_loses_no_pair_and_gains_no_link(spark):
    rows, members = family()
    assert jaccard(rows[0][1], rows[members][1]) > 0.8 > 0.75 > jaccard(rows[0][1], rows[1][1])
    shingles = [similar.shingle_set(t, 5) for _, t, _ in rows]
    every = np.unique(np.concatenate(shingles))
    held = np.stack([np.isin(every, s) for s in shingles]).astype(np.float32)
    shared, n = held @ held.T, held.sum(1)
    alike = shared >= 0.8 * (n[:, None] + n[None, :] - shared)
    alone = set(np.flatnonzero(alike.sum(1) == 1).tolist())
    got = {r.doc_id for r in similar.first_of_each(spark, documents(spark, rows)).collect()}
    assert len(alone) > 900 and alone <= got
    assert len([i for i in got if i >= members]) <= 3  # of 60 planted copies


def test_recall_against_all_pairs(spark):
    """Links between different texts of sf0.01 that are lost: each pair of similarity 0.8 or more must end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    rows = docs.collect()
    shingles = [similar.shingle_set(r.text, 5) for r in rows]
    every = np.unique(np.concatenate(shingles))
    places = [np.searchsorted(every, s) for s in shingles]
    owners = [[] for _ in every]
    for i, p in enumerate(places):
        for x in p.tolist():
            owners[x].append(i)
    shared = Counter((a, b) for o in owners if 1 < len(o) < 400 for k, a in enumerate(o) for b in o[k + 1 :])
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(places[a]) + len(places[b]) - n)]
    root = list(range(len(rows)))
    for _ in range(20):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    empty = [i for i, p in enumerate(places) if not len(p)]
    want = {rows[min(g, key=lambda i: rows[i].doc_id)].doc_id for g in ([i for i in range(len(rows)) if root[i] == x] for x in {*root}) if not {*g} & {*empty}}
    got = {r.doc_id for r in similar.first_of_each(spark, docs).collect()} - {rows[i].doc_id for i in empty}
    different = len(pairs) and sum(len(places[a]) != len(places[b]) or (places[a] != places[b]).any() for a, b in pairs)
    assert want <= got and different > 10 and len(got - want) <= 0.05 * (len(rows) - len(want))


def few_changes(members, length=300):
    """Texts of one template with two words of their own: all pairs have a similarity over 0.85."""
    r = random.Random(9)
    out = []
    for i in range(members):
        text = [f"t{k}" for k in range(length)]
        for place in r.sample(range(0, length, 10), 2):
            text[place] = f"m{i}x{place}"
        out.append((i, " ".join(text), "s"))
    return out


def test_fingerprints_in_reach_are_linked_without_bands(spark, monkeypatch):
    """The pigeonhole over 64-bit fingerprints is a way of its own to the links."""
    meet = similar.meetings
    monkeypatch.setattr(similar, "meetings", lambda nodes: meet(nodes).filter("size < 0"))
    rows = few_changes(30)
    prints = [int(similar.sketch(similar.shingle_set(t, 5))[0]) for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= 3:
                    assert jaccard(rows[i][1], rows[j][1]) >= 0.8
                    root[i] = root[j] = min(root[i], root[j])
    got = sorted(r.doc_id for r in similar.first_of_each(spark, documents(spark, rows)).collect())
    assert got == sorted({*root}) and len(got) < len(rows)


def test_a_crowd_gives_as_many_links_as_members_at_most(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 64)
    rows = few_changes(60)
    texts = spark.createDataFrame([(f"n{i:03}", t) for i, t, _ in rows], "node string, text string")
    met = spark.createDataFrame([(1, f"n{i:03}", len(rows), f"n{i:03}") for i, _, _ in rows], "key long, node string, size long, root string")
    links = similar.in_crowds(similar.Scratch(spark, "t"), met, texts, 5, 0.8).collect()
    assert len(links) == len(rows) - 1  # 1770 pairs are similar
    root = {f"n{i:03}": f"n{i:03}" for i, _, _ in rows}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {*root.values()} == {"n000"}
