import zlib

import numpy as np
import pytest
from pathloom.llm import queries, rans, tokens

from .fixtures import TEXTS, documents

ODD_TEXTS = ["a  b", "a  <|endoftext|>  b\n\n c", "\t\tx\r\n y  ", "é É İ ǅ", "", "  ", "  x", "don't  we'll", "x\x1cy", "\x85 z", "a　　b", "   b", "x" * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(spark, sf_dir, name):
    encode = tokens.PieceEncoder(tokens.vocabulary(name))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for t in texts + ODD_TEXTS:
        assert list(encode.encode(t)) == encode.whole(t), t[:60]


def coder(ids, scale=16):
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    shares = rans.scaled(counts[symbols], scale)
    assert shares.sum() == 1 << scale and shares.min() >= 1
    return rans.Coder(symbols, shares, scale)


def test_round_trip():
    ids = np.minimum(np.random.default_rng(1).geometric(0.01, 300_001), 3000).astype(np.uint32)
    c = coder(ids)
    data = c.encode(ids)
    assert (c.decode(data) == ids).all()
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(data) * 8 / len(ids) < -(p * np.log2(p)).sum() + 0.7
    for first in range(2):
        assert (c.decode(data, first, 1) == ids[first * rans.CHECKPOINT : (first + 1) * rans.CHECKPOINT]).all()
    for n in (0, 1, rans.LANES - 1, rans.LANES, rans.LANES + 1):
        assert (c.decode(c.encode(ids[:n])) == ids[:n]).all()
    same = np.zeros(5000, np.uint32)
    assert (coder(same).decode(coder(same).encode(same)) == same).all()


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 91
    c = coder(ids)
    data = bytearray(c.encode(ids))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        c.decode(bytes(data))


def brute(rows):
    library, at, out = tokens.PieceEncoder(tokens.vocabulary("byte_bpe_50k.json")), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.asarray([*library.whole(t or ""), 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(queries.op1_token_ids(spark, sf_dir)) == brute(rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 1000)
    got = queries.token_digests(rans.stored_tokens(spark, documents(spark), tokens.vocabulary("byte_bpe_50k.json"), 2))
    assert found(got) == brute([(i, t) for i, t, _ in TEXTS])
    assert rans.stored_tokens(spark, documents(spark, []), tokens.vocabulary("byte_bpe_50k.json"), 2).count() == 0
