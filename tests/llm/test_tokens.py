"""Ids of the cutting encoder against the library's own encode() on whole texts."""

import random

import numpy as np
import pytest
from pathloom.llm import tokens

CONTEXTS = ["{c}", "a{c}b", " {c}1", "é{c}", "{c}{c} {c}", "'{c}s", "A{c}\n{c}z.", "x {c}  y"]
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def differing(encoder, texts):
    wanted = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    return [t for t, w in zip(texts, wanted, strict=True) if encoder.encode(t).tolist() != w]


@pytest.mark.parametrize("name", NAMES)
def test_every_code_point_in_contexts(name):
    encoder = tokens.PieceEncoder(tokens.vocabulary(name))
    for context in CONTEXTS:
        assert differing(encoder, [context.format(c=chr(c)) for c in range(0x3000)]) == []


@pytest.mark.parametrize("name", NAMES)
def test_random_texts(name):
    r, encoder = random.Random(5), tokens.PieceEncoder(tokens.vocabulary(name))
    kinds = [lambda: chr(r.randrange(0x250)), lambda: chr(r.randrange(0x20, 0x7F)), lambda: r.choice(" \n\t\r  "), lambda: chr(r.randrange(0x250, 0xD800)), lambda: chr(r.randrange(0xE000, 0x11000)), lambda: r.choice(["–", "’", "İ", "ß", "Ɓ", "<|", "'ll", "don't "])]
    weights = [(9, 9, 4, 0, 0, 0), (0, 9, 3, 0, 0, 1), (5, 5, 3, 3, 1, 1), (9, 2, 3, 0, 0, 3)]
    texts = ["".join(k() for k in r.choices(kinds, r.choice(weights), k=r.randrange(60))) for _ in range(10_000)]
    assert differing(encoder, texts) == []


def test_memory_is_bounded_and_harmless():
    path, r = tokens.vocabulary("word_bpe_49k.json"), random.Random(3)
    small, large = tokens.PieceEncoder(path), tokens.PieceEncoder(path)
    small.pieces = tokens.Remembered(20_000)
    for _ in range(300):
        text = " ".join(f"w{r.randrange(3000)} y{r.randrange(20)}" for _ in range(r.randrange(40))) + " " + "z" * r.randrange(90)
        assert np.array_equal(small.encode(text), large.encode(text))
        assert len(small.pieces.young) + len(small.pieces.old) < 250


@pytest.mark.parametrize("name", NAMES)
def test_pieces_of_ascii_texts(name):
    """Texts of ASCII alone have a pattern of their own, and a new piece goes to the model once."""
    encoder, asked, r = tokens.PieceEncoder(tokens.vocabulary(name)), [], random.Random(8)
    one = encoder.encode_piece
    encoder.encode_piece = lambda piece: asked.append(piece) or one(piece)
    text = " ".join(f"word{i % 40}'s #{i % 7}\t{'ab' * (i % 3)}\n" for i in range(300))
    assert encoder.encode(text).tolist() == encoder.whole(text) and asked and len(asked) == len({*asked})
    texts = ["".join(chr(r.randrange(1, 128)) for _ in range(r.randrange(80))) for _ in range(3000)] + ["z" * 200 + " " + "z" * 200, "a<|endoftext|>b", "it's 'lls <|"]
    assert differing(encoder, texts) == []
    ascii_, latin = tokens.ASCII_PIECES[encoder.kind], tokens.PIECES[encoder.kind]
    assert all(ascii_.findall(t) == latin.findall(t) for t in texts)


@pytest.mark.parametrize("name", NAMES)
def test_many_texts_at_once(name, monkeypatch):
    """Texts that are cut together have the library's ids, whatever lies at their ends."""
    monkeypatch.setattr(tokens, "GROUP", 300)
    r, encoder = random.Random(11), tokens.PieceEncoder(tokens.vocabulary(name))
    signs = [*"   \n\t\r''strevlmdLaé1²½.,–’…", "'ll", " 're", "<|endoftext|>", "\x0b", "\x85", "Ж", "東"]
    weights = [9] * (len(signs) - 5) + [1] * 5
    texts = ["".join(r.choices(signs, weights, k=r.randrange(16))) for _ in range(8000)] + ["", "x" * 500, " ", "", *(c.format(c=chr(p)) for c in CONTEXTS for p in range(0x250))]
    wanted = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode_many(texts)] == wanted
    assert encoder.encode_many([]) == [] and [len(x) for x in encoder.encode_many(["", ""])] == [0, 0]


def test_pieces_of_many_texts_are_looked_up_once():
    asked = []

    class Counted(tokens.Young):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    encoder = tokens.PieceEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    encoder.pieces.young = Counted()
    encoder.pieces.young.memory = encoder.pieces
    texts = [" ".join(f"word{i % 40} été{i % 7}," for i in range(k)) for k in range(200)]
    assert [x.tolist() for x in encoder.encode_many(texts)] == [encoder.whole(t) for t in texts]
    assert asked and len(asked) == len({*asked})
