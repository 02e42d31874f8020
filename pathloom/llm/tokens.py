"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once in a worker.

Both public byte-pair vocabularies cut a text into pieces (a word with the space before it, a number, a run of signs,
white space) and encode each piece by itself. Texts of Latin letters, whose classes no library disputes, are cut here
by the vocabulary's own pattern and new pieces go to the library's model; for a vocabulary of lower case a text is Latin
if it still is in lower case (some capitals below U+0250 have small letters above it). Other texts are cut before runs of
plain white space, which is always a piece's border, and the chunks go through the library's whole pipeline; texts with
any other white space go through it in one. All three ways give the ids of the whole text; the tests hold every code
point below U+3000, in several contexts, against the library.

Many texts at once (``encode_many``) are cut by array operations that give the pieces of the byte vocabulary's pattern, and
each distinct piece of a group of texts is looked up once, not at every place.

What a worker remembers is bounded in bytes (``Remembered``), so that a worker that Spark reuses for another job holds
no more than that.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space by any library's rules, other than the four plain ones.
ODD = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: Letters and numbers among the code points up to U+024F; these and some signs make a Latin text.
LETTERS, NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
NOT_LATIN = re.compile(r"[^\x00-ɏ–—‘-„…]")
SPACE = r" \n\t\r"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"


def patterns(letters: str, numbers: str) -> dict[str, re.Pattern]:
    """The pieces of the two kinds of vocabulary, as their files define them; letters come first, which no other alternative begins with."""
    return {
        "bytes": re.compile(rf" ?[{letters}]+|{SHORT}| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
        "words": re.compile(rf"[{letters}]+|{SHORT}|[{numbers}]|[^{SPACE}{letters}{numbers}]+"),
    }


PIECES, ASCII_PIECES = patterns(LETTERS, NUMBERS), patterns("A-Za-z", "0-9")
#: Bytes that a memory of pieces may hold, by a rough count of its strings and ids, and the longest piece it takes.
KNOWN_BYTES, MAX_PIECE = 80 << 20, 64
#: Characters of a group of texts that are cut together; a longer text is encoded by itself.
GROUP = 1 << 20
#: What each character of a Latin text is to the patterns, by code point.
WHITE, LETTER, NUMBER, SIGN = range(4)
KIND = np.full(0x2100, SIGN, np.uint8)
for _kind, _class in ((WHITE, SPACE), (LETTER, LETTERS), (NUMBER, NUMBERS)):
    KIND[[ord(c) for c in re.findall(f"[{_class}]", "".join(map(chr, range(0x250))))]] = _kind
_encoders: dict[str, PieceEncoder] = {}


class Young(dict):
    """Pieces and their ids; one that is looked up and not there is asked of the memory."""

    memory: Remembered

    def __missing__(self, piece: str) -> bytes:
        return self.memory.recalled(piece)


class Remembered:
    """Ids of pieces, as bytes, in two generations: pieces of the older one that are met again move to the younger one; when that is full, the older one goes."""

    def __init__(self, most: int = KNOWN_BYTES):
        self.old: dict[str, bytes] = {}
        self.most = most
        self.renew()

    def renew(self) -> None:
        self.young, self.size = Young(), 0
        self.young.memory = self

    def missing(self, parts: list[str]) -> list[str]:
        """Distinct pieces that are not known; the known ones are in ``young`` from now on, until the next call of ``trim``."""
        new = []
        for p in {*parts}.difference(self.young):
            if p in self.old:
                self.add(p, self.old[p])
            else:
                new.append(p)
        return new

    def recalled(self, piece: str) -> bytes:
        """The ids of a piece that is not in ``young``, and is from now on unless it is long."""
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= MAX_PIECE:
            self.add(piece, ids)
        return ids

    def add(self, piece: str, ids: bytes) -> None:
        self.young[piece] = ids
        self.size += 200 + len(piece) + len(ids)

    def drop(self, piece: str) -> None:
        self.size -= 200 + len(piece) + len(self.young.pop(piece))

    def trim(self) -> None:
        if 2 * self.size > self.most:
            self.old = self.young
            self.renew()


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; any other path may be given in its stead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of Latin texts begin that lie one after another, by the pattern "bytes"; texts: where the texts begin."""
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[texts] = edge[n] = True
    kind = KIND[points]
    white, start = kind == WHITE, edge[:n].copy()
    # another kind begins a piece, but a blank belongs to what follows it
    start[1:] |= (kind[1:] != kind[:-1]) & (points[:-1] != 32)
    # the last of several white characters is a piece's first, unless the text ends with them
    start[1:-1] |= white[1:-1] & white[:-2] & ~white[2:] & ~edge[2:n]
    quote = np.flatnonzero(start & (points == 39))
    if len(quote):
        after = [np.where(quote + k < n, points[np.minimum(quote + k, n - 1)], 0) for k in (1, 2)]
        one, two = ~edge[quote + 1], ~edge[np.minimum(quote + 2, n)]
        short = one & np.isin(after[0], [ord(c) for c in "stmd"])
        long = one & two & (np.isin(after[0], [ord("r"), ord("v")]) & (after[1] == ord("e")) | (after[0] == ord("l")) & (after[1] == ord("l")))
        start[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """encode(text) gives the ids; pieces that were seen are remembered within a bound of bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.library = Tokenizer.from_str(f.read())
        self.kind = "words" if self.library.model.end_of_word_suffix else "bytes"
        self.letters = byte_letters()
        self.model = self.library.model
        self.pieces, self.chunks = Remembered(), Remembered()

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        if ODD.search(text):
            return np.asarray(self.whole(text), np.uint32)
        lower = text.lower() if self.kind == "words" else text
        if plain := text.isascii():
            latin = "<|" not in text
        else:
            latin = not (NOT_LATIN.search(text) or "<|" in text or (lower is not text and NOT_LATIN.search(lower)))
        if not latin:
            return self.joined(CHUNK.findall(text), self.chunks, self.encode_chunks)
        known = self.pieces
        known.encode = self.encode_piece
        out = np.frombuffer(b"".join(map(known.young.__getitem__, (ASCII_PIECES if plain else PIECES)[self.kind].findall(lower))), np.uint32)
        known.trim()
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out, group, size = [], [], 0

        def cut():
            nonlocal size
            for i, ids in zip(group, self.encode_group([texts[i] for i in group]), strict=True):
                out[i] = ids
            group.clear()
            size = 0

        for i, text in enumerate(texts):
            if self.kind != "bytes" or len(text) > GROUP or "<|" in text or ODD.search(text) or not text.isascii() and NOT_LATIN.search(text):
                out.append(self.encode(text))
                continue
            if size + len(text) > GROUP:
                cut()
            out.append(None)
            group.append(i)
            size += len(text)
        cut()
        return out

    def encode_group(self, texts: list[str]) -> list[np.ndarray]:
        """encode_many for Latin texts, which are cut together, by the pattern "bytes"."""
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        data = joined.encode()
        points = np.frombuffer(data, np.uint8) if len(data) == len(joined) else np.frombuffer(joined.encode("utf-16-le"), "<u2")
        ends = np.cumsum([len(t) for t in texts])
        start = piece_starts(points, np.concatenate([[0], ends[:-1]]))
        place = np.append(start, len(points))
        if len(data) != len(joined):  # places in UTF-8
            place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800), dtype=np.int64)])[place]
        pieces = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        known = self.pieces
        known.encode = self.encode_piece
        found = [*map(known.young.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False))]
        known.trim()
        ids = np.frombuffer(b"".join(found), np.uint32)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = pieces.indices.to_numpy()
        first, counts = (np.cumsum(counts) - counts)[which], counts[which]
        stop = np.cumsum(counts)
        ids = ids[np.repeat(first - stop + counts, counts) + np.arange(stop[-1])]
        return np.split(ids, np.concatenate([[0], stop])[np.searchsorted(start, ends[:-1])])

    def encode_piece(self, piece: str) -> bytes:
        letters = self.letters
        if piece.isascii() and piece.isprintable():  # of these bytes only the blank has another letter
            spelled = piece.replace(" ", letters[0x20])
        else:
            spelled = "".join([letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode_chunks(self, new: list[str]):
        for at in range(0, len(new), 4096):
            for e in self.library.encode_batch_fast(new[at : at + 4096], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    @staticmethod
    def joined(parts: list[str], known: Remembered, encode) -> np.ndarray:
        new = known.missing(parts)
        for p, ids in zip(new, encode(new), strict=True):
            known.add(p, ids)
        out = np.frombuffer(b"".join(map(known.young.__getitem__, parts)), np.uint32)
        for p in new:
            if len(p) > MAX_PIECE:
                known.drop(p)
        known.trim()
        return out


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
