"""Whole texts to ids of a byte-level BPE file, as the tokenizers library gives them.

Most texts repeat their words, so a text is cut before spaces and each distinct piece is encoded once. A cut before a space is safe unless
that space has white space (or an end of the text) on both sides: the file's pattern never joins a word to the space after it, and a single
space goes with what follows. Texts with such a spot are encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np

_WHITE = frozenset("\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0            "
                   "    　")
#: Marks that end a word. After a letter they are tokens of their own in files with the usual pattern.
_TAILS = ".,;:!?"
#: Letters below this one are letters in every version of the tables that tell them.
_SETTLED = "\u0250"
#: Stands for a piece before which a cut isn't safe: its text has to be encoded whole.
_WHOLE = b""
#: Distinct pieces that a worker keeps (some 300 bytes each), characters of text taken at once, and of new pieces. They bound memory and
#: change no result.
KEPT_PIECES, CHARS_AT_ONCE, NEW_CHARS = 1_000_000, 2_000_000, 2_000


def little_endian(ids: Iterable[int]) -> bytes:
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise RuntimeError("array('I') isn't 32 bits wide here")
    return packed.tobytes()


class TextEncoder:
    """Texts -> their ids as little-endian unsigned 32-bit bytes.

    encode: the exact encoder of one string. encode_many: the same for many strings of which none is empty, starts or ends with white space but
    for one leading space; it may be faster than a loop. encode_word: the ids of a space and a word of plain letters, where the file's pattern
    takes these as one and parts a letter from the marks after it; words that differ in such marks alone are then encoded once.
    """

    def __init__(self, encode: Callable[[str], Iterable[int]], encode_many: Callable[[list[str]], Iterable[bytes]] | None = None,
                 encode_word: Callable[[str], Iterable[int]] | None = None):
        self.encode, self.encode_word = encode, encode_word
        self.encode_many = encode_many or (lambda pieces: [little_endian(encode(x)) for x in pieces])
        self.kept, self.tails = KEPT_PIECES, {}
        # ids of a space and a piece: pieces met lately, and those met before them
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        begin = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHARS_AT_ONCE or i + 1 == len(texts):
                yield from self._some(texts[begin:i + 1])
                begin, size = i + 1, 0

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        cut = [text.split(" ") for text in texts]
        heads = [parts.pop(0) for parts in cut]
        met = set().union(*cut)
        if len(self.known) > self.kept // 2:
            self.older, self.known = self.known, {}
        new = met.difference(self.known)
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        words, others, tailed = set(), [], []
        for piece in new.difference(again):
            if not piece or piece[0] in _WHITE:
                self.known[piece] = _WHOLE
            elif piece[-1] in _WHITE:
                self.known[piece] = little_endian(self.encode(" " + piece))
            elif self.encode_word is None:
                others.append(piece)
            elif _plain(piece):
                words.add(piece)
            elif piece[-1] in _TAILS and _plain(word := piece.rstrip(_TAILS)):
                tailed.append((piece, word))
                words.add(word)
            else:
                others.append(piece)
        for word in words:
            if word not in self.known:
                self.known[word] = little_endian(self.encode_word(word))
        self.known.update(zip(others, self.encode_many([" " + x for x in others]), strict=True))
        for piece, word in tailed:
            tail = piece[len(word):]
            if tail not in self.tails:
                self.tails[tail] = little_endian(self.encode(tail))
            self.known[piece] = self.known[word] + self.tails[tail]
        whole, known = {p for p in met if self.known[p] is _WHOLE}, self.known.__getitem__
        for text, head, parts in zip(texts, heads, cut, strict=True):
            if whole and not whole.isdisjoint(parts):
                yield little_endian(self.encode(text))
            else:
                yield (little_endian(self.encode(head)) if head else b"") + b"".join(map(known, parts))


def _plain(word: str) -> bool:
    """Letters alone, and such as are letters in every version of the tables that tell them."""
    return word.isalpha() and (word.isascii() or max(word) < _SETTLED)


def _word_encoder(model) -> Callable[[str], list[int]]:
    """The ids of a space and a word by the file's own model. Byte-level files write bytes that aren't printable as letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    written = {b: chr(256 + i) for i, b in enumerate(hidden)}
    space, tokenize = written[32], model.tokenize

    def encode(word: str) -> list[int]:
        return [x.id for x in tokenize(space + (word if word.isascii() else word.encode().decode("latin-1").translate(written)))]

    return encode


def _joined(encode: Callable[[str], list[int]], special: list[str]) -> Callable[[list[str]], Iterator[bytes]]:
    """Many pieces in one call: a tab between two pieces is a token of its own, and no other token holds one."""
    mark = encode("\t")

    def many(pieces: list[str]) -> Iterator[bytes]:
        for some in _portions(pieces):
            text = "\t".join(some)
            if len(mark) != 1 or text.count("\t") >= len(some) or any(s in text for s in special):
                yield from (little_endian(encode(x)) for x in some)
            else:
                yield from _split(encode(text), mark[0])

    return many


def _portions(pieces: list[str]) -> Iterator[list[str]]:
    ends, begin = list(accumulate(map(len, pieces))), 0
    while begin < len(pieces):
        end = max(begin + 1, bisect_right(ends, (ends[begin - 1] if begin else 0) + NEW_CHARS))
        yield pieces[begin:end]
        begin = end


def _split(ids: list[int], mark: int) -> Iterator[bytes]:
    packed, begin = little_endian(ids), 0
    for end in (4 * np.flatnonzero(np.frombuffer(packed, np.uint32) == mark)).tolist():
        yield packed[begin:end]
        begin = end + 4
    yield packed[begin:]


_ENCODERS: dict[str, TextEncoder] = {}


def library_encoder(path: str, kept: int = KEPT_PIECES) -> TextEncoder:
    """The encoder of a tokenizers file, one for each worker process, that keeps `kept` pieces. Truncation and padding of the file are switched off."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)  # the first makes no offsets

        def encode(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        with open(path, encoding="utf-8") as file:
            pattern = json.load(file).get("pre_tokenizer") or {}
        usual = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not any(set(x) & set(_TAILS) for x in special)
        usual = usual and tokenizer.normalizer is None and not any(_plain(x.strip()) for x in special)
        _ENCODERS[path] = TextEncoder(encode, _joined(lambda text: many([text], add_special_tokens=False)[0].ids, special),
                                      _word_encoder(tokenizer.model) if usual else None)
    _ENCODERS[path].kept = kept
    return _ENCODERS[path]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
