"""Byte-pair encoding by backtracking, and decoding by an offset table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatsieve.llm.bytelevel import TextEncoder, default_file
from chatsieve.llm.common import small_batches, texts


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level files write for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class BacktrackingEncoder:
    """Exact merges in linear time.

    A sequence of tokens is what merging gives if and only if each neighbouring pair is what merging gives (the pair is compatible). So the
    longest token at each place is tried first, shorter prefixes of it next; when none is compatible with the token before, that token is
    taken back, and its end is marked as leading nowhere. No end is visited again once marked, which keeps the work linear.
    Tokens are numbered by merge order inside: bytes first, then merges.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names = [letters[b] for b in range(256)]
        number = {x: i for i, x in enumerate(names)}
        self.halves, self.merged = [(i, i) for i in range(256)], {}
        for a, b in merges:
            pair = number[a], number[b]
            if pair in self.merged:
                continue
            number.setdefault(a + b, len(names))
            if number[a + b] == len(names):
                names.append(a + b)
                self.halves.append(pair)
            self.merged[pair] = number[a + b]
        self.outer = [vocab[x] for x in names]
        raw = [bytes(back[c] for c in x).decode("latin-1") for x in names]
        self.length = [len(x) for x in raw]
        self.automaton, by_text = ahocorasick.Automaton(), {x: i for i, x in enumerate(raw)}
        for x, i in by_text.items():
            self.automaton.add_word(x, (len(x), i))
        self.automaton.make_automaton()
        self.shorter = [next((by_text[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in by_text), -1) for x in raw]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.around = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(_pattern())
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two; undoes merges in reverse order and looks for an earlier one across."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        bound = len(self.halves)  # merges numbered below it come before what has been undone
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                bound, left = left, self.halves[left][1]
            else:  # of two equal tokens the left one is made first, so a merge of that number across would come between
                bound, right = right + 1, self.halves[right][0]

    def longest(self, word: str) -> list[int]:
        """The longest token that begins at each place."""
        best, size = [0] * len(word), [0] * len(word)
        for end, (n, token) in self.automaton.iter(word):
            begin = end - n + 1
            if n > size[begin]:
                best[begin], size[begin] = token, n
        return best

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        data = word.encode().decode("latin-1")
        longest, alive, out, at, token = self.longest(data), [True] * (len(data) + 1), [], 0, -1
        token = longest[0]
        while at < len(data):
            end = at + self.length[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < len(data):
                    token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                alive[at] = False
                token = out.pop()
                at -= self.length[token]
        return [self.outer[t] for t in out]

    def __call__(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.around.split(text) if self.around and self.around.search(text) else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self.words.findall(part):
                    ids = self.pieces.get(word)
                    if ids is None:
                        ids = self.word(word)
                        if len(word) < 40:
                            if len(self.pieces) >= 500_000:
                                self.pieces.clear()
                            self.pieces[word] = ids
                    out += ids
        return out


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class OffsetDecoder:
    """All tokens' bytes end to end, and where each begins: ids become bytes by one gather."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {c: b for b, c in byte_letters().items()}
        by_id = {i: bytes(back[c] for c in x) for x, i in spec["model"]["vocab"].items() if all(c in back for c in x)}
        by_id |= {i: x.encode() for x, i in spec["model"]["vocab"].items() if i not in by_id}
        by_id |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
        """Texts of the id lists ids[bounds[i]:bounds[i + 1]]; bytes that aren't UTF-8 become U+FFFD. A bounded number of ids is gathered at once."""
        for first in range(len(bounds) - 1):
            parts = []
            for begin in range(bounds[first], bounds[first + 1], 500_000):
                some = ids[begin:min(begin + 500_000, bounds[first + 1])]
                sizes = self.sizes[some]
                ends = np.cumsum(sizes)
                where = np.repeat(self.begins[some] - (ends - sizes), sizes) + np.arange(ends[-1])
                parts.append(self.bytes[where].tobytes())
            yield b"".join(parts).decode("utf-8", "replace")


_MADE: dict[tuple, object] = {}


def _made(kind, path: str):
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


def bpe_encode(docs: DataFrame, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, as the byte-level BPE file gives them without added special tokens.

    Null or empty text: no ids. Null and repeated doc_ids: one row for each row. Empty table: no rows. Strings of special tokens in a text
    become those tokens. Other columns of `docs` don't matter.
    """
    path = tokenizer_file or default_file()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ("text", path) not in _MADE:
            _MADE["text", path] = TextEncoder(BacktrackingEncoder(path))
        encoder = _MADE["text", path]
        for batch in small_batches(batches, 1):
            lists = list(encoder(batch.column(1).to_pylist()))
            bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in lists]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(lists), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>")


def bpe_decode(coded: DataFrame, tokenizer_file: str | None = None, ids_col: str = "ids") -> DataFrame:
    """`coded` with its ids replaced by a column `decoded`, their text. Null ids count as none."""
    path, others = tokenizer_file or default_file(), [c for c in coded.columns if c != ids_col]
    schema = coded.select(*others).schema.add("decoded", "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _made(OffsetDecoder, path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            ids = np.asarray(lists.flatten())
            sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            texts_ = pa.array(list(decoder(ids, bounds)), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), texts_], names=[*others, "decoded"])

    return coded.mapInArrow(decode, schema)
