"""Token counts of a unigram vocabulary: Viterbi that carries scores and counts, no pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from chatsieve.llm.common import small_batches, texts

SPACE = "▁"
#: What an unknown letter scores below the lowest piece, as tokenizers of this kind have it.
UNKNOWN_PENALTY = 10.0
_KEPT_UNITS = 700_000
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def unmatched_pieces(path: str) -> frozenset[str]:
    """Pieces that no text matches: marks of begin and end, the unknown piece, bytes. They count as ordinary letters where a text has them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return frozenset(model.id_to_piece(i) for i in range(model.get_piece_size()) if any(is_odd(i) for is_odd in odd))


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class UnigramCounter(dict):
    """Unit (a run of spaces and what follows up to the next space) -> number of its tokens.

    Every occurrence of every piece comes from one Aho-Corasick pass. The best way to each end keeps its score and its number of tokens. Tie
    rules of the tokenizer: of two ways of equal score the one whose last piece begins earlier wins; a letter that is no piece by itself
    may be taken as unknown, at the lowest score less a penalty; an unknown letter counts as its bytes where there are pieces for all
    bytes, and as one token else, neighbouring unknown letters together. A text may be cut before a space where no piece holds a space
    behind another letter; units of one text then add up. unmatched: pieces that a text never matches.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]], unmatched: frozenset[str] = frozenset()):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in unmatched:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.single = {p for p in names if len(p) == 1 and p not in unmatched}
        self.unknown_score = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in names) and SPACE in names

    def __missing__(self, part: str) -> int:
        if len(self) >= _KEPT_UNITS:
            self.clear()
        n = self[part] = self.count_unit(SPACE + part)
        return n

    def count_unit(self, unit: str) -> int:
        size = len(unit)
        score, count, begin, unknown = [None] * (size + 1), [0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        score[0] = 0.0
        found = self.automaton.iter(unit)
        match = next(found, None)
        for end in range(1, size + 1):
            best, at, n, is_unknown = None, 0, 0, False
            while match is not None and match[0] == end - 1:
                length, own = match[1]
                first = end - length
                reached = score[first] + own
                if best is None or reached > best or (reached == best and first < at):
                    best, at, n = reached, first, count[first] + 1
                match = next(found, None)
            if unit[end - 1] not in self.single:
                reached = score[end - 1] + self.unknown_score
                if best is None or reached > best:
                    best, at, is_unknown = reached, end - 1, True
                    n = count[at] + (len(unit[at].encode("utf-8", "surrogatepass")) if self.bytes else not unknown[at])
            score[end], begin[end], count[end], unknown[end] = best, at, n, is_unknown
        return count[size]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cut:
            return self.count_unit(SPACE + text.replace(" ", SPACE))
        if SPACE not in text:
            parts = text.split(" ")
            if "" not in parts:
                return sum(map(self.__getitem__, parts))
        return sum(self[u[1:]] for u in _UNITS.findall(SPACE + text.replace(" ", SPACE)))


_MADE: dict[str, UnigramCounter] = {}


def count_tokens(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text under the file's pieces and scores, read as a unigram vocabulary.

    A space before the text is assumed and spaces are kept. Null or empty text: 0. Null and repeated ids: one row for each row. Empty table:
    no rows. Other columns of `docs` don't matter.
    """
    path = model_file or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _MADE:
            _MADE[path] = UnigramCounter(pieces_of(path), unmatched_pieces(path))
        counter = _MADE[path]
        for batch in small_batches(batches, 1):
            n = pa.array(map(counter.count, batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
