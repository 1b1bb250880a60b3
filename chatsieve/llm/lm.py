"""Language-model scoring: a log-bilinear model, trained by noise-contrastive estimation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import crc_of_id, small_batches, staged, texts

#: Stands for the end of a text; no word holds a line end.
END = b"\n"
_KEPT_WORDS = 500_000
#: Products of the exponentials of two parts up to so far from zero, and sums of some thousand, neither overflow nor vanish in single precision.
FAR = 40.0


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between white space (space, tab to carriage return)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_key(word: bytes) -> int:
    """A negative 63-bit hash. Different words share one with a chance of about V * V / 2**64 for V distinct words."""
    return -1 - (xxhash.xxh3_64_intdigest(word) >> 1)


@dataclass(frozen=True)
class CorpusCounts:
    """What the training texts hold: counts by word key (a table), their sum and number, and the frequent words.

    head: keys of the words with at least tokens / head_bound occurrences, so at most `head_bound` of them, most frequent first.
    """

    table: DataFrame
    tokens: int
    words: int
    head: np.ndarray
    head_counts: np.ndarray


def corpus_counts(docs: DataFrame, head_bound: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> CorpusCounts:
    """Counts over all rows of `docs`; combined per task before the shuffle, and no count is dropped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small_batches(batches, 1):
            for text in batch.column(1).to_pylist():
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) > _KEPT_WORDS:
                    yield _counted(seen)
                    seen = Counter()
        if seen:
            yield _counted(seen)

    table = staged(texts(docs, id_col, text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, words = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = table.where(F.col("n") * head_bound >= tokens).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return CorpusCounts(table, int(tokens), int(words), head["word"].to_numpy(np.int64), head["n"].to_numpy(np.int64))


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = np.fromiter(map(word_key, seen), np.int64, len(seen))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], names=["word", "n"])


class _Places:
    """Words of a text, and its end, as their places in the head, or their (negative) keys."""

    def __init__(self, head: np.ndarray):
        self.order = np.argsort(head)
        self.sorted = head[self.order]

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        words.append(END)
        keys = -1 - (np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8") >> np.uint64(1)).astype(np.int64)
        if not len(self.sorted):
            return keys
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.order[at], keys)


@dataclass(frozen=True)
class LogBilinear:
    """The next word's features are a linear map of the word before; its score is their product with each word's vector, plus a bias.

    Words are numbered by place in the head; the last number stands for all others. before, mapped, word: vectors; bias: one per word.
    """

    before: np.ndarray
    mapped: np.ndarray
    word: np.ndarray
    bias: np.ndarray

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probability of each word (column) after each word (row), by batched matrix products."""
        out = np.empty((len(self.bias), len(self.bias)), np.float32)
        for first in range(0, len(out), 512):
            s = (self.before[first:first + 512] @ self.mapped) @ self.word.T + self.bias
            s = s.astype(np.float64)
            top = s.max(1, keepdims=True)
            out[first:first + 512] = (s - top - np.log(np.exp(s - top).sum(1, keepdims=True))) / np.log(10)
        return out


def fit_log_bilinear(pairs: np.ndarray, dim: int = 16, noise: int = 20, steps: int = 150, rate: float = 0.05, ridge: float = 10.0,
                     seed: int = 5) -> LogBilinear:
    """Noise-contrastive estimation from a table of counts: pairs[v, w] is how often w follows v.

    Each observed pair is told from `noise` draws of the unigram distribution by the logistic of score - log(noise * unigram). As the table
    holds all pairs, the expectation over data and noise is taken whole at each step of Adam, not by drawing. `ridge` is the precision of a
    Gaussian prior on the vectors; it keeps rare pairs of a small corpus from being learned by heart.
    """
    n = len(pairs)
    total = max(1.0, pairs.sum())
    unigram = ((pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * n)).astype(np.float32)
    data = (pairs / total).astype(np.float32)
    drawn = (noise * (data.sum(1, keepdims=True)) * unigram).astype(np.float32)
    draw = np.random.default_rng(seed)
    params = [(0.1 * draw.standard_normal((n, dim))).astype(np.float32), np.eye(dim, dtype=np.float32),
              (0.1 * draw.standard_normal((n, dim))).astype(np.float32), np.log(unigram)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    shift, pull = np.log(noise * unigram), np.float32(ridge / total)
    for t in range(1, steps + 1):
        before, mapped, word, bias = params
        hidden = before @ mapped
        s = hidden @ word.T
        s += bias - shift
        np.clip(s, -30, 30, out=s)
        np.negative(s, out=s)
        np.exp(s, out=s)
        s += 1
        np.reciprocal(s, out=s)  # chance that a pair is data
        g = (data + drawn) * s - data
        grad_hidden = g @ word
        gradients = [grad_hidden @ mapped.T + pull * before, before.T @ grad_hidden, g.T @ hidden + pull * word, g.sum(0)]
        pace = rate * (1 - t / (steps + 1))
        for i, x in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * x
            second[i] = 0.99 * second[i] + 0.01 * x * x
            params[i] = params[i] - pace * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-10)
    return LogBilinear(*params)


@dataclass(frozen=True)
class Words:
    """Every word has a number: its place in the head, or one of `buckets` by its key (a power of two that grows with the words beyond the head).

    The first `own` numbers are outcomes of the first level by themselves; the others are dealt over `groups`, each one outcome, in turn.
    total: occurrences plus one for each number of the head; for a bucket, plus one for each of its words and for one unseen word.
    """

    head: np.ndarray
    buckets: int
    own: int
    groups: int
    total: np.ndarray

    @classmethod
    def of(cls, counts: CorpusCounts, vocabulary: int) -> Words:
        rest = counts.words - len(counts.head)
        buckets = 1 << int(np.ceil(np.log2(16 * np.sqrt(rest)))) if rest else 1
        got = _beyond(counts).groupBy(F.col("word").bitwiseAND(buckets - 1).alias("b")).agg(F.sum(F.col("n") + 1).alias("n")).toArrow()
        total = np.ones(buckets)
        total[got["b"].to_numpy()] += got["n"].to_numpy()
        total = np.concatenate((counts.head_counts + 1.0, total))
        own = min(max(1, vocabulary // 4), len(total))
        return cls(counts.head, buckets, own, min(max(1, vocabulary // 4), len(total) - own), total)

    def numbers(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, places, len(self.head) + (places & (self.buckets - 1)))

    def outcomes(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < self.own, numbers, self.own + (numbers - self.own) % max(1, self.groups))

    def unigram(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the outcomes, and of each number within its outcome."""
        outcome = self.outcomes(np.arange(len(self.total)))
        of_outcome = np.bincount(outcome, self.total, self.own + self.groups)
        return of_outcome / self.total.sum(), self.total / of_outcome[outcome]


def _beyond(counts: CorpusCounts) -> DataFrame:
    """Counts of the words beyond the head."""
    return counts.table.where(F.col("n") < int(counts.head_counts.min()) if len(counts.head) else F.lit(True))


def _contexts(numbers: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the word before each and of the one before that; a text follows the end of a text."""
    return np.concatenate(([end], numbers[:-1])), np.concatenate(([end, end], numbers[:-2]))[:len(numbers)]


@dataclass(frozen=True)
class TwoWords:
    """Log-bilinear over the two words before. Their vectors are added; a word's chance is that of its outcome times its share in the group.

    tables: vectors as the word before, and as the one before that, of each number; vector and bias of each outcome, and of each number
    within its group. Both levels are normalised by sums over all their members, so the chances of all words sum to one.
    """

    words: Words
    tables: tuple[np.ndarray, ...]

    def log10(self, one: np.ndarray, two: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        before, earlier, first, within = self.tables
        own, groups = self.words.own, self.words.groups
        wide = _wide(before, earlier, one, two)
        outcome = self.words.outcomes(numbers)
        out = np.einsum("ij,ij->i", wide, first.take(outcome, 0)).astype(np.float64) - _log_normals(before, earlier, first, one, two)
        far = np.flatnonzero(np.isnan(out))
        out[far] = _log_chances(wide[far], first, outcome[far])
        out = np.minimum(0.0, out)  # rounding may pass 1
        order, cuts = _by_group(numbers, outcome, own)
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[begin:end]
            out[mine] += _log_chances(wide[mine], within[outcome[mine[0]]::groups], (numbers[mine] - own) // groups)
        return out / np.log(10)


def _wide(before: np.ndarray, earlier: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Features of the contexts, and a one for the bias."""
    wide = np.ones((len(one), before.shape[1] + 1), np.float32)
    np.add(before.take(one, 0), earlier.take(two, 0), out=wide[:, :-1])
    return wide


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the rows, and the rows in it; by one sort of whole numbers that hold both, which takes less than sorting places."""
    bits = len(rows).bit_length()
    both = np.sort(rows.astype(np.int64) << bits | np.arange(len(rows)))
    return both & ((1 << bits) - 1), both >> bits


def _short(numbers: np.ndarray) -> np.ndarray:
    """In 16 bits where they fit, as these sort in linear time."""
    return numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers


def _by_group(numbers: np.ndarray, outcome: np.ndarray, own: int) -> tuple[np.ndarray, list[int]]:
    """Places of the numbers that belong to a group, group by group, and where each group begins and the last one ends."""
    order = np.flatnonzero(numbers >= own)
    order = order[np.argsort(_short(outcome[order]), kind="stable")]
    of = outcome[order]
    return order, np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))).tolist() if len(order) else []


def _placed(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of `rows` (numbers below n), ascending, and the place of each row among them."""
    met, at = np.zeros(n, bool), np.empty(n, np.intp)
    met[rows] = True
    some = np.flatnonzero(met)
    at[some] = np.arange(len(some))
    return some, at.take(rows)


def _log_normals(before: np.ndarray, earlier: np.ndarray, table: np.ndarray, one: np.ndarray, two: np.ndarray, width: int = 64,
                 rows: int = 2048) -> np.ndarray:
    """Log of the sum of exp(score) over all outcomes of each context.

    A score is a part by the word before plus a part by the one before that. So exponentials are taken once for each distinct word, and a context
    sums their products; `width` outcomes at a time, which bounds memory. NaN where a part is beyond `FAR`.
    """
    words, places = zip(_placed(one, len(before)), _placed(two, len(earlier)), strict=True)
    vectors, far = [before[words[0]], earlier[words[1]]], [np.zeros(len(w), bool) for w in words]
    sums = np.zeros(len(one))
    for k in range(0, len(table), width):
        some = np.ascontiguousarray(table[k:k + width].T)
        parts = [v @ some[:-1] for v in vectors]
        parts[0] += some[-1]
        for part, beyond in zip(parts, far, strict=True):
            if not (part.max() <= FAR and part.min() >= -FAR):
                beyond |= ~(np.abs(part).max(1) <= FAR)
                np.clip(part, -FAR, FAR, out=part)
            np.exp(part, out=part)
        for i in range(0, len(one), rows):
            sums[i:i + rows] += np.einsum("ij,ij->i", parts[0].take(places[0][i:i + rows], 0), parts[1].take(places[1][i:i + rows], 0))
    sums[far[0][places[0]] | far[1][places[1]]] = np.nan
    return np.log(sums)


def _log_chances(wide: np.ndarray, table: np.ndarray, chosen: np.ndarray, rows: int = 512) -> np.ndarray:
    """Log of the chosen members' softmax; blocks of rows in one buffer, so that a block's scores stay near the processor."""
    if len(table) == 1:
        return np.zeros(len(wide))
    out, turned, ones = np.empty(len(wide)), np.ascontiguousarray(table.T), np.ones(len(table), np.float32)
    room = np.empty((min(rows, len(wide)), len(table)), np.float32)
    for i in range(0, len(wide), rows):
        s = np.matmul(wide[i:i + rows], turned, out=room[:len(wide) - i])
        top = s.max()
        if top > 60 or s.min() < -60:  # else neither overflows nor vanishes
            s -= s.max(1, keepdims=True)
        at = s[np.arange(len(s)), chosen[i:i + rows]].astype(np.float64)
        np.exp(s, out=s)
        out[i:i + rows] = at
        out[i:i + rows] -= np.log((s @ ones).astype(np.float64))
    return np.minimum(0.0, out)  # rounding may pass 1


class _Trainer:
    """Noise-contrastive steps over the texts of one task, with drawn noise; Adagrad with one scale for each row of a table."""

    def __init__(self, model: TwoWords, seed, noise: int = 10, shared: int = 128, own_noise: int = 8, rate: float = 0.2):
        self.words, self.tables = model.words, [t.copy() for t in model.tables]
        self.scale = [np.full(len(t), 0.1, np.float32) for t in self.tables]
        self.touched = [np.zeros(len(t), np.int64) for t in self.tables]
        self.noise, self.shared, self.own_noise, self.rate = noise, shared, own_noise, rate
        self.draw = np.random.default_rng(seed)
        share, inner = self.words.unigram()
        self.share, self.inner = share.astype(np.float32), inner.astype(np.float32)
        self.cumulated = np.cumsum(share)
        own, groups = self.words.own, self.words.groups
        #: Cumulated shares of the numbers of each group, one group after the other.
        self.members = np.concatenate([np.arange(own + g, len(inner), groups) for g in range(groups)]) if groups else np.empty(0, np.int64)
        self.starts = np.cumsum([0] + [len(range(own + g, len(inner), groups)) for g in range(groups)])
        self.within = np.cumsum(inner[self.members])

    def _change(self, k: int, rows: np.ndarray, gradient: np.ndarray, seen: bool = True) -> None:
        order, ordered = _sorted(rows)
        begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        some = ordered[begin]
        g = np.add.reduceat(gradient.take(order, 0), begin, axis=0)
        self.scale[k][some] += (g * g).mean(1)
        self.tables[k][some] -= self.rate * g / np.sqrt(self.scale[k][some])[:, None]
        if seen:
            self.touched[k][some] += np.diff(begin, append=len(rows))

    def step(self, one: np.ndarray, two: np.ndarray, numbers: np.ndarray) -> None:
        """One step on some tokens. `shared` outcomes are drawn for all of them, `own_noise` numbers for all that belong to one group."""
        before, earlier, first, within = self.tables
        wide = _wide(before, earlier, one, two)
        outcome = self.words.outcomes(numbers)
        drawn = np.minimum(np.searchsorted(self.cumulated, self.draw.random(self.shared)), len(self.cumulated) - 1)
        mine = first.take(outcome, 0)
        data = _chance(np.einsum("ij,ij->i", wide, mine) - np.log(self.noise * self.share[outcome])) - 1
        turned, noise = first[drawn].T.copy(), np.empty((len(wide), self.shared), np.float32)
        turned[-1] -= np.log(self.noise * self.share[drawn])  # times one
        np.negative(turned, out=turned)
        for i in range(0, len(wide), 1024):  # short blocks stay near the processor
            _chance_against(np.matmul(wide[i:i + 1024], turned, out=noise[i:i + 1024]))
        noise *= np.float32(self.noise / self.shared)
        back = data[:, None] * mine[:, :-1] + noise @ first[drawn, :-1]
        changes = [(2, outcome, data[:, None] * wide, True), (2, drawn, noise.T @ wide, False)]
        order, cuts = _by_group(numbers, outcome, self.words.own)
        if len(order):
            w, x = numbers[order], wide.take(order, 0)
            mine = within.take(w, 0)
            data = _chance(np.einsum("ij,ij->i", x, mine) - np.log(self.own_noise * self.inner[w])) - 1
            mine *= data[:, None]
            groups = outcome[order[cuts[:-1]]] - self.words.own
            low = np.where(self.starts[groups] > 0, self.within[self.starts[groups] - 1], 0.0)
            at = low[:, None] + self.draw.random((len(groups), self.own_noise)) * (self.within[self.starts[groups + 1] - 1] - low)[:, None]
            z = self.members[np.clip(np.searchsorted(self.within, at), self.starts[groups][:, None], self.starts[groups + 1][:, None] - 1)]
            shift, drawn_rows, met = np.log(self.own_noise * self.inner[z]), within[z], np.empty((*z.shape, x.shape[1]), np.float32)
            spans, chance = list(zip(range(len(z)), cuts[:-1], cuts[1:], strict=True)), np.empty((len(x), self.own_noise), np.float32)
            for i, begin, end in spans:
                np.matmul(x[begin:end], drawn_rows[i].T, out=chance[begin:end])
            chance -= np.repeat(shift, np.diff(cuts), 0)
            _chance(chance)
            for i, begin, end in spans:
                mine[begin:end] += chance[begin:end] @ drawn_rows[i]
                np.matmul(chance[begin:end].T, x[begin:end], out=met[i])
            back[order] += mine[:, :-1]
            changes += [(3, w, data[:, None] * x, True), (3, z.ravel(), met.reshape(-1, x.shape[1]), False)]
        for change in [*changes, (0, one, back, True), (1, two, back, True)]:
            self._change(*change)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows met in the texts of this task, times how often."""
        for k, table in enumerate(self.tables):
            some = np.flatnonzero(self.touched[k])
            for i in range(0, len(some), 50_000):
                at = some[i:i + 50_000]
                values = np.zeros((len(at), self.tables[2].shape[1]), np.float32)
                values[:, :table.shape[1]] = table[at] * self.touched[k][at][:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(self.touched[k][at]), *map(pa.array, values.T)],
                                                 names=["k", "row", "times", *[f"v{j}" for j in range(values.shape[1])]])


def _chance(x: np.ndarray) -> np.ndarray:
    return _chance_against(np.negative(x, out=x))


def _chance_against(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)); beyond -30 it is 1 in single precision by itself."""
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def train_log_bilinear(docs: DataFrame, counts: CorpusCounts, vocabulary: int = 1024, id_col: str = "doc_id", text_col: str = "text", dim: int = 16,
                       rounds: int = 1, batch_size: int = 8192, seed: int = 5) -> TwoWords:
    """Every word of every text is learned, as target and as either context word.

    Start: how often each outcome (vocabulary // 4 words and as many groups) follows each other over all texts, fitted whole on the driver;
    every number begins with the vector of its outcome, moved a little at random, so that contexts of one outcome can be told apart from the first step
    on. Then `rounds` rounds of noise-contrastive steps over all texts, as many for every size of the corpus, each task for itself; after a round a row
    is the mean over the tasks that met it, by how often.
    A task and the driver hold the tables: 50 numbers of 4 bytes for each word of the head and each bucket, and the buckets grow with the square root
    of the words.
    """
    words = Words.of(counts, vocabulary)
    n, outcomes = len(words.total), words.own + words.groups

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(words.head)
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array([words.numbers(places(t)).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()],
                                                       pa.binary())], names=["numbers"])

    numbered = staged(texts(docs, id_col, text_col).mapInArrow(number, "numbers binary"), "zstd")
    last = int(words.numbers(_Places(words.head)(None))[0])

    def chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, ...]]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                mine = np.frombuffer(text.as_buffer(), np.int32).astype(np.int64)
                held.append((*_contexts(mine, last), mine))
                size += len(mine)
                if size >= least:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(outcomes * outcomes, np.int64)
        for one, _, mine in chunks(batches, 1_000_000):
            cells += np.bincount(words.outcomes(one) * outcomes + words.outcomes(mine), minlength=len(cells))
        some = np.flatnonzero(cells)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], names=["cell", "n"])

    got = numbered.mapInArrow(pair, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(outcomes * outcomes)
    pairs[got["cell"].to_numpy()] = got["n"].to_numpy()
    start = fit_log_bilinear(pairs.reshape(outcomes, outcomes), dim, seed=seed)
    outcome = words.outcomes(np.arange(n))
    _, inner = words.unigram()
    apart = 0.25 * np.random.default_rng(seed).standard_normal((2, n, dim))
    tables = [(start.before @ start.mapped)[outcome] + apart[0], apart[1], np.concatenate((start.word, start.bias[:, None]), 1),
              np.concatenate((np.zeros((n, dim)), np.log(inner)[:, None]), 1)]
    model = TwoWords(words, tuple(np.ascontiguousarray(t, np.float32) for t in tables))
    names = [f"v{j}" for j in range(dim + 1)]
    for r in range(rounds):
        def learn(batches: Iterator[pa.RecordBatch], model: TwoWords = model, r: int = r) -> Iterator[pa.RecordBatch]:
            trainer = _Trainer(model, (seed, r, TaskContext.get().partitionId()), rate=0.2 / (1 + r))
            for one, two, mine in chunks(batches, 200_000):
                order = trainer.draw.permutation(len(mine))
                for i in range(0, len(mine), batch_size):
                    at = order[i:i + batch_size]
                    trainer.step(one[at], two[at], mine[at])
            yield from trainer.rows()

        schema = "k long, row long, times long, " + ", ".join(f"{v} float" for v in names)
        got = (numbered.mapInArrow(learn, schema).groupBy("k", "row").agg(
            *[(F.sum(v) / F.sum("times")).cast("float").alias(v) for v in names]).toArrow())
        which, row = got["k"].to_numpy(), got["row"].to_numpy()
        values = np.stack([got[v].to_numpy() for v in names], 1)
        tables = [t.copy() for t in model.tables]
        for k, table in enumerate(tables):
            table[row[which == k]] = values[which == k, :table.shape[1]]
        model = TwoWords(words, tuple(tables))
    return model


_SCORED = "row long, doc_id long, n_tokens long, n_known long, log_head double, log_model double, rare array<long>, times array<int>"


def score_texts(docs: DataFrame, counts: CorpusCounts, model: TwoWords, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (with the end), n_known, train_tokens, base_score, score of every whole text.

    base_score: unigram with one added to each count. score: the model's log10 probability; a word beyond the head costs its bucket times
    its share of the training words there, one added to each count and one unseen word allowed for, so that both are probabilities over the
    same words. Frequent words are looked up in the task (at most CorpusCounts.head); rare ones meet their counts in
    a join, and none of them is frequent, so no key is hot.

    Null or empty text: the end alone. Null and repeated ids: one row for each row. Empty table: no rows. No training text: every word has
    probability 1 in both.
    """
    head, words = counts.head, model.words
    log_counts, log_total = np.log10(counts.head_counts + 1.0), np.log10(words.total)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, part, made = _Places(head), TaskContext.get().partitionId(), 0
        end = int(words.numbers(places(None))[0])
        for batch in small_batches(batches, 1):
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, places(text)))
                size += len(held[-1][1])
                if size >= 200_000:
                    yield scored(held, part, made, end)
                    made += len(held)
                    held, size = [], 0
            if held:
                yield scored(held, part, made, end)
                made += len(held)

    def scored(held: list, part: int, made: int, end: int) -> pa.RecordBatch:
        numbers = [words.numbers(at) for _, at in held]
        one, two = (np.concatenate(x) for x in zip(*[_contexts(x, end) for x in numbers], strict=True))
        whole = np.concatenate(numbers)
        logs = model.log10(one, two, whole) - np.where(whole >= len(head), log_total[whole], 0.0)
        sums = np.add.reduceat(logs, np.cumsum([0] + [len(x) for x in numbers[:-1]]))
        rows = []
        for i, (doc_id, at) in enumerate(held):
            rare, times = np.unique(at[at < 0], return_counts=True)
            common = at[at >= 0]
            rows.append((part << 40 | made + i, doc_id, len(at), len(common), log_counts[common].sum(), sums[i], rare, times.astype(np.int32)))
        return _scored(rows)

    rows = staged(texts(docs, id_col, text_col).mapInArrow(score, _SCORED), "zstd")
    rare = (rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
            .join(_beyond(counts), "word")
            .groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("log_rare"), F.sum("k").alias("known_rare")))
    whole = F.lit(float(np.log10(counts.tokens + counts.words + 1)))
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return rows.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("log_head") + log_rare - F.col("n_tokens") * whole).alias("base_score"), (F.col("log_model") + log_rare).alias("score"))


def _scored(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SCORED.split(", ")]
    types = [*[pa.int64()] * 4, *[pa.float64()] * 2, pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def trained(docs: DataFrame, folds: int = 7, held_out: int = 2, vocabulary: int = 1024, head_bound: int = 50_000) -> tuple[CorpusCounts, TwoWords]:
    """Counts and model of all documents but the fold held out, by the crc32 of the id as text."""
    learned = docs.where(crc_of_id("doc_id") % folds != held_out)
    counts = corpus_counts(learned, head_bound)
    return counts, train_log_bilinear(learned, counts, vocabulary)
