"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import crc_of_id, texts

#: Classes of bytes: lower case, upper case, digit, space, line end, sentence mark, exclamation, quote or bracket, other symbols by kind, beyond ASCII.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:?", "!", "\"'()[]{}<>", "#$%&*", "|", "@+-/=\\^_`~")
_CLASS = np.full(256, len(_KINDS), np.int64)
for _k, _letters in enumerate(_KINDS):
    _CLASS[[ord(c) for c in _letters]] = _k
_CLASS[:32][_CLASS[:32] == len(_KINDS)] = 10
_N = len(_KINDS) + 1
N_FEATURES = _N * _N + 8
#: Bytes of text whose classes are looked at together; bounds memory.
BYTES_AT_ONCE = 500_000


def features(texts_: Sequence[str | None]) -> np.ndarray:
    """One row of numbers per whole text; none depends on language, source or id. Null counts as empty.

    Shares of neighbouring byte classes (square roots), share of words that repeat the word before (also its square root, and that of words
    that repeat the two words before), share of lines that repeat the line before, distinct words against their number, length of words,
    length of the text, whether it is empty.
    """
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts_]
    out = np.zeros((len(raw), N_FEATURES))
    begin = size = 0
    for i, text in enumerate(raw):
        size += len(text)
        if size >= BYTES_AT_ONCE or i + 1 == len(raw):
            out[begin:i + 1, :_N * _N] = _pair_shares(raw[begin:i + 1])
            begin, size = i + 1, 0
        out[i, _N * _N:] = _word_numbers(text)
    return out


def _pair_shares(raw: list[bytes]) -> np.ndarray:
    """Square roots of the shares of neighbouring byte classes, a row per text. Long stretches are counted piece by piece."""
    sizes = np.array([len(x) + 1 for x in raw])
    data, ends = b" ".join(raw) + b" ", np.cumsum(sizes)
    counts = np.zeros(len(raw) * _N * _N, np.int64)
    for first in range(0, len(data) - 1, BYTES_AT_ONCE):
        kinds = _CLASS[np.frombuffer(data, np.uint8)[first:first + BYTES_AT_ONCE + 1]]
        row = np.searchsorted(ends, np.arange(first, first + len(kinds)), side="right")
        inside = row[:-1] == row[1:]
        counts += np.bincount((row[:-1] * (_N * _N) + kinds[:-1] * _N + kinds[1:])[inside], minlength=len(counts))
    counts = counts.reshape(len(raw), -1)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def _word_numbers(text: bytes) -> tuple:
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    same = list(map(operator.eq, words, words[1:]))
    twice, thrice = sum(same) / max(1, n - 1), sum(map(operator.and_, same, same[1:])) / max(1, n - 2)
    return (twice, np.sqrt(twice), np.sqrt(thrice), sum(map(operator.eq, lines, lines[1:])) / max(1, len(lines) - 1),
            np.log1p(len(set(words))) / np.log1p(n) if n else 1.0, np.log1p(sum(map(len, words)) / max(1, n)), np.log1p(n) / 10, not n)


@dataclass(frozen=True)
class QualityModel:
    """A linear scorer over standardised features; prior: the share of good texts it was fitted with."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, texts_: Sequence[str | None]) -> np.ndarray:
        x = np.clip((features(texts_) - self.centre) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -40, 40)))


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1,
                     decay: float = 1e-3) -> QualityModel:
    """Minimises prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]) with the logistic loss by Adam.

    While the part in max() is negative, the step goes against it, which undoes overfitting. Without positives or unlabelled rows the score
    is the prior for every text.
    """
    n = positive.shape[1] if positive.size else N_FEATURES
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(n), np.ones(n), np.zeros(n), float(np.log(prior / (1 - prior))), prior)
    centre, scale = unlabelled.mean(0), unlabelled.std(0)
    scale[scale < 1e-4] = 1.0
    p, u = (np.clip((x - centre) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        gp, gu = p @ w.astype(np.float32) + b, u @ w.astype(np.float32) + b
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        plus = prior * (sp - 1) / len(p)  # of loss(+) on positives
        minus_p, minus_u = -prior * sp / len(p), su / len(u)
        if negative < 0:
            plus, minus_p, minus_u = 0 * plus, -minus_p, -minus_u
        gradient = np.append((plus + minus_p).astype(np.float32) @ p + minus_u.astype(np.float32) @ u + decay * w, (plus + minus_p).sum() + minus_u.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return QualityModel(centre, scale, w, float(b), prior)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, default_prior: float = 0.5, id_col: str = "doc_id",
                text_col: str = "text") -> QualityModel:
    """Fits on a bounded, documented sample: about `sample_rows` trusted positives (labels whose quality is 1) and as many unlabelled texts.

    Samples are the rows whose hashed id is lowest, so they are the same on each run. The class prior is estimated as the share of quality 1
    among all labels given (`default_prior` where there are none). `labels` must hold those rows alone that may be learned from. Labels
    with null id or quality count as none; of labels with one id the highest quality counts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
    prior = min(0.98, max(0.05, good / n)) if n else default_prior

    def lowest(df: DataFrame, rows: int) -> DataFrame:
        share = min(1.0, sample_rows / max(1, rows))
        return df.where(F.expr("xxhash64(doc_id, 7)").cast("double") / 2.0**64 + 0.5 < share)

    trusted = lowest(known.where("quality = 1"), good or 0).select("doc_id")
    plain = texts(docs, id_col, text_col)
    # the sample of ids is bounded by sample_rows (times a little, as it goes by a hash)
    positive = plain.join(F.broadcast(trusted), "doc_id", "left_semi")
    unlabelled = lowest(plain, plain.count())
    return fit_non_negative(_features_of(positive), _features_of(unlabelled), prior)


def _features_of(plain: DataFrame) -> np.ndarray:
    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": list(features(pdf["text"]).astype(np.float32))})

    got = plain.select("text").mapInPandas(rows, "x array<float>").toArrow().column("x")
    # a matrix from Arrow's own buffers: as Python's numbers, rows would take the driver several times their size
    return np.concatenate([np.empty(0, np.float32), *(x.flatten().to_numpy() for x in got.chunks)]).astype(np.float64).reshape(len(got), N_FEATURES)


def quality_score(model: QualityModel, text: Column) -> Column:
    """The score of a text column: 0 to 1, higher for good texts. Null scores as the empty text."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(x.tolist()))

    return score(F.coalesce(text, F.lit("")))


def learnable(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Labels that may be learned from: all but the fold held out, by the crc32 of the id as text."""
    return labels.where(crc_of_id("doc_id") % folds != 0)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (1 where the score reaches the threshold) of every whole text.

    Null or empty text: the score of the empty text. Null and repeated ids: one row for each row. Empty table: no rows.
    """
    return (texts(docs, id_col, text_col).withColumn("score", quality_score(model, F.col("text")))
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
