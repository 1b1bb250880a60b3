"""Removal of repeated word runs, against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from chatsieve.llm import substrings
from tests.llm.cases import none, odd, prose


def brute(rows, k):
    """rows: (doc_id, text) in the order that counts. (doc_id, n_words, n_removed, kept_sha256) of each."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            window = tuple(words[i:i + k])
            if window in seen:
                gone[i:i + k] = [True] * k
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def found(df, **how):
    return [tuple(r)[:4] for r in substrings.remove_repeats(df, **how).orderBy("doc_id").collect()]


@pytest.mark.parametrize("k, inner, seed", [(20, 8, 1), (5, 2, 2), (3, 3, 3), (1, 1, 4), (7, 1, 5)])
def test_same_words_go_as_by_brute_force(spark, k, inner, seed):
    draw = random.Random(seed)
    passages = prose(12, 90, seed, 60)
    texts = prose(60, 60, seed, 12)
    for _ in range(120):  # passages cut, joined and placed anywhere, also twice in one text
        parts = []
        for _ in range(draw.randint(1, 5)):
            words = draw.choice(passages).split()
            a = draw.randrange(len(words))
            parts += words[a:a + draw.randint(1, 80)] + draw.choices("xyz", k=draw.randint(0, 4))
        texts.append(draw.choice([" ", "\n", " \t"]).join(parts))
    texts += ["a " * 100, "a b " * 70, "b a " * 45, "a b c " * 40 + "a b a b", "", "a", " ".join(passages)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    assert found(df, k=k, inner=inner) == brute(rows, k)


def test_spans_are_the_words_that_go(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(1, passage), (2, f"x y {passage} z"), (3, passage), (4, f"{passage} q {passage}"), (5, " ".join(passage.split()[:19]))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(2, 50)], 3: [(0, 50)], 4: [(0, 50), (51, 50)], 5: []}


def test_odd_rows(spark):
    order = [(None, "Alpha BETA gamma delta epsilon zeta eta theta"), *[(r[0], r[1]) for r in sorted((r for r in odd(spark).collect() if r[0]), key=lambda r: r[0])]]
    for k, inner in ((20, 8), (2, 1)):
        assert found(odd(spark), k=k, inner=inner) == brute(order, k)
    assert found(none(spark)) == []


def test_rows_of_one_id(spark):
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(5, 40))
    rows = [(7, text), (7, text), (7, other), (None, other), (9, text)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 35, 0), (7, 30, 25), (7, 30, 30), (7, 35, 35), (9, 30, 30)]


def test_run_keys_are_polynomials():
    keys = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    for n in range(1, 25):
        plain = [sum(int(x) * substrings._BASE ** (n - 1 - j) for j, x in enumerate(keys[i:i + n])) % 2**64 for i in range(40 - n + 1)]
        assert (substrings.gram_keys(keys, n) == substrings._mixed(np.array(plain, np.uint64))).all()
