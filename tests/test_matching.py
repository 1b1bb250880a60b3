import random

import pytest
from pyspark.sql import functions as F

from chatsieve.operators import matching as M


def brute(text, terms, limit=None):
    return sorted((t, i) for t in terms for i in range(len(text)) if text.startswith(t, i)
                  and (limit is None or i < limit))


@pytest.mark.parametrize("strategy", ["auto", "join"])
def test_matches_equal_brute_force(spark, strategy):
    rng = random.Random(7)
    terms = ["a", "ab", "aba", "bb", "b😀", "cab", "abab", "c.c", "😀"]
    texts = ["".join(rng.choice("abc😀.") for _ in range(rng.randint(0, 25))) for _ in range(80)]
    msgs = spark.createDataFrame(list(enumerate(texts)), "id int, norm_text string")
    tf = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {}
    for r in M.match_all(msgs, tf, ["id"], strategy=strategy).collect():
        got.setdefault(r["id"], []).append((r["term"], r["start"]))
    firsts = {r["id"]: (r["term"], r["start"])
              for r in M.match_first(msgs, tf, ["id"], strategy=strategy).collect()}
    for i, text in enumerate(texts):
        want = brute(text, terms, None)
        assert sorted(got.get(i, [])) == want, text
        first = min(((s, len(t), t) for t, s in want), default=None)
        assert firsts.get(i) == (None if first is None else (first[2], first[0])), text
    whole = {r["id"]: r["t"] for r in M.match_contains(msgs, tf, ["id"], strategy=strategy).groupBy("id").agg(
        F.sort_array(F.collect_list("term")).alias("t")).collect()}
    assert all(whole.get(i, []) == sorted({t for t in terms if t in x}) for i, x in enumerate(texts))


def test_long_terms_are_found(spark):
    msgs = spark.createDataFrame([(1, "x" * 70)], "id int, norm_text string")
    tf = spark.createDataFrame([("x" * 61,)], "term string")
    for strategy in ("auto", "join"):
        assert M.match_all(msgs, tf, ["id"], strategy=strategy).count() == 10


def ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return 100.0 * (1 - row[-1] / max(len(a), len(b)))


@pytest.mark.parametrize("strategy", ["auto", "join"])
def test_fuzzy_equals_brute_force(spark, strategy):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    terms = list(dict.fromkeys([" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(40)] + ["x", "abc", "abcdabcd"]))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["say x now", "abcdabxd", ""]
    request = ["dd", "request phrase"]
    out = M.fuzzy_match(spark.createDataFrame([*enumerate(texts), (999, None)], "id int, norm_text string"),
                        spark.createDataFrame([(t, 0.5 + i / 100, i) for i, t in enumerate(terms)], "term string, weight double, ord int"),
                        spark.createDataFrame([(t,) for t in request], "term string"), ["id"], cutoff=75.0, strategy=strategy)
    got = {r["id"]: (r["term"], round(r["similarity"], 6), round(r["weight"], 6)) for r in out.collect()}
    want = {}
    for i, text in enumerate(texts):
        if any(r in text for r in request):
            continue
        best = []
        for k, t in enumerate(terms):
            n, w = len(t.split(" ")), text.split(" ")
            sims = [ratio(" ".join(w[j:j + n]), t) for j in range(len(w) - n + 1)]
            if sims and max(sims) >= 75.0:
                best.append((-max(sims), k, t))
        if best:
            s, k, t = min(best)
            want[i] = t, round(-s, 6), round((0.5 + k / 100) * 0.85, 6)
    assert got == want


def test_fuzzy_finds_a_typo(spark):
    msgs = spark.createDataFrame([(1, "i realy need help"), (2, "really need"), (3, "nothing here")], "id int, norm_text string")
    terms = spark.createDataFrame([("really need", 0.8, 0)], "term string, weight double, ord int")
    out = M.fuzzy_match(msgs, terms, terms, ["id"]).collect()
    assert [(r["id"], r["term"], round(r["weight"], 3)) for r in out] == [(1, "really need", 0.68)]


def test_matches_in_one_pass_over_the_text(spark):
    """Nested terms and joined ones of any length read the text once, whatever their number."""
    msgs = spark.createDataFrame([(1, "xthexthenxtherexx"), (2, None)], "id int, norm_text string")
    tf = spark.createDataFrame([(t,) for t in ("the", "then", "there", "x", "]", "^", "")], "term string")
    for strategy, reader in (("auto", "regexp_extract_all"), ("join", "regexp_extract_all")):
        out = M.match_all(msgs, tf, ["id"], strategy=strategy)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(reader) == 1, plan
        assert sorted((r["term"], r["start"]) for r in out.collect()) == brute("xthexthenxtherexx", ["the", "then", "there", "x"])


def test_matches_meet_across_pieces(spark):
    """Terms that lie across the pieces a text is cut into, at its very end, and terms longer than a piece or than the text."""
    text = "😀b" * 40 + "tail"
    terms = ["b😀", "😀", "😀b" * 17, "btail", "tail", "ail", "l", "tails", "😀b" * 60]
    msgs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, norm_text string")
    tf = spark.createDataFrame([(t,) for t in terms], "term string")
    for strategy in ("auto", "join"):
        got = sorted((r["term"], r["start"]) for r in M.match_all(msgs, tf, ["id"], strategy=strategy).collect())
        assert got == brute(text, terms)
