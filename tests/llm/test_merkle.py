"""The Merkle manifest, against a tree built level by level on the driver."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chatsieve.llm import merkle
from tests.llm.cases import DOCS, none


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    for level in tree[:-1]:
        run = level[at // 3 * 3:at // 3 * 3 + 3]
        yield run[:at % 3], run[at % 3 + 1:]
        at //= 3


def brute(rows):
    """(doc_id, leaf, subroot, root, proof as text, folded root) of rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for row in rows:
        i, text, lang, source, n = row
        other = text.replace("\n", "") if text is not None and zlib.crc32(str(i if i is not None else "").encode()) % 2 == 0 else text
        leaf, claimed = (h(*map(field, (i, source, lang, n, t))) for t in (text, other))
        groups.setdefault(source, []).append(((i is not None, i or 0), leaf, claimed, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: x[:2])
    trees = {s: levels([x[1] for x in groups[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, leaf, claimed, i) in enumerate(groups[s]):
            steps, d = [*path(trees[s], at), *path(top, k)], claimed
            for left, right in steps:
                d = h(*left, d, *right)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], "".join(x for step in steps for part in step for x in part), d))
    return sorted(out, key=str)


def found(df, at_once=7):
    altered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(df, claims={"text": altered}, levels=at_once)
    got = rows.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")), merkle.folded(F.col("proof"), F.col("claimed"))).collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("at_once", [1, 2, 7])
def test_same_digests_as_level_by_level(spark, at_once):
    draw = random.Random(3)
    sources = [None, "", "a", "z", "é", "zz", *(f"s{i}" for i in range(30))]
    rows = [(i, draw.choice([None, "", "a\nb", "x", f"zeile {i}\n", "日本\n😀"]), draw.choice([None, "en"]), "hot" if i % 3 else draw.choice(sources), draw.choice([None, -3, i]))
            for i in range(700)]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), DOCS).repartition(6)
    assert found(df, at_once) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, n):
    rows = [(i, f"text\n{i}", "en", "one", 3) for i in range(n)]
    assert found(spark.createDataFrame(rows, DOCS)) == brute(rows)
    rows = [(i, f"text\n{i}", "en", f"source {i}", 3) for i in range(n)]
    assert found(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "a\n", "en", "s", 2), (1, "a\n", "en", "s", 2), (1, "b", "en", "s", 1), (None, "x\n", "de", "s", 2), (2, "w " * 90_000, "de", None, 5)]
    assert found(spark.createDataFrame(rows, DOCS).withColumn("proof", F.lit(1)).withColumn("value", F.lit(2))) == brute(rows)
    assert found(none(spark).selectExpr("doc_id", "text", "'a' lang", "ids source", "1 n_chars")) == []


def test_queues_stay_small():
    sweep = merkle.Sweep([str(i) for i in range(2000)], 7)
    assert sweep.forward() == levels([str(i) for i in range(2000)])[-1][0]
    proofs = dict(sweep.backward([("up", "")]))
    assert sorted(proofs) == list(range(2000)) and all(p[-1] == ("up", "") and len(p) == 8 for p in proofs.values())
