"""Near-duplicate vectors, n-gram joins, fingerprints, components: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatsieve.llm import fingerprints, graph, jaccard, neardup
from tests.llm.cases import ODD, none, odd, prose, union


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {x: 100 for x in range(100, 160)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_over_few_links_take_one_task(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 107), (107, 103)], "a long, b long").coalesce(1)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tracker, got, tasks = spark.sparkContext.statusTracker(), [], []
    try:
        for few in (graph.FEW_LINKS, 0):
            monkeypatch.setattr(graph, "FEW_LINKS", few)
            spark.sparkContext.setJobGroup(f"links-{few}", "")
            got.append(sorted(map(tuple, graph.components(links).collect())))
            stages = {s for job in tracker.getJobIdsForGroup(f"links-{few}") for s in tracker.getJobInfo(job).stageIds}
            tasks.append(sum(info.numTasks for info in map(tracker.getStageInfo, stages) if info))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got[0] == got[1] == [(i, 0) for i in range(41)] + [(100, 100), (103, 100), (107, 100)]
    assert tasks[0] < tasks[1] / 2


def sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute(texts, n, percent):
    s = sets(texts, n)
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    return [len(x) for x in s], union(len(s), pairs)


@pytest.mark.parametrize("n, percent, block_rows", [(4, 85, 512), (2, 60, 3), (5, 80, 2)])
def test_jaccard_finds_the_same_components(spark, n, percent, block_rows):
    shared = " ".join(f"common{i}" for i in range(40))
    texts = prose(240, seed=n) + [f"{shared} {x}" for x in prose(40, 20, 9)] + ["one", "one", "two words", "TWO words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, percent, block_rows).collect()}
    sizes, roots = brute(texts, n, percent)
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_jaccard_of_odd_rows(spark):
    rows = jaccard.jaccard_components(odd(spark), 4, 85).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows)
    assert got == [(0, 5, 1), (1, 5, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 5, 1), (5, 5, 1), (7, got[7][1], 7), (8, 1, 8), (9, 1, 9), (10, 1, 10), (11, 1, 11)]
    assert jaccard.jaccard_components(none(spark)).count() == 0
    kept = jaccard.keep_one_of_each(odd(spark), 4, 85)
    assert kept.columns == ["doc_id", "text", "ids"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]


def test_second_pivots_are_one_for_a_node(spark):
    """However many blocks a node has, and however many first nodes these have."""
    rows = [(100 * b + p, p, b) for b in (50, 51) for p in range(10)] + [(9000, 4, 50), (9001, 0, 51), (9002, 0, 51), (9003, 3, 52)]
    blocks = spark.createDataFrame(rows, "shingle long, pivot long, node long")
    first = spark.createDataFrame([(0, 50), (0, 51), (3, 52)], "a long, b long")
    own = spark.createDataFrame([(51, 9), (9, 9)], "node long, component long")
    got = {tuple(r) for r in jaccard._second_pivots(blocks, first, own).collect()}
    assert got == {(4, 50), (8, 51)}  # 4: of two blocks; 9 is linked to 51, 0 was compared; 52 has no other


def test_a_pair_is_made_in_one_of_its_blocks(spark, monkeypatch):
    """Texts that share many keys, but are too different to link, meet once, not in each block; also where blocks are cut into parts."""
    draw = np.random.default_rng(8)
    common = [f"c{i}" for i in range(400)]
    rows = []
    for d in range(12):
        own = common.copy()
        for at in draw.choice(400, 5, replace=False):
            own[at] = f"d{d}x{at}"
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, plain = [], type(df).mapInArrow

    def seen(self, func, schema, *more, **named):
        out = plain(self, func, schema, *more, **named)
        if "block" in self.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(df), "mapInArrow", seen)
    got = jaccard.jaccard_components(df, 5, 80, block_rows=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(brute([t for _, t in rows], 5, 80)[1]))
    assert len(made) == 2 and 0 < max(made) <= 12 * 11 // 2


def test_signature_tree_loses_no_pair():
    draw = np.random.default_rng(4)
    base = [draw.integers(-2**62, 2**62, draw.integers(1, 300)) for _ in range(30)]
    keys = [np.unique(np.concatenate((b[draw.random(len(b)) < 0.97], draw.integers(-2**62, 2**62, 3)))) for b in base for _ in range(9)]
    keys.sort(key=len)
    size = np.array([len(k) for k in keys])
    bits = np.frombuffer(b"".join(jaccard.signature(k) for k in keys), np.uint64).reshape(len(keys), -1)
    found = set(zip(*(x.tolist() for x in jaccard.SignatureTree.of(size, bits, np.arange(len(keys))).pairs(80)), strict=True))
    true = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys))
            if 100 * len(np.intersect1d(keys[i], keys[j])) >= 80 * len(np.union1d(keys[i], keys[j]))}
    assert true and true <= found and len(found) < len(keys) * (len(keys) - 1) // 4
    for i, j in found:
        assert jaccard.greatest_overlap(jaccard.bitmap(keys[i]), len(keys[i]), jaccard.bitmap(keys[j]), len(keys[j])) >= len(np.intersect1d(keys[i], keys[j]))
    whole = jaccard.SignatureTree.of(size, bits, np.zeros(len(keys), np.int64)).pairs(80)
    assert len(whole[0]) == 0


def test_prefixes_of_similar_sets_meet():
    draw = np.random.default_rng(5)
    order = jaccard._Order(draw.integers(0, 9, jaccard.BUCKETS))
    for _ in range(300):
        a = np.unique(draw.integers(0, 200, draw.integers(1, 60))) << 40
        b = np.unique(np.concatenate((a[draw.random(len(a)) < 0.95], draw.integers(0, 200, 2) << 40)))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert len(np.intersect1d(order.prefix(a, 85), order.prefix(b, 85)))


def vectors(seed=3, dim=16):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, dim))
    x = [c + 0.12 * draw.standard_normal(dim) for c in centres for _ in range(9)] + list(draw.standard_normal((80, dim)))
    big = [centres[0] + 0.2 * draw.standard_normal(dim) for _ in range(60)]
    return [v.tolist() for v in x + big + x[:5] + [x[0]] * 4]


def test_near_vectors_against_brute_force(spark):
    x = vectors()
    odd_ones = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, i % 3) for i, v in enumerate(x + odd_ones)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int").repartition(3)
    got = {r.vec_id: r for r in neardup.near_duplicate_vectors(df, passes=10, window=40, chunk_rows=16).collect()}
    e = np.array(x)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    near = e @ e.T >= 0.9
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i) if near[i, j]] + [(n + 6, n + 7)]
    roots, links = union(n + 8, pairs), [*(near.sum(1) - 1).tolist(), 0, 0, 0, 0, 0, 0, 1, 1]
    assert [got[i].component_id for i in range(n + 8)] == roots
    assert [got[i].n_links for i in range(n + 8)] == links
    assert all(got[i].kept == (roots[i] == i) for i in range(n + 8))
    assert neardup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_fingerprints_of_edited_texts(spark):
    texts = prose(60, 200, 8, 5000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in fingerprints.fingerprint_pairs(df).collect()}
    for i, t in enumerate(texts):
        after, m = texts[i - 1], len(t) // 3
        assert rows[i].edited == t[:len(t) - m] + after[:m] and rows[i].n_chars == len(t)
        if len(t.split()) > 30 and i % 3 != 2:
            assert rows[i].near_edited > 0.25 > rows[i].near_next or rows[i].near_next > 0.25 and texts[i - 1].split()[:3] == t.split()[:3]
    by_text = {}
    for i, t in enumerate(texts):
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_anchors_do_not_depend_on_context(spark):
    draw = random.Random(1)
    passage, other = (" ".join(str(draw.random()) for _ in range(50)) for _ in range(2))
    a, b = spark.createDataFrame([(passage,), (f"{other} {passage}",)], "t string").select(
        fingerprints.fingerprint(F.col("t"), anchors=10_000).alias("f")).collect()
    cut = lambda f: {f[i:i + 8]: int(f[i + 8:i + 14], 16) for i in range(0, len(f), 14)}
    x, y = cut(a.f), cut(b.f)
    assert set(x) <= set(y) and {y[h] - p for h, p in x.items()} == {50}


def test_fingerprints_of_odd_rows(spark):
    rows = fingerprints.fingerprint_pairs(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "" and by[2].near_edited == 1.0
    assert by[9].n_chars == 70_000 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    alone = fingerprints.fingerprint_pairs(odd(spark).where("doc_id = 7")).first()
    assert alone.near_next == 1.0
    assert fingerprints.fingerprint_pairs(none(spark)).count() == 0


@pytest.mark.parametrize("ids", [list(range(1, 3000, 7)), [0, 1, 2, 3, 10**15, 10**15 + 1, -(10**12)], [5] * 9 + [None] * 4 + [6, 6, -1]])
def test_next_row_over_all_ranges(spark, ids):
    rows = [(i, f"t{n:05d}") for n, i in enumerate(ids)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ["text"], bucket_rows=5, cells=3).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {a[1]: order[(k + 1) % len(order)][1] for k, a in enumerate(order)}
    assert {r.text: r.next_text for r in got} == want


def test_edited_digest(spark, tmp_path):
    from chatsieve.llm.queries import op10_fingerprints
    spark.createDataFrame([(1, "abcdef"), (2, "uvwxyzé")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.edited_sha256 for r in op10_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256("abcduv".encode()).hexdigest(), 2: hashlib.sha256("uvwxyab".encode()).hexdigest()}


def planted_pairs(rows, pairs, cosine, dim=64):
    """Random vectors, of which the last `pairs` are each at that cosine to one of the first."""
    draw = np.random.default_rng(3)
    x = draw.standard_normal((rows, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.standard_normal((pairs, dim))
    y -= (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    x[rows - pairs:] = cosine * x[:pairs] + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    return x


def test_passes_grow_with_the_table():
    assert neardup.passes_for(40, 0.9, 48, 0.99) == 12
    few, many = (neardup.passes_for(n, 0.9, 48, 0.99) for n in (10**5, 10**6))
    assert 12 < few < many
    for n, k in ((10**5, few), (10**6, many)):
        assert (1 - neardup.chance_of_pass(n, 0.9, 48)) ** k <= 0.01


def test_planted_pairs_are_found_at_the_stated_recall(spark):
    rows, pairs = 20_000, 1000
    x = planted_pairs(rows, pairs, 0.901)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in neardup.near_duplicate_vectors(df, window=8).collect()}
    assert sum(got[i] == got[rows - pairs + i] for i in range(pairs)) >= 0.985 * pairs


def test_neighbours_meet_across_borders():
    import pyarrow as pa
    x = planted_pairs(8, 4, 0.95)
    rows = [neardup._found(np.arange(4), np.arange(4), 0, x[:4]), neardup._found(np.arange(4, 8), np.arange(4, 8), 0, x[4:])]
    got = list(neardup._across(0.9, 4)(iter(rows)))
    assert sorted(zip(*pa.Table.from_batches(got).to_pydict().values(), strict=True)) == [(4, 0), (5, 1), (6, 2), (7, 3)]
