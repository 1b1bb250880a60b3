"""Small tables with every odd case, and brute-force helpers."""

import random

ODD = [(1, "alpha beta gamma delta epsilon zeta eta theta", "en"), (2, None, None), (3, "", "en"), (4, "   \n\t ", "fr"),
       (5, "alpha beta gamma delta epsilon zeta eta theta", "de"), (5, "alpha beta gamma delta epsilon zeta eta theta", "de"),
       (None, "Alpha BETA gamma delta epsilon zeta eta theta", "de"), (7, "ein\x00wort  zwei  日本語 😀 <|endoftext|>  x ", None),
       (8, "word " * 30_000, "en"), (9, "x" * 70_000, "en"), (10, "kurz", "de"), (11, "a b", "de")]
SCHEMA = "doc_id long, text string, ids string"  # `ids` clashes with a column that operators make
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(n, words=60, seed=1, vocabulary=400):
    """Texts of which a third are near copies of another."""
    draw = random.Random(seed)
    lexicon = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        if i % 3 == 2:
            w = out[draw.randrange(len(out))].split()
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = draw.choice(lexicon)
        else:
            w = [draw.choice(lexicon) for _ in range(draw.randint(1, words))]
        out.append(" ".join(w))
    return out


def union(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]
