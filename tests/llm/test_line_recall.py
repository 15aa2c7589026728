"""Recall of line dedup where signatures change their kind, and in crowds of lines around one common text."""

import random

from kerbside.llm import lines


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)}


def joined(of, pairs):
    up = {x: x for x in of}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in of}


def recall(spark, texts):
    """Share of all similar pairs that end in one component; no link joins lines that are not similar."""
    texts = sorted(set(texts))
    sets = {x: shingles(x) for x in texts}
    similar = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(4)
    names = {r["id"]: r["line"] for r in lines._own_lines(df).collect()}
    found = [(names[r["a"]], names[r["b"]]) for r in lines.links(df).collect()]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in similar}
    roots = joined(texts, found)
    return sum(roots[a] == roots[b] for a, b in similar) / len(similar)


def word(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_lines_on_both_sides_of_a_kind(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(120):
        words = [word(rng, 8) for _ in range(20)]
        k = rng.randrange(1, 19)
        texts += [" ".join(words), " ".join([*words[: k - 1], words[k - 1] + words[k], *words[k + 1 :]])]
    assert recall(spark, texts) >= 0.99


def test_crowd_around_one_text(spark):
    rng = random.Random(46)
    base, texts = [word(rng, 6) for _ in range(46)], []
    for _ in range(60):
        own = list(base)
        for k in rng.sample(range(46), 2):
            own[k] = word(rng, 6)
        for _ in range(6):
            one = list(own)
            one[rng.randrange(46)] = word(rng, 6)
            texts.append(" ".join(one))
    assert recall(spark, texts) >= 0.95
