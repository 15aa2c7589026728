"""Line dedup: a text is split once whatever its number of lines, and pairs are verified exactly from one side."""

import random
import time

from kerbside.llm import lines
from tests.llm.test_line_recall import shingles, word


def test_one_text_of_many_lines(spark):
    rng = random.Random(3)
    own = [f"{word(rng, 9)} {word(rng, 8)} {word(rng, 9)}" for _ in range(30_000)]
    docs = spark.createDataFrame([(1, "\n".join(own[:100])), (2, "\n".join(own))], "doc_id long, text string")
    found = lines.dedup(docs).where("row.doc_id = 2")
    began = time.time()
    row = found.first()
    assert time.time() - began < 20
    assert (row["n_lines"], row["n_removed"]) == (30_000, 100)
    assert row["kept_text"] == "\n".join(own[100:])


def test_pairs_around_the_bound(spark):
    rng = random.Random(4)
    texts = ["aaaa bbbb " * 9, "aaaa bbbb " * 30, "x" * 40, "x" * 12, "ab  c " * 8 + "d", "ab  c " * 8 + "de"]
    for _ in range(30):
        words = [word(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(8, 60))]
        for n in (0, 1, 2, 4):
            other = list(words)
            for k in rng.sample(range(len(words)), min(n, len(words))):
                other[k] = word(rng, rng.randrange(1, 9))
            texts.append(" ".join(other))
    texts = sorted(set(texts))
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    names = {r["id"]: r["line"] for r in lines._own_lines(docs).collect()}
    ids = sorted(names)
    sets = {i: shingles(names[i]) for i in ids}
    pairs = [(a, b) for a in ids for b in ids if a < b]
    known = lines.described(docs, spark.createDataFrame([(i,) for i in ids], "id long"))
    assert {r["id"]: r["n"] for r in known.collect()} == {i: len(sets[i]) for i in ids}
    found = {(r["a"], r["b"]) for r in lines.verified(known, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
