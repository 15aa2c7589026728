"""Packing: the reduction against exact optima of small instances, pieces against the library, sequences without gaps."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from kerbside.llm import encoder, packing
from kerbside.llm.queries import op13_packing, tokenizer_path
from tests.conftest import SF


def optimum(sizes, capacity):
    """Fewest sequences, by trying every set with the longest piece."""

    @lru_cache(maxsize=None)
    def best(left):
        if not left:
            return 0
        found = len(left)

        def fill(rest, room, used):
            nonlocal found
            found = min(found, 1 + best(tuple(x for k, x in enumerate(left[1:]) if k not in used)))
            seen = set()
            for k in range(rest, len(left) - 1):
                if left[1 + k] <= room and left[1 + k] not in seen:
                    seen.add(left[1 + k])
                    fill(k + 1, room - left[1 + k], used | {k})

        fill(0, capacity - left[0], frozenset())
        return found

    return best(tuple(sorted(sizes, reverse=True)))


def test_reduction_keeps_the_optimum():
    rng = random.Random(11)
    fixed_any = 0
    for _ in range(400):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(rng.choice([1, capacity // 4, capacity // 3]), capacity) for _ in range(rng.randint(1, 9))]
        count = np.bincount(sizes, minlength=capacity + 1)
        left = count.copy()
        fixed = packing.reduce(left)
        fixed_any += bool(fixed)
        rest = [s for s in range(capacity + 1) for _ in range(left[s])]
        assert all(sum(s * n for s, n in parts) <= capacity for parts, _ in fixed)
        assert sum(bins for _, bins in fixed) + optimum(rest, capacity) == optimum(sizes, capacity)
    assert fixed_any > 200


@pytest.mark.parametrize("most", [3, 40, 100000])
def test_solutions_pack_every_piece(most):
    rng = np.random.default_rng(most)
    count = rng.integers(0, most, 1025) * (rng.random(1025) < 0.3)
    count[0] = 0
    patterns = packing.solve(count)
    held = Counter()
    for parts, bins in patterns:
        assert sum(s * n for s, n in parts) <= 1024 and bins > 0
        for s, n in parts:
            held[s] += n * bins
    assert held == Counter({s: int(n) for s, n in enumerate(count) if n})
    bins = sum(n for _, n in patterns)
    least = -(-int((count * np.arange(1025)).sum()) // 1024)
    assert least <= bins and len(packing.slots(patterns, 1024)["length"]) < 40_000
    if most > 3:
        # as a plain best fit does, piece by piece
        assert bins <= 1.02 * max(least, int(count[513:].sum()))


def test_best_fit_equals_piece_by_piece():
    rng = random.Random(5)
    for _ in range(30):
        capacity = 64
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 120))]
        bins = []
        for w in sorted(sizes, reverse=True):
            fit = [k for k, room in enumerate(bins) if room >= w]
            if fit:
                bins[min(fit, key=lambda k: bins[k])] -= w
            else:
                bins.append(capacity - w)
        assert sum(n for _, n in packing.best_fit(np.bincount(sizes, minlength=capacity + 1))) == len(bins)


def test_ranks_are_the_librarys_merges():
    path = tokenizer_path()
    assert encoder.by_rank(path)
    assert not encoder.by_rank(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    alphabet = "aeiou thnrs'\n\t .,19éß漢́  \U0001f600"
    texts = ["", " ", "<|endoftext|>", "x<|endoftext|> y <|endof", " " * 3000, "a" * 5000, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400))]
    for specials in (True, False):
        for t in texts:
            assert encoder.encode(t, path, True, specials).tolist() == encoder.encode(t, path, False, specials).tolist()


def checked(rows, texts):
    """texts: of each key of ``row``, repeats allowed. Every piece by the library; sequences whole."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for key, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k in range(-(-len(ids) // 1024)):
            stop = at + (len(ids) - 1) % 1024 + 1 if k == 0 else at + 1024
            want[key, k, at, stop - at, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at:stop]))] += 1
            at = stop
    assert Counter((r[0], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    inside = defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in inside.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return len(inside)


def test_query_on_its_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = op13_packing(spark, SF).collect()
    n = checked(rows, docs)
    lengths = [r["length"] for r in rows]
    assert n <= 1.01 * max(-(-sum(lengths) // 1024), sum(x > 512 for x in lengths)) + 1


def test_odd_rows(spark):
    texts = [(1, "one two"), (1, "one two"), (2, None), (None, ""), (3, "word " * 5000), (4, "a" * 30000), (5, "x<|endoftext|>y")]
    docs = spark.createDataFrame([(k, t, "ids", "part") for k, t in texts], "doc_id long, text string, ids string, part string").repartition(3)
    found = packing.pack(docs, tokenizer_path(), with_ids=True)
    checked(found.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect(), texts)
    whole = packing.sequences(found).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in found.collect())
    assert all(len(r["ids"]) <= 1024 and r["pieces"][0]["offset"] == 0 for r in whole)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
