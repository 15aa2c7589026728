"""The trie of rebuilt conversations against a brute-force one, with small bands and shards; slot tables by themselves."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kerbside.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d1 string, pos string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """Nodes by the chained hash of their turns; the remainder has the sign of the id, as in SQL."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    said = {c: [v for _, v in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    size, low, ends, words, kids = defaultdict(int), {}, defaultdict(list), {}, defaultdict(set)
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        turns = said.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
        key, parent = b"", None
        for d in range(len(turns) + 1):
            if d:
                parent, key = key, hashlib.sha256(key + repr(turns[d - 1]).encode()).digest()
                words[key] = len(re.findall(r"[^\x20\x09-\x0D]+", turns[d - 1][1]))
                kids[parent].add(key)
            size[key, d, parent] += 1
            low[key] = min(low.get(key, c), c)
        ends[key].append(c)
    n, leaves, saved = {k: s for (k, _, _), s in size.items()}, {}, {}
    for k, _, _ in sorted(size, key=lambda x: -x[1]):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (n[k] - 1) * words.get(k, 0)
    return sorted((low[k], d, None if p is None else low[p], n[k], len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, d, p in size)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df).collect())


def some_rows(seed, convs=70, deep=9):
    rng = random.Random(seed)
    said = ["hi", "hello there", "", None, "a  b\tc\n", "é 漢", "a b"]
    rows = []
    for c in rng.sample(range(140), convs):
        for turn in range(rng.choice([0, 1, 2, 3, 5, deep])):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, rng.choice(["user", "user", None, ""]), rng.choice(said[:2] if rng.random() < 0.8 else said)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BAND", 2 + seed)
    monkeypatch.setattr(prefix_trie, "SHARD", 40)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = some_rows(seed)
    assert found(spark, rows) == brute(rows)


def test_hot_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BAND", 64)
    monkeypatch.setattr(prefix_trie, "SHARD", 200)
    same = [(c, t, "user", f"word{t} and more") for c in range(300) for t in range(4)]
    long = [(1000, t, "user", f"line {t % 7}") for t in range(900)] + [(1001, t, "user", f"line {t % 7}") for t in range(500)]
    rows = same + long + [(-3, 1, "user", "below zero"), (-20, 1, "user", "base below zero"), (1 << 40, 0, None, None)]
    assert found(spark, rows) == brute(rows)


def test_turns_that_tie_and_repeat(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "x", "first"), (2, 0, "x", "second")]
    once, again = found(spark, rows), found(spark, rows[::-1])
    assert once == again
    assert max(r[1] for r in once if r[0] == 1) == 3 - min(3, zlib.crc32(b"1") % 4)


def test_empty_tables_and_null_ids(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "nobody's")]) == []
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    # its base is absent and its only turn is cut off: a member of the root alone
    assert found(spark, [(alone, 0, "user", "gone")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_slot_table():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 30000):
        hi, lo = rng.integers(0, 1 << 63, (2, n), np.uint64)
        hi[: n // 2] = hi[0] if n else 0  # half of them agree in the first word
        table = prefix_trie.SlotTable(hi, lo)
        assert sorted(table.find(hi, lo)) == list(range(n))
        assert (table.find(hi, lo + np.uint64(1 << 63)) == -1).all()
