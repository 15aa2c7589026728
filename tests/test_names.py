"""The similarity join of names against all pairs, on misspellings and on random names."""

import difflib
import random

import pytest

from kerbside.operators import names


def ratio(x, y):
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def brute(left, right):
    found = set()
    for a in set(left):
        if a and len(a) >= names.SHORTEST:
            found |= {(a, b, ratio(a, b), ratio(b, a)) for b in set(right) if b and ratio(b, a) >= names.ALIKE}
    return found


def misspelt(rng, name):
    chars = list(name)
    for _ in range(rng.randint(1, 3)):
        k, how = rng.randrange(len(chars)), rng.randrange(4)
        if how == 0 and len(chars) > 4:
            del chars[k]
        elif how == 1:
            chars.insert(k, rng.choice("abcdefghij "))
        elif how == 2:
            chars[k] = rng.choice("aeiou")
        elif k + 1 < len(chars):
            chars[k], chars[k + 1] = chars[k + 1], chars[k]
    return "".join(chars)


def streets(rng, n, letters="abcdeghilmnorstuvy"):
    kinds = ["street", "road", "avenue", "court", "grove", "place"]
    return [" ".join(["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 2))] + [rng.choice(kinds)]) for _ in range(n)]


def found(spark, left, right):
    sides = [spark.createDataFrame([(x,) for x in side], "name string") for side in (left, right)]
    return {tuple(r) for r in names.similar(*sides).select("a", "b", "score", "rank").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    right = streets(rng, 150) + [rng.choice(["row 1 street", "row 11 street", "row 12 street", "row 2 street"]) for _ in range(20)]
    left = [misspelt(rng, rng.choice(right)) for _ in range(150)] + ["abc", "", None, "aaaaaaaaaaaa", "abababab"] + ["babababa", "mary", "mery street"]
    right += ["aaaaaaaaaaaaaaa", "abababababa", "mry", "mary street", "a", None]
    want = brute(left, right)
    assert len(want) > 150 and found(spark, left, right) == want


def test_few_letters(spark):
    """Repeated bigrams and short names, where the bounds are tight."""
    rng = random.Random(7)
    left, right = (["".join(rng.choice("ab ") for _ in range(rng.randint(3, 9))).strip() for _ in range(120)] for _ in range(2))
    assert found(spark, left, right) == brute(left, right)


def test_no_theta_join(spark):
    """Every pair comes through an equi-join on a bigram."""
    sides = [spark.range(50).selectExpr("concat('street ', id) AS name") for _ in range(2)]
    plan = names.meeting(*sides)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty(spark):
    assert found(spark, [], ["mary street"]) == set() and found(spark, ["mary street"], []) == set()
