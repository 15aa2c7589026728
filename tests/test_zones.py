"""Bisection by selection and colouring in rounds, against the plain sequential rules."""

import math
import random

import pytest

from kerbside.operators import zones

SCHEMA = "blockface_id string, street string, from_number string, side string, lat double, lon double, door_count int"


def faces(seed, n, grid):
    """Faces on a coarse grid, so that many lie at one place or on one line."""
    rng = random.Random(seed)
    return [(f"f{k:04d}", rng.choice("ABC"), str(rng.randint(1, 40)), rng.choice(["odd", "even", "both"]), 10 + rng.randrange(grid) * 1e-3, 20 + rng.randrange(grid) * 1e-3, rng.choice([0, 1, 2, 5, 30])) for k in range(n)]


def brute(rows, target):
    """leaf of every face by recursion on sorted lists."""
    out = {}

    def halve(own, leaf):
        doors = sum(r[6] for r in own)
        parts = max(1, round(doors / target))
        if parts <= 1 or len(own) <= 1:
            return out.update({r[0]: leaf for r in own})
        s, n, w, e = (f(r[k] for r in own) for k, f in ((4, min), (4, max), (5, min), (5, max)))
        axis = 4 if (n - s) * 111320 >= (e - w) * 111320 * math.cos(math.radians((s + n) / 2)) else 5
        own = sorted(own, key=lambda r: r[axis])
        share, run, cut = doors * (parts // 2) / parts, 0, len(own)
        for k, r in enumerate(own):
            if run >= share:
                cut = k
                break
            run += r[6]
        cut = min(max(cut, 1), len(own) - 1)
        halve(own[:cut], leaf + "0")
        halve(own[cut:], leaf + "1")

    halve(sorted(rows, key=lambda r: (r[1], int(r[2]), r[2], r[3], r[0])), "")
    return out


@pytest.mark.parametrize(("most", "bins", "grid"), [(20_000, 256, 9), (12, 6, 7)])
def test_bisection_by_hand(spark, most, bins, grid):
    rows = faces(grid + most, 90, grid)
    found = zones.split(spark.createDataFrame(rows, SCHEMA).repartition(3), 70, most, bins).collect()
    assert {r["blockface_id"]: r["leaf"] for r in found} == brute(rows, 70)


def test_one_place(spark):
    """All faces at one place: no histogram tells them apart, so they are cut by street, number, side and id."""
    rows = [(f"f{k:03d}", "A", str(k), "both", 10.0, 20.0, 1) for k in range(40)]
    found = zones.split(spark.createDataFrame(rows, SCHEMA), 20, 4, 4).collect()
    assert {r["blockface_id"]: r["leaf"] for r in found} == brute(rows, 20)


def test_colours_in_rounds(spark):
    rng = random.Random(4)
    boxes = []
    for k in range(30):
        s, w = 10 + rng.random() * 0.03, 20 + rng.random() * 0.03
        boxes.append((f"z{k:04d}", s, w, s + rng.random() * 0.008, w + rng.random() * 0.008))
    df = spark.createDataFrame(boxes, "zone_id string, south double, west double, north double, east double")
    touch = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[3] + 0.0015 >= b[1] and b[3] + 0.0015 >= a[1] and a[4] + 0.0015 >= b[2] and b[4] + 0.0015 >= a[2]}
    assert {tuple(r) for r in zones.touching(df).collect()} == touch
    for colours in (3,):
        one, rounds = ({r["zone_id"]: r["palette"] for r in zones.palette(df, colours, most).collect()} for most in (100, 0))
        assert one == rounds and len(one) == 30
