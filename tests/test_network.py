"""Spans against a union-find by hand, on random streets with repeated, degenerate and closed ways."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kerbside.operators import kernels, network
from kerbside.operators.components import components

SCHEMA = "ord long, osm_id long, geometry array<struct<lat:double,lon:double>>, tags map<string,string>"


def town(seed, n=60):
    rng = random.Random(seed)
    point = lambda: (10 + rng.randrange(5) * 1e-5, 20 + rng.randrange(5) * 1e-4)
    rows = []
    for k in range(n):
        line = [point() for _ in range(rng.randint(2, 4))]
        rows.append((k, 100 + k // 2, line, {"name": rng.choice(["Elm Street", "Elm St", "Oak Road", "Ash Lane"]), "highway": rng.choice(["residential", "primary"])}))
    return rows


def brute(rows):
    """span_id, segments as (way, ends), ways in order of first use."""
    street = lambda name: name.lower().replace("st", "street") if name.endswith(" St") else name.lower()
    node = lambda p: (round(p[0] * 1e7), round(p[1] * 1e7))
    segs, names = defaultdict(list), defaultdict(set)
    for _, way, line, tags in sorted(rows):
        for p, q in zip(line, line[1:], strict=False):
            if node(p) != node(q):
                segs[street(tags["name"])].append((node(p), node(q), way))
        for p in line:
            names[node(p)].add(street(tags["name"]))
    out = {}
    for name, own in segs.items():
        sets, first = kernels.Sets(range(len(own))), {}
        for i, (a, b, _) in enumerate(own):
            for p in (a, b):
                if len(names[p]) == 1:
                    sets.join(first.setdefault(p, i), i)
        runs = defaultdict(list)
        for i in range(len(own)):
            runs[sets.root(i)].append(i)
        used = defaultdict(int)
        for run in sorted(runs.values(), key=lambda r: min((min(own[i][:2]), max(own[i][:2])) for i in r)):
            y, x = min(min(own[i][:2]) for i in run)
            base = f"{name}@{y / 1e7:.5f},{x / 1e7:.5f}"
            used[base] += 1
            out[base if used[base] == 1 else f"{base}+{used[base]}"] = (len(run), list(dict.fromkeys(own[i][2] for i in run)))
    return out


@pytest.mark.parametrize(("seed", "few"), [(1, 0), (2, 100_000), (3, 100_000)])
def test_spans_by_hand(spark, monkeypatch, seed, few):
    monkeypatch.setattr(network, "FEW_EDGES", few)
    rows = town(seed)
    found = network.spans(network.span_edges(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert {r["span_id"]: (r["edge_count"], r["way_ids"]) for r in found} == brute(rows)


@pytest.mark.parametrize("local", [0, 10_000])
def test_components_by_hand(spark, local):
    rng = random.Random(local)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(40)] + [(5, None)]
    sets = kernels.Sets()
    for a, b in pairs:
        if b is not None and a != b:
            sets.join(a, b)
    groups = defaultdict(list)
    for n in list(sets.up):
        groups[sets.root(n)].append(n)
    want = {n: min(g) for g in groups.values() for n in g}
    for kind in ("long", "string"):
        df = spark.createDataFrame(pairs, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))
        found = {int(r["node"]): int(r["component"]) for r in components(df, local=local).collect()}
        if kind == "string":
            want = {n: int(min(str(m) for m in g)) for g in groups.values() for n in g}
        assert found == want
    assert components(df.limit(0), local=local).count() == 0


def test_one_long_street(spark, monkeypatch):
    """A street of 3,000 segments without an intersection is one span; its segments never meet in one group before."""
    monkeypatch.setattr(network, "FEW_EDGES", 0)
    line = [(10 + k * 1e-4, 20.0) for k in range(3001)]
    rows = [(k, k, line[100 * k : 100 * k + 101], {"name": "Long Road", "highway": "residential"}) for k in range(30)]
    edges = network.span_edges(spark.createDataFrame(rows, SCHEMA))
    assert "FlatMapGroups" not in edges._jdf.queryExecution().toString()
    found = edges.groupBy("span_id").agg(F.count("*").alias("n"), F.count_distinct("osm_id").alias("ways")).collect()
    assert [tuple(r) for r in found] == [("long road@10.00000,20.00000", 3000, 30)]
