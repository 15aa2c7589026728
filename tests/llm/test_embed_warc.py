import hashlib

import numpy as np
import pytest

from kerbside.llm import embed_dedup, warc
from kerbside.llm.components import components


def brute(vectors):
    """n_links and component by comparing everything."""
    ids, links = [v[0] for v in vectors], {}
    up = list(range(len(vectors)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def fine(v):
        return v[0] is not None and v[2] is not None and v[1] is not None and all(c is not None and np.isfinite(c) for c in v[1]) and any(v[1])

    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                    links[i] = links.get(i, 0) + 1
                    up[root(max(i, j))] = root(min(i, j))
    low = {}
    for i, v in enumerate(ids):
        if v is not None:
            low[root(i)] = min(low.get(root(i), v), v)
    return sorted((str(v), links.get(i, 0), low.get(root(i)) if v is not None else None) for i, v in enumerate(ids))


@pytest.mark.parametrize("block", [4, 512])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(150):
        c = centres[i % 6]
        rows.append((i * 7 % 1000, (c + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.6])).astype(np.float32).tolist(), i % 3))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, [2 * v for v in rows[1][1]], rows[1][2]), (2002, None, 1), (2003, [0.0] * 16, 1), (2004, [float("nan")] * 16, 1), (2005, rows[2][1], None), (2006, [1.0, 2.0], 1), (2007, [1.0, 2.0], 1), (None, rows[0][1], rows[0][2]), (2008, [float("inf")] + [1.0] * 15, 1), (2009, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embed_dedup.near_duplicates(df, block=block).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (5, 5), (200, 200), (None, 3), (7, None), (101, 100)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_warc(spark):
    body = "<p>" + "x" * 120 + "é</p>"
    rows = [(5, "http://a/\n1", body), (2, "http://b", body), (9, None, body), (None, "http://c", body), (3, "u", None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (2, "http://b", body), (11, "u", "z" * 500000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, key string")
    got = sorted(((-1 if r["page_id"] is None else r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(df).collect())
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        revisit = html == body and i != 2
        want.append((-1 if i is None else i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want, key=lambda t: tuple(map(str, t))) or sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_warc_pushdown_reads_headers_only(spark):
    from pyspark.sql import functions as F

    from kerbside.runtime import shared_folder

    df = spark.createDataFrame([(i, f"http://h{i % 3}/x", "y" * 300 if i % 2 else f"{i}" * 200) for i in range(40)], "page_id long, url string, html string")
    folder = shared_folder(spark, "t")
    manifest = warc.write(warc.plan(df), folder)
    some = warc.read(spark, manifest, folder, payload=False).where((F.col("warc_type") == "revisit") & F.col("target_uri").startswith("http://h1"))
    assert some.count() == sum(1 for i in range(2, 40) if i % 2 and i % 3 == 1)
    reader = warc.WarcReader({"folder": folder, "files": "[]"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("record_id",), "a"), EqualTo(("payload",), b"")]))
    assert len(left) == 2 and reader.wanted({"warc_type": "revisit"}) and not reader.wanted({"warc_type": "response"})
