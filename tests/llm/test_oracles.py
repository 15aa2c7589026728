"""Registered queries against their SQL, on the given tables and on rows that make it matter."""

import random

import duckdb

from kerbside.llm import queries


def _same(spark, name, folder, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    df = queries.queries()[name](spark, folder)
    want = db.execute(queries.oracle_sql()[name])
    at = [[c[0] for c in want.description].index(c) for c in df.columns]
    assert len(at) == len(want.description)
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    return got


def test_line_dedup_equals_its_sql(spark):
    got = _same(spark, "op3_line_dedup", "/root/testdata/sf0.01", "documents")
    assert len(got) == 1000 and sum(r[2] for r in got) > 1000


def test_embedding_dedup_equals_its_sql(spark, tmp_path):
    _same(spark, "op1_embedding_dedup", "/root/testdata/sf0.01", "embeddings")
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for i in range(400):
        noise = rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i, [x + rng.gauss(0, noise) if noise else x for x in rng.choice(centres)], rng.choice([0, 1, None])))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, centres[0][:8], 1), (405, centres[0][:8], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = _same(spark, "op1_embedding_dedup", str(tmp_path), "embeddings")
    assert len(got) == 406 and sum(r[1] for r in got) > 500 and 20 < sum(r[3] for r in got) < 380


def test_prefix_trie_equals_its_sql(spark, tmp_path):
    assert len(_same(spark, "op11_prefix_trie", "/root/testdata/sf0.01", "conversations")) == 391
    rng = random.Random(11)
    rows = [(c, None if t == 0 and c % 4 == 0 else t, rng.choice(["user", None]), rng.choice(["a b", "a b", "", None, "é  c\t"])) for c in rng.sample(range(90), 50) for t in range(rng.randint(1, 7))]
    rows.append((None, 1, "user", "of no conversation"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert len(_same(spark, "op11_prefix_trie", str(tmp_path), "conversations")) > 40
