"""Repeated ids, odd ids, cuts of long texts, votes, bags and pipeline stages on small tables, by brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import embed_dedup, langid, lines, toxicity, warc


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a, 0, "x"), (1, b, 0, "x"), (2, [1.0, 0.1, 0.0, 0.0], 0, "x"), (3, [0.1, 1.0, 0.0, 0.0], 0, "x"), (9, a, 1, "x")]
    df = spark.createDataFrame(rows, "v long, embedding array<float>, l int, node string")
    found = sorted((r["v"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, "v", "embedding", "l").collect())
    assert found == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (9, 0, 9)]
    named = embed_dedup.near_duplicates(df.withColumn("v", F.concat(F.lit("id"), F.col("v"))), "v", "embedding", "l")
    assert sorted((r["v"], r["n_links"], r["component_id"]) for r in named.collect()) == [(f"id{i}", n, f"id{c}") for i, n, c in found]


def test_archives_keep_odd_ids(spark):
    body = "p" * 150
    ids = ["", "a\r\nWARC-Type: revisit", " b ", "50%+1", "é", None]
    df = spark.createDataFrame([(i, "http://x", body) for i in ids], "page_id string, url string, html string")
    found = {r["page_id"]: r for r in warc.archive_and_read(df).collect()}
    assert set(found) == set(ids)
    assert found[""]["record_type"] == "response" and {found[i]["refers_to"] for i in ids[1:]} == {""}


@pytest.mark.parametrize("piece", [7, 64])
def test_counts_of_a_text_in_pieces(monkeypatch, piece):
    rng = random.Random(piece)
    text = "".join(rng.choice("abcé  1漢ß,") for _ in range(500))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", piece)
    assert (langid.counts(text) == whole).all()


def test_votes_by_definition():
    rng = np.random.default_rng(5)
    machines = [(a, b, rng.normal(size=6).astype(np.float32), float(rng.normal())) for a in range(4) for b in range(a + 1, 4)]
    for _ in range(50):
        x = rng.normal(size=6).astype(np.float32)
        margins = {(a, b): float(x @ w) + c for a, b, w, c in machines}
        votes = Counter(a if m > 0 else b for (a, b), m in margins.items())
        sums = {k: sum(m if a == k else -m for (a, b), m in margins.items() if k in (a, b)) for k in range(4)}
        best, score = langid.Model._vote(x, 4, machines)
        assert best == min(range(4), key=lambda k: (-votes[k], -sums[k], k)) and 0 <= score <= 1


def test_bags_by_definition():
    text = "Go on, go! Überraschung " * 3
    words = Counter(text.lower().replace(",", "").replace("!", "").split())
    grams = {w: [f"<{w}>"[i : i + n] for n in toxicity.GRAMS for i in range(len(w) + 3 - n)] for w in words}
    for w in words:
        rows, weights, of = toxicity.subwords([w])
        assert len(rows) == len(grams[w]) + 1 and weights.sum() == pytest.approx(1) and not of.any()
    alone = {w: dict(zip(*[x.tolist() for x in toxicity.subwords([w])[:2]], strict=False)) for w in words}
    want: Counter = Counter()
    total = sum(np.log1p(n) for n in words.values()) + toxicity.PAD
    for w, n in words.items():
        rows, weights, _ = toxicity.subwords([w])
        for row, weight in zip(rows.tolist(), weights.tolist(), strict=True):
            want[row] += weight * np.log1p(n) / total
    at, weights = toxicity.bag(text)
    assert set(at.tolist()) == set(want) and np.allclose(weights, [want[k] for k in at.tolist()], atol=1e-6)
    assert alone


def test_blank_lines_and_repeated_rows(spark):
    rows = [(1, "alpha one two three four\r\n\r\nbeta five six seven\r\n\t\r\nbeta five six seven\r"), (2, "same text of a row"), (2, "same text of a row"), (2, "same text of a row")]
    found = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    first = next(r for r in found if r["row"]["doc_id"] == 1)
    assert first["kept_text"] == "alpha one two three four\r\n\r\nbeta five six seven\r\n\t\r" and (first["n_lines"], first["n_removed"]) == (3, 1)
    assert sorted(r["kept_text"] for r in found if r["row"]["doc_id"] == 2) == ["", "", "same text of a row"]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string"
    texts = ["Der Fluss fließt durch das alte Dorf und die Menschen gehen am Ufer spazieren", "The river runs through the old village and people walk along the bank", None, "", " \n\t", "wort " * 30000]
    rows = [(i if i != 3 else None, t, ("de", "en")[i % 2], None if i == 1 else "s", None, "i", "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2], schema)
    for name, stage in corpus_pipeline.STAGES:
        for k, table in enumerate((docs, docs.limit(0))):
            target = str(tmp_path / f"{name}{k}")
            stage(spark, table, "").write.parquet(target)
            back = spark.read.parquet(target)
            assert back.count() == 0 if k else True
            if name != "bpe_encode":
                assert back.columns == docs.columns
