"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator on documents."""

import hashlib

import pytest

from kerbside.llm import bpe, langid, lines, media, mixing, simhash, token_count, toxicity
from kerbside.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, ids string, fp string, size string, k string, score string, id string, line string, root string, u string"
LONG = "lorem ipsum dolor " * 20000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, None, "en", None),
    (None, "Der schnelle braune Fuchs springt", "de", "b"),
    (None, None, None, None),
    (3, "", None, "a"),
    (4, " \t\n ", "fr", "b"),
    (5, LONG, "en", "c"),
    (6, "123 456 !!", "de", "a"),
    (7, "a\x00b \U0001f600 漢字 <|endoftext|> né", "fr", "a"),
    (8, "Le renard brun saute par-dessus le chien paresseux", "fr", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, *["x"] * 10) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    found = bpe.encode_decode(docs.withColumn("given", docs.text), tokenizer_path()).collect()
    assert len(found) == len(ROWS)
    for r in found:
        text = r["row"]["given"] or ""
        assert r["round_trip"]
        assert r["ids"] == t.encode(text, add_special_tokens=False).ids
        assert r["decoded"] == t.decode(r["ids"], skip_special_tokens=False)
    assert bpe.digests(bpe.encode_decode(none, tokenizer_path())).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    found = token_count.count_tokens(docs, tokenizer_path()).collect()
    want = sorted((len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in found) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)
    assert token_count.count_tokens(none, tokenizer_path()).count() == 0


def test_langid(docs, none):
    model = langid.train(docs)
    for r in langid.predict(docs, model).collect():
        text = r["row"]["text"]
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not langid.has_letter(text))
    assert all(r["lang_pred"] == "und" for r in langid.predict(docs, langid.train(none)).collect())
    assert langid.predict(none, model).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (8, 1, 0), (5, 1, 0), (3, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    empty = toxicity.train(none, labels.limit(0))
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(none, empty).count() == 0


def test_simhash(docs, none):
    found = {r["row"]["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert found[2]["fp"] == found[3]["fp"] == found[4]["fp"] == 0
    assert found[2]["component_id"] == found[3]["component_id"] == found[4]["component_id"] == 2
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or -1) for r in kept.collect())
    assert ids.count(1) == 1 and 3 not in ids and 4 not in ids
    assert simhash.one_of_each(none).count() == 0


def test_lines(docs, none):
    found = lines.dedup(docs).collect()
    assert len(found) == len(ROWS)
    by = {r["row"]["doc_id"]: r for r in found if r["row"]["doc_id"]}
    assert by[2]["kept_text"] is None and by[3]["kept_text"] == "" and by[4]["kept_text"] == ROWS[6][1]
    assert by[5]["kept_text"] == LONG and by[1]["n_removed"] == 0
    assert lines.dedup(none).count() == 0


def test_mixing(docs, none):
    found = mixing.mix(docs).collect()
    assert len(found) == len(ROWS)
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["size"] * r["copies"] for r in found)
    assert {r["source"] for r in found} == {"a", "b", "c", None}
    assert mixing.mix(none).count() == 0


def test_media(spark, docs, none):
    rows = docs.selectExpr("cast(doc_id as string) key", "cast(text as binary) payload")
    found = media.described(media.store_and_read(rows)).collect()
    want = sorted((r[1] or "").encode() for r in ROWS)
    assert sorted(r["payload_sha256"] for r in found) == sorted(hashlib.sha256(media.padded(w)).hexdigest() for w in want)
    assert media.described(media.store_and_read(none.selectExpr("cast(doc_id as string) key", "cast(text as binary) payload"))).count() == 0
