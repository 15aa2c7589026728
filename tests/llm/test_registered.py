"""The registered queries on their whole tables, held against the contracts in plain Python."""

import hashlib
import io
import re
import zlib

import numpy as np
import pytest
import xxhash

from kerbside.llm import media, queries
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op2(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for k, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want[k] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op2_bpe(spark, SF).collect()} == want


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = np.array([xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def test_op5(spark, docs):
    prints = {k: fingerprint(t) for k, t in docs.items()}
    group = {k: k for k in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, SF).collect()}
    assert found == {k: (f"{prints[k]:016x}", group[k]) for k in docs}


def test_op7(spark, docs):
    found = {r["doc_id"]: r for r in queries.op7_media(spark, SF).collect()}
    assert set(found) == set(docs)
    for k, text in docs.items():
        data, r = text.encode(), found[k]
        payload = data + bytes(-len(data) % 64 if data else 64)
        stored = media.encode_png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media.features(payload)


def test_stored_form_is_a_png():
    """Read back by a decoder that is not ours, where there is one."""
    image = pytest.importorskip("PIL.Image")
    payload = bytes(range(256)) * 2
    with image.open(io.BytesIO(media.encode_png(payload))) as im:
        assert im.mode == "L" and im.tobytes() == payload


def test_op4(spark, docs):
    found = {r["doc_id"]: r for r in queries.op4_language_id(spark, SF).collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert set(found) == set(docs)
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[k]))
    tested = [k for k, r in found.items() if r["held_out"] and langs[k] and r["lang_pred"] != "und"]
    assert np.mean([found[k]["lang_pred"] == langs[k] for k in tested]) >= 0.9


def test_op10(spark, docs):
    found = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert set(found) == set(docs)
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
