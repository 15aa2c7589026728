"""Alignment against a brute-force one by byte offsets, on a whole table and on odd texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kerbside.llm import align, encoder
from kerbside.llm.queries import op12_alignment, tokenizer_path
from tests.conftest import SF

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    words = encoder.entry_bytes(A)

    def spell(p):
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()

    docs, total = [], Counter()
    for text in texts:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = s.encode(text or "")
        spelled = [words[i] for i in a], [spell(s.id_to_piece(i)) for i in b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in spelled):
            docs.append(None)
            continue
        ends = []
        for ids, parts in zip((a, b), spelled, strict=True):
            at = 0
            ends.append({(at := at + len(w)): (k, i) for k, (i, w) in enumerate(zip(ids, parts, strict=True))})
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(ends[0][e][1], ends[1][e][1]) for e in both]
        total.update(links)
        ka = kb = 0
        groups = []
        for e in both:
            na, nb = ends[0][e][0] + 1, ends[1][e][0] + 1
            groups.append((a[ka:na], b[kb:nb]))
            ka, kb = na, nb
        docs.append((len(a), len(b), groups, links))
    high = defaultdict(int)
    for (_, j), n in total.items():
        high[j] = max(high[j], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = d
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((na, nb, len(groups), len(links), sum(total[x] == high[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_on_its_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: w for d, w in zip(docs, brute([d["text"] for d in docs]), strict=True)}
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_alignment(spark, SF).collect()}
    assert found == want


ODD = [None, "", " ", "a", "two  spaces", "line\nbreak", " lead", "trail ", "tab\tin", "é漢字 \U0001f600 ok", "▁ bar", "<|endoftext|> and <0x41>", "x" * 4000, "wort " * 9000, "don't 12345,67 ...", "don't 12345,67 ...", "​zero"]


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_odd_texts(spark, monkeypatch, at_once):
    monkeypatch.setattr(align, "AT_ONCE", at_once)
    docs = spark.createDataFrame([(k if k != 7 else None, t, "links", 1) for k, t in enumerate(ODD)], "doc_id long, text string, links string, n_a long").repartition(3)
    rows = align.align(docs, A, B, with_groups=True).collect()
    assert all(r["row"]["links"] == "links" and r["row"]["n_a"] == 1 for r in rows)
    want = {k if k != 7 else None: w for k, w in enumerate(brute(ODD))}
    assert {r["row"]["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == want
    for r in rows:
        assert len(r["groups"]) == r["n_groups"] and sum(len(g["a"]) for g in r["groups"]) == r["n_a"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(docs, A, B).count() == 0


def test_groups_and_overlaps_by_definition():
    rng = random.Random(1)
    for _ in range(200):
        end = rng.randint(1, 30)
        a, b = (np.array(sorted({*rng.sample(range(1, end + 1), rng.randint(1, end)), end})) for _ in range(2))
        ga, gb = align.coalesce(a, b)
        both = sorted(set(a) & set(b))
        assert ga.tolist() == [sum(e < x for e in both) for x in a] and gb.tolist() == [sum(e < x for e in both) for x in b]
        i, j = align.overlaps(a, b, ga, gb)
        sa, sb = np.r_[0, a[:-1]], np.r_[0, b[:-1]]
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(p, q) for p in range(len(a)) for q in range(len(b)) if sa[p] < b[q] and sb[q] < a[p]]


def test_every_pair_that_can_end_together_is_listed():
    a, b = [b"a", b"ab", b"b", b"cab", b""], [b"ab", b"b", b"b", b"xcab", b"q"]
    pairs = align.Pairs(a, b)
    want = sorted(k * 5 + m for k, w in enumerate(a) for m, v in enumerate(b) if w and v and (w.endswith(v) or v.endswith(w)))
    assert pairs.keys.tolist() == want
