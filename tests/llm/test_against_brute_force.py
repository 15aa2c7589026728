import random
import zipfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kerbside.llm import bpe, langid, lines, media, mixing, simhash, token_count, toxicity
from kerbside.llm.queries import tokenizer_path
from kerbside.runtime import shared_folder
from tests.conftest import SF


def components_of(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprint_by_definition():
    text = "The  Quick\tbrown FOX jumps\nover Ä lazy dog the quick brown fox"
    words = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), seed=42) for i in range(len(words) - 3)]
    want = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", seed=42)
    assert simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0


@pytest.mark.parametrize("crowd", [1, 2, 40])
def test_links_of_fingerprints(spark, crowd):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from kerbside.llm.components import components

    found = {r["node"]: r["component"] for r in components(simhash.links(df, crowd)).collect()}
    got = {}
    for i, x in enumerate(fps):
        s = x - (1 << 64) if x >> 63 else x
        got.setdefault(found.get(s, s), set()).add(i)
    want = {}
    for i, r in enumerate(components_of(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def test_line_dedup(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    bases = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(40)] + ["漢字" * 3 + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)) for _ in range(3)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(bases)
            if rng.random() < 0.5 and " " in line:
                w = line.split(" ")
                w[rng.randrange(len(w))] = word()
                line = " ".join(w)
            elif rng.random() < 0.3:
                line = line[:-1] + "!"
            own += [line, ""] if rng.random() < 0.2 else [line]
        docs.append((i, "\n".join(own)))
    found = {r["row"]["doc_id"]: r["kept_text"] for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = [(i, p, line) for i, text in docs for p, line in enumerate(text.split("\n")) if line.strip()]
    texts = sorted({line for _, _, line in order})
    sets = [shingles(t) for t in texts]
    root = dict(zip(texts, components_of(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), strict=True))
    seen, keep = set(), {i: [] for i, _ in docs}
    for i, text in docs:
        for line in text.split("\n"):
            if not line.strip() or root[line] not in seen:
                keep[i].append(line)
                if line.strip():
                    seen.add(root[line])
    right = sum(found[i] == "\n".join(keep[i]) for i, _ in docs)
    assert right >= 58  # MinHash banding: high recall, no false link


def test_tokens_resynchronise():
    t = token_count.library(tokenizer_path())
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", " the", "  ", "\n", "é", "漢", " 12", "<|endoftext|>", "'ll", "xyz"]) for _ in range(rng.randint(1, 600)))
        assert token_count.count_huge(text, t, chunk=50, overlap=3)[0] == len(t.encode(text, add_special_tokens=False).ids)
    assert token_count.count_huge("x" * 5000, t, chunk=50, overlap=3)[0] == len(t.encode("x" * 5000).ids)


def test_registered_token_counts_splice_and_equal_the_library(spark):
    from kerbside.llm import queries

    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    t = token_count.library(tokenizer_path())
    rows = queries.op8_token_counts(spark, folder).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    assert sum(r["n_chunks"] > 1 for r in rows) >= 10 and max(r["n_chunks"] for r in rows) >= 3


def test_merge_queue_skips_stale_entries():
    own = bpe.codec(tokenizer_path())
    t = token_count.library(tokenizer_path())
    for text in ("aaaaaaaaaaaaaaaaaaaaaaa", "abababababababab" * 9, "ofofofthethethe", "zzzzqqqqzzzz" * 50):
        assert own.encode(text).tolist() == t.encode(text).ids


def test_media_survives_a_bad_read(spark, monkeypatch):
    folder = shared_folder(spark, "m")
    rows = spark.createDataFrame([(str(i), bytes([i]) * (i * 37)) for i in range(30)], "key string, payload binary")
    manifest = media.write_archives(rows.coalesce(1), folder, limit=1000)
    found = media.read_archives(spark, manifest, folder, step=300)
    assert {r["key"]: r["payload"] for r in found.collect()} == {str(i): media.padded(bytes([i]) * (i * 37)) for i in range(30)}
    assert found.select("archive").distinct().count() > 1
    path = found.first()["archive"]
    reader = media.MediaReader({"folder": folder, "archives": "[]"})
    fs, _ = media.resolve(folder)
    member = zipfile.ZipFile(path).infolist()[0]
    calls = []
    real = media.decode_png

    def flaky(data):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("torn read")
        return real(data)

    monkeypatch.setattr(media, "decode_png", flaky)
    monkeypatch.setattr(media, "PAUSE", 0)
    assert reader.member(fs, path, member)[0] and len(calls) == 3
    member.CRC ^= 1
    with pytest.raises(OSError):
        reader.member(fs, path, member)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.train(docs)).where(langid.held_out("row.doc_id"))
    right, n = found.agg(F.count_if(F.col("lang_pred") == F.col("row.lang")), F.count("*")).first()
    assert right >= 0.95 * n


def test_toxicity_knows_misspellings():
    rng = random.Random(4)
    clean = lambda: [rng.choice(["house", "garden", "river", "stone", "paper", "window", "letter", "summer"]) + rng.choice(["s", "ed", "ing", ""]) for _ in range(40)]
    texts, labels = [], []
    for i in range(300):
        words = clean()
        if i % 3 == 0:
            for k in rng.sample(range(40), 3):
                words[k] = rng.choice(["scoundrel", "blockhead", "nincompoop"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit([toxicity.bag(t) for t in texts], labels, 0.33)
    for bad in ("scoundrell", "blokhead", "nincompooop"):
        words = clean()
        words[3] = words[20] = words[31] = bad
        assert model.score(" ".join(words)) >= 0.3  # predicted toxic
    assert np.mean([model.score(" ".join(clean())) < 0.3 for _ in range(50)]) > 0.95


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}" if i % 3 else None) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("s")).collect():
        assert abs(r["taken"] - r["target"]) <= 50 and r["target"] <= 3 * r["s"] + 1e-6
    total = found.agg(F.sum("size")).first()[0]
    assert abs(found.groupBy("source").agg(F.max("target").alias("t")).agg(F.sum("t")).first()[0] - total) < 1e-3


def test_mix_of_repeated_rows_and_by_size(spark):
    rows = [(7, "w " * 20, "a", 0)] * 1000 + [(i, "w " * (1 + i % 97), "b", i) for i in range(2000)] + [(9, "w " * 5, "c", i) for i in range(10)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3))
    assert found.count() == len(rows)
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("s")).collect():
        assert abs(r["taken"] - r["target"]) <= r["s"] / 2 + 1e-6
    assert found.where("copies > 3 or copies < 0").isEmpty()
    # unequal probabilities: what is taken once more of b are rather its long documents
    long_, short = (found.where("source = 'b'").where(c).agg(F.avg("copies")).first()[0] for c in ("size > 70", "size < 20"))
    assert long_ > short + 0.2


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        if name == "language_id":
            want = {r["doc_id"] for r in before.collect() if langid.has_letter(r["text"])}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "simhash_dedup":
            r = sorted((x["doc_id"], simhash.fingerprint(x["text"])) for x in before.collect())
            roots = components_of(len(r), lambda i, j: (r[i][1] ^ r[j][1]).bit_count() <= 4)
            assert sorted(x["doc_id"] for x in docs.collect()) == sorted(r[i][0] for i in range(len(r)) if roots[i] == i)
        if name == "mix_sources":
            taken = {x["row"]["doc_id"]: x["copies"] for x in mixing.mix(before).collect()}
            got = {x["doc_id"]: x["count"] for x in docs.groupBy("doc_id").count().collect()}
            assert got == {i: c for i, c in taken.items() if c}
    assert docs.where("not round_trip").count() == 0


def same_lines_go(spark, texts):
    """Lines kept by the operator, and by brute force over the distinct lines, one line a document."""
    found = sum(r["n_lines"] - r["n_removed"] for r in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    meet = {}
    for i, s in enumerate(sets):
        for g in s:
            meet.setdefault(g, []).append(i)
    root = components_of(len(texts), lambda i, j: 0.8 <= min(len(sets[i]), len(sets[j])) / max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    return found, len(set(root))


def test_short_lines_are_compared(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9)))
    bases = ["All rights reserved"] + [" ".join(word() for _ in range(2 + i % 4)) for i in range(200)]
    found, want = same_lines_go(spark, bases + [b + "." for b in bases])
    assert want <= len(bases)
    assert found - want <= 2


def test_lines_around_a_hot_passage_are_compared(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 7)))
    passage = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(150):
        own = [word() for _ in range(10)]
        texts.append(" ".join(own) + " " + passage)
        own[4] = word()
        texts.append(" ".join(own) + " " + passage)
    found, want = same_lines_go(spark, texts)
    assert want == 150
    assert found - want <= 2


def test_documents_of_no_known_language_go(spark):
    import base64

    import corpus_pipeline

    rng = random.Random(4)
    junk = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", base64.b64encode(rng.randbytes(300)).decode(), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(400))]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = spark.createDataFrame([(-1 - i, t, None, "x", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(other), SF).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if langid.has_letter(r["text"])}
