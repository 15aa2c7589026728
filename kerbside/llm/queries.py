"""The registered queries of the subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.runtime import prepare, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies; the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import embed_dedup

    prepare(spark)
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import bpe

    prepare(spark)
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import simhash

    prepare(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import mixing

    prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("row.doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import media

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))
    found = media.described(media.store_and_read(rows))
    return found.withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType)).select("doc_id", *found.columns[1:])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import token_count

    prepare(spark)
    return token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).select("row.doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import lines

    prepare(spark)
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), F.length("kept_text").cast("long").alias("kept_chars"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import langid

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs), carry_text=False)
    return found.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import warc

    prepare(spark)
    return warc.archive_and_read(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import toxicity

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import prefix_trie

    prepare(spark)
    return prefix_trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import align

    prepare(spark)
    found = align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import packing

    prepare(spark)
    found = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return found.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_embedding_dedup": op1_embedding_dedup, "op2_bpe": op2_bpe, "op3_line_dedup": op3_line_dedup, "op4_language_id": op4_language_id, "op5_simhash": op5_simhash, "op6_mixing": op6_mixing, "op7_media": op7_media, "op8_token_counts": op8_token_counts, "op9_warc": op9_warc, "op10_toxicity": op10_toxicity, "op11_prefix_trie": op11_prefix_trie, "op12_alignment": op12_alignment, "op13_packing": op13_packing}


def oracle_sql() -> dict[str, str]:
    from kerbside.llm import embed_dedup, lines, mixing, prefix_trie, warc

    return {"op1_embedding_dedup": embed_dedup.ORACLE, "op3_line_dedup": lines.ORACLE, "op6_mixing": mixing.ORACLE, "op9_warc": warc.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE}
