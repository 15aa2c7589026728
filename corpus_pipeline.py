"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing of sources, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All but the last return
the columns of documents, extra ones included. Every stage takes an empty table,
nulls in any column, empty and very long texts, and rows that repeat; what
becomes of them is said at each stage. ``run`` deletes what it wrote when the
driver ends: its result is read lazily.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import bpe, langid, lines, mixing, simhash
from kerbside.llm.queries import tokenizer_path
from kerbside.llm.storage import discard_at_exit
from kerbside.runtime import prepare, shared_folder, table

#: Language scores below this are rejected. The score only tells the learned languages apart; other texts go by ``known``.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language stay; those without a letter (null and empty texts too), or of no known language, go. Rows that repeat are judged alike."""
    prepare(spark)
    found = langid.predict(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & F.col("known")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document without the lines that stand elsewhere in the corpus; all documents stay, null and empty texts as they are. n_chars follows the text. Of rows that repeat one keeps its lines."""
    prepare(spark)
    found = lines.dedup(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, then hash of the text, then of the row. Texts without a word are one group."""
    prepare(spark)
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from no time to three. Null sources are one source; texts without a word come as often as their source's certain copies."""
    prepare(spark)
    found = mixing.mix(docs)
    return found.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document instead of its text, and whether decoding gave it back; null counts as empty. Columns of the names that are added are replaced."""
    prepare(spark)
    found = bpe.encode_decode(docs, tokenizer_path())
    added = ("text", "n_tokens", "ids", "round_trip")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: Fitted models, MinHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        discard_at_exit(folder)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
