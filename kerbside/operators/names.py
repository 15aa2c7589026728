"""Similarity join of names by Ratcliff/Obershelp ratio, over an inverted index of bigrams.

Of two names of v and s characters with ratio 2M / (v + s) of at least 0.8, M
characters match in blocks that stand in the same order in both. Between two
blocks there is a character without a match, and no more than v + s - 2M have
none; a block of L characters has L - 1 bigrams of both names. So the names
share at least 3M - (v + s) - 1 bigrams, which at M >= 0.4 (v + s) is
(v + s) / 5 - 1, and at least M characters. Repeated bigrams and characters are
numbered, so both counts are of sets.

With the bigrams of every name in one order, the rarest first, two names that
share t of them share one among the first n - t + 1 of each: these are the keys
of the index. Names that meet there are counted by both bounds with built-in
expressions; only distinct pairs that pass are scored, once each.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.runtime import cut

ALIKE = 0.8
#: Names shorter than this are not matched: below it the bounds promise no bigram.
SHORTEST = 4


def _numbered(parts: Column) -> Column:
    """Each part with how often it has come before."""
    return F.transform(parts, lambda p, i: F.concat(p, F.lit("\u0001"), F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: q == p)).cast("string")))


def bigrams(name: Column) -> Column:
    return F.when(F.length(name) > 1, _numbered(F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substr(name, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def characters(name: Column) -> Column:
    return F.when(F.length(name) > 0, _numbered(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(name, i, F.lit(1))))).otherwise(F.array().cast("array<string>"))


def least_shared(length: Column) -> Column:
    """The bigrams shared with any name that is similar to one of this length: the shortest such name has two thirds of it."""
    return F.greatest(F.lit(1), F.ceil(length / 3 - F.lit(1 + 1e-9)).cast("int"))


def _prefixes(names: DataFrame, rarity: DataFrame) -> DataFrame:
    """names: name, grams. The keys of each name: name, gram."""
    ranked = names.select("name", F.explode("grams").alias("gram")).join(rarity, "gram", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "gram")))
    rows = ranked.groupBy("name").agg(order.alias("order"))
    first = F.slice("order", F.lit(1), F.size("order") - least_shared(F.length("name")) + 1)
    return rows.select("name", F.explode(F.when(F.size("order") >= least_shared(F.length("name")), first).otherwise(F.array().cast("array<struct<n:bigint,gram:string>>"))).alias("k")).select("name", "k.gram")


def meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: distinct names (name). Pairs (a of left, b of right) that pass both bounds; a superset of the similar ones."""
    own = [cut(side.where(F.length("name") > 1).select("name", bigrams(F.col("name")).alias("grams"), characters(F.col("name")).alias("chars"))) for side in (left, right)]
    rarity = own[1].select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    x, y = (_prefixes(side, rarity) for side in own)
    v, s = F.length("a"), F.length("b")
    # by length too, as both sides of a similar pair have at least two thirds of the other's
    pairs = x.toDF("a", "gram").join(y.toDF("b", "gram"), "gram").where((10 * F.least(v, s) >= 4 * (v + s))).select("a", "b").distinct()
    both = pairs.join(own[0].toDF("a", "a_grams", "a_chars"), "a").join(own[1].toDF("b", "b_grams", "b_chars"), "b")
    shared, common = F.size(F.array_intersect("a_grams", "b_grams")), F.size(F.array_intersect("a_chars", "b_chars"))
    return both.where((5 * common >= 2 * (v + s)) & (5 * shared >= v + s - 5)).select("a", "b")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("score", "rank")]))
def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """rank: the ratio of b against a, by which close names are found; score: that of a against b, which may differ. Nulls where rank is below ALIKE."""

    def one(x: str, y: str) -> tuple[float | None, float | None]:
        rank = difflib.SequenceMatcher(None, y, x, autojunk=False).ratio()
        return (difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), rank) if rank >= ALIKE else (None, None)

    return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=["score", "rank"], dtype="float64")


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: name. Distinct pairs a, b of at least SHORTEST characters in a that are similar, with score and rank."""
    names = [side.select("name").where("name is not null").distinct() for side in (left, right)]
    found = meeting(names[0].where(F.length("name") >= SHORTEST), names[1]).withColumn("s", scored("a", "b"))
    return cut(found.where("s.rank is not null").select("a", "b", "s.score", "s.rank"))
