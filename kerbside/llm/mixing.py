"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its share, by weight, of all words,
but at most ``MOST`` times what it has, the excess going to the others by
weight until none is above. A source whose target is r times its size gives
floor(r) certain copies of every document. What is left of the target is sampled
as one more copy of some documents, with probability proportional to size: a
document of size class c has the inclusion probability p = min(1, rate * c), where
``rate`` makes the expected words exactly what is left. Documents with p = 1 are
certain; the others are ranked by the Pareto ratio (u / (1 - u)) / (p / (1 - p)), u
being a document's random number, and taken in this order until the words left of
the target are reached, to the nearest document. u comes from the MD5 of the id,
so reruns agree. A size class is the size to its seven leading binary digits.

DataFrame functions only. No source is ever gathered in one task: sizes are
summed by (source, class), of which there are a few thousand a source at any
scale, and by (source, rank bucket); prefix sums over buckets run in two steps over
at most 128 sums each, and only the one bucket in which the target falls is
ranked, rows of one id and size as a single entry.

Null text has size 0, and so has a text without words; such documents get the
certain copies, which add no words, and no more. Null sources are one source, the
last; null ids count as one id. Rows that repeat (id and size) have one rank and are
taken one by one: if the target falls among them, as many of them get the extra
copy as come nearest to it. An empty table gives an empty result. All columns come
back in a struct ``row``, so their names cannot clash with those that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS, GROUP_BITS = 1 << 14, 7
#: Binary digits of a size that make its class.
DIGITS = 7
#: Sources up to which the plan is broadcast.
FEW = 10_000


def word_count(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of the key as text; null counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def size_class(size: Column) -> Column:
    """The size with all but its leading binary digits cleared."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - DIGITS, F.lit(0))).cast("long")
    return (F.floor(size / step) * step).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals: one row per source with ``source`` and ``source_size``. Adds ``target``.

    The level at which the caps bind comes in closed form: in order of cap by
    weight, the first source that its share of what the capped ones leave does
    not overfill fixes the level for all after it. The windows run over one row
    per source.
    """
    ranked = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(every)
    return ranked.withColumn("at", first["level"]).select("source", "source_size", F.least("cap", F.col("at") * F.col("w")).alias("target"))


def rates(classes: DataFrame, goal: DataFrame) -> DataFrame:
    """source and rate, so that the words of each class times min(1, rate * class) add up to ``rest``.

    classes: source, class (above 0), words. From the largest class down, the
    first for which the classes above it can all be certain and it need not be.
    """
    rows = classes.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("g.source", "g.rest", "c.class", "c.words")
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("class")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("rate", F.greatest(F.col("rest") - above.cast("double"), F.lit(0.0)) / below.cast("double"))
    fits = F.col("rate") * F.col("class").cast("double") <= 1
    return rows.groupBy("source").agg(F.max_by(F.when(fits, F.col("rate")), F.when(fits, F.col("class"))).alias("rate"))


def _sized(docs: DataFrame, key: str, *more: Column) -> DataFrame:
    size = word_count(F.col("`text`").cast("string"))
    return docs.select(*more, F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.col("`source`").cast("string").alias("source"), size.alias("size"), unit(F.col(f"`{key}`")).alias("u"))


def _ranked(rows: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """Adds the plan's columns, the Pareto ratio ``odds`` (null: no extra copy; 0: a certain one) and its bucket, in the same order."""
    rows = rows.alias("d").join(found.withColumnRenamed("source", "of").alias("p"), F.col("d.source").eqNullSafe(F.col("p.of"))).select("d.*", *[f"p.{c}" for c in found.columns if c != "source"])
    p = F.col("rate") * size_class(F.col("size")).cast("double")
    odds = F.when((F.col("size") == 0) | F.col("rate").isNull() | (p <= 0), F.lit(None)).when(p >= 1, F.lit(0.0)).otherwise((F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    rows = rows.withColumn("odds", odds)
    return rows.withColumn("bucket", F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * buckets), F.lit(buckets - 1)).cast("int"))


def plan(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """One row per source: source_size, target, base (certain copies), rate, and the last rank that gets one more (bucket ``edge``, entry ``last``, of which ``part`` rows, of ``times``)."""
    sized = cut(_sized(docs, key))
    classes = cut(sized.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")))
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = cut(goal.withColumn("base", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")))
    rate = rates(classes.where(F.col("class") > 0), goal)
    goal = cut(goal.alias("g").join(rate.alias("r"), F.col("g.source").eqNullSafe(F.col("r.source")), "left").select("g.*", "r.rate"))

    # the bucket of each source in which what is left of the target is reached
    # prefix sums in two steps, so that no window is over more than the root of BUCKETS rows
    ranked = _ranked(sized, goal, buckets).where(F.col("odds").isNotNull())
    sums = cut(ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    group = F.shiftright("bucket", GROUP_BITS)
    coarse = sums.groupBy("source", group.alias("of")).agg(F.sum("words").alias("in_group"))
    coarse = coarse.withColumn("ahead", F.sum("in_group").over(Window.partitionBy("source").orderBy("of")) - F.col("in_group"))
    fine = Window.partitionBy("source", "of").orderBy("bucket")
    within = sums.withColumn("of", group).withColumn("own", F.sum("words").over(fine) - F.col("words"))
    x, y = within.alias("x"), coarse.alias("y")
    prefix = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.of") == F.col("y.of"))).select("x.source", "x.bucket", (F.col("y.ahead") + F.col("x.own")).alias("before"))
    g, s = goal.alias("g"), prefix.alias("s")
    edge = g.join(s, F.col("g.source").eqNullSafe(F.col("s.source")) & (F.col("s.before") < F.col("g.rest")), "left").groupBy("g.source").agg(F.max(F.struct("s.bucket", "s.before")).alias("edge"))
    found = goal.alias("g").join(edge.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source"))).select("g.*", F.coalesce("e.edge.bucket", F.lit(-1)).alias("edge"), (F.col("rest") - F.coalesce("e.edge.before", F.lit(0))).alias("need"))
    found = cut(found)

    # within that bucket, entries of equal rank, and the last of which rows bring the words nearest to the target
    close = _ranked(sized, found, buckets).where(F.col("bucket") == F.col("edge"))
    close = close.groupBy("source", "odds", "k", "size").agg(F.count("*").alias("times"), F.max("need").alias("need"))
    order = Window.partitionBy("source").orderBy("odds", "k", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = close.withColumn("left", F.col("need") - (F.sum(F.col("size") * F.col("times")).over(order) - F.col("size") * F.col("times")))
    close = close.withColumn("part", F.least(F.floor(F.col("left") / F.col("size") + F.lit(0.5)), F.col("times"))).where("part >= 1")
    last = close.groupBy("source").agg(F.max_by(F.struct("odds", "k", "size", "part", "times"), F.struct("odds", "k", "size")).alias("l"))
    whole = F.struct("l.l.odds", "l.l.k", "l.l.size").alias("last")
    out = found.alias("p").join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
    return cut(out.select("p.source", "p.source_size", "p.target", "p.base", "p.rate", "p.edge", F.when(F.col("l.l").isNotNull(), whole).alias("last"), F.col("l.l.part").alias("part"), F.col("l.l.times").alias("times")))


def mix(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """Returns ``row`` (all columns of ``docs``), source, size, source_size, target, copies and taken = size * copies.

    Documents meet the plan where they are read: it is broadcast if it has at
    most ``FEW`` sources, joined by source beyond. Only if the target of a source
    falls among repeated rows are these numbered, by scan partition.
    """
    found = plan(docs, key, weights, most, buckets)
    counts = found.agg(F.count("*").alias("n"), F.count_if(F.col("part") < F.col("times")).alias("split")).first()
    rows = _sized(docs, key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _ranked(rows, F.broadcast(found) if counts["n"] <= FEW else found, buckets)
    rank = F.struct("odds", "k", "size")
    at_edge = F.coalesce(rank == F.col("last"), F.lit(False))
    extra = F.coalesce((F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (rank <= F.col("last"))), F.lit(False))

    def done(some: DataFrame, more: Column) -> DataFrame:
        copies = F.least(F.col("base") + more.cast("long"), F.lit(most)).cast("long")
        return some.select("row", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))

    if not counts["split"]:
        return done(rows, extra)
    tied = cut(rows.where(at_edge & (F.col("part") < F.col("times"))).withColumn("at", F.spark_partition_id()))
    ahead = tied.groupBy("source", "at").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(Window.partitionBy("source").orderBy("at")) - F.col("n"))
    tied = tied.withColumn("own", F.row_number().over(Window.partitionBy("source", "at").orderBy(F.xxhash64("row"))))
    tied = tied.alias("t").join(ahead.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source")) & (F.col("t.at") == F.col("a.at"))).select("t.*", "a.ahead")
    return done(rows.where(~(at_edge & F.coalesce(F.col("part") < F.col("times"), F.lit(False)))), extra).unionByName(done(tied, F.col("ahead") + F.col("own") <= F.col("part")))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656e0 AS u
  FROM documents),
classed AS (
  SELECT *, CAST(floor(size / pow(2e0, greatest(length(bin(size)) - 7, 0))) * pow(2e0, greatest(length(bin(size)) - 7, 0)) AS BIGINT) AS class FROM sized),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
         CAST(source_size AS DOUBLE) * 3 AS cap FROM totals),
levels AS (
  SELECT *, row_number() OVER o AS place,
         ((SELECT CAST(sum(source_size) AS DOUBLE) FROM totals) - coalesce(sum(cap) OVER (ORDER BY cap / w, source COLLATE C NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source COLLATE C NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / w, source COLLATE C NULLS LAST)),
goal AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, place) FROM levels WHERE level * w <= cap) * w) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS rest FROM goal),
classes AS (SELECT source, class, CAST(sum(size) AS HUGEINT) AS words FROM classed WHERE class > 0 GROUP BY source, class),
rated AS (
  SELECT c.source, c.class,
         greatest(p.rest - CAST(coalesce(sum(c.words) OVER (PARTITION BY c.source ORDER BY c.class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE), 0e0)
         / CAST(sum(c.words * c.class) OVER (PARTITION BY c.source ORDER BY c.class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM classes c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source),
rates AS (SELECT source, arg_max(rate, class) AS rate FROM rated WHERE rate * CAST(class AS DOUBLE) <= 1 GROUP BY source),
likely AS (
  SELECT d.doc_id, d.source, d.size, d.u, p.source_size, p.target, p.base, p.rest, r.rate * CAST(d.class AS DOUBLE) AS p
  FROM classed d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
odds AS (
  SELECT *, CASE WHEN size = 0 OR p IS NULL OR p <= 0 THEN NULL WHEN p >= 1 THEN 0e0 ELSE (u / (1 - u)) / (p / (1 - p)) END AS odds FROM likely),
upto AS (
  SELECT *, sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, coalesce(CAST(doc_id AS VARCHAR), ''), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM odds)
SELECT doc_id, size, source_size, target,
       CAST(size * least(base + CASE WHEN odds IS NOT NULL AND upto - size / 2e0 <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM upto
"""
