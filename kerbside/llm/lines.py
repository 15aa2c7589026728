"""Fuzzy line dedup by MinHash: one line of each group of similar lines stays in the corpus.

DataFrame functions only. Two lines are similar if their sets of five-character
shingles have a Jaccard similarity of 0.8 or more. Lines stand between line feeds; a
line without a character other than blanks and tabs is blank and never touched.

1. Signatures. A line is signed by the ``LEAST`` smallest of its window hashes: of more
   than 100 characters, runs of three words where these have up to 10 characters on
   average and windows of 16 characters where they have 7.5 or more (from 25 words on
   windows that start with a word, up to 45 words all windows); windows of 10
   characters in a line of 20 to 125, windows of 5 in one of up to 30. Similar lines
   have a kind in common, as the kinds overlap: by a quarter in length, by a third in
   characters a word.
2. High-recall banding. Each hash of a signature is a key; lines that meet at one
   are candidates if their signatures share ``SHARED``. A key of more than ``CROWD``
   lines forms no pairs by itself: its lines meet at pairs of such keys instead.
   Where even a pair of keys has more lines than that, and where a line has fewer
   windows than a signature, lines are signed by one-permutation MinHash over the
   five-character shingles that define similarity: the smallest hash of each of
   ``BINS`` ranges. Keys are made of them in ``LEVELS``: so many keys of so many minima.
   Lines that meet at one are candidates if half of all minima agree. In such a key
   of more than ``CROWD`` lines every line is a candidate with the first one, so that
   a group of copies is connected by as many pairs as it has lines, and all
   its lines go on to the next level, whose keys of more minima tell lines apart
   that only share a passage. No key is dropped, and none forms all pairs of a crowd.
3. Candidates are verified by exact Jaccard similarity on the whole lines. The texts of
   candidates are fetched once, with the number of their shingles and the ``SKETCH``
   smallest shingle hashes. Pairs of which these show less than ``LIKELY`` of the
   similarity asked for are left out (a pair of similarity 0.8 is with a probability of
   1 in 100,000). Of the others one line's contexts (a word and what follows
   it) that the other has not are taken to shingles, and these looked up: with both
   numbers of shingles the shared ones of one side give the similarity.
4. Pools are cut into tiles of bounded size; a row holds two tiles and puts out the
   links between lines of different components, by exact Jaccard similarity of their
   sets of shingle hashes. What one component holds already is not compared again.
5. Distributed union-find over the links; of all lines of a component, equal
   lines included, the first by (key, hash of the text, position) stays.

Equal lines are told by their 64-bit hash, and so are shingles. Null texts stay
null and empty ones empty. Rows that repeat (key and text) are told apart: one of
them is the document, and the others lose all their lines but the blank ones. An
empty table gives an empty result. Other columns come back in a struct ``row``, so
their names cannot clash with those that are added.
"""

from __future__ import annotations

import gc
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.llm.components import components
from kerbside.runtime import cut

SIMILARITY, NARROW, CROWD = 0.8, 5, 32
#: Window hashes kept of a line, and how many of them candidates share.
LEAST, SHARED = 8, 2
#: Windows of characters by the lengths of the lines that they are for; longer lines are signed by runs of words.
WINDOWS = {5: (5, 30), 10: (20, 125)}
LONG = 100
#: Long lines of up to so many characters a word on average are signed by word runs, those of at least so many by windows of so many characters.
RUN_WORDS, WINDOW_WORDS, WINDOW = 10, 7.5, 16
#: Of those, lines of up to so many words take the windows at all characters, lines of at least so many those at the starts of words, a kind of its own.
FEW_WORDS, MANY_WORDS, STARTS = 45, 25, 17
#: Minima of the fine shingles, in how many of them candidates agree, and the keys by level: number, and minima of each.
BINS, AGREE = 16, 8
LEVELS = ((16, 4), (24, 8))
#: Lines of a tile, and shingle hashes of one, about.
TILE, TILE_SHINGLES = 64, 40_000
#: A character other than blanks and tabs.
VISIBLE = r"[^\x20\x09-\x0D]"
#: Smallest shingle hashes of a candidate, and the share of the asked similarity that they must show.
SKETCH, LIKELY = 32, 0.625
_SHINGLE = rf"(?s)(?=(.{{{NARROW}}}))"
#: A word, the blanks after it, and the characters that a shingle from there can reach.
_CONTEXT = rf"(?s)(?=([^ ]*+ *+.{{0,{NARROW - 1}}}+))(?:[^ ]++ *+| ++)"


def _sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints that nothing refers to any more."""
    # its listeners hold the last query, and so its files, until another one has ended
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _released(df: DataFrame) -> DataFrame:
    """Cut the lineage, and drop the files of what came before."""
    df = cut(df)
    _sweep(df.sparkSession)
    return df


def _each_line(docs: DataFrame, *more: Column) -> DataFrame:
    """One row per line that is not blank, with its position."""
    return docs.select(*more, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(VISIBLE))


def _own_lines(docs: DataFrame) -> DataFrame:
    """id and line, copies included, without those too short for a shingle: they are similar to none."""
    return docs.select(F.explode(F.split("text", "\n")).alias("line")).where((F.length("line") >= NARROW) & F.col("line").rlike(VISIBLE)).select(F.xxhash64("line").alias("id"), "line")


def signatures(docs: DataFrame) -> DataFrame:
    """id, kind and sig, the smallest window hashes in order, of each distinct line; one row a kind of windows."""
    line, words, size = F.col("line"), F.col("words"), F.length("line")

    def windows(n: int, after: str = "") -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(rf"(?s){after}(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.xxhash64(g))

    runs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    wide = (size > LONG) & (size >= WINDOW_WORDS * F.size(words))
    kinds = {3: F.when((size > LONG) & (size <= RUN_WORDS * F.size(words)), runs), WINDOW: F.when(wide & (F.size(words) <= FEW_WORDS), windows(WINDOW)), STARTS: F.when(wide & (F.size(words) >= MANY_WORDS), windows(WINDOW, "(?<![^ ])"))}
    kinds |= {n: F.when(size.between(lo, hi), windows(n)) for n, (lo, hi) in WINDOWS.items()}
    rows = _own_lines(docs).select("id", "line", F.split("line", " ").alias("words"))
    rows = rows.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), h.alias("h")) for n, h in kinds.items()])).alias("of")).where("of.h is not null")
    rows = rows.select("id", "of.kind", F.slice(F.array_distinct(F.slice(F.sort_array("of.h"), 1, 4 * LEAST)), 1, LEAST).alias("h")).select("id", "kind", *[F.get("h", F.lit(k)).alias(f"s{k}") for k in range(LEAST)])
    # copies of a line have equal hashes
    rows = rows.groupBy("id", "kind").agg(*[F.min(f"s{k}").alias(f"s{k}") for k in range(LEAST)])
    return rows.select("id", "kind", F.array_compact(F.array(*[f"s{k}" for k in range(LEAST)])).alias("sig"))


def fine_signatures(lines: DataFrame) -> DataFrame:
    """lines: id, line. id and sig, the smallest shingle hash in each of BINS ranges, 0 where there is none."""
    rows = lines.select("id", F.explode(F.regexp_extract_all("line", F.lit(_SHINGLE), F.lit(1))).alias("g")).select("id", F.xxhash64("g").alias("h"))
    mins = rows.groupBy("id").agg(*[F.min(F.when(F.pmod("h", F.lit(BINS)) == k, F.col("h"))).alias(f"s{k}") for k in range(BINS)])
    return mins.select("id", F.array(*[F.coalesce(f"s{k}", F.lit(0).cast("long")) for k in range(BINS)]).alias("sig"))


def fine_keys(sig: Column, level: int) -> Column:
    rng = random.Random(level)
    number, rows = LEVELS[level]
    return F.array(*[F.xxhash64(F.lit(b), *[F.get(sig, F.lit(k)) for k in rng.sample(range(BINS), rows)]) for b in range(number)])


def _agree(x: str, y: str) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def _shared(keys: DataFrame) -> DataFrame:
    """keys: k and what has it. Those rows whose key more than one has, with their number m. Counts are partial before the shuffle, and Spark can split the join."""
    counts = keys.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
    return keys.join(counts.hint("shuffle_hash"), "k")


def _pairs(few: DataFrame, sigs: DataFrame, alike) -> DataFrame:
    """Pairs a < b that meet at a key of ``few`` and are alike by their signatures, which meet as 32-bit hashes."""
    by = [c for c in sigs.columns if c != "sig"]
    rows = few.select("k", *by).join(sigs.select(*by, F.transform("sig", lambda h: F.hash(h)).alias("sig")), by)
    x, y = rows.alias("x"), rows.alias("y")
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")) & alike("x.sig", "y.sig")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def candidates(docs: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of line ids that meet at window hashes; and the ids of lines that are to meet at fine keys."""
    sigs = _released(signatures(docs))
    # equal windows of two kinds are two keys
    shared = _released(_shared(sigs.select("id", "kind", F.explode("sig").alias("k")).withColumn("k", F.col("k").bitwiseXOR(F.col("kind")))))

    def alike(x: str, y: str) -> Column:
        return F.size(F.array_intersect(x, y)) >= SHARED

    # crowded keys two by two
    hot = shared.where(F.col("m") > crowd).groupBy("id", "kind").agg(F.array_sort(F.collect_set("k")).alias("ks")).where(F.size("ks") > 1)
    twos = F.flatten(F.transform("ks", lambda p, i: F.transform(F.slice("ks", i + 2, F.lit(LEAST)), lambda q: F.xxhash64(p, q))))
    both = cut(_shared(hot.select("id", "kind", F.explode(twos).alias("k"))))
    few = shared.where(F.col("m") <= crowd).select("k", "id", "kind").unionByName(both.where(F.col("m") <= crowd).select("k", "id", "kind"))
    met = _released(_pairs(few, sigs, alike).distinct())
    packed = both.where(F.col("m") > crowd).select("id").unionByName(sigs.where(F.size("sig") < LEAST).select("id")).distinct()
    return met, cut(packed)


def _fine_candidates(pool: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of lines (id, line) by their fine shingles, level by level; a level takes the lines of the last one's crowds. And the last crowds."""
    sigs = cut(fine_signatures(pool))
    found, level_of = [], sigs
    for level in range(len(LEVELS)):
        shared = cut(_shared(level_of.select("id", F.explode(fine_keys(F.col("sig"), level)).alias("k"))))
        found.append(_pairs(shared.where(F.col("m") <= crowd), sigs, lambda x, y: _agree(x, y) >= AGREE))
        packed = shared.where(F.col("m") > crowd)
        first = packed.groupBy("k").agg(F.min("id").alias("c"))
        crowds = cut(packed.join(first, "k").where(F.col("id") != F.col("c")).select("id", "c").distinct())
        star = crowds.join(sigs, "id").join(sigs.toDF("c", "c_sig"), "c").where(_agree("sig", "c_sig") >= AGREE)
        found.append(star.select(F.col("c").alias("a"), F.col("id").alias("b")))
        level_of = sigs.join(packed.select("id").distinct(), "id", "left_semi")
    pairs = reduce(DataFrame.unionByName, found)
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), crowds


def _contexts(line: str) -> Column:
    return F.regexp_extract_all(line, F.lit(_CONTEXT), F.lit(1))


def _absent(contexts: Column, line: Column) -> Column:
    """How many shingles of these contexts the line has not."""
    lost = F.filter(contexts, lambda c: ~F.contains(line, c))
    found = F.regexp_extract_all(F.array_join(lost, "\n"), F.lit(rf"(?=([^\n]{{{NARROW}}}))"), F.lit(1))
    return F.size(F.array_distinct(F.transform(F.filter(found, lambda g: ~F.contains(line, g)), lambda g: F.xxhash64(g))))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def described(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, line, n (distinct shingles) and least (the first halves of the SKETCH smallest shingle hashes) of the lines of these ids, each once."""
    texts = _own_lines(docs).join(ids.distinct().hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])
    rows = texts.select("id", "line", F.array_distinct(_shingle_hashes("line")).alias("sh"))
    return rows.select("id", "line", F.size("sh").alias("n"), F.transform(F.slice(F.sort_array("sh"), 1, SKETCH), lambda h: F.shiftright(h, 32).cast("int")).alias("least"))


def _shingle_hashes(line: str) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(_SHINGLE), F.lit(1)), lambda g: F.xxhash64(g))


def _sketched(x: str, y: str) -> Column:
    """The similarity that the smallest hashes of both show: how many of the smallest of their union both have."""
    smallest = F.array(F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH))
    return F.get(F.transform(smallest, lambda u: F.size(F.array_intersect(u, F.array_intersect(x, y))) / F.size(u)), F.lit(0))


def verified(lines: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """lines: as ``described``; pairs: a, b. Those of at least this similarity, exactly.

    A shingle of one line that the other has not lies in a context (a word and
    what follows it) that the other has not. So with n the distinct shingles of
    each line, counted once a line, all that is left is to look up the shingles
    of such contexts of one of them.
    """
    fit = pairs.join(lines.select(F.col("id").alias("a"), F.col("n").alias("p"), F.col("least").alias("s")), "a")
    fit = fit.join(lines.select(F.col("id").alias("b"), F.col("n").alias("q"), F.col("least").alias("t"), F.col("line").alias("y")), "b")
    near = (F.least("p", "q") >= similarity * F.greatest("p", "q") - 1e-9) & (_sketched("s", "t") >= LIKELY * similarity)
    both = fit.where(near).select("a", "b", "p", "q", "y").join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    shared = F.col("p") - _absent(_contexts("x"), F.col("y"))
    return both.where(shared * (1 + similarity) >= similarity * (F.col("p") + F.col("q")) - 1e-9).select("a", "b")


def _tiled(pools: DataFrame, similarity: float) -> DataFrame:
    """pools: id, pool, root, rest, sh (distinct shingle hashes). Links between lines of different roots of a pool of which one is of the rest.

    Tiles hold about ``TILE`` lines or ``TILE_SHINGLES`` hashes, one line at least.
    """
    size = pools.groupBy("pool").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.size("sh")) / TILE_SHINGLES)).cast("int").alias("tiles"))
    dealt = pools.join(size, "pool").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = _released(dealt.groupBy("pool", "tiles", "rest", "tile").agg(F.collect_list(F.struct("id", "root", "sh")).alias("of")))
    # every tile of the rest meets every tile of the pool; two of the rest once
    left = tiles.where("rest").select("pool", F.col("tile").alias("own"), F.col("of").alias("x"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    both = left.join(tiles.select("pool", "tile", "rest", F.col("of").alias("y")), ["pool", "tile"]).where(~F.col("rest") | (F.col("own") <= F.col("tile")))

    def near(p, q):
        least, most = F.least(F.size(p["sh"]), F.size(q["sh"])), F.greatest(F.size(p["sh"]), F.size(q["sh"]))
        shared = F.size(F.array_intersect(p["sh"], q["sh"]))
        return (p["root"] != q["root"]) & (least >= similarity * most - 1e-9) & (shared * (1 + similarity) >= similarity * (least + most) - 1e-9)

    found = F.flatten(F.transform("x", lambda p: F.transform(F.filter("y", lambda q: near(p, q)), lambda q: F.struct(F.least(p["id"], q["id"]).alias("a"), F.greatest(p["id"], q["id"]).alias("b")))))
    return both.select(F.inline(found)).distinct()


def crowd_links(lines: DataFrame, found: DataFrame, crowds: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """lines: id, line. The links that ``found`` lacks to join similar lines of the last crowds (pairs id, c): exact, whatever their number."""
    pools = components(crowds).toDF("id", "pool")
    member = pools.join(components(found).toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    size = member.groupBy("pool", "root").agg(F.count("*").alias("n"))
    largest = size.groupBy("pool").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    member = cut(member.join(largest, "pool").select("id", "pool", "root", (F.col("root") != F.col("most")).alias("rest")))
    return cut(_tiled(member.join(lines, "id").withColumn("sh", F.array_distinct(_shingle_hashes("line"))).drop("line"), similarity))


def links(docs: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """docs: text. Pairs a, b of line ids that are similar; enough of them to connect all that are found similar."""
    met, packed = candidates(docs, crowd)
    # only now nothing refers to the signatures and keys
    _sweep(docs.sparkSession)
    lines = _released(described(docs, _ends(met).unionByName(packed)))
    fine, crowds = _fine_candidates(lines.join(packed, "id", "left_semi").select("id", "line"), crowd)
    found = _released(verified(lines, met.unionByName(fine).distinct(), similarity))
    if crowds.isEmpty():
        return found
    return _released(found.unionByName(crowd_links(lines.select("id", "line"), found, crowds, similarity)))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``row`` (all columns of ``docs`` but the text), n_lines (not blank), n_removed, kept_text."""
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    roots = components(links(own.select("text"), similarity))
    at = cut(_each_line(own, F.col("key"), F.xxhash64("text").alias("dk")).select("key", "dk", "pos", F.xxhash64("line").alias("id")))
    again = at.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    of = again.join(roots, again["id"] == roots["node"], "full").select(F.coalesce("id", "node").alias("of"), F.coalesce("component", "id").alias("root"))
    group = cut(at.join(of, at["id"] == of["of"]).select("root", "key", "dk", "pos"))
    first = group.groupBy("root").agg(F.min(F.struct("key", "dk", "pos")).alias("first"))
    group = group.join(first, "root").select("key", "dk", "pos", F.struct("key", "dk", "pos").eqNullSafe(F.col("first")).alias("stays"))
    marks = group.groupBy("key", "dk").agg(F.collect_set(F.when(~F.col("stays"), F.col("pos"))).alias("gone"), F.collect_set("pos").alias("all"), F.count("*").alias("n"))
    # a document whose lines come more than once at one place is a repeated row
    marks = _released(marks.select("key", "dk", "gone", "all", (F.col("n") > F.size("all")).alias("repeated")).where((F.size("gone") > 0) | F.col("repeated")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("dk", F.xxhash64("text")).alias("d").join(marks.alias("g"), F.col("d.key").eqNullSafe(F.col("g.key")) & (F.col("d.dk") == F.col("g.dk")), "left").select("row", "text", "d.key", "d.dk", "gone", "all", "repeated")

    def done(some: DataFrame, gone: Column) -> DataFrame:
        parts = F.split("text", "\n")
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        # bound to a lambda variable, so that a text is split once and not for each of its lines
        joined = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), "\n")), F.lit(0))
        kept = F.when(F.coalesce(F.size(gone), F.lit(0)) <= 0, F.col("text")).otherwise(joined)
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: x.rlike(VISIBLE))))
        return some.select("row", n.cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))

    if marks.where("repeated").isEmpty():
        return done(rows, F.col("gone"))
    # repeated rows are numbered by (document, partition), in two steps, so that no document is one task's
    many = cut(rows.where("repeated").withColumn("part", F.spark_partition_id()))
    lowest = many.groupBy("key", "dk").agg(F.min("part").alias("low"))
    many = many.withColumn("place", F.row_number().over(Window.partitionBy("key", "dk", "part").orderBy(F.xxhash64("row")))).alias("d")
    many = many.join(lowest.alias("l"), F.col("d.key").eqNullSafe(F.col("l.key")) & (F.col("d.dk") == F.col("l.dk"))).select("d.*", "l.low")
    one = (F.col("part") == F.col("low")) & (F.col("place") == 1)
    return done(rows.where(~F.coalesce("repeated", F.lit(False))), F.col("gone")).unionByName(done(many, F.when(one, F.col("gone")).otherwise(F.col("all"))))


#: By exact similarity of all lines (rarest shingles first, so that lines of Jaccard 0.8 meet at one), for tables whose ids are unique.
ORACLE = r"""
WITH RECURSIVE
spot AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
own AS (SELECT * FROM spot WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM own)),
sh AS MATERIALIZED (
  SELECT DISTINCT id, substr(line, i, 5) AS g
  FROM (SELECT id, line, unnest(range(1, length(line) - 3)) AS i FROM d WHERE length(line) >= 5)),
freq AS (SELECT g, count(*) AS f FROM sh GROUP BY g),
ranked AS (
  SELECT id, g, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY f, g) AS r
  FROM sh JOIN freq USING (g)),
rare AS MATERIALIZED (SELECT id, g, n FROM ranked WHERE 5 * (r - 1) <= n),
cand AS MATERIALIZED (
  SELECT DISTINCT x.id AS a, y.id AS b, x.n AS p, y.n AS q
  FROM rare x JOIN rare y ON x.g = y.g AND x.id < y.id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
link AS MATERIALIZED (
  SELECT a, b FROM cand JOIN sh x ON x.id = a JOIN sh y ON y.id = b AND y.g = x.g
  GROUP BY a, b, p, q HAVING 5 * count(*) >= 4 * (p + q - count(*))),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT DISTINCT a AS id, a AS other FROM way
  UNION SELECT r.id, w.b FROM reach r JOIN way w ON w.a = r.other),
root AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
placed AS (
  SELECT o.doc_id, o.pos, coalesce(root.root, d.id) AS root
  FROM own o JOIN d USING (line) LEFT JOIN root ON root.id = d.id),
gone AS (
  SELECT doc_id, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY root ORDER BY doc_id, pos) AS r FROM placed) WHERE r > 1),
kept AS (
  SELECT spot.doc_id, count(*) FILTER (WHERE regexp_matches(spot.line, '[^\x20\x09-\x0D]')) AS n_lines,
    count(g.pos) AS n_removed,
    coalesce(string_agg(spot.line, chr(10) ORDER BY spot.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM spot LEFT JOIN gone g ON g.doc_id = spot.doc_id AND g.pos = spot.pos GROUP BY spot.doc_id)
SELECT t.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256, length(k.text) AS kept_chars
FROM documents t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
