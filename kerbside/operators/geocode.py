"""A local geocoder over batches of queries, and reverse geocoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo, text
from kerbside.operators import names
from kerbside.operators.stops import spatial_clusters
from kerbside.runtime import cut

#: Degrees of the smallest cells that are told apart in a search for the nearest, how much wider each level's are, and cells of the top.
NEAR_CELL, WIDER, TOP_CELLS = 1e-3, 4, 16


def _first(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def resolve_streets(parsed: DataFrame, addresses: DataFrame) -> DataFrame:
    """qid, street_norm, score, match_type: the longest variant that is a street, or else up to three that look like one.

    parsed: qid, street. Only the distinct variants of queries without an exact
    street are looked up by similarity.
    """
    variants = parsed.select("qid", F.posexplode(text.suffix_variants(F.col("street"))).alias("place", "variant"))
    streets = addresses.select("street_norm").distinct()
    exact = variants.join(streets, F.col("variant") == F.col("street_norm"))
    exact = cut(exact.groupBy("qid").agg(F.min_by("street_norm", "place").alias("street_norm"))).select("qid", "street_norm", F.lit(1.0).alias("score"), F.lit("exact").alias("match_type"))
    open_ = cut(variants.join(exact, "qid", "left_anti").where(F.length("variant") >= names.SHORTEST))
    close = names.similar(open_.select(F.col("variant").alias("name")), streets.select(F.col("street_norm").alias("name"))).toDF("variant", "street_norm", "ratio", "rank")
    top = Window.partitionBy("variant").orderBy(F.desc("rank"), F.desc("street_norm"))
    close = open_.join(close.withColumn("n", F.row_number().over(top)).where("n <= 3"), "variant")
    best = close.groupBy("qid", "street_norm").agg(F.max("ratio").alias("score"), F.min(F.struct("place", "n")).alias("seen"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "seen"))).where("n <= 3")
    return exact.unionByName(best.select("qid", "street_norm", "score", F.lit("fuzzy").alias("match_type")))


def indexed(addresses: DataFrame) -> DataFrame:
    """Addresses with their normalised street."""
    return addresses.withColumn("street_norm", text.normalise_street(F.col("street")))


def _described(groups: DataFrame, by: list[str], addresses: DataFrame) -> DataFrame:
    """One candidate per cluster: position, first door (the last in order), doors, and what tells it from its namesakes.

    groups: places with the number of their ``doors`` and the last ``ord`` of them.
    """
    mean = [(F.sum(F.col(c) * F.col("doors")) / F.sum("doors")).alias(c) for c in ("lat", "lon")]
    c = groups.groupBy(*by, "cluster").agg(*mean, F.max_by(F.struct("street", "number", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")), "ord").alias("f"), F.sum("doors").cast("int").alias("door_count"), F.array_sort(F.collect_set(F.nullif("postcode", F.lit("")))).alias("codes"))
    c = c.withColumn("clusters", F.count("*").over(Window.partitionBy(*by)))
    c = cut(c)
    unclear = c.where((F.col("clusters") > 1) & (F.size("codes") != 1)).select(F.col("f.street").alias("street"), F.col("f.f_lat").alias("lat"), F.col("f.f_lon").alias("lon")).distinct()
    other = nearest_other_street(unclear, addresses.withColumn("ord", F.col("first"))).toDF("o_street", "o_lat", "o_lon", "other")
    c = c.join(other, (F.col("f.street") == F.col("o_street")) & (F.col("f.f_lat") == F.col("o_lat")) & (F.col("f.f_lon") == F.col("o_lon")), "left")
    place = F.format_string("%.4f, %.4f", F.col("f.f_lat"), F.col("f.f_lon"))
    hint = F.when(F.size("codes") == 1, F.col("codes")[0]).when(F.col("other").isNotNull(), F.concat(F.lit("near "), "other")).otherwise(place)
    return c.withColumn("hint", F.when(F.col("clusters") > 1, F.concat(F.lit(" - "), hint)).otherwise("")).drop("o_street", "o_lat", "o_lon")


def search(queries: DataFrame, addresses: DataFrame, limit: int = 8) -> DataFrame:
    """queries: qid, q. Returns up to ``limit`` candidates a query with their rank; an empty or blank query has none.

    Columns: qid, rank, label, lat, lon, street, number, door_count, match_type, score.
    """
    if not 1 <= limit <= 25:
        raise ValueError("limit must be from 1 to 25")
    # doors at one place and questions of one text are one; what they are normalised to is found once for each
    place = addresses.groupBy("street", "number", "lat", "lon", "postcode").agg(F.count("*").alias("doors"), F.min("ord").alias("first"), F.max("ord").alias("ord"))
    # plans that are used more than once are cut, or they would multiply
    own = cut(indexed(place).withColumn("num", text.normalise_number(F.col("number"))))
    texts = queries.where(F.trim("q") != "").select("q").distinct()
    texts = cut(texts.select("q", text.parse_query(F.col("q")).alias("p")).select("q", "p.number", "p.street"))
    asked_once = cut(texts.select("number", "street").distinct().withColumn("ask", F.monotonically_increasing_id()))
    found = cut(resolve_streets(asked_once.select(F.col("ask").alias("qid"), "street"), own).join(asked_once.select(F.col("ask").alias("qid"), "number"), "qid"))
    door = ["ord", "lat", "lon", "street", "number", "postcode", "doors"]

    # by number: the first key of the query's number that the street has
    keyed = own.select("street_norm", F.explode(text.number_keys(F.col("number"))).alias("part"), *door)
    asked = found.where(F.col("number").isNotNull()).select("qid", "street_norm", "score", "match_type", "number", F.posexplode(text.number_keys(F.col("number"))).alias("place", "part"))
    held = keyed.select("street_norm", "part").distinct()
    hits = asked.join(held, ["street_norm", "part"]).groupBy("qid", "street_norm", "score", "match_type").agg(F.min_by("part", "place").alias("part"))
    hits = cut(hits.select("qid", "street_norm", "score", "match_type", F.lit(0).alias("near"), F.lit("key").alias("kind"), "part"))

    # else the nearest numbers of the street
    rest = found.where(F.col("number").isNotNull()).join(hits, ["qid", "street_norm"], "left_anti").withColumn("goal", text.leading_int(F.trim("number")))
    groups = own.groupBy("street_norm", F.col("num").alias("part")).agg(F.min_by(text.leading_int(F.col("number")), "first").alias("value"), F.min("first").alias("first"))
    near = rest.select("street_norm", "goal").distinct().join(groups.where("value is not null"), "street_norm").withColumn("away", F.abs(F.col("value") - F.col("goal")))
    order = Window.partitionBy("street_norm", "goal").orderBy("away", "first")
    near = near.withColumn("near", F.row_number().over(order)).where(F.col("near") <= max(1, min(limit, 3))).select("street_norm", F.col("goal").alias("at"), "near", "part")
    # a goal that is no number is as far from all of them
    near = rest.join(near.withColumnRenamed("street_norm", "of"), (F.col("street_norm") == F.col("of")) & F.col("goal").eqNullSafe(F.col("at")))
    near = cut(near.select("qid", "street_norm", (F.col("score") * 0.7).alias("score"), F.lit("approximate").alias("match_type"), "near", F.lit("number").alias("kind"), "part"))

    # no number: the street itself
    whole = found.where(F.col("number").isNull()).select("qid", "street_norm", "score", F.lit("street").alias("match_type"), F.lit(0).alias("near"), F.lit("street").alias("kind"), F.lit("").alias("part"))

    # the doors of what is asked for are put together once, however many ask for it
    by = ["kind", "street_norm", "part"]
    wanted = [df.select("street_norm", "part").distinct() for df in (hits, near, whole)]
    doors = [keyed, own.withColumn("part", F.col("num")), own.withColumn("part", F.lit(""))]
    members = [d.join(w, ["street_norm", "part"]).select(F.lit(kind).alias("kind"), "street_norm", "part", *door) for kind, d, w in zip(("key", "number", "street"), doors, wanted, strict=True)]
    members = cut(members[0].unionByName(members[1]).unionByName(members[2]))
    places = _described(spatial_clusters(members, by, ["ord"], weight="doors"), by, own)
    # of one group only the first clusters can be among the candidates
    places = cut(places.where(F.col("cluster") < limit))

    answers = hits.unionByName(near).unionByName(whole).join(places, by)
    is_street = F.col("kind") == "street"
    count = F.concat(F.lit(" ("), F.col("door_count").cast("string"), F.lit(" doors)"))
    several = F.when(F.col("door_count") > 1, count).otherwise("")
    label = F.when(is_street, F.concat("f.street", count, "hint")).otherwise(F.concat("f.number", F.lit(" "), "f.street", several, "hint"))
    own_score = F.when(is_street, F.col("score") * 0.9 - 0.01 * F.col("cluster")).otherwise(F.col("score") - 0.01 * F.col("cluster"))
    answers = answers.select("qid", "street_norm", "score", "near", "cluster", "match_type", label.alias("label"), "lat", "lon", "f.street", F.when(~is_street, F.col("f.number")).alias("number"), "door_count", own_score.alias("own"))

    order = Window.partitionBy("qid").orderBy(F.desc("own"), F.desc("score"), "street_norm", "near", "cluster")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumnRenamed("qid", "ask").drop("street_norm")
    ranked = ranked.join(asked_once.select("ask", F.col("number").alias("a_number"), F.col("street").alias("a_street")), "ask")
    every = queries.select("qid", "q").join(texts.select("q", F.col("number").alias("q_number"), F.col("street").alias("q_street")), "q").drop("q")
    ranked = every.join(ranked, F.col("q_number").eqNullSafe(F.col("a_number")) & F.col("q_street").eqNullSafe(F.col("a_street")))
    return ranked.select("qid", "rank", "label", "lat", "lon", "street", "number", "door_count", "match_type", F.bround("own", 3).alias("score"))


def _half_chord(dlat: Column, dlon: Column, lat: Column, other_lat: Column) -> Column:
    """The square of half the chord between two places; grows with their distance."""
    return F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(other_lat)) * F.pow(F.sin(F.radians(dlon) / 2), 2)


def _bounds() -> tuple[Column, Column]:
    """How near and how far a place inside the box s, n, w, e can be to the point, as of _half_chord."""
    lat, lon, s, n, w, e = (F.col(c) for c in ("p_lat", "p_lon", "s", "n", "w", "e"))
    zero = F.lit(0.0)
    widest = F.when((s <= 0) & (n >= 0), zero).otherwise(F.least(F.abs(s), F.abs(n)))
    near = _half_chord(F.greatest(zero, s - lat, lat - n), F.greatest(zero, w - lon, lon - e), lat, F.greatest(F.abs(s), F.abs(n)))
    far = _half_chord(F.greatest(F.abs(s - lat), F.abs(n - lat)), F.least(F.greatest(F.abs(w - lon), F.abs(e - lon)), F.lit(180.0)), lat, widest)
    return near, far


def _pyramid(addresses: DataFrame, apart: str | None) -> list[DataFrame]:
    """Occupied cells by level, each ``WIDER`` times as wide as those below: cy, cx, the box of the addresses inside, their first and last value of ``apart``."""
    values = [F.lit(None).cast("string").alias(c) for c in ("low", "high")] if apart is None else [f(apart).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    cells = addresses.groupBy(geo.cell(F.col("lat"), NEAR_CELL).alias("cy"), geo.cell(F.col("lon"), NEAR_CELL).alias("cx")).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), *(values if apart else []))
    levels = [cut(cells if apart else cells.select("*", *values))]
    while levels[-1].count() > TOP_CELLS:
        up = [F.floor(F.col(c) / WIDER).alias(c) for c in ("cy", "cx")]
        levels.append(cut(levels[-1].groupBy(*up).agg(*[f(c).alias(c) for c, f in (("s", F.min), ("n", F.max), ("w", F.min), ("e", F.max), ("low", F.min), ("high", F.max))])))
    return levels


def _cells_in_reach(points: DataFrame, key: list[str], addresses: DataFrame, apart: str | None = None) -> DataFrame | None:
    """The smallest cells (cy, cx) in which each point's nearest address can lie: down a pyramid of occupied cells.

    On every level a point goes on to the cells that may hold its nearest address:
    those no farther than the farthest place of the best one. None without addresses.
    """
    levels = _pyramid(addresses, apart)
    columns = list(dict.fromkeys([*key, "p_lat", "p_lon", *([f"p_{apart}"] if apart else [])]))
    near, far = _bounds()

    def pruned(df: DataFrame) -> DataFrame:
        if apart:
            df = df.where(~(F.col("low").eqNullSafe(F.col(f"p_{apart}")) & F.col("high").eqNullSafe(F.col(f"p_{apart}"))))
        best = F.min(far).over(Window.partitionBy(*key))
        return df.withColumn("best", best).where(near <= F.col("best") * (1 + 1e-9) + 1e-18).select(*columns, "cy", "cx")

    # the cells of the top are few, and stand in the plan
    top = [F.struct(*[F.lit(r[c]).alias(c) for c in levels[-1].columns]) for r in levels[-1].collect()]
    if not top:
        return None
    frontier = pruned(points.select(*columns, F.explode(F.array(*top)).alias("c")).select(*columns, "c.*"))
    for level in levels[-2::-1]:
        below = level.withColumnsRenamed({"cy": "y", "cx": "x"}).withColumns({"cy": F.floor(F.col("y") / WIDER), "cx": F.floor(F.col("x") / WIDER)})
        found = frontier.join(below, ["cy", "cx"]).drop("cy", "cx").withColumnsRenamed({"y": "cy", "x": "cx"})
        frontier = pruned(found)
    return frontier


def _nearest(points: DataFrame, key: list[str], addresses: DataFrame, out: list[str], apart: str | None = None) -> DataFrame:
    """For each point (p_lat, p_lon) its nearest address, of another ``apart`` than p_apart if that is given. Only the places of the cells in reach meet it, wherever it lies.

    Addresses at one place (and of one ``apart``) are one, the first in order; so are points.
    """
    at = ["p_lat", "p_lon", *([f"p_{apart}"] if apart else [])]
    first = F.min(F.struct("ord", *[c for c in out if c not in ("ord", "lat", "lon", apart)])).alias("first")
    places = addresses.groupBy("lat", "lon", *([apart] if apart else [])).agg(first)
    places = cut(places.select("lat", "lon", *([apart] if apart else []), "first.*"))
    asked = points.select(*at).distinct()
    frontier = _cells_in_reach(asked, at, places, apart)
    if frontier is None:
        return points.limit(0).select(*key, F.lit(0.0).alias("distance_m"), *[F.lit(None).cast(addresses.schema[c].dataType).alias(c) for c in out])
    held = places.withColumns({"cy": geo.cell(F.col("lat"), NEAR_CELL), "cx": geo.cell(F.col("lon"), NEAR_CELL)})
    pairs = frontier.join(held, ["cy", "cx"])
    if apart:
        pairs = pairs.where(F.col(apart) != F.col(f"p_{apart}"))
    distance = geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    best = pairs.withColumn("distance_m", distance).groupBy(*at).agg(F.min(F.struct("distance_m", "ord", *[c for c in out if c != "ord"])).alias("b"))
    return points.select(*dict.fromkeys([*key, *at])).join(best, at).select(*key, "b.distance_m", *[F.col(f"b.{c}") for c in out])


def reverse(points: DataFrame, addresses: DataFrame) -> DataFrame:
    """points: pid, lat, lon. The nearest door of each: pid, label, lat, lon, distance_m; the first in order among equals."""
    own = points.select("pid", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    found = _nearest(own, ["pid"], addresses.select("ord", "lat", "lon", "unit", "number", "street"), ["ord", "lat", "lon", "unit", "number", "street"])
    return found.select("pid", text.address_label(F.col("unit"), F.col("number"), F.col("street")).alias("label"), "lat", "lon", "distance_m")


def nearest_other_street(points: DataFrame, addresses: DataFrame) -> DataFrame:
    """points: street, lat, lon. The street of the nearest address that is on another one."""
    own = points.select(F.col("street").alias("p_street"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    key = ["p_street", "p_lat", "p_lon"]
    found = _nearest(own, key, addresses.select("ord", "lat", "lon", "street"), ["ord", "lat", "lon", "street"], "street")
    return found.select(*[F.col(k).alias(k[2:]) for k in key], F.col("street").alias("other"))
