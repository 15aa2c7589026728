"""The whole district cut into connected zones of about so many doors.

The bisection goes level by level while groups are large: one job splits all groups
of a level along each group's longer axis. The cut is found by selection: histograms
of doors tell in which bin it lies, and only the faces of that bin are put in order.
Groups that one task can put in order get the rest of their cuts in one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo, text
from kerbside.operators import kernels
from kerbside.runtime import cut

DEFAULT_TARGET, LEAST_TARGET, MOST_TARGET = 100, 20, 2000
NEAR_M = 250.0
PALETTE, BOX_PAD = 8, 0.0015
#: Faces around a cut, or of a group, that are ordered in one task, and bins of a histogram.
MOST_ORDERED, BINS = 20_000, 256
#: Zones that are coloured in one task; more are coloured in rounds.
MOST_COLOURED = 4096


def _narrowed(rows: DataFrame, leaves: DataFrame, most: int, bins: int) -> DataFrame:
    """Where the cut of each leaf lies: leaf, share, base, lo1, hi1, lo2, hi2, n.

    rows: leaf, k1, k2, door_count; leaves: leaf, share, size, lo1, hi1. Of a leaf
    of more than ``most`` faces a histogram of doors over k1 tells in which bin the
    cut lies; that bin is divided again, until it has few faces or one value, and
    then by k2. ``base`` are the doors before the range, which holds ``n`` faces.
    """
    state = cut(leaves.select("leaf", "share", F.lit(0).cast("long").alias("base"), F.col("size").alias("n"), "lo1", "hi1", F.lit(float("-inf")).alias("lo2"), F.lit(float("inf")).alias("hi2")))
    for key, lo, hi in (("k1", "lo1", "hi1"), ("k2", "lo2", "hi2")):
        inside = F.col("k1").between(F.col("lo1"), F.col("hi1")) & F.col("k2").between(F.col("lo2"), F.col("hi2"))
        if key == "k2" and not state.where(F.col("n") > most).isEmpty():
            # only ranges of one value of k1 are still as large
            ends = rows.join(F.broadcast(state.where(F.col("n") > most)), "leaf").where(inside).groupBy("leaf").agg(F.min("k2").alias("low"), F.max("k2").alias("high"))
            state = cut(state.join(ends, "leaf", "left").withColumns({"lo2": F.coalesce("low", "lo2"), "hi2": F.coalesce("high", "hi2")}).drop("low", "high"))
        while True:
            wide = (F.col("n") > most) & (F.col(lo) < F.col(hi))
            open_ = state.where(wide)
            if open_.isEmpty():
                break
            bin_ = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins))
            found = rows.join(F.broadcast(open_), "leaf").where(inside).groupBy("leaf", bin_.alias("bin")).agg(F.sum("door_count").alias("doors"), F.count("*").alias("m"), F.min(key).alias("low"), F.max(key).alias("high"))
            before = F.coalesce(F.sum("doors").over(Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            found = found.withColumn("before", before).join(open_.select("leaf", "share", "base"), "leaf").where((F.col("bin") == 0) | (F.col("base") + F.col("before") < F.col("share")))
            # the last bin before which the doors do not reach the share
            last = found.groupBy("leaf").agg(F.max_by(F.struct("before", "m", "low", "high"), "bin").alias("b"))
            moved = open_.join(last, "leaf").withColumns({"base": F.col("base") + F.col("b.before"), "n": F.col("b.m"), lo: F.col("b.low"), hi: F.col("b.high")}).drop("b")
            state = cut(state.where(~wide).unionByName(moved))
    return state


def split(faces: DataFrame, target: int, most: int = MOST_ORDERED, bins: int = BINS) -> DataFrame:
    """faces: blockface_id, street, from_number, side, lat, lon, door_count. Adds ``leaf``, a path of 0s and 1s in reading order, and k1, k2, house.

    Each group worth more than one target is cut in proportion, at the first
    face before which the doors reach its left share, never leaving a side empty.
    Faces are ordered by the axis of the cut, equal ones as on the level above:
    by k1, the last axis, k2, the other one if it has been cut too, then street,
    number, side and id. Groups of more than ``most`` faces are cut level by level,
    and only the faces around a cut are put in order; a group that is down to
    ``most`` faces gets all its further cuts at once.
    """
    if target < 1:
        raise ValueError("target must be at least 1")
    place = F.struct("street", "house", "from_number", "side", "blockface_id")
    rows = faces.withColumns({"leaf": F.lit(""), "house": text.natural_key(F.col("from_number"))["n"], "k1": F.lit(0.0), "k2": F.lit(0.0), "last": F.lit("")})
    columns = [*rows.columns]
    rows = cut(rows)
    while True:
        box = rows.groupBy("leaf").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.sum("door_count").alias("doors"), F.count("*").alias("size"))
        box = box.withColumn("parts", F.greatest(F.lit(1), F.bround(F.col("doors") / target, 0).cast("int"))).where((F.col("parts") > 1) & (F.col("size") > 1))
        axis = geo.longer_axis(*(F.col(c) for c in "snwe"))
        share = F.col("doors") * F.floor(F.col("parts") / 2) / F.col("parts")
        ends = [F.when(F.col("axis") == "lat", F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("s", "w", "lo1"), ("n", "e", "hi1"))]
        # a row for each group: never more than there are groups of some hundred doors left to cut
        box = cut(box.withColumn("axis", axis).select("leaf", "axis", share.alias("share"), "size", *ends))
        large = box.where(F.col("size") > most)
        if large.isEmpty():
            return _finished(rows, box.select("leaf"), target, place).drop("last")
        new = rows.join(F.broadcast(large.select("leaf", "axis", F.col("hi1").alias("top"))), "leaf", "left")
        value = F.when(F.col("axis") == "lat", F.col("lat")).otherwise(F.col("lon"))
        kept = F.col("axis").isNull() | (F.col("last") == F.col("axis"))
        new = new.withColumns({"k2": F.when(kept | (F.col("last") == ""), F.col("k2")).otherwise(F.col("k1")), "k1": F.when(kept, F.col("k1")).otherwise(value), "last": F.coalesce("axis", "last")})
        open_ = new.where("axis is not null")
        state = _narrowed(open_.select("leaf", "k1", "k2", "door_count"), large, most, bins)
        # the last face of a leaf is always on the right
        final = open_.where(F.col("k1") == F.col("top")).groupBy("leaf").agg(F.max(F.struct("k1", "k2", place.alias("p"))).alias("final"))
        open_ = open_.join(F.broadcast(state.join(final, "leaf")), "leaf")
        past = (F.col("k1") > F.col("hi1")) | ((F.col("k1") == F.col("hi1")) & (F.col("k2") > F.col("hi2")))
        inside = F.col("k1").between(F.col("lo1"), F.col("hi1")) & F.col("k2").between(F.col("lo2"), F.col("hi2"))
        around = open_.where(inside)
        running = F.sum("door_count").over(Window.partitionBy("leaf").orderBy("k1", "k2", place)) - F.col("door_count")
        left = (F.col("base") + running < F.col("share")) & (F.struct("k1", "k2", place.alias("p")) != F.col("final"))
        cut_ = around.withColumn("step", F.when(left, "0").otherwise("1")).unionByName(open_.where(~inside).withColumn("step", F.when(past, "1").otherwise("0")))
        done = cut_.withColumn("leaf", F.concat("leaf", "step")).select(*columns)
        rows = cut(new.where("axis is null").select(*columns).unionByName(done))


def _finished(rows: DataFrame, leaves: DataFrame, target: int, place: Column) -> DataFrame:
    """Rows with all further cuts of these leaves, each of which one task can put in order."""
    columns = rows.columns
    ranked = rows.join(F.broadcast(leaves), "leaf", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy("k1", "k2", place)))

    def bisect(leaf: pa.Table) -> pa.Table:
        leaf = leaf.sort_by("rank")
        paths, k1, k2 = kernels.bisected(*(leaf[c].to_numpy() for c in ("lat", "lon", "door_count", "k1", "k2")), leaf["last"][0].as_py(), target)
        found = {"leaf": pa.array([leaf["leaf"][0].as_py() + p for p in paths], pa.string()), "k1": pa.array(k1), "k2": pa.array(k2)}
        return pa.table([found.get(c, leaf[c]) for c in columns], names=columns)

    cut_ = ranked.groupBy("leaf").applyInArrow(bisect, rows.schema)
    return cut(rows.join(F.broadcast(leaves), "leaf", "left_anti").unionByName(cut_))


def adjacency(nodes: list[list], lat: np.ndarray, lon: np.ndarray, metres: float = NEAR_M) -> list[set[int]]:
    """Which faces touch: they share a node, or their centroids are near."""
    near: list[set[int]] = [set() for _ in nodes]
    at: dict = {}
    for i, own in enumerate(nodes):
        for n in own:
            at.setdefault(n, []).append(i)
    pairs = [(a, b) for group in at.values() for a in group for b in group if a < b]
    for a, b in [*pairs, *kernels.near_pairs(lat, lon, metres)]:
        near[a].add(b)
        near[b].add(a)
    return near


def build_zones(faces: DataFrame, target: int = DEFAULT_TARGET) -> DataFrame:
    """One row per face: blockface_id, zone_id, kept; faces cut off from their zone's larger part are not kept (zone null)."""
    usable = faces.where(F.size("stops") > 0)
    leaves = split(usable.select("blockface_id", "street", "from_number", "side", "lat", "lon", "door_count", "nodes"), target)

    def largest(leaf: pd.DataFrame) -> pd.DataFrame:
        leaf = leaf.sort_values(["k1", "k2", "street", "house", "from_number", "side", "blockface_id"]).reset_index(drop=True)
        sets = kernels.Sets(range(len(leaf)))
        nodes = [[(n["y"], n["x"]) for n in own] for own in leaf["nodes"]]
        for i, around in enumerate(adjacency(nodes, leaf["lat"].to_numpy(), leaf["lon"].to_numpy())):
            for j in around:
                sets.join(i, j)
        root = np.array([sets.root(i) for i in range(len(leaf))])
        doors = leaf.groupby(root)["door_count"].sum()
        first = {r: i for i, r in reversed(list(enumerate(root.tolist())))}
        best = min(doors.index, key=lambda r: (-doors[r], first[r]))
        return pd.DataFrame({"blockface_id": leaf["blockface_id"], "leaf": leaf["leaf"], "kept": root == best})

    marked = leaves.select("blockface_id", "leaf", "k1", "k2", "street", "house", "from_number", "side", "lat", "lon", "door_count", "nodes").groupBy("leaf").applyInPandas(largest, "blockface_id string, leaf string, kept boolean")
    marked = cut(marked)
    points = usable.select("blockface_id", F.explode("stops").alias("s")).join(marked.where("kept"), "blockface_id")
    middle = points.groupBy("leaf").agg(F.avg("s.lat").alias("lat"), F.avg("s.lon").alias("lon"))
    # one row per zone
    named = middle.withColumn("zone_id", F.format_string("z%04d", F.row_number().over(Window.orderBy("lat", "lon", "leaf")))).select("leaf", "zone_id")
    return marked.join(named, "leaf", "left").select("blockface_id", F.when(F.col("kept"), F.col("zone_id")).alias("zone_id"), F.col("zone_id").alias("cut_zone_id"), "kept")


def zone_table(zones: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per zone: label, doors, stops, blockfaces, streets, minutes, box, centroid, dropped_doors, palette."""
    own = cut(zones.join(faces.select("blockface_id", "street", "from_number", "door_count", "stop_count", "minutes", "stops"), "blockface_id"))
    lost = own.where(~F.col("kept")).groupBy(F.col("cut_zone_id").alias("zone_id")).agg(F.sum("door_count").alias("lost"))
    kept = own.where("kept")
    first = kept.groupBy("zone_id", "street").agg(F.min(F.struct("street", text.natural_key(F.col("from_number")).alias("k"))).alias("p")).groupBy("zone_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["street"]).alias("streets"))
    sums = kept.groupBy("zone_id").agg(F.sum("door_count").alias("doors"), F.sum("stop_count").alias("stops"), F.count("*").alias("blockfaces"), F.sum("minutes").alias("minutes"))
    box = kept.select("zone_id", F.explode("stops").alias("s")).groupBy("zone_id").agg(F.min("s.lat").alias("south"), F.min("s.lon").alias("west"), F.max("s.lat").alias("north"), F.max("s.lon").alias("east"), F.avg("s.lat").alias("lat"), F.avg("s.lon").alias("lon"))
    table = sums.join(first, "zone_id").join(box, "zone_id").join(lost, "zone_id", "left")
    table = table.withColumn("dropped_doors", F.coalesce("lost", F.lit(0))).drop("lost").withColumn("label", text.zone_label(F.col("streets"), F.col("doors")))
    table = cut(table)
    return table.join(palette(table.select("zone_id", "south", "west", "north", "east")), "zone_id")


def touching(boxes: DataFrame) -> DataFrame:
    """Pairs a < b of zones whose padded boxes overlap, by the grid cells that they reach."""
    size = boxes.agg(F.max(F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))).alias("size")).first()["size"] or 0.0
    cell = size + 2 * BOX_PAD  # no box reaches more than four cells
    near = [boxes.select(*[F.col(c).alias(f"{e}_{c}") for c in boxes.columns]) for e in "ab"]
    for k, e in enumerate("ab"):
        pad = BOX_PAD if k else 0.0
        cells = [F.explode(geo.cells_between(F.col(f"{e}_{lo}") - pad, F.col(f"{e}_{hi}") + pad, cell)) for lo, hi in (("south", "north"), ("west", "east"))]
        near[k] = near[k].withColumn("cy", cells[0]).withColumn("cx", cells[1])
    pairs = near[0].join(near[1], ["cy", "cx"]).where("a_zone_id < b_zone_id")
    over = F.lit(True)
    for lo, hi in (("south", "north"), ("west", "east")):
        over &= (F.col(f"a_{hi}") + BOX_PAD >= F.col(f"b_{lo}")) & (F.col(f"b_{hi}") + BOX_PAD >= F.col(f"a_{lo}"))
    return pairs.where(over).select(F.col("a_zone_id").alias("a"), F.col("b_zone_id").alias("b")).distinct()


def palette(boxes: DataFrame, colours: int = PALETTE, most: int = MOST_COLOURED) -> DataFrame:
    """zone_id, palette: in order of id each zone takes the lowest colour that no earlier zone touching it has.

    Up to ``most`` zones go to one task. More take their colours in rounds: a zone
    has its turn once all earlier zones that it touches have had theirs, so the
    colours are the same.
    """
    boxes = cut(boxes.select("zone_id", "south", "west", "north", "east"))
    order = F.row_number().over(Window.orderBy("zone_id")) - 1
    if boxes.count() <= most:

        def colour(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("zone_id").reset_index(drop=True)
            s, w, n, e = (group[c].to_numpy() for c in ("south", "west", "north", "east"))
            taken: list[int] = []
            for i in range(len(group)):
                touch = (n[:i] + BOX_PAD >= s[i]) & (n[i] + BOX_PAD >= s[:i]) & (e[:i] + BOX_PAD >= w[i]) & (e[i] + BOX_PAD >= w[:i])
                used = {taken[j] for j in np.flatnonzero(touch)}
                taken.append(next((c for c in range(colours) if c not in used), i % colours))
            return pd.DataFrame({"zone_id": group["zone_id"], "palette": np.array(taken, np.int32)})

        return boxes.groupBy(F.lit("all").alias("all")).applyInPandas(colour, "zone_id string, palette int")

    place = cut(boxes.select("zone_id", order.alias("i")))
    pairs = cut(touching(boxes))
    done = place.limit(0).select("zone_id", F.lit(0).alias("palette"))
    while True:
        left = place.join(done, "zone_id", "left_anti")
        blocked = pairs.join(left.select(F.col("zone_id").alias("a")), "a", "left_semi").select(F.col("b").alias("zone_id")).distinct()
        turn = left.join(blocked, "zone_id", "left_anti")
        used = pairs.join(done.toDF("a", "c"), "a").groupBy(F.col("b").alias("zone_id")).agg(F.collect_set("c").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(colours - 1)), F.coalesce("used", F.array().cast("array<int>"))))
        now = turn.join(used, "zone_id", "left").select("zone_id", F.coalesce(free, F.col("i") % colours).cast("int").alias("palette"))
        before, done = done.count(), cut(done.unionByName(now))
        if done.count() == before:
            return done


def split_streets(zones: DataFrame, faces: DataFrame) -> DataFrame:
    """Streets in more than one zone, by the raw name that comes first."""
    own = zones.where("kept").join(faces.select("blockface_id", "street", "street_norm", "from_number"), "blockface_id")
    rows = own.groupBy("street_norm").agg(F.count_distinct("zone_id").alias("zones"), F.min_by("street", F.struct("zone_id", "street", text.natural_key(F.col("from_number")).alias("k"))).alias("street"))
    return rows.where("zones > 1").select("street", "zones")


def plan_summary(zones: DataFrame, faces: DataFrame, target: int) -> DataFrame:
    """One row: counts, coverage and size spread."""
    own = zones.join(faces.select("blockface_id", "door_count"), "blockface_id")
    size = own.where("kept").groupBy("zone_id").agg(F.sum("door_count").alias("doors"))
    spread = size.agg(F.count("*").alias("zone_count"), ((F.max("doors") - F.min("doors")) / F.nullif(F.avg("doors"), F.lit(0.0))).alias("spread"))
    total = own.agg(F.coalesce(F.sum("door_count"), F.lit(0)).alias("total_doors"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("door_count"))), F.lit(0)).alias("covered_doors"), F.count_if(~F.col("kept")).alias("dropped_blockfaces"))
    return total.crossJoin(spread).select(
        F.lit(target).alias("target_doors"),
        "zone_count",
        "total_doors",
        "covered_doors",
        (F.col("total_doors") - F.col("covered_doors")).alias("dropped_doors"),
        "dropped_blockfaces",
        F.bround(F.coalesce(F.col("covered_doors") / F.nullif("total_doors", F.lit(0)), F.lit(0.0)) * 100, 1).alias("coverage_pct"),
        F.bround(F.coalesce("spread", F.lit(0.0)) * 100, 1).alias("size_spread_pct"),
    )
