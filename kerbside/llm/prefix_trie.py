"""Trie of the prefixes of rebuilt conversations, with subtree sums from minimal-perfect-hash node tables.

Turns are ranked within their conversation (null turn first; turns that tie are
taken in the order of a 128-bit hash of role and text), conversations rebuilt on
the head of their family's first one, and every prefix gets a digest: the
exclusive or of 128-bit hashes of (place, role, text), so that prefixes of any
length come from windows over bounded bands. Distinct digests are the nodes; a
digest under which two different last turns or depths meet raises an error.

Sums over subtrees: each node's own value is laid on the conversation that owns
it (its smallest member), so that a shard of conversations can add up its part
alone. A shard holds some ``SHARD`` prefixes: it lists its distinct digests,
gives each a slot by a minimal perfect hash, verified against the digest stored
there, scatters the values into flat arrays and accumulates them through the
array of parent slots, deepest level first. Shards put out one row a node, which
are added by digest, so a hot node costs a row a shard. A conversation longer
than ``BAND`` turns is spread over shards by bands, sums passing from a band to
the one above.

Null role and text count as empty. Rows without a conv_id belong to no
conversation and are ignored. Rows that repeat are turns of their own. An empty
table (or one without a conv_id) has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.runtime import cut

#: Conversations of a family are rebuilt on the head of its first one, of up to HEADS - 1 turns.
FAMILY, HEADS = 20, 4
#: Turns of a band, prefixes of a shard (about), and ids that are joined to one string (at most).
BAND, SHARD, CHUNK = 4096, 150_000, 8192
WORD = r"[^\x20\x09-\x0D]+"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class SlotTable:
    """A minimal perfect hash over distinct digests (two uint64 arrays): slots 0 .. n-1, each with its digest.

    Level by level the digests that are left are thrown at a table twice their
    number; those alone in their cell stay there, the rest go on. The slot is the
    rank of the cell among the taken ones.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[np.uint64, np.ndarray]] = []
        left, n = np.arange(len(hi)), 0
        slots = np.empty(len(hi), np.int64)
        while len(left):
            cells = np.uint64(2 * len(left) + 1)
            at = self._cell(hi[left], lo[left], len(self.levels), cells)
            alone = np.bincount(at, minlength=int(cells)) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + n, -1)
            self.levels.append((cells, rank))
            stay = alone[at]
            slots[left[stay]] = rank[at[stay]]
            n += int(alone.sum())
            left = left[~stay]
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        self.hi[slots], self.lo[slots] = hi, lo

    @staticmethod
    def _cell(hi: np.ndarray, lo: np.ndarray, level: int, cells: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (hi ^ (lo * (_GOLD + np.uint64(2 * level)))) + np.uint64(level + 1) * _GOLD
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(29))) % cells).astype(np.int64)

    def __len__(self) -> int:
        return len(self.hi)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not in the table."""
        found = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (cells, rank) in enumerate(self.levels):
            got = rank[self._cell(hi[left], lo[left], level, cells)]
            found[left] = got
            left = left[got < 0]
        hit = found >= 0
        found[hit] = np.where((self.hi[found[hit]] == hi[hit]) & (self.lo[found[hit]] == lo[hit]), found[hit], -1)
        return found


def subtree_sums(hi: np.ndarray, lo: np.ndarray, parent_hi: np.ndarray, parent_lo: np.ndarray, depth: np.ndarray, top: np.ndarray, values: list[np.ndarray]) -> tuple[SlotTable, list[np.ndarray]]:
    """Rows are prefixes, repeats included, with values to be laid on their node. The sums of each slot's subtree, as far as the rows go; nothing passes upwards from a ``top``."""
    key = np.empty(len(hi), [("hi", np.uint64), ("lo", np.uint64)])
    key["hi"], key["lo"] = hi, lo
    _, first = np.unique(key, return_index=True)
    table = SlotTable(hi[first], lo[first])
    slot = table.find(hi, lo)
    if (slot < 0).any():
        raise AssertionError("a prefix without a slot")
    parent, level = np.full(len(table), -1, np.int64), np.zeros(len(table), np.int64)
    parent[slot[first]], level[slot[first]] = table.find(parent_hi[first], parent_lo[first]), depth[first]
    parent[slot[first][top[first]]] = -1
    sums = []
    for value in values:
        flat = np.zeros(len(table), np.int64)
        np.add.at(flat, slot, value)
        sums.append(flat)
    order = np.argsort(-level, kind="stable")
    bounds = np.flatnonzero(np.diff(level[order])) + 1
    for nodes in np.split(order, bounds):
        nodes = nodes[parent[nodes] >= 0]
        for flat in sums:
            np.add.at(flat, parent[nodes], flat[nodes])
    return table, sums


def ranked(turns: DataFrame) -> DataFrame:
    """``r``, the rank of each turn within its conversation from 1: ranks within sorted ranges, then the few conversations that cross a range's end are mended."""
    key = ["conv_id", "turn", "hi", "lo"]
    dealt = turns.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            r = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            if ids[0] == last:
                r[: starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(r[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r.astype(np.int64))], names=[*batch.schema.names, "r"])

    found = cut(dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("r", T.LongType())])))
    ends = found.groupBy("conv_id", "part").agg(F.max("r").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most one conversation crosses the end of a range, so there are no more rows than ranges
    crossing = ends.select("conv_id", "part", before.alias("before")).where("before > 0")
    return found.join(F.broadcast(crossing), ["conv_id", "part"], "left").select("conv_id", (F.col("r") + F.coalesce("before", F.lit(0))).alias("r"), "hi", "lo", "words")


def _head_turns() -> Column:
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), hi, lo, words of the rebuilt conversations. ``turns`` as of ``ranked``, ``convs`` the distinct ids."""
    first = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    head = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("r") < HEADS))
    head = head.groupBy(F.col("conv_id").alias("family")).agg(F.array_sort(F.collect_list(F.struct("r", "hi", "lo", "words"))).alias("head"))
    own = convs.select("conv_id", first, _head_turns().alias("h")).where("h > 0").join(head, "family", "left")
    taken = own.select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t")).select("conv_id", F.col("t.r").alias("pos"), "t.hi", "t.lo", "t.words")
    short = own.select("conv_id", (F.col("h") - F.coalesce(F.array_size("head"), F.lit(0))).alias("lack")).where("lack > 0")
    rest = turns.where(F.col("r") > _head_turns()).join(short, "conv_id", "left")
    return taken.unionByName(rest.select("conv_id", (F.col("r") - F.coalesce("lack", F.lit(0))).alias("pos"), "hi", "lo", "words"))


def prefixes(rows: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: digest (d1, d2), the parent's (p1, p2), pos, band and the last turn's words."""
    tag = rows.select("conv_id", "pos", F.floor(F.col("pos") / BAND).cast("int").alias("band"), F.xxhash64("pos", "hi", "lo").alias("t1"), F.xxhash64("lo", "pos", "hi").alias("t2"), "words")
    own = Window.partitionBy("conv_id", "band").orderBy("pos")
    run = tag.select("*", *[F.bit_xor(f"t{k}").over(own).alias(f"x{k}") for k in (1, 2)])
    bands = tag.groupBy("conv_id", "band").agg(*[F.bit_xor(f"t{k}").alias(f"t{k}") for k in (1, 2)])
    above = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    above = bands.select("conv_id", "band", *[F.bit_xor(f"t{k}").over(above).alias(f"y{k}") for k in (1, 2)]).where("band > 0")
    full = run.join(above, ["conv_id", "band"], "left").select("*", *[F.col(f"x{k}").bitwiseXOR(F.coalesce(f"y{k}", F.lit(0))).alias(f"d{k}") for k in (1, 2)])
    return full.select("conv_id", "band", "pos", "d1", "d2", *[F.col(f"d{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2)], "words")


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct digests: members, owner (smallest member), depth, words, parent's digest, children. The root's digest is (0, 0)."""
    extremes = [f(c).alias(f"{n}_{c}") for c in ("p1", "p2", "pos") for n, f in (("min", F.min), ("max", F.max))]
    found = rows.groupBy("d1", "d2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.min("words").alias("words"), *extremes)
    same = F.lit(True)
    for c in ("p1", "p2", "pos"):
        same &= F.col(f"min_{c}") == F.col(f"max_{c}")
    checked = found.select("d1", "d2", "n_convs", "owner", "words", F.col("min_p1").alias("p1"), F.col("min_p2").alias("p2"), F.when(same, F.col("min_pos")).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).alias("depth"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    checked = checked.unionByName(root.select(zero.alias("d1"), zero.alias("d2"), "n_convs", "owner", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("depth")))
    children = checked.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    return checked.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def accumulated(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """leaves and saved of every node but the root: the shards' sums, added by digest."""
    value = nodes.where("depth > 0").select(F.col("owner").alias("conv_id"), F.col("depth").alias("pos"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    laid = cut(rows.join(value, ["conv_id", "pos"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("leaf", "saving")}))
    total, deepest = laid.agg(F.count("*"), F.max("band")).first()
    if deepest:
        bands = laid.groupBy("conv_id", "band").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
        below = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
        carry = bands.select("conv_id", ((F.col("band") + 1) * BAND - 1).cast("long").alias("pos"), *[F.sum(c).over(below).alias(f"more_{c}") for c in ("leaf", "saving")]).where("more_leaf is not null")
        laid = laid.join(carry, ["conv_id", "pos"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaf", "saving")})
    shards = 1 + (total or 0) // SHARD
    # families stay together, as they share heads; a family's band has at most FAMILY * BAND prefixes
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    dealt = laid.select(F.pmod(F.xxhash64(family, "band"), F.lit(shards)).alias("shard"), "d1", "d2", "p1", "p2", "pos", (F.col("pos") % BAND == 0).alias("top"), "leaf", "saving")

    def run(shard: pa.Table) -> pa.Table:
        column = lambda c: shard.column(c).to_numpy()
        bits = [column(c).view(np.uint64) for c in ("d1", "d2", "p1", "p2")]
        table, (leaves, saved) = subtree_sums(*bits, column("pos"), shard.column("top").to_numpy(), [column("leaf"), column("saving")])
        return pa.table({"d1": table.hi.view(np.int64), "d2": table.lo.view(np.int64), "leaves": leaves, "saved": saved})

    parts = dealt.groupBy("shard").applyInArrow(run, "d1 long, d2 long, leaves long, saved long")
    return parts.groupBy("d1", "d2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def end_hashes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the ids, in ascending order and joined by commas, of the conversations that end at each node.

    The order makes one stream of a node's ids; they come as strings of up to
    ``CHUNK`` ids, sorted by Spark, and pass through the hash batch by batch.
    """
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("d1", "d2"), "pos").alias("d"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("d.d1", zero).alias("d1"), F.coalesce("d.d2", zero).alias("d2"), (F.col("conv_id") - F.col("conv_id") % CHUNK).alias("chunk"))
    chunks = ends.groupBy("d1", "d2", "chunk").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = chunks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashed = None, None
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
                if (d1, d2) == at:
                    hashed.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, hashed.hexdigest()))
                at, hashed = (d1, d2), hashlib.sha256(ids.encode())
            yield _hash_batch(out)
            out.clear()
        if at:
            yield _hash_batch([(*at, hashed.hexdigest())])

    return dealt.mapInArrow(run, "d1 long, d2 long, ends_sha256 string")


def _hash_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["d1", "d2", "ends_sha256"])


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node; see the module's docstring. conv_id is any integer type, turn any orderable one."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    words = F.when(blank(text) == "", 0).otherwise(F.size(F.regexp_extract_all(blank(text), F.lit(f"({WORD})"), F.lit(1)))).cast("long")
    said = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.xxhash64(F.lit(1), blank(role), blank(text)).alias("hi"), F.xxhash64(F.lit(2), blank(role), blank(text)).alias("lo"), words.alias("words"))
    turns = ranked(said)
    convs = cut(turns.where("r = 1").select("conv_id"))
    rows = cut(prefixes(rebuilt(turns, convs)))
    nodes = cut(nodes_of(rows, convs))
    sums = accumulated(rows, nodes)
    whole = nodes.agg(F.sum((F.col("depth") > 0).cast("long") * (F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    zero = F.lit(0).cast("long")
    # the root has no prefix row; where no conversation has a turn it is a leaf itself
    sums = sums.unionByName(whole.select(zero.alias("d1"), zero.alias("d2"), F.greatest(F.coalesce("leaves", zero), F.lit(1).cast("long")).alias("leaves"), F.coalesce("saved", zero).alias("saved")))
    parent = nodes.where("n_children > 0").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    found = nodes.join(sums, ["d1", "d2"]).join(end_hashes(rows, convs), ["d1", "d2"], "left").join(parent, ["p1", "p2"], "left")
    return found.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


#: crc32 of the decimal id, bit by bit; all prefixes as lists, subtrees by their own prefixes.
ORACLE = """
WITH own AS (
  SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) r, {'r': coalesce(role, ''), 't': coalesce(text, '')} v
  FROM conversations WHERE conv_id IS NOT NULL),
listed AS (SELECT c, list(v ORDER BY r) vs FROM own GROUP BY c),
headed AS (
  SELECT c, vs, c - c % 20 b,
    xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
      lambda a, s: list_reduce(list_concat([xor(a, s)], range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 4 h
  FROM listed),
built AS (
  SELECT a.c, list_concat(coalesce(list_slice(b.vs, 1, a.h::BIGINT), []), coalesce(list_slice(a.vs, a.h::BIGINT + 1, len(a.vs)), [])) vs
  FROM headed a LEFT JOIN listed b ON b.c = a.b),
sliced AS (SELECT c, d, list_slice(vs, 1, d) k, len(vs) n FROM (SELECT c, vs, unnest(range(len(vs) + 1)) d FROM built)),
node AS (
  SELECT k, d, min(c) c, count(*) n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) ends,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, '[^\\x20\\x09-\\x0D]+')) END w
  FROM sliced GROUP BY k, d),
child AS (SELECT list_slice(k, 1, d - 1) k, d - 1 d, count(*) n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(child.n, 0) kids FROM node LEFT JOIN child USING (k, d)),
below AS (
  SELECT list_slice(k, 1, e) k, e d, sum((kids = 0)::BIGINT) leaves, sum((n - 1) * w) saved
  FROM (SELECT *, unnest(range(d + 1)) e FROM full_node) GROUP BY ALL)
SELECT f.c conv_id, f.d depth, p.c parent_conv_id, f.n n_convs, f.kids n_children, b.leaves::BIGINT n_leaves, b.saved::BIGINT saved_tokens, f.ends ends_sha256
FROM full_node f JOIN below b USING (k, d) LEFT JOIN full_node p ON p.d = f.d - 1 AND p.k = list_slice(f.k, 1, f.d - 1)
"""
