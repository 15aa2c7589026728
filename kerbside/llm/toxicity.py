"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly.

A word is the bag of its character n-grams (3 to 6, with word-end marks) and of
itself; each hashes to a row of an embedding table. A word's vector is the mean
of its rows, a document's vector the mean over its words, weighted by log(1 +
occurrences) so that one repeated word is not the whole document, and a linear
softmax sits on top. Table and softmax are trained together in numpy by mini-batch
Adagrad, so a misspelling that was never seen lies near the words whose n-grams
it shares. The fitted model collapses to one log-odds per table row, hence one per word.

Training takes a bounded sample of labelled rows: at most ``POSITIVES`` and
``NEGATIVES`` documents, drawn by a hash of the id over the whole table, and of
each at most the ``MOST_ROWS`` heaviest table rows.
Everything else covers all documents and whole texts.

Null, empty or wordless texts score the prior of the training labels (0.0 if
nothing could be learned). Null labels and null ids are not learned from; of
repeated labels of one document the highest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVES, NEGATIVES = 1200, 2800
BITS, DIM, GRAMS = 18, 8, (3, 4, 5, 6)
#: Table rows of one training text, the heaviest ones, so that all bags of the sample fit into a quarter of a GB.
MOST_ROWS = 8192
EPOCHS, BATCH, RATE, SCALE, SEED = 8, 64, 0.15, 150.0, 7
#: Neutral words that every text is taken to have besides its own, so that a handful of words is weak evidence.
PAD = 2.0
#: Characters per vectorised pass.
PIECE = 1 << 19
#: Words whose log-odds a worker keeps.
KEPT = 300_000
#: A run of letters and digits beyond this length counts as several words, whole all the same.
_WORD, _GAP = re.compile(r"\w{1,1000}"), re.compile(r"\W")

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)], dtype=np.uint64) for p in (_P, _INV)]
    return _POWERS[0], _POWERS[1]


def words_of(text: str) -> Iterator[list[str]]:
    """The lower-case words of a text, piece by piece; a piece ends between two words."""
    text = text.lower()
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE, at + 2 * PIECE)
        end = gap.start() if gap else at + 2 * PIECE
        yield _WORD.findall(text, at, end)
        at = end
    yield _WORD.findall(text, at)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of all words, their weights (adding up to 1 a word), and the index of the word each belongs to."""
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.r_[0, np.cumsum(lengths)]
    n = len(code)
    own = np.repeat(np.arange(len(words)), lengths)
    left = first[1:][own] - np.arange(n)  # characters from here to the word's end
    with np.errstate(over="ignore"):
        up, down = _powers(n + 1)
        total = np.r_[np.uint64(0), np.cumsum((code + np.uint64(1)) * up[:n], dtype=np.uint64)]
        rows, of = [(total[first[1:]] - total[first[:-1]]) * down[first[:-1]]], [np.arange(len(words))]
        for g in GRAMS:
            k = np.flatnonzero(left >= g)
            rows.append((total[k + g] - total[k]) * down[k] + np.uint64(g))
            of.append(own[k])
        hashed = np.concatenate(rows)
        hashed = (hashed ^ (hashed >> np.uint64(29))) * _MIX
    of = np.concatenate(of)
    share = 1.0 / np.bincount(of, minlength=len(words))
    return (hashed >> np.uint64(64 - BITS)).astype(np.int32), share[of], of


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's table rows and their weights, which add up to 1 at most."""
    counts: Counter[str] = Counter()
    for words in words_of(text or ""):
        counts.update(words)
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    rows, weights, of = subwords(list(counts))
    times = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    at, back = np.unique(rows, return_inverse=True)
    return at.astype(np.int32), (np.bincount(back, weights=weights * times[of]) / (times.sum() + PAD)).astype(np.float32)


@dataclass
class Model:
    """log_odds of each table row, and the intercept."""

    log_odds: np.ndarray
    intercept: float

    def score(self, text: str | None, known: dict[str, float] | None = None) -> float:
        """known: log-odds of words met so far, a bounded cache of the caller's."""
        known = {} if known is None else known
        counts: Counter[str] = Counter()
        for words in words_of(text or ""):
            counts.update(words)
        new = [w for w in counts if w not in known]
        if new:
            if len(known) + len(new) > KEPT:
                known.clear()
                new = list(counts)
            rows, weights, of = subwords(new)
            known.update(zip(new, np.bincount(of, weights=weights * self.log_odds[rows]).tolist(), strict=True))
        times = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        n = times.sum()
        total = float(times @ np.fromiter(map(known.__getitem__, counts), np.float64, len(counts)))
        return float(1 / (1 + np.exp(-np.clip(self.intercept + SCALE * total / (n + PAD), -500, 500))))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rate: float) -> Model:
    """Train embeddings and softmax together; ``rate`` is the share of positives among all labelled rows."""
    y = np.array(labels, np.int64)
    table = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(table, 500.0 * (1 if len(y) and y[0] else -1))
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    seen = np.zeros(1 << BITS, bool)
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    ge, gw, gb = np.full((1 << BITS, 1), 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        step = RATE * (1 - epoch / EPOCHS) + 1e-3
        for lo in range(0, len(y), BATCH):
            at = order[lo : lo + BATCH]
            rows = np.concatenate([bags[k][0] for k in at])
            weights = np.concatenate([bags[k][1] for k in at]) * SCALE
            doc = np.repeat(np.arange(len(at)), [len(bags[k][0]) for k in at])
            x = np.stack([np.bincount(doc, weights=e[rows, d] * weights, minlength=len(at)) for d in range(DIM)], 1).astype(np.float32)
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            dx = p @ w.T
            dw, db = x.T @ p, p.sum(0)
            uniq, back = np.unique(rows, return_inverse=True)
            de = np.stack([np.bincount(back, weights=weights * dx[doc, d], minlength=len(uniq)) for d in range(DIM)], 1).astype(np.float32)
            seen[uniq] = True
            ge[uniq] += (de**2).mean(1, keepdims=True)
            gw += dw**2
            gb += db**2
            e[uniq] -= step * de / np.sqrt(ge[uniq])
            w -= step * dw / np.sqrt(gw)
            b -= step * db / np.sqrt(gb)
    # rows that no training text has say nothing
    log_odds = np.where(seen, e @ (w[:, 1] - w[:, 0]), 0).astype(np.float32)
    # back from the sample's share of positives to that of all labelled rows
    sampled = y.mean()
    shift = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)) - np.log(sampled / (1 - sampled))
    return Model(log_odds, float(b[1] - b[0] + shift))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample. The sampled labels, at most POSITIVES + NEGATIVES rows, are broadcast; texts stay where they are."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [], 0.0)
    rate = counts.get(1, 0) / sum(counts.values())
    parts = []
    for value, most in ((1, POSITIVES), (0, NEGATIVES)):
        rank = F.xxhash64(F.col("doc_id"), F.lit(SEED))
        parts.append(known.where(F.col("toxic") == value).orderBy(rank, "doc_id").limit(most))
    sample = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    # one text an id, so that the bound holds whatever repeats
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, weights = bag(batch.column(2)[k].as_py())
                if len(at) > MOST_ROWS:
                    heavy = np.sort(np.argsort(-weights, kind="stable")[:MOST_ROWS])
                    at, weights = at[heavy], weights[heavy]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([at.tobytes()]), pa.array([weights.tobytes()])], names=["doc_id", "toxic", "at", "weights"])

    got = rows.mapInArrow(bags, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, at binary, weights binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], len(r["at"]), bytes(r["at"])))
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in got], [r["toxic"] for r in got], rate)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` but the text in a struct ``row``, with score and predicted beside it. Narrow."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(texts[k].as_py(), known) for k in range(len(texts))], pa.float64())], names=["row", "score"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
