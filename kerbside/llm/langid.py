"""Language identification in two steps: the language family, then the language within it.

A text's letters, lower-cased, become byte trigrams (runs of anything else
count as one space), hashed to ``2**BITS`` counts and scaled to unit length
after a square root. Linear support vector machines (squared hinge, L2) are
fitted in numpy on the driver: one against one between families, and one
against one between the languages of a family.

The families of common languages are fixed values; a language that is not among
them is a family of its own. Fitting takes a bounded sample: at most
``PER_LANGUAGE`` documents of a language and ``SAMPLE`` in all, drawn by a hash
over the whole table. Only features leave the executors, not texts.

A null text, or one without a letter, is ``und`` with score 0. So is every text
if nothing could be learned. Every row is judged by itself: rows that repeat come
out alike, and once in the sample. Ties of votes go by summed margins, then by
name. An empty table gives an empty result. Other columns come back in a struct
``row``, so their names cannot clash with those that are added.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indo-aryan": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
    "celtic": ("ga", "gd", "cy", "br"),
    "semitic": ("ar", "he", "mt"),
    "malayic": ("id", "ms"),
}

BITS = 12
PER_LANGUAGE, SAMPLE = 300, 3000
#: Strength of the L2 term, passes, and the slope from margin to score.
RIDGE, PASSES, SLOPE = 1e-4, 80, 6.0
#: Characters per vectorised pass.
PIECE = 1 << 19
UNKNOWN = "und"
#: A text is of a known language if its nearness to its language's mean is at least this share of what all but one in
#: a hundred of the sample reach. Nearness is the cosine over the root of the distinct trigrams, up to so many.
LEAST_SHARE, MOST_TRIGRAMS = 0.7, 256

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def counts(text: str) -> np.ndarray:
    """Hashed trigram counts of the whole text."""
    total = np.zeros(1 << BITS, np.int64)
    tail = np.array([0x20], np.uint8)

    def add(b: np.ndarray) -> None:
        nonlocal total
        b = b.astype(np.uint32)
        h = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
        total += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)

    # the last two letters go over each cut, so that pieces count as one text
    for lo in range(0, len(text), PIECE):
        b = np.r_[tail, _FOLD[np.frombuffer(text[lo : lo + PIECE].lower().encode("utf-8", "surrogatepass"), np.uint8)]]
        space = b == 0x20
        b = b[~(space & np.r_[False, space[:-1]])]
        add(b)
        tail = b[-2:]
    add(np.r_[tail, np.uint8(0x20)])
    return total


def features(text: str) -> np.ndarray:
    x = np.sqrt(counts(text).astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine by accelerated gradient steps on the squared hinge; y is 1 or -1. Classes weigh the same."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate, was = 0.25 / (1 + RIDGE), 1.0
    for _ in range(PASSES):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - rate * (RIDGE * v - 2 * x.T @ (weight * y * slack))
        now = (1 + np.sqrt(1 + 4 * was * was)) / 2
        v = step + (was - 1) / now * (step - w)
        w, was = step, now
    return w[:-1], float(w[-1])


def nearness(x: np.ndarray, mean: np.ndarray) -> float:
    """Cosine to a language's mean (of unit length), in proportion to what a text of so many distinct trigrams can reach."""
    return float(x @ mean) / float(np.sqrt(min(max(np.count_nonzero(x), 1), MOST_TRIGRAMS)))


@dataclass
class Model:
    """Pairwise machines between families and, by family, between its languages."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    between: list[tuple[int, int, np.ndarray, float]] = field(default_factory=list)
    within: dict[str, list[tuple[int, int, np.ndarray, float]]] = field(default_factory=dict)
    means: dict[str, np.ndarray] = field(default_factory=dict)
    least: float = 0.0

    @staticmethod
    def _vote(x: np.ndarray, n: int, machines: list[tuple[int, int, np.ndarray, float]]) -> tuple[int, float]:
        """The winner of all pairs (then by summed margins) and a score from its smallest margin."""
        votes, sums, least = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        for a, b, w, c in machines:
            m = float(x @ w) + c
            votes[a if m > 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = int(np.lexsort((-sums, -votes))[0])
        return best, 1.0 if n == 1 else float(1 / (1 + np.exp(-SLOPE * np.clip(least[best], -50, 50))))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is like that language at all."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0, False
        x = features(text)
        k, sure = self._vote(x, len(self.families), self.between)
        family = self.families[k]
        names = self.members[family]
        j, surer = self._vote(x, len(names), self.within[family])
        return names[j], sure * surer, nearness(x, self.means[names[j]]) >= self.least


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """x: a row of features for each text."""
    if not len(langs):
        return Model()
    own = {lang: name for name, some in FAMILIES.items() for lang in some}
    lang = np.array(langs, object)
    family = np.array([own.get(name, name) for name in langs], object)

    def pairs(of: np.ndarray, names: list[str]) -> list[tuple[int, int, np.ndarray, float]]:
        found = []
        for a, b in itertools.combinations(range(len(names)), 2):
            at = np.flatnonzero((of == names[a]) | (of == names[b]))
            found.append((a, b, *svm(x[at], np.where(of[at] == names[a], 1, -1).astype(np.float32))))
        return found

    families = sorted(set(family))
    members = {f: sorted(set(lang[family == f])) for f in families}
    means = {name: m / max(float(np.sqrt((m * m).sum())), 1e-9) for name in sorted(set(lang)) for m in [x[lang == name].mean(axis=0)]}
    near = [nearness(row, means[name]) for row, name in zip(x, lang, strict=True)]
    return Model(families, members, pairs(family, families), {f: pairs(lang, members[f]) for f in families}, means, LEAST_SHARE * float(np.quantile(near, 0.01)))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text divides by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample of documents with a language that are not held out."""
    sizes = {r["lang"]: r["n"] for r in docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model()
    most = max(2, min(PER_LANGUAGE, SAMPLE // len(sizes)))
    # a draw of about twice as many by hash, each row once, then the first ones by hash: exactly so many, or all there are
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 2 * most / n))])
    fit_for = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")
    chosen = docs.select("doc_id", "text", "lang").where(fit_for & (draw / float(1 << 30) < share[F.col("lang")])).withColumn("draw", draw)
    chosen = chosen.dropDuplicates(["lang", "doc_id", "draw"])
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("place") <= most).select("lang", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([features(batch.column(1)[k].as_py()).tobytes()])], names=["lang", "x"])

    got = sorted(((r["lang"], bytes(r["x"])) for r in chosen.mapInArrow(rows, "lang string, x binary").collect()))
    if not got:
        return Model()
    return fit(np.stack([np.frombuffer(x, np.float32) for _, x in got]), [lang for lang, _ in got])


def predict(docs: DataFrame, model: Model, text: str = "text", carry_text: bool = True) -> DataFrame:
    """The columns of ``docs`` (without the text if it is not to be carried) in a struct ``row``, with lang_pred, score and known (like the language at all) beside it. Narrow."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if carry_text or c != text]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [model.judge(texts[k].as_py()) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["row", "lang_pred", "score", "known"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double, known boolean")
