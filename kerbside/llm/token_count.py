"""Token counts of whole documents.

Documents of up to ``CHUNK + OVERLAP`` characters go to the tokenizer library as
they are. A longer one is encoded in overlapping chunks with offsets, and the
counts are spliced at a boundary inside the overlap that is stable: both encodings
start a token there, and the characters around it make it a word start whatever
the context (a single space between two visible characters). If an overlap has no
such boundary, it is widened, up to the rest of the document, so the count is
always exact and no call encodes much more than a chunk of ordinary text.

Null counts as empty: 0 bytes, 0 tokens, one chunk. Every row is counted by
itself, so rows that repeat (id, text or both) give equal rows, and there are no
ties to break. An empty table gives an empty result. All other columns come back
in a struct ``row``, so their names cannot clash with those that are added.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of the first overlap.
CHUNK, OVERLAP = 1 << 13, 1 << 8
#: Documents handed to the library at once.
GROUP = 64
LIMIT = 1024
_SEAM = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")


@functools.lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=4)
def specials(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def seams(text: str, lo: int, hi: int, marks: tuple[str, ...]) -> list[int]:
    """Places in [lo, hi) where a word starts in any context and that lie in no special string."""
    found = [m.start() for m in _SEAM.finditer(text, lo, min(hi, len(text)))]
    for mark in marks:
        if " " in mark:
            spans = [(m.start(), m.end()) for m in regex.finditer(regex.escape(mark), text[max(0, lo - len(mark)) : hi + len(mark)])]
            found = [p for p in found if not any(a < p - max(0, lo - len(mark)) < b for a, b in spans)]
    return found


def count_huge(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of one text by splicing overlapping chunks, and how many chunks were spliced.

    A chunk covers [start, start + chunk + width); the next starts at the chunk's
    nominal end. The splice is the first stable place in the overlap at which
    both begin a token; what stands left of it is counted from the left chunk.
    """
    marks = specials(tokenizer)
    total, start, chunks = 0, 0, 1
    while len(text) - start > chunk + overlap:
        width, cut = overlap, None
        while cut is None:
            end = start + chunk
            stop = min(len(text), end + width)
            left = tokenizer.encode(text[start:stop], add_special_tokens=False)
            if stop == len(text):
                return total + len(left.ids), chunks
            # the right-hand chunk begins mid-text, at `end`; only what both agree on can be a splice
            right = tokenizer.encode(text[end:stop], add_special_tokens=False)
            lefts: dict[int, int] = {}
            for k, (a, _) in enumerate(left.offsets):
                if a > chunk:
                    lefts.setdefault(start + a, k)
            rights = {end + a for a, _ in right.offsets}
            cut = next((p for p in seams(text, end + 1, stop - 1, marks) if p in lefts and p in rights), None)
            width *= 4
        total += lefts[cut]
        start = cut
        chunks += 1
    return total + len(tokenizer.encode(text[start:], add_special_tokens=False).ids), chunks


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All columns of ``docs`` but the text in a struct ``row``, with n_bytes, n_tokens, n_chunks and over_limit beside it. Narrow."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            counts, chunks = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
            for lo in range(0, len(texts), GROUP):
                part = texts.slice(lo, GROUP).to_pylist()
                small = [k for k, t in enumerate(part) if len(t) <= chunk + overlap]
                for k, e in zip(small, own.encode_batch_fast([part[k] for k in small], add_special_tokens=False), strict=True):
                    counts[lo + k] = len(e.ids)
                for k, t in enumerate(part):
                    if len(t) > chunk + overlap:
                        counts[lo + k], chunks[lo + k] = count_huge(t, own, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.binary_length(texts.cast(pa.binary())).cast(pa.int64()), pa.array(counts), pa.array(chunks)], names=["row", "n_bytes", "n_tokens", "n_chunks"])

    import pyarrow.compute  # noqa: F401

    schema = f"row {packed.schema['row'].dataType.simpleString()}, n_bytes long, n_tokens long, n_chunks long"
    return packed.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
