"""Byte-level BPE encoding and decoding.

Encoding runs the merge loop over a doubly linked list of symbols with a
priority queue of (merge rank, position); an entry whose symbols have changed
since it was pushed is stale and skipped. Decoding concatenates the vocabulary
strings of the ids. Results equal those of the public ``tokenizers`` library for
files whose model is plain BPE behind a ByteLevel pre-tokenizer, added special
tokens inside a text included.

Null text counts as empty and gives no ids. Any Unicode text, of any length, is
encoded whole; long texts are walked in pieces cut where no token can span.
"""

from __future__ import annotations

import array
import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the byte-level pre-tokenization, as published for this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts within Latin-1, where the classes can be spelled out.
_L, _N, _W = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+"

#: Characters of a text that are split into words at once.
PIECE = 1 << 20
#: Words kept with their ids in each of two generations, and the longest word that is kept.
KEPT, KEPT_LENGTH = 150_000, 48
#: Bytes of text per Arrow batch that leaves the worker.
OUT_BYTES = 8 << 20

ENCODED = "ids array<int>, decoded string, round_trip boolean"


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(spare)}


class Codec:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for word, k in vocab.items():
            self.strings[k] = bytes(symbols[c] for c in word)
        for word, k in added.items():
            self.strings[k] = word.encode()
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = added
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._wide, self._latin = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
        self._seam = regex.compile(r"\P{White_Space}(?= \P{White_Space})")
        self._words = _Words(self)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges in order of rank, leftmost first among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        nxt, prv, ids = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        merges = self.merges
        queue = [(hit[0], i, hit[1], ids[i], ids[i + 1]) for i in range(n - 1) if (hit := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, whole, left, right = heapq.heappop(queue)
            j = nxt[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has merged with another since
            ids[i], ids[j] = whole, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if hit := merges.get((whole, ids[k])):
                    heapq.heappush(queue, (hit[0], i, hit[1], whole, ids[k]))
            if (h := prv[i]) >= 0 and (hit := merges.get((ids[h], whole))):
                heapq.heappush(queue, (hit[0], h, hit[1], ids[h], whole))
        return [x for x in ids if x >= 0]

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of about PIECE characters, cut before a single space between two visible characters: a word always starts there."""
        at = 0
        while len(text) - at > PIECE:
            seam = self._seam.search(text, at + PIECE)
            if not seam:
                break
            yield text[at : seam.end()]
            at = seam.end()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text as int32."""
        if not text:
            return np.empty(0, np.int32)
        packed: list[bytes] = []
        for part in self._split.split(text) if self._split else [text]:
            if part in self.added:
                packed.append(np.int32(self.added[part]).tobytes())
                continue
            for piece in self._pieces(part):
                try:
                    piece.encode("latin-1")
                    words = self._latin.findall(piece)
                except UnicodeEncodeError:
                    words = self._wide.findall(piece)
                packed.append(b"".join(map(self._words.__getitem__, words)))
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.strings.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


class _Words(dict):
    """Packed ids by word; a word is merged when first asked for.

    A full generation becomes the old one, from which words that are asked for
    again come back, so frequent words stay and the rest goes.
    """

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = array.array("i", self.codec.merge([self.codec.byte_id[b] for b in word.encode("utf-8")])).tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per file and Python worker."""
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` in a struct ``row``, with ids, decoded and round_trip (decoded equals the text) beside it.

    Narrow: each row is encoded where it is read, one Arrow batch at a time.
    Empty input gives an empty result of the same schema.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            start, ids, plain, same, held = 0, [], [], [], 0
            for k in range(len(texts)):
                given = texts[k].as_py()
                found = own.encode(given)
                back = own.decode(found)
                same.append(back == given)
                ids.append(found)
                plain.append(back)
                held += len(back) + 4 * len(found)
                if held >= OUT_BYTES or k == len(texts) - 1:
                    yield _batch(rows.slice(start, len(ids)), ids, plain, same)
                    start, ids, plain, same, held = k + 1, [], [], [], 0

    def _batch(rows: pa.Array, ids: list[np.ndarray], plain: list[str], same: list[bool]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([rows, lists, pa.array(plain, pa.string()), pa.array(same)], names=["row", "ids", "decoded", "round_trip"])

    schema = f"row {packed.schema['row'].dataType.simpleString()}, {ENCODED}"
    return packed.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of the query, from the ids and the decoded text."""
    return encoded.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
