"""Fast encoding of whole texts by a byte-level BPE file, with the ids of the public ``tokenizers`` library.

``tiktoken`` merges any two neighbours whose bytes together are an entry, the
lowest id first; ``tokenizers`` merges the pairs of its list in their order. The
two agree on every word if ids ascend with the list and every entry, encoded
alone by the list, comes back as itself: the merges inside the span of an entry
are then the same in any word. ``by_rank`` checks this for a file; if it fails
(or the file is of another kind), the library itself encodes.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from kerbside.llm.bpe import _byte_symbols
from kerbside.llm.token_count import library


@functools.lru_cache(maxsize=4)
def spec_of(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.lru_cache(maxsize=4)
def entry_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level file; ids that are not used are empty, added tokens stand for their own text."""
    spec, symbols = spec_of(path), _byte_symbols()
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    out = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for word, k in vocab.items():
        out[k] = bytes(symbols[c] for c in word)
    for word, k in added.items():
        out[k] = word.encode()
    return out


@functools.lru_cache(maxsize=4)
def by_rank(path: str) -> bool:
    """Whether the ids of ``tiktoken`` are those of the library; see the module's docstring. Half a second, on the driver."""
    from tokenizers import Tokenizer

    spec = spec_of(path)
    model, front = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback", "unk_token"))
    added = all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or not added or spec.get("normalizer") or front.get("type") != "ByteLevel" or front.get("add_prefix_space") or front.get("use_regex") is False:
        return False
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or min(made, default=256) < 256:
        return False
    alone = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "added_tokens": [], "post_processor": None}))
    words = list(vocab)
    return all(e.ids == [vocab[w]] for w, e in zip(words, alone.encode_batch_fast(words), strict=True))


@functools.lru_cache(maxsize=4)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    spec = spec_of(path)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    taken = set(added.values())
    ranks = {b: k for k, b in enumerate(entry_bytes(path)) if k not in taken}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@functools.lru_cache(maxsize=4)
def _plain_library(path: str):
    from tokenizers import Tokenizer

    library(path)  # sets what the library reads from the environment
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = True
    return own


def encode(text: str, path: str, fast: bool, specials: bool = True) -> np.ndarray:
    """Ids as uint32. specials: strings of added tokens inside the text are those tokens (the library's default), else plain text."""
    if fast:
        ids = _ranks(path).encode(text, allowed_special="all") if specials else _ranks(path).encode_ordinary(text)
    else:
        ids = (library(path) if specials else _plain_library(path)).encode(text, add_special_tokens=False).ids
    return np.array(ids, np.uint32)
