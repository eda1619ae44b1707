"""Token ids of the public byte-level BPE.

Ids are those of the `tokenizers` library for byte_bpe_50k.json. The same vocabulary as ranks gives the same ids several
times faster; a text that this path refuses goes through `tokenizers` itself. Tests hold the two against each other.
"""

from __future__ import annotations

import base64

import numpy as np

VOCABULARY, RANKS, SPECIAL, SPECIAL_ID = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>", 50256
#: Ends each document.
END = 0

_LOADED: dict = {}


def _fast():
    if "fast" not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(RANKS), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _LOADED["fast"] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return _LOADED["fast"]


def _plain():
    if "plain" not in _LOADED:
        import public_tokenizers
        from tokenizers import Tokenizer

        _LOADED["plain"] = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return _LOADED["plain"]


def plain_ids(text: str) -> np.ndarray:
    """Straight from `tokenizers`."""
    return np.array(_plain().encode(text, add_special_tokens=False).ids, np.uint32)


def ids(text: str | None) -> np.ndarray:
    """The text's ids and the end id, unsigned 32-bit."""
    if not text:
        return np.array([END], np.uint32)
    try:
        found = _fast().encode_to_numpy(text, allowed_special="all")
    except (ValueError, RuntimeError):
        found = plain_ids(text)
    return np.append(found.astype(np.uint32, copy=False), np.uint32(END))


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: only the first may be shorter than capacity, if there are several."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]
