"""Tokenizers on executors, with their models sent as bytes."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import tiktoken
from tokenizers import Tokenizer

_LOADED: dict = {}  # a worker's tokenizers by the digest of their model


class WordIds(dict):
    """Word -> little-endian ids of a tokenizer that treats white-space separated words alone.

    Encoding a text is then the concatenation of its words' ids, each word
    encoded once for each worker.  ``bytes.split`` cuts at ASCII white space,
    which such a tokenizer drops.  The memo is emptied when it is full.
    """

    LIMIT, LONGEST = 1_000_000, 48

    def __init__(self, model: bytes):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(model.decode())

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = ids
        return ids

    def all(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


def word_ids(model: bytes) -> WordIds:
    key = ("word", hashlib.sha256(model).digest())
    if key not in _LOADED:
        _LOADED[key] = WordIds(model)
    return _LOADED[key]


def byte_bpe(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """A byte-level tokenizer without special tokens: their strings are ordinary text."""
    key = ("byte", hashlib.sha256(ranks).digest(), pattern)
    if key not in _LOADED:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _LOADED[key] = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _LOADED[key]
