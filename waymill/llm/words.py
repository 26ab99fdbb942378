"""Words of a text as the leak search compares them, and their 64-bit hashes."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

_TAG = re.compile(r"<[^<>]*>")
_DROPPED = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Tags become spaces, entities are decoded, invisible characters dropped, NFKC, lower case, runs of letters and digits."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _DROPPED.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


class WordHashes:
    """Hashes of words, each distinct word of a batch hashed once."""

    def __init__(self, limit: int = 1_000_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def of(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in tokens), dtype=np.uint64, count=len(tokens))
