"""Evaluation texts leaking into training text: SimHash windows, multi-index Hamming blocks, exact verification.

Items and documents are cut into windows of words, for each length that occurs among the items' windows. A window gets
a SimHash fingerprint over its word shingles. The items' fingerprints are indexed by four blocks of 16 bits: two
fingerprints within radius r differ by at most r // 4 bits in at least one block, so an index of every key within
r // 4 bits of an item's block finds, with one probe of each block, every fingerprint within the radius. Candidates
are then verified by the exact weighted similarity of their shingles (five words, at least 0.8, weights are the
shingles' numbers of letters).

Two searches use this. `passages`: windows of 12 consecutive words of an item (the whole item where it has fewer),
RADIUS 3; a passage's copy has similarity 1 and distance 0, and the words themselves are compared at the end. `whole`:
item-sized windows, RADIUS_SIMILAR 15, for items that stand in a document with changes; a pair of similarity 0.8
differs in about ten bits of 64, and tests measure what is found against brute force.

The items are the stated query set. They are cut into blocks of bounded size; one block's index at a time is collected
and sent to the tasks, its hits are written, and the index is taken back before the next, so neither the driver nor a
task holds more than one whatever the number of items; every block reads the whole corpus. Documents are never
shuffled: a pass is a scan, a map over Arrow batches and a distinct of the few hits. Texts are processed whole, in
pieces of CHUNK words with an overlap, so that very long texts cost no memory.

Null and empty texts hold nothing, items without words are in no document, repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.words import WordHashes, words
from waymill.session import Scratch

WINDOW, SHINGLE, RADIUS, RADIUS_SIMILAR, SIMILAR = 12, 5, 3, 15, 0.8
#: Item windows of one block, and entries of its index, at most; words looked at in one lot.
BLOCK_WINDOWS, BLOCK_ENTRIES, CHUNK = 200_000, 4_000_000, 60_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ h[i : n + i]) * _MIX
            out ^= out >> np.uint64(31)
        return _mixed(out)


def fingerprints(h: np.ndarray, window: int, known: dict | None = None) -> np.ndarray:
    """SimHash of every window of so many words, over its shingles; known keeps running counts for further lengths."""
    size = min(SHINGLE, window)
    known = {} if known is None else known
    each = window - size + 1
    if size not in known:
        s = shingles(h, size)
        known[size] = s, np.unpackbits(s.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    s, bits = known[size]
    n = len(s) - each + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if each == 1:
        return s
    kind = np.uint8 if each < 256 else np.uint32
    if (size, kind) not in known:  # counts wrap around; their differences don't
        known[size, kind] = np.concatenate([np.zeros((1, 64), kind), np.cumsum(bits, axis=0, dtype=kind)])
    run = known[size, kind]
    total = run[each : each + n] - run[:n]
    set_bits = total > each // 2
    if each % 2 == 0:  # an even split is decided by the first shingle
        set_bits |= (total == each // 2) & (bits[:n] == 1)
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)


def near_masks(bits: int) -> np.ndarray:
    """All 16-bit masks of at most so many bits."""
    return np.array([sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(16), k)], np.int64)


class HammingIndex:
    """Item windows of one length by four 16-bit blocks of their fingerprints."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.blocks = []
        masks = near_masks(radius // 4)
        for b in range(4):
            own = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            keys = (own[:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            there = np.zeros(65536, bool)
            there[keys] = True
            self.blocks.append((there, keys[order].astype(np.uint16), (order // len(masks)).astype(np.int32)))

    def within(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, item window) pairs within the radius; a pair may come out of several blocks."""
        left, right = [], []
        for b, (there, keys, items) in enumerate(self.blocks):
            key = ((probes >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            hit = np.flatnonzero(there[key])
            if not len(hit):
                continue
            start = np.searchsorted(keys, key[hit], "left")
            n = np.searchsorted(keys, key[hit], "right") - start
            probe = np.repeat(hit, n)
            nth = np.arange(len(probe)) - np.repeat(np.cumsum(n) - n, n)
            item = items[np.repeat(start, n) + nth]
            near = np.bitwise_count(probes[probe] ^ self.prints[item]) <= self.radius
            left.append(probe[near])
            right.append(item[near])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)


class ItemIndex:
    """Index of one block of items, small enough to be sent to every task."""

    def __init__(self, rows: list[tuple[int, list[str]]], radius: int = RADIUS):
        """rows: (item id, the words of one window)."""
        self.by_length: dict[int, tuple[HammingIndex, list[int], list[list[str]], np.ndarray]] = {}
        hashes = WordHashes()
        lengths: dict[int, list] = {}
        for item, window in rows:
            lengths.setdefault(len(window), []).append((item, window))
        for n, own in lengths.items():
            h = np.stack([hashes.of(w) for _, w in own])
            prints = np.array([fingerprints(x, n)[0] for x in h], np.uint64)
            self.by_length[n] = (HammingIndex(prints, radius), [i for i, _ in own], [w for _, w in own], h)


def len_weights(window: list[str]) -> np.ndarray:
    """Letters of each shingle."""
    size = min(SHINGLE, len(window))
    n = np.array([len(w) for w in window])
    return np.convolve(n, np.ones(size, int), "valid")


def weighted_similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two windows' shingles, repeated shingles counted as often as they stand."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], wa, len(keys)), np.bincount(at[len(a) :], wb, len(keys))
    top = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / top) if top else 0.0


def pieces(texts: Iterator[tuple[int, list[str]]], overlap: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Documents' words in lots of about CHUNK words; a longer document is cut, its pieces overlapping."""
    lot, size = [], 0
    for doc, tokens in texts:
        for at in range(0, max(len(tokens) - overlap, 1), CHUNK):
            piece = tokens[at : at + CHUNK + overlap]
            lot.append((doc, piece))
            size += len(piece)
            if size >= CHUNK:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def similarity(a: np.ndarray, words_a: list[str], b: np.ndarray, words_b: list[str]) -> float:
    """Weighted similarity of two windows of one length, given their word hashes and words."""
    if (a == b).all():  # the same shingles with the same weights
        return 1.0
    size = min(SHINGLE, len(a))
    return weighted_similarity(shingles(a, size), len_weights(words_a), shingles(b, size), len_weights(words_b))


def hits(lot: list[tuple[int, list[str]]], index: ItemIndex, hashes: WordHashes, exact: bool) -> dict[tuple[int, int], float]:
    """Best similarity by (item, document) of a lot of documents, whose words are looked at in one array; exact keeps
    only windows whose words are the item's."""
    out: dict[tuple[int, int], float] = {}
    tokens = [w for _, t in lot for w in t]
    h = hashes.of(tokens)
    known: dict = {}
    owner = np.repeat(np.arange(len(lot)), [len(t) for _, t in lot])
    for n, (near, items, words_of, hashes_of) in index.by_length.items():
        if len(h) < n:
            continue
        probe, item = near.within(fingerprints(h, n, known))
        inside = owner[probe] == owner[probe + n - 1]  # windows within one document
        for p, i in np.unique(np.stack([probe[inside], item[inside]], 1), axis=0).tolist():
            key, own = (items[i], lot[owner[p]][0]), tokens[p : p + n]
            if out.get(key, 0.0) == 1.0:
                continue
            s = similarity(h[p : p + n], own, hashes_of[i], words_of[i])
            if s >= SIMILAR and (not exact or own == words_of[i]):
                out[key] = max(out.get(key, 0.0), s)
    return out


def item_windows(items: DataFrame, window: int | None = WINDOW) -> DataFrame:
    """(item_id, window) of every distinct window of the items; without a length, of whole items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                w = words(text)
                n = min(window or len(w), len(w))
                rows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
            yield pd.DataFrame(rows, columns=["item_id", "window"])

    whole = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return whole.mapInPandas(run, "item_id bigint, window array<string>").distinct()


def leaks(docs: DataFrame, items: DataFrame, exact: bool = True) -> DataFrame:
    """(item_id, doc_id, similarity) of every document that holds a passage of an item word by word, or with
    exact=False one that holds a window like the whole item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    radius = RADIUS if exact else RADIUS_SIMILAR
    windows = scratch.write(item_windows(items, WINDOW if exact else None), "windows")
    n = windows.count()
    blocks = -(-n // max(1, min(BLOCK_WINDOWS, BLOCK_ENTRIES // len(near_masks(radius // 4)))))
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    out = None
    for b in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(ItemIndex([(r[0], list(r[1])) for r in own.collect()], radius))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            hashes, overlap = WordHashes(), max(index.value.by_length, default=1) - 1
            texts = ((doc, words(text)) for pdf in batches for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True))
            for lot in pieces(texts, overlap):
                rows = [(*key, s) for key, s in hits(lot, index.value, hashes, exact).items()]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "similarity"])

        part = texts.mapInPandas(run, "item_id bigint, doc_id bigint, similarity double")
        if blocks > 1:
            part = scratch.write(part, f"hits-{b}")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return texts.select(F.lit(0).cast("bigint").alias("item_id"), "doc_id", F.lit(0.0).alias("similarity")).limit(0)
    return out.groupBy("item_id", "doc_id").agg(F.max("similarity").alias("similarity"))
