"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact weighted shingle similarity."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.llm.common import like

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
ITEMS_AT_ONCE = 20_000
"""Benchmark items whose index goes to the executors at once; a larger benchmark takes several passes."""
_BLOCKS = 8
_MATCH = ("item_id", "similarity", "first_word", "n_words")
_WORD = re.compile(r"[^\W_]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) | 1


def _shingles(codes: np.ndarray) -> np.ndarray:
    """A hash of each five words in a row."""
    n = len(codes) - SHINGLE + 1
    mixed = np.zeros(max(0, n), np.uint64)
    for i, factor in enumerate(_MIX):
        mixed = (mixed ^ (mixed >> np.uint64(29))) + codes[i : i + len(mixed)] * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(32))


def _weights(words: list[str]) -> np.ndarray:
    """A shingle weighs as many points as its words have letters: long runs tell more than short ones."""
    ends = np.cumsum([0, *map(len, words)])
    return ends[SHINGLE:] - ends[:-SHINGLE]


def _bit_sums(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of the shingles' bits, each plus or minus its weight; the first row is zero."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    sums = np.zeros((len(shingles) + 1, 64), np.int64)
    np.cumsum(bits * weights[:, None], axis=0, out=sums[1:])
    return sums


def _window_prints(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the `size` shingles from each place of `at`: the sign of the weighted sum of their bits."""
    return np.packbits(sums[at + size] > sums[at], axis=1)


def _bag(shingles: np.ndarray, weights: np.ndarray) -> dict[int, int]:
    bag: dict[int, int] = defaultdict(int)
    for s, w in zip(shingles.tolist(), weights.tolist(), strict=True):
        bag[s] += w
    return bag


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    shared = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Index:
    """Fingerprints of benchmark items, and for each item length a table of blocks."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.codes: dict[str, int] = {}
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        by_length = defaultdict(list)
        hashes = []
        for item_id, text in items:
            words = words_of(text)
            if len(words) < SHINGLE:
                if words:
                    self.short[tuple(words)].append(item_id)
                continue
            self.codes |= {w: _code(w) for w in words}
            shingles, weights = _shingles(np.array([self.codes[w] for w in words], np.uint64)), _weights(words)
            hashes.append(shingles)
            by_length[len(words)].append((item_id, _bag(shingles, weights), _window_prints(_bit_sums(shingles, weights), np.zeros(1, int), len(shingles))[0]))
        self.first: dict[str, set[int]] = defaultdict(set)
        for run in self.short:
            self.first[run[0]].add(len(run))
        self.known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.lengths = {}
        spread = np.arange(256)
        for length, found in by_length.items():
            prints = np.array([f[2] for f in found])
            # near[block][value]: items whose block differs from the value in at most RADIUS // _BLOCKS bits.
            near = np.array([np.bitwise_count(spread[:, None] ^ prints[None, :, b]) <= RADIUS // _BLOCKS for b in range(_BLOCKS)])
            self.lengths[length] = (found, prints, near)

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the most similar window of each item that reaches the threshold."""
        words = words_of(text)
        best = self._short(words)
        if len(words) >= SHINGLE and len(self.known):
            known = np.fromiter(map(self.codes.get, words, repeat(0)), np.uint64, len(words))
            runs = np.convolve(known != 0, np.ones(SHINGLE, int), "valid") == SHINGLE
            starts = np.flatnonzero(runs)
            if len(starts):
                found = _shingles(known)[starts]
                hits = starts[self.known[np.searchsorted(self.known, found) % len(self.known)] == found]
                if len(hits):
                    self._windows(words, hits, threshold, best)
        return [(item, *found) for item, found in sorted(best.items())]

    def _short(self, words: list[str]) -> dict[int, tuple[float, int, int]]:
        """The first place of each item of fewer than SHINGLE words: a run of exactly its words."""
        best = {}
        for at, word in enumerate(words):
            for size in self.first.get(word, ()):
                for item in self.short.get(tuple(words[at : at + size]), ()):
                    best.setdefault(item, (1.0, at, size))
        return best

    def _windows(self, words: list[str], hits: np.ndarray, threshold: float, best: dict) -> None:
        """Windows without a benchmark shingle have similarity zero, so only those around hits are looked at. A part
        shorter than an item is the whole document, and one window."""
        reach = max(self.lengths)
        gaps = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
        for group in np.split(hits, gaps):
            begin, end = max(0, group[0] - reach), min(len(words), group[-1] + reach + SHINGLE)
            part = words[begin:end]
            shingles = _shingles(np.array([self.codes.get(w) or _code(w) for w in part], np.uint64))
            weights = _weights(part)
            seen = np.zeros(len(shingles) + 1, np.int64)
            np.add.at(seen, group - begin + 1, 1)
            seen = np.cumsum(seen)
            sums = _bit_sums(shingles, weights)
            for length, (items, prints, near) in self.lengths.items():
                size = min(length - SHINGLE + 1, len(shingles))
                at = np.flatnonzero(seen[size:] - seen[:-size])
                if not len(at):
                    continue
                windows = _window_prints(sums, at, size)
                close = reduce(np.logical_or, (near[b][windows[:, b]] for b in range(_BLOCKS)))
                at_window, at_item = np.nonzero(close)
                within = np.bitwise_count(windows[at_window] ^ prints[at_item]).sum(axis=1) <= RADIUS
                for w, i in zip(at_window[within], at_item[within], strict=True):
                    a = int(at[w])
                    value = similarity(items[i][1], _bag(shingles[a : a + size], weights[a : a + size]))
                    found = (value, int(begin) + a, size + SHINGLE - 1)
                    if value >= threshold and (items[i][0] not in best or value > best[items[i][0]][0]):
                        best[items[i][0]] = found


def _search(index: Broadcast, threshold: float) -> Callable[[Column], Column]:
    @F.pandas_udf("array<struct<item_id: long, similarity: double, first_word: long, n_words: long>>")
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(_MATCH, m, strict=True)) for m in index.value.matches(t, threshold)] for t in texts])

    return search


def matches_of(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator[Callable[[Column], Column]]:
    """Column functions, one for each part of the benchmark: text to its matches. The parts are drawn by hash."""
    items = like(benchmark, ["item_id", "text"])
    parts = max(1, -(-items.count() // ITEMS_AT_ONCE))
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield _search(docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in some.collect()])), threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item that a document holds, by its best window.

    Words are runs of letters and digits, lower-cased, so that punctuation and case hide nothing. A document holds an
    item if a window of as many words as the item has, or the whole document where it is shorter, reaches `threshold` in weighted Jaccard similarity of five-word
    shingles. Windows are compared by SimHash: 64 bits in eight blocks, looked up with up to two bits changed, find every
    fingerprint within RADIUS (beyond it all eight blocks would differ three times); the similarity of what is found is exact.
    Windows that share no shingle with any item have similarity zero and are passed over.
    Items of fewer than five words match exact runs of their words anywhere; empty items and null texts match nothing; ties
    keep the first window. Repeated documents and items are each reported. The index of about ITEMS_AT_ONCE items is
    broadcast at a time; larger benchmarks take a pass over the documents for each part."""
    rows = like(docs, ["doc_id", "text"])
    found = [rows.select("doc_id", F.explode(m(F.col("text"))).alias("m")) for m in matches_of(docs, benchmark, threshold)]
    return reduce(DataFrame.unionByName, found).select("doc_id", "m.item_id", "m.similarity", "m.first_word", "m.n_words")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that hold no item; all columns stay."""
    for matches in matches_of(docs, benchmark, threshold):
        docs = docs.filter(F.size(matches(F.col("text"))) == 0)
    return docs
