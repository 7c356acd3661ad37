"""Packing of token pieces into sequences: best fit inside partitions, then a tree of merges for what is not full."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.common import like, written

CAPACITY = 2048
CHUNK = 200_000
"""Items that one task holds at a time: beyond it best fit starts anew."""
FULL = 0.995
"""Bins filled to this part of the capacity leave the tree."""
FAN_IN = 8
_KEPT_WORDS = 400_000
_TEXTS = 500
_BIN = "fill long, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"
_ODD = re.compile("[Σͅ\x1c-\x1f\x85᠎]")


class WordTokenizer:
    """Ids of the word-end BPE vocabulary at `path`.

    White space is dropped by this vocabulary, so the ids of a text are those of its white-space runs, one after the
    other; runs are kept in a bounded table. Texts whose normal form differs between libraries (not composed, special
    token strings, final sigma, unusual separators) go to the library's own encoder whole."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        visible = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        byte_of = {chr(b): b for b in visible}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {}
        for token, rank in vocabulary.items():
            if not token.startswith("<|") or not token.endswith("|>"):
                end = token.endswith("</w>") and len(token) > 4
                ranks[bytes(byte_of[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = rank
        self.of_piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: set[str]) -> None:
        encode, flat, sizes = self.of_piece, [], []
        for word in words:
            before = len(flat)
            if word.isalpha():
                flat += encode(word.encode() + b"\xff")
            else:
                for piece in self.pieces(word):
                    flat += encode(piece.encode() + b"\xff")
            sizes.append(len(flat) - before)
        n = len(self.known)
        self.flat = np.concatenate([self.flat[: self.start[n]], np.array(flat, np.uint32)]) if n else np.array(flat, np.uint32)
        self.start = np.concatenate([self.start[: n + 1], self.start[n] + np.cumsum(sizes)]) if n else np.cumsum([0, *sizes])
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. New words of a part of the texts are learnt together."""
        for at in range(0, len(texts), _TEXTS):
            part = texts[at : at + _TEXTS]
            runs = [None if "<|" in t or _ODD.search(t) or not unicodedata.is_normalized("NFC", t) else t.lower().split() for t in part]
            new = set().union(*(r for r in runs if r)).difference(self.known)
            if len(self.known) + len(new) > _KEPT_WORDS:
                self.known.clear()
                new = set().union(*(r for r in runs if r))
            if new:
                self._learn(new)
            for text, words in zip(part, runs, strict=True):
                if words is None:
                    yield np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                elif not words:
                    yield np.zeros(0, np.uint32)
                else:
                    where = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                    begin, sizes = self.start[where], self.start[where + 1] - self.start[where]
                    ends = np.cumsum(sizes)
                    yield self.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker, as building it takes longer than many documents."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of one document's ids."""
    for piece, start in enumerate(range(0, len(ids), capacity)):
        part = ids[start : start + capacity]
        yield piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit in falling size: each item goes to the bin it fills most; equal sizes keep their order."""
    bins: list[list[int]] = []
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, sizes[i])
        if at == len(room):
            bins.append([])
            b, left = len(bins) - 1, capacity
        else:
            left = room[at]
            b = by_room[left].pop()
            if not by_room[left]:
                room.pop(at)
        bins[b].append(i)
        left -= sizes[i]
        if left:
            if not by_room.setdefault(left, []):
                insort(room, left)
            by_room[left].append(b)
    return bins


def _packed(items: list[tuple[int, list]], capacity: int) -> pd.DataFrame:
    bins = best_fit([fill for fill, _ in items], capacity)
    for b in bins:
        at = 0
        for i in b:
            for piece in items[i][1]:
                piece["offset"] = at
                at += piece["length"]
    return pd.DataFrame({
        "fill": [sum(items[i][0] for i in b) for b in bins], "pieces": [[p for i in b for p in items[i][1]] for b in bins],
    })


_FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")


def local_bins(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(fill, pieces): each partition's documents, tokenised, cut and packed by best fit on their own."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, items = tokenizer(tokenizer_path).ids, []
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], encode([t or "" for t in batch["text"]]), strict=True):
                ids = np.append(ids, np.uint32(0))
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                items += [(p[2], [dict(zip(_FIELDS, (doc_id, *p), strict=True))]) for p in cut(ids, capacity)]
            if len(items) >= CHUNK:
                yield _packed(items, capacity)
                items = []
        if items:
            yield _packed(items, capacity)

    return like(docs, ["doc_id", "text"]).mapInPandas(pack, _BIN)


def merged(bins: DataFrame, capacity: int) -> DataFrame:
    """Bins packed as items, by best fit in each partition."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: list[tuple[int, list]] = []
        for batch in batches:
            items += [(int(fill), list(pieces)) for fill, pieces in zip(batch["fill"], batch["pieces"], strict=True)]
            if len(items) >= CHUNK:
                yield _packed(items, capacity)
                items = []
        if items:
            yield _packed(items, capacity)

    return bins.mapInPandas(pack, _BIN)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of `docs` (doc_id, text).

    A document's ids end with id 0; a null or empty text is that id alone. Only documents beyond `capacity` are cut.
    Partitions pack by best fit; bins filled to FULL are done, and the others are merged as items in a tree: each
    round brings FAN_IN partitions' bins into one and packs again. A bin holds at most `capacity` pieces, and a task at
    most CHUNK bins at a time. The tree ends when one task has seen all bins left, or when a round no longer saves a
    hundredth of them, so that bins which cannot be merged never gather in one task. Repeated rows are packed
    each on its own; an empty table gives no rows. Ids of sequences are unique, not gapless."""
    level = written(local_bins(docs, tokenizer_path, capacity))
    limit = int(FULL * capacity)
    full, rest = level.filter(F.col("fill") >= limit), level.filter(F.col("fill") < limit)
    left = rest.count()
    parts = len(level.inputFiles())
    while left > 1:
        parts = max(1, -(-parts // FAN_IN), -(-left // CHUNK))
        level = written(merged(rest.repartition(parts), capacity))
        full = full.unionByName(level.filter(F.col("fill") >= limit))
        rest = level.filter(F.col("fill") < limit)
        before, left = left, rest.count()
        if parts == 1 or left > max(CHUNK, 0.99 * before):
            break
    bins = full.unionByName(rest).select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    return bins.select("sequence_id", F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset"
    )
