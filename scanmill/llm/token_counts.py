"""Token counts of a byte-level vocabulary: pre-tokens that are one token are counted, only the rest is merged."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanmill.llm.common import like

LIMIT = 1024
_KEPT = 400_000
"""So many merged pre-tokens a worker remembers; further ones are merged anew each time."""
_KEPT_LETTERS = 64
_BLOCK = 1 << 20


@lru_cache
def _settled() -> frozenset[str]:
    """Characters that have a Unicode category: they are in the same class for the pattern here and in the library, which a test
    shows for each. The class of all others depends on the Unicode version of a library."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Co", "Cs"))


def settled(text: str) -> bool:
    return text.isascii() or _settled().issuperset(text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones are themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """The text in parts of about `size` letters, cut before a blank that follows a visible letter; no pre-token spans such a place."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Ids(dict):
    """Ids by pre-token; those that are not known are merged, and remembered within bounds."""

    def __init__(self, whole: dict[str, tuple[int, ...]], merge: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__(whole)
        self.room, self.merge = len(whole) + _KEPT, merge

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece)
        if len(self) < self.room and len(piece) <= _KEPT_LETTERS:
            self[piece] = ids
        return ids


class WholeTokens:
    """Ids and counts by the byte-level vocabulary file at `path`.

    A vocabulary string is proved whole by running the merges on it once: if they end in that one token, a pre-token equal
    to the string is one token in every text, as merges never cross pre-tokens. Texts are cut by the vocabulary's pattern;
    texts with a character of no Unicode category go to the library. Special strings are plain text unless asked for."""

    def __init__(self, path: str) -> None:
        self.library, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        letters = {letter: b for b, letter in enumerate(byte_letters())}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.bytes_of: dict[int, bytes] = {
            i: v.encode() if v in special else bytes(letters[c] for c in v) for v, i in self.library.get_vocab().items()
        }
        whole = {}
        for entry, i in self.library.get_vocab().items():
            if entry not in special and [t.id for t in self.library.model.tokenize(entry)] == [i]:
                try:
                    whole[self.bytes_of[i].decode()] = (i,)
                except UnicodeDecodeError:
                    pass  # part of a letter: never a pre-token
        self.whole = frozenset(whole)
        self.known = _Ids(whole, self._merger(path, special))
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _merger(self, path: str, special: set[str]) -> Callable[[str], tuple[int, ...]]:
        """The merges of one pre-token. Where merges are in the order of their ids, as a test of the file shows, a faster library
        that merges by id gives the same; it takes any vocabulary string as one token, so strings that are not whole go elsewhere."""
        model, letters, vocabulary = self.library.model, byte_letters(), self.library.get_vocab()

        def slow(piece: str) -> tuple[int, ...]:
            return tuple(t.id for t in model.tokenize("".join(letters[b] for b in piece.encode())))

        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        order = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(a >= b for a, b in pairwise(order)):
            return slow
        ranks = {self.bytes_of[i]: i for v, i in vocabulary.items() if v not in special}
        halved = {v for v in ranks if v.decode(errors="ignore") not in self.whole}
        fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

        def merge(piece: str) -> tuple[int, ...]:
            data = piece.encode()
            return slow(piece) if data in halved else tuple(fast(data))

        return merge

    def ids(self, text: str) -> list[int]:
        """All ids of a text; the strings of special tokens are plain text."""
        if not settled(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        ids = self.known.__getitem__
        return list(chain.from_iterable(chain.from_iterable(map(ids, self.pieces(part)) for part in blocks(text))))

    def count(self, text: str) -> int:
        """The number of ids, special strings being one each, as the library has it by default."""
        if not settled(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        total, rest = 0, [text]
        if self.special and self.special.search(text):
            rest = self.special.split(text)
            total = len(rest) - 1
        known, whole = self.known.__getitem__, self.whole
        for part in chain.from_iterable(map(blocks, rest)):
            pieces = self.pieces(part)
            merged = [p for p in pieces if p not in whole]
            total += len(pieces) - len(merged) + sum(map(len, map(known, merged)))
        return total


@lru_cache(4)
def whole_tokens(path: str) -> WholeTokens:
    """One for each Python worker, as the proof takes longer than many documents."""
    return WholeTokens(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of `docs` (doc_id, text; other columns are ignored).

    Counts are those of the library without begin, end or added tokens; a special token's string inside a text counts one.
    Texts are read whole, in blocks. Null and empty texts have no bytes and no tokens. Repeated rows and null ids are
    counted each on their own; an empty table gives no rows. No shuffle."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = whole_tokens(tokenizer_path).count
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    rows = like(docs, ["doc_id", "text"]).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counted("text").alias("n_tokens")
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
