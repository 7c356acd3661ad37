"""Alignment of two tokenizers: linked id pairs are counted over the corpus from compressed sorted runs, merged by a heap."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.common import like, written
from scanmill.llm.token_counts import whole_tokens

RADIX_BITS = 6
RUN_LINKS = 2_000_000
"""So many links a task gathers before it writes them as one run for each radix; a longer text is a run of its own."""
GROUP_RECORDS = 2_000_000
"""About so many records one merge takes; a radix with more, as one very frequent id makes it, is dealt into several merges."""
_DOC_BITS = 20
_TEXTS = 64
_STEP = 4096


@lru_cache(4)
def _pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes | None]]:
    """The piece vocabulary and the bytes of each id; ids without bytes of their own have None."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def content(i: int) -> bytes | None:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:5], 16)])
        return None if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace("▁", " ").encode()

    return model, [content(i) for i in range(model.get_piece_size())]


def widths(a_path: str, b_path: str) -> tuple[int, int]:
    """Bits that hold every id of either vocabulary."""
    return max(whole_tokens(a_path).bytes_of).bit_length(), len(_pieces(b_path)[1]).bit_length()


class Aligner:
    """Tokens of both vocabularies for texts, with their end offsets in the bytes of blank + text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, (self.b, self.b_bytes) = whole_tokens(a_path), _pieces(b_path)
        self.a_sizes = np.zeros(max(self.a.bytes_of) + 1, np.int64)
        for i, content in self.a.bytes_of.items():
            self.a_sizes[i] = len(content)
        self.b_sizes = np.array([len(x or b"") for x in self.b_bytes], np.int64)
        names = [*map(str, range(len(self.a_sizes))), *map(str, range(len(self.b_sizes)))]
        self.names = np.array([n + sep for sep in ",|;" for n in names], object)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for each text; None for null and empty texts and where the bytes of either differ from the text's."""
        for at in range(0, len(texts), _TEXTS):
            part = texts[at : at + _TEXTS]
            of_b = iter(self.b.encode([t for t in part if t], num_threads=1))
            for text in part:
                if not text:
                    yield None
                    continue
                a, b = self.a.ids(" " + text), next(of_b)
                data = b" " + text.encode()
                try:
                    same = b"".join(map(self.b_bytes.__getitem__, b)) == data
                except TypeError:  # an id without bytes
                    same = False
                a, b = (np.fromiter(x, np.int64, len(x)) for x in (a, b))
                # A byte-level vocabulary only cuts the text's bytes, so their number tells whether any are missing.
                yield (a, b) if same and self.a_sizes[a].sum() == len(data) else None

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, str]:
        """(A ids, B ids, groups, text of the groups): one entry for each pair of token occurrences whose byte ranges overlap.

        Every end of a token closes one stretch of bytes that lies in one A and one B token, and each overlap is one stretch."""
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted runs: a merge
        twice = ends[1:] == ends[:-1]
        common, ends = ends[1:][twice], ends[np.r_[True, ~twice]]
        key = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.diff(key, append=key[-1])
        separator = np.where(step == 0, 0, np.where(key & 1, 2, 1))
        codes = np.concatenate([a, b + len(self.a_sizes)])[order]
        spelled = "".join(self.names[separator * (len(self.a_sizes) + len(self.b_sizes)) + codes].tolist())[:-1]
        return a[np.searchsorted(a_ends, ends)], b[np.searchsorted(b_ends, ends)], len(common), spelled


@lru_cache(2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, zstd-compressed byte by byte, as high bytes are alike."""
    planes = b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _restored(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel().astype(np.int64) for p in planes]


def _runs(links: list[np.ndarray], bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(radix, records, pairs, records' places) from keys radix | pair | document: sorted, equal ones counted, one run a radix.

    `pairs` holds each id pair once, as steps, with its number of records; the other blob each record's document and how
    often the document has the pair."""
    keys = np.sort(np.concatenate(links))
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times, keys = np.diff(first, append=len(keys)), keys[first]
    radix = keys >> (bits + _DOC_BITS)
    for begin, end in pairwise([*np.flatnonzero(np.diff(radix, prepend=-1)).tolist(), len(keys)]):
        pair = (keys[begin:end] >> _DOC_BITS) & ((1 << bits) - 1)
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        yield (
            int(radix[begin]), end - begin, _squeezed(np.diff(pair[heads], prepend=0), np.diff(heads, append=len(pair))),
            _squeezed(keys[begin:end] & ((1 << _DOC_BITS) - 1), times[begin:end]),
        )


_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, flush long, place int, "
    "radix int, records long, pairs binary, places binary"
)


def _aligned(docs: DataFrame, a_path: str, b_path: str, spelled: bool) -> DataFrame:
    """One row for each document, then rows of runs, of which each has a radix."""
    a_bits, b_bits = widths(a_path, b_path)
    if RADIX_BITS + a_bits + b_bits + _DOC_BITS > 63:
        raise ValueError("ids of these vocabularies don't fit a key of 63 bits")
    names = [f.strip().split()[0] for f in _ALIGNED.split(",")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(f.strip().split()[0], kinds[f.strip().split()[1]]) for f in _ALIGNED.split(",")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        flush = TaskContext.get().partitionId() << 32
        held, links, place = [], 0, 0

        def runs() -> pa.RecordBatch:
            rows = [(None,) * 7 + (flush, None, *run) for run in _runs(held, a_bits + b_bits)]
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            for doc_id, pair in zip(batch.column("doc_id").to_pylist(), aligner.tokens(texts), strict=True):
                if place >> _DOC_BITS or links >= RUN_LINKS:
                    if held:
                        yield runs()
                    flush, held, links, place = flush + 1, [], 0, 0
                if pair is None:
                    rows.append((doc_id, 0, 0, 0, 0, "", "", flush, place))
                else:
                    a, b, groups, text = aligner.links(*pair)
                    radix = a & ((1 << RADIX_BITS) - 1)
                    held.append(((((radix << a_bits) | a) << b_bits | b) << _DOC_BITS) | place)
                    links += len(a)
                    digest = hashlib.sha256(text.encode()).hexdigest()
                    rows.append((doc_id, len(pair[0]), len(pair[1]), groups, len(a), digest, text if spelled else None, flush, place))
                place += 1
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
        if held:
            yield runs()

    return like(docs, ["doc_id", "text"]).mapInArrow(align, _ALIGNED)


def _stream(pairs: bytes) -> Iterator[tuple[int, int]]:
    steps, counts = _restored(pairs, 2)
    ids = np.cumsum(steps)
    for at in range(0, len(ids), _STEP):
        yield from zip(ids[at : at + _STEP].tolist(), counts[at : at + _STEP].tolist(), strict=True)


def _counted(runs: DataFrame) -> DataFrame:
    """(radix, pair, n): in how many documents an id pair is linked. The runs of each merge are read side by side through a heap."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, counts = [], []
        for pair, n in heapq.merge(*map(_stream, group["pairs"])):
            if ids and ids[-1] == pair:
                counts[-1] += n
            else:
                ids.append(pair)
                counts.append(n)
        return pd.DataFrame({"radix": key[0], "pair": ids, "n": counts})

    merged = runs.select("radix", "part", "pairs").groupBy("radix", "part").applyInPandas(merge, "radix int, pair long, n long")
    return merged.groupBy("radix", "pair").agg(F.sum("n").alias("n"))


def _contributions(runs: DataFrame, counts: DataFrame, b_bits: int) -> DataFrame:
    """(flush, place, best, total): what the pairs of one merge give to each document.

    Counts come sorted by pair, so all pairs of one A id stand together and give its highest count; then the records of each
    run pass by, look their pair up and add to their document."""

    def give(runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("pair")
        pairs, n = counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
        side = pairs >> b_bits
        heads = np.flatnonzero(np.diff(side, prepend=-1))
        top = np.repeat(np.maximum.reduceat(n, heads), np.diff(heads, append=len(n))) if len(n) else n
        out = []
        for flush, ids, places in zip(runs["flush"], runs["pairs"], runs["places"], strict=True):
            steps, records = _restored(ids, 2)
            at = np.repeat(np.searchsorted(pairs, np.cumsum(steps)), records)
            place, times = _restored(places, 2)
            total, best = np.zeros(place.max() + 1, np.int64), np.zeros(place.max() + 1, np.int64)
            np.add.at(total, place, n[at] * times)
            np.add.at(best, place, np.where(n[at] == top[at], times, 0))
            some = np.flatnonzero(total)
            out.append(pd.DataFrame({"flush": flush, "place": some, "best": best[some], "total": total[some]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["flush", "place", "best", "total"])

    left, right = runs.groupBy("radix", "part"), counts.groupBy("radix", "part")
    return left.cogroup(right).applyInPandas(give, "flush long, place int, best long, total long")


def aligned(docs: DataFrame, a_path: str, b_path: str, spelled: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs` (doc_id, text); with
    `spelled` also the groups as text.

    Both vocabularies cut blank + text; byte offsets where tokens of both end cut the tokens into groups, and tokens whose
    bytes overlap are linked. Special strings are plain text. Null and empty texts, and texts that either vocabulary does not
    give back byte by byte, have no tokens: zeros and empty strings. Counts are over rows, so repeated rows count each on their
    own, whatever their id; ids may be null or repeat. An empty table gives no rows.

    Tasks write their documents' distinct linked pairs as zstd runs, dealt by the low bits of the A id and sorted A id first.
    Merges take whole runs of one radix, about GROUP_RECORDS records each, so an id that is in every document is counted in many
    merges whose sums meet as (pair, count) rows; a merge holds at most the distinct pairs of its radix, bounded by the two
    vocabularies. Runs and documents' rows are written once to the shared folder. Groups' texts never leave their task."""
    found = written(_aligned(docs, a_path, b_path, spelled))
    runs = found.filter("radix is not null").select("radix", "flush", "records", "pairs", "places")
    sizes = {r.radix: r.records for r in runs.groupBy("radix").agg(F.sum("records").alias("records")).collect()}
    parts = F.array(*(F.lit(max(1, -(-sizes.get(k, 0) // GROUP_RECORDS))) for k in range(1 << RADIX_BITS)))
    parts_of = F.element_at(parts, F.col("radix") + 1)
    runs = runs.withColumn("part", F.pmod(F.xxhash64("flush"), parts_of).cast("int"))
    counts = _counted(runs).select("radix", "pair", "n", F.explode(F.sequence(F.lit(0), parts_of - 1)).alias("part"))
    given = _contributions(runs.select("radix", "part", "flush", "pairs", "places"), counts, widths(a_path, b_path)[1])
    sums = given.groupBy("flush", "place").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    rows = found.filter("radix is null").join(sums, ["flush", "place"], "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", *(["groups"] if spelled else []),
    )
