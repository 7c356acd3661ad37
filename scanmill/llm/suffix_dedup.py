"""Exact substring dedup: repeated strings of a fixed length by suffix arrays over shards of candidate text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.common import like, written

LENGTH = 400
GRAM = 32
SHARD = 256
"""Most contexts of one gram in a shard; grams with more are spread over shards that are merged afterwards."""
BATCH_BYTES = 2 << 20
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_STEP = 1 << 20
_BYTES = np.array([1 << (8 * k) for k in range(8)], np.uint64)
"""A difference of two words below the k-th of these leaves their first 8 - k bytes equal."""


def _joined(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """Hashes of strings from those of their halves."""
    mixed = left ^ (left >> np.uint64(29))
    mixed *= np.uint64(_FACTORS[level % len(_FACTORS)])
    mixed += right
    return mixed


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes in a row."""
    hashes = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTORS[0])
    size = 1
    while size < GRAM:
        hashes = _joined(hashes[:-size], hashes[size:], size.bit_length())
        size *= 2
    return hashes ^ (hashes >> np.uint64(31))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, gram hash) for each anchor of a text: the windows first .. first + count - 1 of `length` bytes
    that have it in common as their least gram, the leftmost of equals.

    A window's anchor depends on its bytes alone, so equal windows anywhere have equal anchors at equal places."""
    firsts, marks = [], []
    windows = len(data) - length + 1
    for at in range(0, max(0, windows), _STEP):
        part = data[at : at + _STEP + length - 1]
        hashes = _gram_hashes(part)
        bits = np.uint64(len(hashes).bit_length())
        places = np.arange(len(hashes), dtype=np.uint64)
        least = _least(((hashes >> bits) << bits) | places, length - GRAM + 1)
        where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        firsts.append(starts + at)
        marks.append(hashes[where[starts]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate(firsts)
    return first, np.diff(np.r_[first, windows]), np.concatenate(marks)


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that sorts like them; zeros follow the end."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)].astype(np.uint64)
    return out


def suffix_array(words: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement: suffixes are grouped by eight bytes, then groups of more
    than one are split by the group of the suffix 8, 16, 32 ... further on, until each stands alone."""
    n = len(words)
    order = np.argsort(words, kind="stable").astype(np.int32)
    new = np.r_[True, words[order][1:] != words[order][:-1]]
    heads = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    open_ = np.flatnonzero(~(new & np.r_[new[1:], True])).astype(np.int32)
    step = 8
    while len(open_):
        suffix = order[open_]
        pair = rank[suffix].astype(np.int64) * (n + 1) + rank[np.minimum(suffix + step, n)]
        by_pair = np.argsort(pair, kind="stable")
        suffix, pair = suffix[by_pair], pair[by_pair]
        order[open_] = suffix
        new = np.r_[True, pair[1:] != pair[:-1]]
        heads = np.flatnonzero(new)
        rank[suffix] = open_[np.repeat(heads, np.diff(np.r_[heads, len(pair)]))]
        open_ = open_[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, starts: np.ndarray, spans: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix of each suffix in `order` and the one before it, up to `most` bytes.

    `order` holds the first `spans` suffixes of the texts at `starts`. The texts are walked together, a byte a round: if
    a suffix shares h bytes with the one before it, both without their first byte share h - 1 and stand in the same
    order, so the next suffix shares as many with its own neighbour, and only what lies beyond is compared. Where the
    neighbour's next suffix is not in `order`, the count starts anew."""
    n = len(words)
    place = np.full(n + 1, -1, np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    found = np.zeros(len(order), np.int64)
    by_span = np.argsort(-spans, kind="stable")
    starts, spans = starts[by_span], spans[by_span]
    shared = np.zeros(len(starts), np.int64)
    for step in range(int(spans[0]) if len(spans) else 0):
        live = int(np.searchsorted(-spans, -step, "left"))
        here = starts[:live] + step
        at = place[here]
        before = order[np.maximum(at - 1, 0)]
        length = shared[:live]
        length[at == 0] = 0
        todo = np.flatnonzero((at > 0) & (length < most))
        while len(todo):
            a, b = here[todo] + length[todo], before[todo] + length[todo]
            inside = np.maximum(a, b) < n
            if not inside.all():
                todo, a, b = todo[inside], a[inside], b[inside]
            equal = 8 - np.searchsorted(_BYTES, words[a] ^ words[b], "right")
            length[todo] += equal
            todo = todo[(equal == 8) & (length[todo] < most)]
        found[at] = np.minimum(length, most)
        shared = np.where((at > 0) & (place[before + 1] >= 0), np.maximum(length - 1, 0), 0)
    return found


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its windows of `length` bytes occur as windows twice or more in all of them."""
    sizes = np.array([len(c) for c in contexts])
    starts, spans = np.cumsum(sizes) - sizes, sizes - length + 1
    words = _words(np.frombuffer(b"".join(contexts), np.uint8))
    edges = np.zeros(len(words) + 1, np.int8)
    edges[starts] += 1
    edges[starts + spans] -= 1
    order = suffix_array(words)
    order = order[np.cumsum(edges[:-1])[order] > 0]
    group = np.cumsum(common_prefixes(words, order, starts, spans, length) < length)
    repeated = np.zeros(len(words), bool)
    repeated[order] = np.bincount(group)[group] > 1
    return [repeated[s : s + n] for s, n in zip(starts, spans, strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last places of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


_RUNS = "key long, context long, starts array<int>, ends array<int>"


def _spans(keys, contexts, flags) -> pd.DataFrame:
    rows = [(k, c, *_runs(f)) for k, c, f in zip(keys, contexts, flags, strict=True) if f.any()]
    return pd.DataFrame(rows, columns=["key", "context", "starts", "ends"])


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, key, context, first, span) for each anchor of each row: `span` windows from byte `first`; key and
    context are hashes of the anchor gram and of all bytes of the windows, mark one of the whole text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for doc_id, mark, text in zip(batch["doc_id"], batch["mark"], batch["text"], strict=True):
                data = (text or "").encode()
                first, span, key = anchors(np.frombuffer(data, np.uint8), length)
                context = [xxhash.xxh3_64_intdigest(data[f : f + s + length - 1]) for f, s in zip(first.tolist(), span.tolist(), strict=True)]
                if len(first):
                    parts.append(pd.DataFrame({
                        "doc_id": doc_id, "mark": mark, "key": key.view(np.int64), "context": np.array(context, np.uint64).view(np.int64),
                        "first": first, "span": span,
                    }))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return docs.select("doc_id", "mark", "text").mapInPandas(find, "doc_id long, mark long, key long, context long, first long, span int")


def _local(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows in each shard. A task takes whole shards, about BATCH_BYTES at a time."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.key, row.shard) != last and size >= BATCH_BYTES:
                    yield _spans([r.key for r in held], [r.context for r in held], repeated_windows([r.bytes for r in held], length))
                    held, size = [], 0
                held.append(row)
                size += len(row.bytes)
                last = (row.key, row.shard)
        if held:
            yield _spans([r.key for r in held], [r.context for r in held], repeated_windows([r.bytes for r in held], length))

    dealt = contexts.select("key", "shard", "context", "bytes").repartition("key", "shard").sortWithinPartitions("key", "shard")
    return dealt.mapInPandas(search, _RUNS)


def _prints(data: bytes, length: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(data[i : i + length]) for i in range(len(data) - length + 1)], np.uint64).view(np.int64)


def _merged(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of windows that shards of one gram share. Each shard deals its sorted window hashes into ranges by binary
    search; the runs of a range are merged, and shards look up what they share by binary search again. A gram has as
    many ranges as shards, so no group grows with the gram's frequency."""

    def deal(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        found = np.unique(np.concatenate([_prints(b, length) for b in shard["bytes"]]))
        ranges = int(shard["shards"].iloc[0])
        bounds = np.linspace(-(2.0**63), 2.0**63, ranges + 1)[1:-1].astype(np.int64)
        parts = np.split(found, np.searchsorted(found, bounds))
        rows = [(key[0], r, key[1], p.tolist()) for r, p in enumerate(parts) if len(p)]
        return pd.DataFrame(rows, columns=["key", "range", "shard", "prints"])

    def merge(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        parts = [np.array(p, np.int64) for p in runs["prints"]]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        shared = values[counts > 1]
        rows = []
        for shard, part in zip(runs["shard"], parts, strict=True):
            at = np.searchsorted(part, shared)
            own = shared[part[np.minimum(at, len(part) - 1)] == shared]
            if len(own):
                rows.append((key[0], shard, own.tolist()))
        return pd.DataFrame(rows, columns=["key", "shard", "prints"])

    def mark(key: tuple, shard: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or found.empty:
            return _spans([], [], [])
        shared = np.unique(np.concatenate([np.array(p, np.int64) for p in found["prints"]]))
        flags = []
        for data in shard["bytes"]:
            own = _prints(data, length)
            flags.append(shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own)
        return _spans(shard["key"], shard["context"], flags)

    split = contexts.filter("shards > 1").select("key", "shard", "shards", "context", "bytes")
    dealt = split.groupBy("key", "shard").applyInPandas(deal, "key long, range int, shard int, prints array<long>")
    shared = dealt.groupBy("key", "range").applyInPandas(merge, "key long, shard int, prints array<long>")
    return split.groupBy("key", "shard").cogroup(shared.groupBy("key", "shard")).applyInPandas(mark, _RUNS)


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, starts): for each row with any, the runs (first, last) of windows that occur elsewhere too."""
    found = written(occurrences(docs, length))
    place = F.struct("doc_id", "mark", "first", "span")
    distinct = written(found.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(place).alias("at")))
    grams = distinct.groupBy("key").agg(F.count("*").alias("contexts"), F.sum("n").alias("total")).filter("total > 1")
    shared = written(distinct.join(grams, "key").select("key", "context", "contexts", "n", "at.*"))
    whole = shared.filter("n > 1").select("key", "context", F.array(F.lit(0)).alias("starts"), F.array(F.col("span") - 1).alias("ends"))
    shards = F.ceil(F.col("contexts") / SHARD).cast("int")
    asked = shared.filter("contexts > 1").select(
        "key", "context", "doc_id", "mark", "first", "span", shards.alias("shards"), F.pmod("context", shards).cast("int").alias("shard")
    )
    texts = docs.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "text")
    cut = F.substring(F.encode("text", "utf-8"), F.col("first").cast("int") + 1, F.col("span") + length - 1)
    contexts = written(
        asked.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
        .select("key", "context", "shard", "shards", cut.alias("bytes"))
    )
    runs = whole.unionByName(_local(contexts, length)).unionByName(_merged(contexts, length))
    each = runs.select(F.col("key").alias("k"), F.col("context").alias("c"), F.explode(F.arrays_zip("starts", "ends")).alias("run"))
    windows = found.join(each, (F.col("key") == F.col("k")) & (F.col("context") == F.col("c"))).select(
        "doc_id", "mark", F.struct((F.col("first") + F.col("run.starts")).alias("s"), (F.col("first") + F.col("run.ends")).alias("e")).alias("run")
    )
    return windows.groupBy("doc_id", "mark").agg(F.collect_list("run").alias("runs"))


def cut_repeats(text: str | None, runs: list[tuple[int, int]], length: int) -> tuple[int, list[tuple[int, int]], bytes]:
    """(length in bytes, removed spans, kept bytes) of a text whose windows in `runs` are repeated."""
    data = (text or "").encode()
    spans: list[list[int]] = []
    for first, last in sorted(runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    ends = [0, *(e for _, e in spans)]
    kept = b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(data)], strict=True))
    return len(data), [(s, e) for s, e in spans], kept


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans) of every row of `docs` (doc_id, text).

    Every byte is removed that a string of `length` bytes covers which also starts elsewhere in any row; strings are judged
    on the input and never cross rows. Windows of `length` bytes meet by their anchor, a gram chosen by their bytes alone.
    Windows around anchors that occur as a whole in several places are repeated; those that share a gram only are put into
    shards by gram, where a suffix array and its common prefixes find the repeated ones, and grams with more than SHARD
    contexts are merged across shards. Spans are maximal runs of removed bytes (start, end); kept_text is what is left, without the parts of a letter that
    a span cuts. Null and short texts lose
    nothing. Repeated rows are each other's copies; rows are told apart by doc_id and text, so doc_id may be null or repeat."""
    rows = like(docs, ["doc_id", "text"]).withColumn("mark", F.xxhash64("text"))
    found = repeats(rows, length).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "runs")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start: long, end: long>>")
    def remove(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, runs, strict=True):
            size, spans, kept = cut_repeats(text, [] if own is None else [(r["s"], r["e"]) for r in own], length)
            out.append((size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"), [{"start": s, "end": e} for s, e in spans]))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"])

    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return joined.select("doc_id", remove("text", "runs").alias("r")).select("doc_id", "r.*")
