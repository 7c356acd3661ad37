"""Near-duplicates by SimHash: block keys, a join on them, and a check of the Hamming distance."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.llm.common import like, written
from scanmill.llm.components import components

SHINGLE_SEED = 42
_STEP = 1 << 16


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    spans = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, spans, _STEP):
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SHINGLE_SEED) for i in range(at, min(at + _STEP, spans))),
            np.uint64,
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > spans, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return fingerprints


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row: ASCII-lower-cased words, shingles of `shingle` words, XXH64, majority of each bit."""
    return like(docs, ["doc_id", "text"]).select("doc_id", _fingerprints(shingle)("text").alias("fp"))


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each choice of blocks - radius of the blocks. Two fingerprints within the radius differ in at most
    `radius` blocks, so they agree on all blocks of one choice at least."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(edges)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(masks, blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(k).cast("byte").alias("k"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def links(classes: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (a, b) of class representatives whose fingerprints differ in at most `radius` bits, each once.
    `classes` has one row (fp, rep) per fingerprint."""
    keyed = classes.select("fp", "rep", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key")).select(
        "fp", "rep", "key.k", "key.bits"
    )
    left, right = keyed.alias("l"), keyed.alias("r")
    near = (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius)
    same = (F.col("l.k") == F.col("r.k")) & (F.col("l.bits") == F.col("r.bits"))
    return left.join(right, same & near).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text; other columns are ignored).

    Rows of one fingerprint are one class, collapsed before any join, so copies never meet in pairs. The classes meet
    on blocks: 64 bits in `blocks` blocks, a key for each choice of blocks - radius of them (by default 20 keys of
    about 32 bits), then the exact distance. The component is the least doc_id reachable over links.
    Null and empty texts have fingerprint zero and link like any other. Repeated doc_ids link their rows' fingerprints
    only by distance. A row without doc_id belongs to its fingerprint's component but never names one; a component
    without any doc_id is null. An empty table gives an empty result."""
    prints = written(fingerprints(docs, shingle))
    classes = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(links(classes, radius, blocks))
    named = classes.join(joined, classes.rep == joined.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = 3, shingle: int = 3, blocks: int = 6) -> DataFrame:
    """`docs` with one row of each component: the one that names it. All columns stay; of rows that repeat a doc_id one
    stays; rows without doc_id are never judged copies and stay."""
    found = near_duplicates(docs, radius, shingle, blocks)
    copies = found.filter("doc_id <> component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))
