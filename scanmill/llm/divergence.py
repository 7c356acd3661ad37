"""Divergence of sources: each pair of a language's sources priced on a quadtree over the matrix of groups and terms."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmill.llm.common import like, written

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
BLOCK_TERMS = 1024
"""Columns of one matrix; a language's terms are dealt to matrices by hash."""
BLOCK_GROUPS = 256
"""Rows of one side of a matrix; languages with more sources get a matrix for each pair of such blocks."""
K = 4
LEAF = 16
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_HELD_LETTERS = 32 << 20
_COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of Latin letters and of everything beyond ASCII, in UTF-8, only A-Z lower-cased."""
    return _TERM.findall((text or "").encode().lower())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, null names being ''.
    Tasks add up their documents first, in tables of bounded size."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def emptied(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [[lang] * len(terms), [source] * len(terms), [t.decode() for t in terms], list(n.values()), [docs[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        letters = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = held[lang or "", source or ""]
                terms = terms_of(text)
                n.update(terms)
                docs.update(set(terms))
                letters += len(text or "")
                if letters >= _HELD_LETTERS:
                    yield from emptied(held)
                    letters = 0
        yield from emptied(held)

    counted = like(docs, ["lang", "source", "text"]).mapInArrow(count, _COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Quadtree:
    """The nonzero quadrants of a matrix: K x K parts of each, down to leaves of LEAF rows and columns that hold the cells."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, base: np.ndarray) -> None:
        self.base = base
        self.leaves: dict[tuple[int, int], np.ndarray] = {}
        r, c = rows // LEAF, columns // LEAF
        order = np.lexsort((c, r))
        r, c, rows, columns, values = (x[order] for x in (r, c, rows, columns, values))
        heads = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(c, prepend=-1) != 0))
        for at, end in pairwise([*heads.tolist(), len(r)]):
            i, j = int(r[at]), int(c[at])
            leaf = np.repeat(base[i * LEAF : (i + 1) * LEAF, None], LEAF, axis=1)
            leaf[rows[at:end] - i * LEAF, columns[at:end] - j * LEAF] = values[at:end]
            self.leaves[i, j] = leaf
        self.levels = [set(self.leaves)]
        while any(i or j for i, j in self.levels[-1]):
            self.levels.append({(i // K, j // K) for i, j in self.levels[-1]})

    def leaf(self, i: int, j: int) -> np.ndarray:
        found = self.leaves.get((i, j))
        return found if found is not None else self.base[i * LEAF : (i + 1) * LEAF, None]


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) in whole numbers; both are at most SCALE + 1."""
    return (p - q) ** 2 // (p + q)


def pair_sums(tree: Quadtree, width: int) -> np.ndarray:
    """For rows g < h the sum of `price` over the first `width` columns; the rest of the result is undefined.

    Quadrants of two row ranges over one column range are visited together. Where both are zero throughout, every pair of
    their rows is owed the price of two absences times the columns, which is only counted; leaves are priced cell by cell."""
    n = len(tree.base)
    sums, empty = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)

    def visit(level: int, i: int, j: int, c: int) -> None:
        size = LEAF * K**level
        columns = min(width - c * size, size)
        if columns <= 0 or i * size >= n or j * size >= n:
            return
        if (i, c) not in tree.levels[level] and (j, c) not in tree.levels[level]:
            empty[i * size : (i + 1) * size, j * size : (j + 1) * size] += columns
        elif level:
            for a in range(i * K, i * K + K):
                for b in range(max(a, j * K), j * K + K):
                    for d in range(c * K, c * K + K):
                        visit(level - 1, a, b, d)
        else:
            p, q = tree.leaf(i, c), tree.leaf(j, c)
            cells = price(p[:, None, :columns], q[None, :, :columns])
            sums[i * LEAF : (i + 1) * LEAF, j * LEAF : (j + 1) * LEAF] += cells.sum(axis=2)

    top = len(tree.levels) - 1
    size = LEAF * K**top
    for i in range(-(-n // size)):
        for j in range(i, -(-n // size)):
            for c in range(-(-width // size)):
                visit(top, i, j, c)
    return sums + empty * price(tree.base[:, None], tree.base[None, :])


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), in decimals that hold every count."""
    scaled = (count + F.lit(2)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", scaled, (total + 2 * terms).cast("decimal(20,0)"))


def _whole_price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for the groups a < b of each language."""
    sized = groups.withColumn("sides", F.ceil(F.col("n_groups") / BLOCK_GROUPS).cast("int")).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / BLOCK_TERMS)).cast("int")
    )
    side = F.floor(F.col("gid") / BLOCK_GROUPS).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    lower, upper = F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")
    bare = sized.select("lang", "gid", "p0", side.alias("side"), "sides", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    bare = bare.select("*", other).select("lang", "block", lower, upper, "gid", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    full = cells.join(sized.select("lang", "source", "sides", "blocks", "gid"), ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), side.alias("side"), "sides", "gid", "term", "p"
    )
    full = full.select("*", other).select("lang", "block", lower, upper, "gid", "term", "p")

    def priced(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bare = rows[rows["term"].isna()].sort_values("gid")
        full = rows[rows["term"].notna()]
        gids, base = bare["gid"].to_numpy(np.int64), bare["p"].to_numpy(np.int64)
        columns, names = pd.factorize(full["term"], sort=True)
        tree = Quadtree(np.searchsorted(gids, full["gid"].to_numpy(np.int64)), columns.astype(np.int64), full["p"].to_numpy(np.int64), base)
        sums = pair_sums(tree, len(names))
        a, b = np.triu_indices(len(gids), 1)
        if key[2] != key[3]:
            across = gids[a] // BLOCK_GROUPS != gids[b] // BLOCK_GROUPS
            a, b = a[across], b[across]
        return pd.DataFrame({"lang": key[0], "a": gids[a], "b": gids[b], "value": sums[a, b], "width": len(names)})

    parts = full.unionByName(bare).groupBy("lang", "block", "i", "j").applyInPandas(priced, "lang string, a int, b int, value long, width long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("width").alias("width"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for the sources of each language of `docs` (text, lang, source).

    Null text, lang and source count as ''. A language keeps the terms in at least `least_docs` of its rows; a group or language
    gives each kept term the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Part `pair`: for every group, the other sources of
    its language with the sum of (p - q)^2 / (p + q), each floored, over all kept terms. Part `term`: a group's kept terms that
    it uses more than its language does, the `top` first. Ranks fall by value, then rise by the item's UTF-8. A language with one
    source has no pairs; without kept terms pairs have the value 0. Repeated rows count each; an empty table gives no rows.

    Each language's matrix of groups and terms is dealt into blocks of about BLOCK_TERMS columns, so no key holds a language;
    a block has at most BLOCK_GROUPS rows on either side. Terms that a block's rows never hold are priced by their number."""
    counted = written(term_counts(docs))
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("all_n")).filter(F.col("d") >= least_docs)
    cells = written(counted.join(kept.drop("d"), ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))
    langs = cells.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(
        F.count("*").alias("n_terms"), F.sum("all_n").alias("lang_n")
    )
    names = like(docs, ["lang", "source"]).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    in_lang = Window.partitionBy("lang")
    groups = names.distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "lang_n",
        (F.row_number().over(in_lang.orderBy("source")) - 1).alias("gid"), F.count("*").over(in_lang).alias("n_groups"),
    )
    zero = F.when(F.col("n_terms") > 0, _share(F.lit(0), F.col("group_n"), F.col("n_terms"))).otherwise(1)
    groups = written(groups.withColumn("p0", zero))
    shared = written(
        cells.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", _share(F.col("n"), F.col("group_n"), F.col("n_terms")).alias("p"),
            _share(F.col("all_n"), F.col("lang_n"), F.col("n_terms")).alias("q"),
        )
    )
    of = groups.select("lang", "gid", "source", "p0", "n_terms")
    a = of.select("lang", F.col("gid").alias("a"), F.col("source").alias("source_a"), F.col("p0").alias("p_a"), "n_terms")
    b = of.select("lang", F.col("gid").alias("b"), F.col("source").alias("source_b"), F.col("p0").alias("p_b"))
    rest = (F.col("n_terms") - F.col("width")) * _whole_price(F.col("p_a"), F.col("p_b"))
    sums = _pairs(shared.drop("q"), groups).join(a, ["lang", "a"]).join(b, ["lang", "b"]).select(
        "lang", "source_a", "source_b", (F.col("value") + rest).alias("value")
    )
    pairs = sums.select("lang", F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))
    )).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _whole_price(F.col("p"), F.col("q")).alias("value"))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(in_order).alias("rank")
    return pairs.select("*", ranked).unionByName(terms.select("*", ranked).filter(F.col("rank") <= top))
