"""Quality rules with thresholds that follow the data: quantile sketches for each language and source."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.llm.common import like, written

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
PRIOR = 10
"""So many rows of its language's sketch, spread as there, are added to each group's own: a small group leans on its language, a
large one hardly does."""
TOP = 1000
"""Sketch bins: shares in thousandths, and tenths of letters for the mean word."""
MEASURES = ("symbols", "dup_lines", "repeats", "word_length")
# How a bound follows from the quantiles of a group, in percent. Junk by symbols or by odd words is a crowd of its own,
# up to a quarter of a group: its bound lies five quartile distances beyond the quartiles. Repeats have one long tail: the bound
# lies beyond the last hundredth by its distance from the median.
RULES = {"symbols": (75, 25, 5), "dup_lines": (99, 50, 1), "repeats": (99, 50, 1), "word_length": (75, 25, 5)}
ROUNDING = 10
"""A bound lies this many units of the sketch further out, as one symbol or word of a short text moves it by a few."""
QUANTILES = (25, 50, 75, 99)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def counted(docs: DataFrame) -> DataFrame:
    """Counts of each row's whole text, by array functions only; `docs` has doc_id, text, lang and source.

    Windows of three words are compared by 64-bit hashes, sorted with their places so that equal ones stand together."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(_without(line, BLANKS)) > 0)
    words = F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")
    measured = like(docs, ["doc_id", "text", "lang", "source"]).select(
        "doc_id", "lang", "source",
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
    )
    pairs = F.zip_with("hashes", F.slice("hashes", 2, F.greatest(F.size("hashes"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    triples = F.filter(
        F.zip_with(pairs, F.slice("hashes", 3, F.greatest(F.size("hashes"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))),
        lambda h: h.isNotNull(),
    )
    placed = measured.select(
        "*", F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("placed")
    )

    def twice(x: Column, k: Column) -> Column:
        return x["h"].eqNullSafe(F.get("placed", k - 1)["h"]) | x["h"].eqNullSafe(F.get("placed", k + 1)["h"])

    again = placed.select("*", F.sort_array(F.transform(F.filter("placed", twice), lambda x: x["i"])).alias("again"))
    steps = F.zip_with("again", F.slice("again", 2, F.greatest(F.size("again"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return again.select(
        "doc_id", "lang", "source", F.size("hashes").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s).alias("n_repeat_words"),
    )


def _scale(part: Column, whole: Column, factor: int) -> Column:
    return F.when(whole > 0, F.least((part * factor / whole).cast("long"), F.lit(TOP))).otherwise(F.lit(0)).cast("long")


def measures(counts: DataFrame) -> DataFrame:
    """The counts with each measure as a whole number from 0 to TOP, and the base rules."""
    n = F.col
    return counts.select(
        "*",
        _scale(n("n_symbols"), n("word_chars"), 1000).alias("symbols"),
        _scale(n("n_dup_lines"), n("n_lines"), 1000).alias("dup_lines"),
        _scale(n("n_repeat_words"), n("n_words"), 1000).alias("repeats"),
        _scale(n("word_chars"), n("n_words"), 10).alias("word_length"),
        ((n("n_words") < LEAST_WORDS) | (100 * n("n_repeat_words") > 50 * n("n_words"))).alias("base_failed"),
    )


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): histograms of at most TOP + 1 bins for each group and measure. Sketches of two
    groups merge by adding n. Tasks count before anything moves, so a hot source is no hot task. Rows that fail the
    base rules are left out."""
    values = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in MEASURES))
    return (
        rows.filter("not base_failed").select("lang", "source", F.explode(values).alias("v"))
        .groupBy("lang", "source", "v.measure", "v.bin").agg(F.count("*").alias("n"))
    )


def _blended(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, w): each group's sketch with PRIOR rows of its language's, as whole numbers: counts of the group
    times the language's rows, plus PRIOR times counts of the language. At most TOP + 1 bins for each measure of a group."""
    wide = "decimal(38,0)"
    langs = sketch.groupBy(F.col("lang").alias("l"), "measure", "bin").agg(F.sum("n").alias("m"))
    rows = langs.groupBy(F.col("l").alias("k"), F.col("measure").alias("of")).agg(F.sum("m").alias("rows"))
    same = F.col("lang").eqNullSafe(F.col("k")) & (F.col("measure") == F.col("of"))
    own = sketch.join(rows, same).select("lang", "source", "measure", "bin", (F.col("n").cast(wide) * F.col("rows")).cast(wide).alias("w"))
    prior = sketch.select("lang", "source").distinct().join(langs, F.col("lang").eqNullSafe(F.col("l"))).select(
        "lang", "source", "measure", "bin", (F.col("m").cast(wide) * PRIOR).cast(wide).alias("w")
    )
    return own.unionByName(prior).groupBy("lang", "source", "measure", "bin").agg(F.sum("w").cast(wide).alias("w"))


def _quantiles(blended: DataFrame) -> DataFrame:
    """One row per group with, for each measure, its QUANTILES: the least bin that so many hundredths of the weight reach."""
    keys = ["lang", "source", "measure"]
    lists = blended.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "w"))).alias("bins"), F.sum("w").cast("decimal(38,0)").alias("total"))
    zero = F.lit(0).cast("decimal(38,0)")
    start = F.struct(zero.alias("seen"), *(F.lit(None).cast("long").alias(f"q{q}") for q in QUANTILES))

    def walk(state: Column, step: Column) -> Column:
        seen = (state["seen"] + step["w"]).cast("decimal(38,0)")
        reached = (F.when((100 * seen >= q * F.col("total")) & state[f"q{q}"].isNull(), step["bin"]).otherwise(state[f"q{q}"]).alias(f"q{q}") for q in QUANTILES)
        return F.struct(seen.alias("seen"), *reached)

    return lists.select(*keys, F.aggregate("bins", start, walk).alias("q")).groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m in MEASURES)
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_high..., word_length_low): the bounds of every group by RULES."""
    def distance(m: str) -> Column:
        far, near, times = RULES[m]
        return times * (F.col(f"{m}.q{far}") - F.col(f"{m}.q{near}")) + ROUNDING

    far, near, _ = RULES["word_length"]
    return _quantiles(_blended(sketch)).select(
        "lang", "source", *((F.col(f"{m}.q{RULES[m][0]}") + distance(m)).alias(f"{m}_high") for m in MEASURES),
        (F.col(f"word_length.q{near}") - distance("word_length")).alias("word_length_low"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row of `docs`.

    Rows under LEAST_WORDS words, or with over half of their words in repeated windows, fail the base rules. The others
    are kept if every measure lies within the bounds of their language and source: shares of symbols, of repeated lines
    and of repeated words not above, and the mean word's letters neither above nor below. Null languages and sources are
    groups of their own; null texts have no words and fail. A group's bounds come from the quantiles of its sketch and a little of its
    language's, so a source with other habits has other bounds. Repeated rows count each; no rows give no rows."""
    rows = written(measures(counted(docs)))
    bounds = thresholds(written(sketches(rows))).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = rows.join(bounds, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    within = reduce(and_, (F.col(m) <= F.col(f"{m}_high") for m in MEASURES)) & (F.col("word_length") >= F.col("word_length_low"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"),
        *MEASURES,
    )
