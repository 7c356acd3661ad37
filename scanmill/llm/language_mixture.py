"""Language identification by a mixture model: which languages, in which proportions, explain a text's n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.llm.common import like

BUCKETS = 1 << 16
MAX_LANGUAGES = 512
"""Bound of the model that goes to every executor: at most this many languages of `BUCKETS` values (4 bytes each)."""
ROUNDS = 8
UNKNOWN = "und"
_BATCH = 1 << 20
_LETTER = np.array([c < 0xD800 and chr(c).isalpha() or 0xE000 <= c and chr(c).isalpha() for c in range(1 << 16)])
_SHIFT = np.uint32(16)


def gram_buckets(text: str) -> np.ndarray:
    """Hashed buckets of all three-letter windows of the lower-cased text; other characters count as one blank."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    points = np.where(letter, points, np.uint32(32))
    points = points[letter | np.r_[True, letter[:-1]]]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA6B) ^ points[2:] * np.uint32(0xC2B2AE35)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> _SHIFT).astype(np.int64)


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each occurs."""
    found = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text or ""), _BATCH):
        found += np.bincount(gram_buckets(text[at : at + _BATCH]), minlength=BUCKETS)
    used = np.flatnonzero(found)
    return used, found[used]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach the model: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class LanguageModel:
    """Probabilities of the buckets for each language, one column a language."""

    languages: tuple[str, ...]
    chances: np.ndarray

    def mixture(self, text: str | None) -> tuple[str, float, list[tuple[str, float]], bool]:
        """(language, its proportion, all chosen languages with proportions, accepted).

        Expectation-maximisation over all languages ranks them; growing sets of the best ones are then fitted and the
        set with the best log-likelihood less a penalty of log(n) / 2 for each proportion is taken. Overlapping windows
        repeat every letter three times, so the likelihood counts a third. A text is accepted if its languages explain
        it better than buckets drawn evenly."""
        used, counts = counts_of(text)
        if not len(used) or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, [], False
        chances = self.chances[used]
        total = counts.sum()
        single = counts @ np.log(chances)
        best = int(single.argmax())
        chosen, share, value = np.array([best]), np.ones(1), single[best] / 3
        if len(self.languages) > 1:
            order = np.argsort(-_fit(chances, counts, total)[0], kind="stable")
            for size in range(2, len(order) + 1):
                some = order[:size]
                shares, likelihood = _fit(chances[:, some], counts, total)
                penalised = likelihood / 3 - (size - 1) * np.log(total) / 2
                if penalised <= value:
                    break
                chosen, share, value = some, shares, penalised
        ranked = sorted(zip((self.languages[i] for i in chosen), share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        accepted = bool(np.log(chances[:, chosen] @ share) @ counts / total > -np.log(BUCKETS))
        return ranked[0][0], min(1.0, ranked[0][1]), ranked, accepted


def _fit(chances: np.ndarray, counts: np.ndarray, total: int) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood."""
    share = np.full(chances.shape[1], 1 / chances.shape[1])
    for _ in range(ROUNDS):
        share = share * ((counts / (chances @ share)) @ chances) / total
    return share, float(counts @ np.log(chances @ share))


def train(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """The model of all languages of `docs` (doc_id, text, lang), learnt from every row that is not held out and has
    a language and an id. Tasks sum their buckets before they are grouped; what reaches the driver is at most
    MAX_LANGUAGES * BUCKETS numbers, checked."""
    rows = like(docs, ["doc_id", "text", "lang"]).filter(
        ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                used, counts = counts_of(text)
                if lang not in held:
                    if len(held) == MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang][used] += counts
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": counts[used]})

    grams = rows.select("lang", "text").mapInPandas(sums, "lang string, bucket long, n long")
    packed = (
        grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("grams"))
        .limit(MAX_LANGUAGES + 1).collect()
    )
    if len(packed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    packed.sort(key=lambda r: r.lang)
    counts = np.zeros((BUCKETS, len(packed)))
    for i, row in enumerate(packed):
        pairs = np.array(row.grams, dtype=np.int64).reshape(-1, 2)
        counts[pairs[:, 0], i] = pairs[:, 1]
    counts += smoothing
    return LanguageModel(tuple(r.lang for r in packed), (counts / counts.sum(axis=0)).astype(np.float64))


def language_of(spark: SparkSession, model: LanguageModel) -> Callable[[Column], Column]:
    """A column function: text to (lang_pred, score, languages, accepted). The model is broadcast; `train` bounds it."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, languages array<struct<lang: string, share: double>>, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.mixture(text) for text in texts]
        return pd.DataFrame({
            "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
            "languages": [[{"lang": a, "share": b} for a, b in f[2]] for f in found], "accepted": [f[3] for f in found],
        })

    return predict


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, accepted) of every row of `docs` (doc_id, text).

    lang_pred is the language with the largest proportion, score that proportion, languages all that were chosen.
    Null texts and texts without a letter give `und`, score 0 and no languages, as does every text if nothing was
    learnt. Ties go to the language first by name. Repeated rows are judged alike."""
    judged = F.col("judged")
    return like(docs, ["doc_id", "text"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), language_of(docs.sparkSession, model)(F.col("text")).alias("judged")
    ).select("doc_id", "held_out", judged["lang_pred"].alias("lang_pred"), judged["score"].alias("score"), judged["languages"].alias("languages"), judged["accepted"].alias("accepted"))


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs` whose text its languages explain; all columns stay."""
    return docs.filter(language_of(docs.sparkSession, model)(F.col("text"))["accepted"])
