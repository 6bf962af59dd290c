"""Language identification by rank-order n-gram profiles (operator 3).

A text is lower-cased; runs of other characters than letters become one separator. Its n-grams are those of 1 to 3 code
points inside words, with the separator as a mark of a word's ends. A language's profile is its PROFILE most frequent
n-grams over all its training texts, in rank order; a document's profile is the same of its own. The out-of-place distance adds, over the
document's n-grams, how far each one's rank is from its rank in the language, or PROFILE if it is not there. The nearest
language wins (ties: its name). The score is one minus the distance as a part of the greatest possible one.

Counts cover all training texts: each task adds up its own, which are summed by n-gram; only PROFILE n-grams of
each language reach the driver.

Defined results: a null text, or one without a letter, is `und` with score 0, as is any text when nothing was learnt;
a null lang teaches nothing; ties in frequency go by code point; repeated rows count as often as they occur; an empty
table gives an empty result; other columns are never read in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
SEPARATOR = 1
SLICE_CHARS = 1 << 20
FLUSH = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_codes(text: str | None) -> np.ndarray:
    """The n-grams of a text, 21 bits for each code point, separators being one; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    letter = np.concatenate([[False], letter, [False]])
    points = np.where(letter, np.concatenate([[0], points, [0]]), SEPARATOR)
    keep = np.concatenate([[True], letter[1:] | letter[:-1]])
    points, letter = points[keep], letter[keep]
    pairs = points[:-1] << 21 | points[1:]
    triples = (pairs[:-1] << 21 | points[2:])[letter[1:-1]]
    return np.concatenate([points[letter], pairs, triples])


def profile(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text in rank order."""
    codes, counts = np.unique(gram_codes(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, texts: list[str]) -> None:
        codes, counts = np.unique(np.concatenate([gram_codes(t) for t in texts]), return_counts=True)
        if lang in totals:
            codes, inverse = np.unique(np.concatenate([totals[lang][0], codes]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([totals[lang][1], counts])).astype(np.int64)
        totals[lang] = codes, counts

    def emit() -> Iterator[pd.DataFrame]:
        for lang, (codes, counts) in totals.items():
            yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})
        totals.clear()

    for pdf in batches:
        for lang, group in pdf.groupby("lang")["text"]:
            held, size = [], 0
            for text in group:
                held.append(text)
                size += len(text)
                if size >= SLICE_CHARS:
                    add(lang, held)
                    held, size = [], 0
            if held:
                add(lang, held)
        if sum(len(x[0]) for x in totals.values()) > FLUSH:
            yield from emit()
    yield from emit()


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language: its `size` most frequent n-grams in rank order."""
    known = docs.filter("text is not null and lang is not null").select("lang", "text")
    counts = known.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("r", rank).filter(F.col("r") <= size).orderBy("lang", "r").toPandas()
    return {lang: g["gram"].to_numpy(np.int64) for lang, g in top.groupby("lang", sort=True)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score appended; columns of these names are replaced."""
    names = sorted(profiles)
    index = [(np.sort(profiles[k]), np.argsort(profiles[k], kind="stable")) for k in names]

    def nearest(text: str | None) -> tuple[str, float]:
        own = profile(text, size) if isinstance(text, str) else []
        if not len(own) or not names:
            return "und", 0.0
        ranks, least = np.arange(len(own)), []
        for codes, places in index:
            i = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            least.append(np.where(codes[i] == own, np.minimum(np.abs(places[i] - ranks), size), size).sum())
        best = int(np.argmin(least))
        return names[best], float(1 - least[best] / (size * len(own)))

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest(t) for t in texts], columns=["lang_pred", "score"])

    found = docs.withColumn("guess_of_text", guess("text"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], F.col("guess_of_text.lang_pred").alias("lang_pred"), F.col("guess_of_text.score").alias("score"))
