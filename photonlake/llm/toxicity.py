"""Toxicity scores (operator 5): subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased and cut into words; a word's subwords are its byte n-grams of 3 to 6, with the space on either side
as a mark of its ends, hashed into buckets. A window of words is the average of its subwords' embeddings; a linear softmax
over two classes scores it. So an unseen misspelling or inflection shares most vectors with the word that was learnt. A
document is as toxic as its most toxic window: a few words in a long text are not averaged away. All windows of a text
are scored.

Training takes at most MAX_PER_LABEL labelled documents of each label and MAX_WINDOWS windows of each (a documented bound,
chosen by hash): embeddings and softmax are fitted together by Adagrad. The label belongs to the document, not to each
window, so later rounds take each document's highest windows by the round before, and of a toxic document only those
that look toxic, or its highest one. This is done FOLDS times, each time without one part of the documents; the model is the mean
of these. A logistic fit on each document's maximum over its whole text, by the model that has not seen it, weighted to the share of labels
over all training rows, sets the score. Since the average and the output layer are linear, the fitted model is one number per bucket for scoring.

Defined results: a null, empty or wordless text has score 0; a null doc_id is scored and never used for training; a null
label is no label; repeated labels of a document count once (the greatest); with no label, or one class only, every
score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.store import materialise
from photonlake.session import release

BUCKETS = 1 << 18
DIMENSION = 8
NGRAMS = (3, 4, 5, 6)
BLOCK_WORDS = 8
MAX_PER_LABEL = 2000
MAX_WINDOWS = 48
EPOCHS = 5
BATCH = 1024
RATE = 0.5
ROUNDS = 3
FOLDS = 3
SAMPLED = "doc_id long, toxic int, top double, words binary"

_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of the word) of every subword of a list of words."""
    none = np.zeros(0, np.int64)
    if not words:
        return none, none
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    seen = np.cumsum(data == 32)  # spaces up to and with each byte
    wide = data.astype(np.uint64) + np.uint64(1)
    ids, at = [], []
    h = wide.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * _PRIME + wide[n - 1 :]
        if n in NGRAMS:
            m = len(h)
            ok = np.flatnonzero(seen[n - 2 : n - 2 + m] == seen[:m])  # no space but at the ends
            x = h[ok]
            ids.append(((x ^ (x >> np.uint64(29))) * _PRIME >> np.uint64(46)).astype(np.int64))
            at.append(seen[ok] - 1)
    return np.concatenate(ids or [none]), np.concatenate(at or [none])


def _window_logits(words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """The average over each window of two neighbouring blocks; NaN for a window without a subword."""
    blocks = (len(words) - 1) // BLOCK_WORDS + 1
    ids, at = subwords(words)
    at = at // BLOCK_WORDS
    total = np.bincount(at, weights=weight[ids], minlength=blocks)
    count = np.bincount(at, minlength=blocks).astype(np.float64)
    if blocks > 1:
        total, count = total[:-1] + total[1:], count[:-1] + count[1:]
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def _top_logit(text: str | None, weight: np.ndarray) -> float:
    """The highest average over windows; NaN if there is no subword."""
    words = words_of(text)
    logit = _window_logits(words, weight) if words else np.array([np.nan])
    return float("nan") if np.isnan(logit).all() else float(np.nanmax(logit))


def _fold(doc: int) -> int:
    return zlib.crc32(str(doc).encode()) // 5 % FOLDS


def _sampler(model=None):
    """Windows of each document to learn from, as texts: a random choice or, given the models of all folds, first the
    highest ones by the model that has not seen the document; and the highest average over all windows."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, toxic, text in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True):
                words = words_of(text)
                if not words:
                    continue
                starts, top = np.arange(max(1, (len(words) - 1) // BLOCK_WORDS)) * BLOCK_WORDS, 0.0
                order = np.random.default_rng(int(doc) & 0xFFFFFFFF).permutation(len(starts))
                if model is not None:
                    logit = np.nan_to_num(_window_logits(words, model.value[_fold(doc)]), nan=-1e9)
                    top, first = float(logit.max()), np.argsort(-logit, kind="stable")[: MAX_WINDOWS // 2]
                    order = np.concatenate([first, order[~np.isin(order, first)]])
                chosen = [b" ".join(words[starts[i] : starts[i] + 2 * BLOCK_WORDS]) for i in order[:MAX_WINDOWS]]
                yield pd.DataFrame({"doc_id": doc, "toxic": toxic, "top": top, "words": chosen})

    return sample


def _batch(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, window) of the subwords of some windows, and how many each has."""
    parts = [w.split(b" ") for w in windows]
    ids, word = subwords([w for p in parts for w in p])
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[word]
    return ids, row, np.bincount(row, minlength=len(parts))


def _logits(windows: list[bytes], weight: np.ndarray) -> np.ndarray:
    out = []
    for i in range(0, len(windows), BATCH):
        ids, row, sizes = _batch(windows[i : i + BATCH])
        out.append(np.bincount(row, weights=weight[ids], minlength=len(sizes)) / np.maximum(sizes, 1))
    return np.concatenate(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_windows(windows: list[bytes], label: np.ndarray, seed: int = 7) -> np.ndarray:
    """Embeddings and softmax fitted together; returns the difference of the two class scores for each bucket."""
    rng = np.random.default_rng(seed)
    e = np.zeros((DIMENSION, BUCKETS), np.float32)  # a subword that training has not seen says nothing
    w = rng.normal(0, 0.5, (2, DIMENSION)).astype(np.float32)
    ge, gw = np.full_like(e, 1e-4), np.full_like(w, 1e-4)
    share = np.clip(label.mean(), 0.02, 0.98)
    importance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    size = min(BATCH, max(64, len(windows) // 80))  # a small sample still takes enough steps
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), size):
            part = order[i : i + size]
            ids, row, sizes = _batch([windows[j] for j in part])
            sizes = np.maximum(sizes, 1)
            # two classes: scores, and the gradients of both layers, need only the difference of the output vectors
            out = w[1] - w[0]
            score = np.bincount(row, weights=(out @ e)[ids], minlength=len(part)) / sizes
            wrong = (_sigmoid(score) - label[part]) * importance[part]
            back = np.bincount(ids, weights=(wrong / sizes)[row], minlength=BUCKETS).astype(np.float32)
            g = (e @ back / len(part)) * np.array([[-1], [1]], np.float32)
            gw += g * g
            w -= RATE * g / np.sqrt(gw)
            seen = np.flatnonzero(back)
            ge_seen = out[:, None] * back[seen]
            squares = ge[:, seen] + ge_seen * ge_seen
            ge[:, seen] = squares
            e[:, seen] -= RATE * 0.2 * ge_seen / np.sqrt(squares)
    return (w[1] - w[0]) @ e


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit by Newton steps."""
    scale = max(float(np.std(x)), 1e-9)
    z, t = np.stack([x / scale, np.ones_like(x)]), np.zeros(2)
    for _ in range(30):
        p = _sigmoid(t @ z)
        gradient = z @ (weight * (p - y)) + 1e-3 * t
        hessian = (z * (weight * p * (1 - p))) @ z.T + 1e-3 * np.eye(2)
        t = t - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(t[0] / scale), float(t[1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float] | None:
    """(score per bucket, slope, intercept) from documents (doc_id, text) and labels (doc_id, toxic 0/1); None without both classes."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = marked.join(docs.select(F.col("doc_id").cast("long").alias("l_id")).distinct(), "l_id", "left_semi")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("l_id"), "l_id").limit(MAX_PER_LABEL) for k in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, F.col("doc_id") == F.col("l_id")).select("doc_id", "toxic", "text")
    texts = materialise(texts, "labelled-texts")  # read once a round
    weights, shared = None, None
    for _ in range(ROUNDS):
        found = texts.mapInPandas(_sampler(shared), SAMPLED).toArrow().sort_by("doc_id")  # as columns: rows would take several times the driver's memory
        label, doc = found["toxic"].to_numpy(), found["doc_id"].to_numpy()
        if len(np.unique(label)) < 2:
            return None
        fold = np.array([_fold(d) for d in doc])
        windows = found["words"].to_pylist()
        del found
        use = np.ones(len(windows), bool)
        if weights is not None:
            logit = np.empty(len(windows))
            for f in range(FOLDS):
                mine = np.flatnonzero(fold == f)
                if len(mine):
                    logit[mine] = _logits([windows[i] for i in mine], weights[f])
            top = pd.Series(logit).groupby(doc).transform("max").to_numpy()
            use = (label == 0) | (logit > np.quantile(logit[label == 0], 0.995)) | (logit >= top)
        fits = []
        for f in range(FOLDS):
            part = np.flatnonzero(use & (fold != f))
            part = part if len({*label[part]}) == 2 else np.flatnonzero(use)
            fits.append(fit_windows([windows[i] for i in part], label[part], seed=7 + f))
        del windows
        weights = np.stack(fits).astype(np.float32)
        release(docs.sparkSession)  # else the windows of every round add up in the driver
        shared = docs.sparkSession.sparkContext.broadcast(weights)
    tops = texts.mapInPandas(_sampler(shared), SAMPLED).groupBy("doc_id").agg(F.max("toxic").alias("y"), F.max("top").alias("x")).toPandas()
    n = tops["y"].value_counts()
    share = {k: shares.get(k, 0) / sum(shares.values()) / n[k] * len(tops) for k in (0, 1)}
    slope, intercept = _platt(tops["x"].to_numpy(), tops["y"].to_numpy(), tops["y"].map(share).to_numpy())
    return weights.mean(axis=0), slope, intercept


def score(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, column: str = "toxicity") -> DataFrame:
    """docs with a score column (0 to 1) appended; every window of every text is scored. A column of that name is replaced."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        weight, slope, intercept = shared.value
        top = np.array([_top_logit(t, weight) for t in texts], dtype=np.float64)
        return pd.Series(np.where(np.isnan(top), 0.0, _sigmoid(slope * np.nan_to_num(top) + intercept)))

    return docs.withColumn(column, toxicity("text"))
