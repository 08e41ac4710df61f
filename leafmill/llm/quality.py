"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated probability.

Every token has a sparse random index vector; a token's word vector is the sum of the index vectors of its neighbours
in the training texts. A token unknown there stands for its shape. A document is the mean of its tokens' word vectors
and index vectors. The network is trained in numpy on part of the sample; the rest fits the temperature by which the
log-odds are divided.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table
from .training import Adam, kept, report, sample, sigmoid

DIMENSIONS, NONZERO, REACH, VOCABULARY, HIDDEN = 64, 6, 2, 8000, 32
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.003, 1e-4
THRESHOLD = 0.7
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Stands for a token that repeats the one before it.
AGAIN = "<again>"


def shape(token: str) -> str:
    """What a token unknown to the sample stands for."""
    if not (token[0].isalnum() or token[0] == "_"):
        return f"<{token[0]}{'+' * (len(token) > 1)}>"
    if token.isdigit():
        return "<0>"
    kind = "A" if token.isupper() else "Aa" if token[0].isupper() else "a" if token.islower() else "aA"
    return f"<{kind}{min(len(token), 12) // 4}>"


class QualityModel:
    def __init__(self, rows: list[tuple[str, int]], seed: int = 7):
        random = np.random.default_rng(seed)
        labels = np.array([y for _, y in rows], np.float32)
        seen: Counter = Counter()
        for text, _ in rows:  # a document's tokens are held one document at a time, their numbers for all
            seen.update(set(TOKEN.findall(text)))
        known = sorted((t for t, n in seen.items() if n >= 3), key=lambda t: (-seen[t], t))[:VOCABULARY]
        names = [AGAIN, *known, *sorted({shape(t) for t in seen})]
        self.numbers = {t: i for i, t in enumerate(names)}
        self.other = len(names)  # a shape not met in training
        index = np.zeros((len(names) + 1, DIMENSIONS), np.float32)
        for i in range(len(names)):
            index[i, random.choice(DIMENSIONS, NONZERO, replace=False)] = random.choice([-1.0, 1.0], NONZERO)
        context = np.zeros_like(index)
        numbered = [self.number(TOKEN.findall(text)) for text, _ in rows]
        for ids in numbered:
            for gap in range(1, REACH + 1):
                np.add.at(context, ids[gap:], index[ids[:-gap]])
                np.add.at(context, ids[:-gap], index[ids[gap:]])
        context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
        self.vectors = np.hstack([context, index / np.sqrt(NONZERO)])
        self.mean, self.scale = np.zeros(2 * DIMENSIONS, np.float32), np.ones(2 * DIMENSIONS, np.float32)
        features = self.pooled(numbered)
        if len(features):
            self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        self.temperature = 1.0
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.trained = len(set(labels.tolist())) == 2
        share = float(np.clip(self.share, 0.02, 0.98))
        w = {"w1": random.normal(0, (2 * DIMENSIONS) ** -0.5, (2 * DIMENSIONS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": random.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.array([np.log(share / (1 - share))])}
        self.weights = {k: v.astype(np.float32) for k, v in w.items()}
        if self.trained:
            self.fit((features - self.mean) / self.scale, labels, random)

    def number(self, tokens: list[str]) -> np.ndarray:
        get, numbers = self.numbers.get, self.numbers
        ids = np.array([i if (i := get(t)) is not None else numbers.get(shape(t), self.other) for t in tokens], np.int32)
        if len(ids) > 1:
            ids[1:][np.array([a == b for a, b in zip(tokens, tokens[1:], strict=False)])] = numbers[AGAIN]
        return ids

    def pooled(self, numbered: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(numbered), 2 * DIMENSIONS), np.float32)
        for i, ids in enumerate(numbered):
            if len(ids):
                counts = np.bincount(ids, minlength=0)
                at = np.flatnonzero(counts)
                out[i] = counts[at].astype(np.float32) @ self.vectors[at] / len(ids)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(x @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"][0]

    def fit(self, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> None:
        order = random.permutation(len(x))
        test, train = order[: len(x) // 5], order[len(x) // 5 :]
        w, adam = self.weights, Adam(self.weights, RATE)
        for _ in range(EPOCHS):
            random.shuffle(train)
            for a in range(0, len(train), BATCH):
                at = train[a : a + BATCH]
                hidden = np.tanh(x[at] @ w["w1"] + w["b1"])
                error = (sigmoid(hidden @ w["w2"] + w["b2"][0]) - y[at]) / len(at)
                back = np.outer(error, w["w2"]) * (1 - hidden**2)
                adam.update({"w1": x[at].T @ back + DECAY * w["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ error + DECAY * w["w2"], "b2": np.array([error.sum()])})
        if len(set(y[test].tolist())) == 2:
            logits = self.logits(x[test])

            def loss(t: float) -> float:
                return float(np.mean(np.logaddexp(0, logits / t) - y[test] * logits / t))

            self.temperature = min(np.geomspace(0.5, 4, 43), key=loss)

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.share)
        x = self.pooled([self.number(TOKEN.findall(t)) for t in texts])
        return sigmoid(self.logits((x - self.mean) / self.scale) / self.temperature)


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return QualityModel(sample(docs, labels, "quality"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7).

    Scores come from the text alone. A null, empty or blank text has the score of no tokens at all. Repeated rows keep a row
    each. Without labels of both kinds every score is the share of label 1, or 0.5 without any.
    """
    ship(docs.sparkSession)
    return report(docs, train(docs, labels).score, THRESHOLD)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score reaches the threshold, with all columns."""
    ship(docs.sparkSession)
    return kept(docs, train(docs, labels).score, f"_score >= {THRESHOLD}")


def op7_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
