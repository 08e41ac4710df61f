"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is an embedding, if the training sample has the word often enough; beside it, from its characters, the
embedding of its most telling beginning or end and the mean embedding of its trigrams. Windows of 32 words, each half over the one before, are scored; a document has the score of its highest window.
Labels are of documents, so training takes from a toxic document the window that looks most toxic: first by
the words' log-odds, then by the network itself. All of it is numpy; the input side of the gates is computed once per
distinct word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table
from .training import Adam, kept, report, sample, sigmoid

WORDS, STRIDE = 32, 16
WORD_SIZE, STEM_SIZE, CHAR_SIZE, CHAR_TABLE, HIDDEN, ATTENTION = 8, 8, 8, 2048, 8, 8
VOCABULARY, LEAST_DOCUMENTS, LEAST_SHARE = 6000, 3, 0.0025
ROUNDS, EPOCHS, LEAST_STEPS, BATCH, RATE = 2, 5, 150, 64, 0.01
THRESHOLD = 0.3
#: Windows scored at a time.
STEP = 8192
#: Words whose stems are kept.
KEPT = 200_000
TOKEN = re.compile(r"\w+")
PAD, UNKNOWN = 0, 1


def windows(size: int) -> range:
    """Window starts of a text of so many words."""
    return range(0, max(1, size - STRIDE), STRIDE) if size else range(0)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the byte trigrams of "<word>", one after the other, and where each word's begin."""
    spelled = [b"<%s>" % w.encode() for w in words]
    data = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(data), bool)
    inside[starts + sizes - 1] = inside[starts + sizes - 2] = False
    at = np.flatnonzero(inside)
    rows = (data[at] * 7919 + data[at + 1] * 104729 + data[at + 2] * 1299709) % CHAR_TABLE
    return rows, np.cumsum(sizes - 2) - (sizes - 2)


def stems(word: str) -> list[str]:
    """Its beginnings and ends of four to seven characters, with a sign for the word's edge."""
    word = f"<{word}>"
    return [word[:5], word[:6], word[:7], word[:8], word[-5:], word[-6:], word[-7:], word[-8:]]


def telling(names: list[str], documents: Iterable[np.ndarray], labels: list[int], most: int) -> list[tuple[str, float]]:
    """(feature, strength) of the features that tell most: smoothed log-odds of the label, less where few documents, which may be
    copies of each other, have the feature. documents: the numbers of their features, each once."""
    seen, bad = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for d, y in zip(documents, labels, strict=True):
        seen[d] += 1
        if y:
            bad[d] += 1
    many, few = sum(labels), len(labels) - sum(labels)
    at = np.flatnonzero(seen >= max(LEAST_DOCUMENTS, LEAST_SHARE * len(labels)))
    seen, bad = seen[at], bad[at]
    odds = np.log((bad + 0.5) / (many + 1)) - np.log((seen - bad + 0.5) / (few + 1))
    strength = odds * np.minimum(1.0, np.where(odds > 0, bad, seen) / (0.03 * many + 2))
    return sorted(((names[i], x) for i, x in zip(at.tolist(), strength.tolist(), strict=True)), key=lambda f: (-abs(f[1]), f[0]))[:most]


def summed(values: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out with the values added to its rows of these numbers."""
    if len(rows):
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
        out[rows[order][starts]] += np.add.reduceat(values[order], starts, axis=0)
    return out


class Windows:
    """The windows of the sample's documents. Words are numbered; a window is cut out when it is wanted."""

    def __init__(self, documents: list[np.ndarray]):
        none = np.full(WORDS, -1, np.int32)
        self.words = np.concatenate([none[:0], *(part for d in documents for part in (d, none))])
        sizes = [len(windows(len(d))) for d in documents]
        ends = np.cumsum([len(d) + WORDS for d in documents])
        self.starts = np.array([e - WORDS - len(d) + s for e, d in zip(ends.tolist(), documents, strict=True) for s in windows(len(d))], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)  # of each document's windows

    def cut(self, numbers: np.ndarray) -> np.ndarray:
        """(WORDS, windows) word numbers, -1 behind a document's end."""
        return self.words[self.starts[numbers] + np.arange(WORDS)[:, None]]


class ToxicityModel:
    def __init__(self, rows: list[tuple[str, int]], seed: int = 11):
        random = np.random.default_rng(seed)
        numbers: dict[str, int] = {}
        documents = [np.array([numbers.setdefault(x, len(numbers)) for x in TOKEN.findall(text.lower())], np.int32) for text, _ in rows]
        words = list(numbers)
        labels = np.array([y for _, y in rows], np.int64)
        many, few = int(labels.sum()), int(len(labels) - labels.sum())
        distinct = [np.unique(d) for d in documents]
        known = telling(words, distinct, labels.tolist(), VOCABULARY)
        each: dict[str, float] = {}
        for k in range(len(stems(""))):  # one sort of stems at a time
            names: dict[str, int] = {}
            of = np.array([names.setdefault(stems(w)[k], len(names)) for w in words], np.int32)
            each |= dict(telling(list(names), (np.unique(of[d]) for d in distinct), labels.tolist(), VOCABULARY))
        parts = sorted(each.items(), key=lambda f: (-abs(f[1]), f[0]))[:VOCABULARY]
        parts.sort(key=lambda f: (-f[1], f[0]))  # of a word's, the first is taken
        self.numbers = {w: i + 2 for i, (w, _) in enumerate(known)}
        self.stems = {x: i + 1 for i, (x, _) in enumerate(parts)}
        self.kept: dict[str, int] = {}
        embedding, stem = random.normal(0, 0.1, (len(known) + 2, WORD_SIZE)), random.normal(0, 0.1, (len(parts) + 1, STEM_SIZE))
        embedding[:2] = stem[0] = 0
        embedding[2:, 0], stem[1:, 0] = [x / 2 for _, x in known], [x / 2 for _, x in parts]
        inputs = WORD_SIZE + STEM_SIZE + CHAR_SIZE

        def matrix(a: int, b: int) -> np.ndarray:
            return random.normal(0, b**-0.5, (a, b))

        w = {"words": embedding, "stems": stem, "chars": random.normal(0, 0.1, (CHAR_TABLE, CHAR_SIZE))}
        for way in ("f", "b"):
            w |= {f"x{way}": matrix(3 * HIDDEN, inputs), f"u{way}": matrix(3 * HIDDEN, HIDDEN), f"c{way}": np.zeros((3 * HIDDEN, 1))}
        w |= {"wa": matrix(ATTENTION, 2 * HIDDEN), "ba": np.zeros((ATTENTION, 1)), "va": matrix(1, ATTENTION), "wo": matrix(1, 2 * HIDDEN), "bo": np.array([[-1.0]])}
        self.weights = {k: v.astype(np.float32) for k, v in w.items()}
        if many and few:
            self.fit(words, Windows(documents), labels, random, dict(known), [x for _, x in parts])
            self.kept = {}
        self.share = float(labels.mean()) if len(labels) else 0.0
        self.trained = bool(many and few)

    # -- forward

    def stem(self, word: str) -> int:
        """The number of the word's most telling stem, 0 without one; words met lately are kept."""
        found = self.kept.get(word)
        if found is None:
            get, none, edged = self.stems.get, len(self.stems) + 1, f"<{word}>"
            found = min(get(edged[:5], none), get(edged[:6], none), get(edged[:7], none), get(edged[:8], none), get(edged[-5:], none), get(edged[-6:], none), get(edged[-7:], none), get(edged[-8:], none)) % none
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[word] = found
        return found

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word rows, stem rows, trigram rows, trigram starts and their end) of words."""
        rows = np.array([self.numbers.get(x, UNKNOWN) for x in words], np.int64)
        grams, starts = trigrams(words) if words else (np.zeros(0, np.int64),) * 2
        return rows, np.array([self.stem(x) for x in words], np.int64), grams, np.append(starts, len(grams))

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.inputs_of(*self.looked_up(words))

    def inputs_of(self, rows: np.ndarray, parts: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs by number, word rows, stem rows, trigram rows, trigram starts) of words looked up; the first two numbers are the pad's
        and an unused one."""
        w = self.weights
        rows, parts = np.append([PAD, UNKNOWN], rows), np.append([0, 0], parts)
        x = np.zeros((len(rows), WORD_SIZE + STEM_SIZE + CHAR_SIZE), np.float32)
        x[:, :WORD_SIZE], x[:, WORD_SIZE:-CHAR_SIZE] = w["words"][rows], w["stems"][parts]
        if len(grams):
            x[2:, -CHAR_SIZE:] = np.add.reduceat(w["chars"][grams], starts[:-1], axis=0) / np.diff(starts)[:, None]
        return x, rows, parts, grams, starts[:-1]

    @staticmethod
    def run(gates: np.ndarray, u: np.ndarray, ids: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States (steps, HIDDEN, windows); gates: input side of the gates by word number, (words, 3 HIDDEN); ids: (steps, windows)."""
        h = np.zeros((HIDDEN, ids.shape[1]), np.float32)
        out = np.empty((len(ids), *h.shape), np.float32)
        for t in range(len(ids)):
            g = gates[ids[t]].T
            s = u @ h
            zr = sigmoid(g[: 2 * HIDDEN] + s[: 2 * HIDDEN])
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n = np.tanh(g[2 * HIDDEN :] + r * s[2 * HIDDEN :])
            if kept is not None:
                kept.append((h, z, r, n, s[2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log-odds of each window, attention, its inner layer, pooled states)."""
        w = self.weights
        inner = np.tanh(np.matmul(w["wa"], states) + w["ba"])  # (steps, ATTENTION, windows)
        energy = np.where(mask, np.matmul(w["va"], inner)[:, 0], np.float32(-1e9))
        energy = np.exp(energy - energy.max(axis=0))
        weight = energy / energy.sum(axis=0)
        pooled = (states * weight[:, None]).sum(axis=0)
        return (w["wo"] @ pooled + w["bo"])[0], weight, inner, pooled

    def logits(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        w, out = self.weights, []
        gates = {way: x @ w[f"x{way}"].T + w[f"c{way}"].T for way in "fb"}
        for a in range(0, ids.shape[1], STEP):
            part = ids[:, a : a + STEP]
            states = np.concatenate([self.run(gates["f"], w["uf"], part), self.run(gates["b"], w["ub"], part[::-1])[::-1]], axis=1)
            out.append(self.pool(states, part != PAD)[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    # -- training

    def gradients(self, ids: np.ndarray, y: np.ndarray, inputs: tuple) -> dict[str, np.ndarray]:
        w, (x, rows, parts, grams, starts) = self.weights, inputs
        kept: dict[str, list] = {"f": [], "b": []}
        gates = {way: x @ w[f"x{way}"].T + w[f"c{way}"].T for way in "fb"}
        order = {"f": ids, "b": ids[::-1]}
        each = {way: self.run(gates[way], w[f"u{way}"], order[way], kept[way]) for way in "fb"}
        states = np.concatenate([each["f"], each["b"][::-1]], axis=1)
        logit, weight, inner, pooled = self.pool(states, ids != PAD)
        error = ((sigmoid(logit) - y) / len(y)).astype(np.float32)[None]
        g = {"wo": error @ pooled.T, "bo": error.sum(axis=1, keepdims=True)}
        d_pooled = w["wo"].T @ error
        d_weight = (states * d_pooled).sum(axis=1)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_inner = w["va"].T * d_energy[:, None] * (1 - inner**2)
        g["va"] = np.einsum("tb,tab->a", d_energy, inner)[None]
        g["wa"], g["ba"] = np.einsum("tab,thb->ah", d_inner, states), d_inner.sum(axis=(0, 2))[:, None]
        d_states = weight[:, None] * d_pooled + np.matmul(w["wa"].T, d_inner)
        d_x = np.zeros_like(x)
        for way, d in (("f", d_states[:, :HIDDEN]), ("b", d_states[::-1, HIDDEN:])):
            u, d_u, carry = w[f"u{way}"], np.zeros_like(w[f"u{way}"]), 0.0
            steps = np.empty((*ids.shape, 3 * HIDDEN), np.float32)
            for t in range(len(ids) - 1, -1, -1):
                before, z, r, n, s = kept[way][t]
                d_h = d[t] + carry
                d_n = d_h * (1 - z) * (1 - n * n)
                d_z, d_r = d_h * (before - n) * z * (1 - z), d_n * s * r * (1 - r)
                d_s = np.concatenate([d_z, d_r, d_n * r])
                d_u += d_s @ before.T
                carry = d_h * z + u.T @ d_s
                steps[t] = np.concatenate([d_z, d_r, d_n]).T
            d_gates = summed(steps.reshape(-1, 3 * HIDDEN), order[way].ravel(), np.zeros((len(x), 3 * HIDDEN), np.float32))
            g[f"u{way}"], g[f"x{way}"], g[f"c{way}"] = d_u, d_gates.T @ x, d_gates.sum(axis=0)[:, None]
            d_x += d_gates @ w[f"x{way}"]
        g["words"] = summed(d_x[:, :WORD_SIZE], rows, np.zeros_like(w["words"]))
        g["words"][:2] = 0
        g["stems"] = summed(d_x[:, WORD_SIZE:-CHAR_SIZE], parts, np.zeros_like(w["stems"]))
        g["stems"][0] = 0
        g["chars"] = np.zeros_like(w["chars"])
        if len(grams):
            sizes = np.diff(np.append(starts, len(grams)))
            summed(np.repeat(d_x[2:, -CHAR_SIZE:] / sizes[:, None], sizes, axis=0), grams, g["chars"])
        return g

    def fit(self, words: list[str], parts: Windows, labels: np.ndarray, random: np.random.Generator, strengths: dict[str, float], parts_strength: list[float]) -> None:
        adam = Adam(self.weights, RATE)
        rows, stem_rows, grams, starts = self.looked_up(words)
        sizes = np.diff(starts)

        def arranged(numbers: np.ndarray) -> tuple[np.ndarray, tuple]:
            """(ids, inputs) of these windows."""
            found, ids = np.unique(parts.cut(numbers), return_inverse=True)
            pads = int(found[0] < 0)
            found = found[pads:]
            ids = np.where(ids < pads, PAD, ids + 2 - pads).reshape(WORDS, -1)
            ends = np.cumsum(sizes[found])
            at = np.repeat(starts[found] - ends + sizes[found], sizes[found]) + np.arange(ends[-1] if len(ends) else 0)
            return ids, self.inputs_of(rows[found], stem_rows[found], grams[at], np.append(0, ends))

        def by_steps(values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            count = len(parts.starts)
            return np.concatenate([np.zeros(0), *(values(np.arange(a, min(a + STEP, count))) for a in range(0, count, STEP))])

        def network(numbers: np.ndarray) -> np.ndarray:
            ids, inputs = arranged(numbers)
            return self.logits(ids, inputs[0])

        for turn in range(ROUNDS):
            if turn:
                found = by_steps(network)
            else:
                strength = np.maximum([strengths.get(x, 0.0) for x in words], np.array([0.0, *parts_strength])[stem_rows])
                strength = np.append(strength, -np.inf)  # of the number -1
                found = by_steps(lambda numbers: strength[parts.cut(numbers)].max(axis=0))
            ranks = np.split(found, parts.cuts[1:-1])
            # A label may be wrong: a toxic document without any window that looks so teaches nothing.
            tops = [rank.max() for rank, y in zip(ranks, labels.tolist(), strict=True) if y and len(rank)]
            least = 0.0 if turn else float(np.median(tops)) / 2 if tops else 0.0
            chosen: list[tuple[int, int]] = []
            for first, y, rank in zip(parts.cuts.tolist(), labels.tolist(), ranks, strict=False):
                if not len(rank):
                    continue
                top = int(np.argmax(rank))
                if y and rank[top] < least:
                    continue
                chosen.append((first + top, y))
                if not y and len(rank) > 1:
                    chosen.append((first + int(random.integers(len(rank))), 0))
            batches = max(1, len(chosen) // BATCH)
            windows_, wanted = np.array([c[0] for c in chosen], np.int64), np.array([c[1] for c in chosen], np.float32)
            for _ in range(max(EPOCHS, LEAST_STEPS // batches)):
                for batch in np.array_split(random.permutation(len(chosen)), batches):
                    if len(batch):
                        ids, inputs = arranged(windows_[batch])
                        adam.update(self.gradients(ids, wanted[batch], inputs))

    # -- scoring

    @staticmethod
    def arranged(parts: list[list[str]]) -> tuple[np.ndarray, list[str]]:
        """(word numbers (WORDS, windows), the words that have numbers from 2 on)."""
        numbers: dict[str, int] = {}
        ids = np.zeros((len(parts), WORDS), np.int64)
        for i, p in enumerate(parts):
            ids[i, : len(p)] = [numbers.setdefault(x, len(numbers) + 2) for x in p]
        return ids.T, list(numbers)

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window's probability of each whole text; 0 without a word."""
        if not self.trained:
            return np.full(len(texts), self.share)
        numbers: dict[str, int] = {}
        rows, owner = [], []
        for i, text in enumerate(texts):
            found = TOKEN.findall(text.lower())
            if not found:
                continue
            starts = windows(len(found))
            ids = np.zeros(starts[-1] + WORDS, np.int32)
            ids[: len(found)] = [numbers.setdefault(x, len(numbers) + 2) for x in found]
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, WORDS)[::STRIDE])
            owner += [i] * len(rows[-1])
        out = np.zeros(len(texts))
        if rows:
            logits = self.logits(np.ascontiguousarray(np.concatenate(rows).T), self.inputs(list(numbers))[0])
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, np.array(owner), logits)
            out = np.where(np.isfinite(best), sigmoid(best), 0.0)
        return out


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return ToxicityModel(sample(docs, labels, "toxic"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.3).

    Scores come from the text alone; a null text or one without a word has the score 0. Repeated rows keep a row each. Without
    labels of both kinds every score is the share of label 1, or 0 without any.
    """
    ship(docs.sparkSession)
    return report(docs, train(docs, labels).score, THRESHOLD)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score stays below the threshold, with all columns."""
    ship(docs.sparkSession)
    return kept(docs, train(docs, labels).score, f"_score < {THRESHOLD}")


def op8_gated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
