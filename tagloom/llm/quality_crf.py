"""Operator 8: document quality from a linear-chain conditional random field over lines.

Each line with words is one variable, good or bad, and the lines of a document are one chain, whatever its length. A
line's features are its own and those of the lines before and after it. The field is trained on labelled documents
whose lines take the document's label, by gradient steps on the exact log-likelihood in numpy. A document's raw
quality is the mean of its lines' forward-backward marginals weighted by their length, and its score is that on a
logistic curve fitted to the training documents.

At most `MAX_LABELLED` labelled rows of at most `MAX_CHARS` characters together (smallest id hash, held-out fold left out)
are learned from; each is used whole, in training and for the curve. Nothing else is bounded.

Chains are laid end to end with no potential between them, which keeps their marginals apart, and messages are passed by
blocks: products of 2 x 2 factors inside all blocks at once, then from block to block. So one chain of a million lines
takes some thousands of steps, and many short ones no padding.

A text without words (null, empty, white space) scores 0. Without labelled rows of both kinds every other text
scores the share of label 1, or 0. Repeated rows give repeated results, equal texts equal scores, an empty table an empty
one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import fold, labelled_sample, slices
from tagloom.llm.toxicity import logistic

#: Bounds of the labelled rows that are used.
MAX_LABELLED = 3000
MAX_CHARS = 16 << 20
ENDS = ".!?…。\"”)"
N_OWN = 16
CHUNK = 4096


def line_features(line: str, words: list[str], seen: set, grams: set) -> list[float]:
    """What one line says; seen and grams hold the document's earlier lines and word triples."""
    n, chars = len(words), len(line)
    body = sum(map(len, words))
    marks = sum(map(line.count, "#*$%&|<>"))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    known = sum(t in grams for t in triples)
    grams.update(triples)
    again = line in seen
    seen.add(line)
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    return [
        1.0,
        np.log1p(n) / 5,
        body / n / 10,
        marks / n,
        line.count("!") / n,
        line.count("|") / n,
        (line.count(".") + line.count(",")) / n,
        upper / n,
        sum(map(line.count, "0123456789")) / chars,
        len(set(words)) / n,
        known / max(1, len(triples)),
        float(again),
        float(words[-1][-1] in ENDS),
        float(words[0][0].isupper()),
        float(n < 4),
        float("://" in line or "@" in line or "=" in line),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Own features of the lines that have words, and the lines' lengths."""
    done, rows, lens, seen, grams = [], [], [], set(), set()
    for line in (text or "").split("\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words, seen, grams))
            lens.append(len(line))
            if len(rows) == CHUNK:
                done.append(np.array(rows, np.float32))
                rows = []
    done.append(np.array(rows, np.float32).reshape(-1, N_OWN))
    return np.concatenate(done), np.array(lens, np.float64)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Whether a line is the first of its chain, for chains of these sizes (none of them 0) laid end to end."""
    first = np.zeros(int(sizes.sum()), bool)
    first[np.cumsum(sizes) - sizes] = True
    return first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features beside those of the line before and the line after; zeros beyond the ends of a chain."""
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first] = 0
    after[np.roll(first, -1)] = 0
    return np.hstack([x, before, after])


def _scale(m: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return m / m.max(axes, keepdims=True)


class Field:
    """Weights for `good` of every feature, and of the four steps between neighbouring labels."""

    def __init__(self, size: int):
        self.w, self.step = np.zeros(size), np.zeros((2, 2))
        self.curve, self.fallback, self.trained = (1.0, 0.0), 0.0, False

    def marginals(self, unary: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and P(i, j) of it and the line before it; unary is a line's potential for good."""
        n = len(unary)
        # factor[t, i, j]: label i of the line before t, j of t; scaled, which no marginal depends on.
        u = np.stack([-np.maximum(unary, 0), unary - np.maximum(unary, 0)], 1)
        factor = np.where(first[:, None, None], 0.0, self.step[None] - self.step.max()) + u[:, None, :]
        block = max(1, int(np.sqrt(n)))
        pad = -n % block
        factor = np.exp(np.concatenate([np.maximum(factor, -300), np.zeros((pad, 2, 2))])).reshape(-1, block, 2, 2)
        ahead, behind = np.empty_like(factor), np.empty_like(factor)
        ahead[:, 0], behind[:, -1] = _scale(factor[:, 0], (1, 2)), np.eye(2)
        for t in range(1, block):
            ahead[:, t] = _scale(ahead[:, t - 1] @ factor[:, t], (1, 2))
            behind[:, -1 - t] = _scale(factor[:, -t] @ behind[:, -t], (1, 2))
        into, back = np.ones((len(factor), 2)), np.ones((len(factor), 2))
        for k in range(1, len(factor)):
            into[k] = _scale(into[k - 1] @ ahead[k - 1, -1], (0,))
            back[-1 - k] = _scale(ahead[-k, -1] @ back[-k], (0,))
        a = _scale((into[:, None, None, :] @ ahead)[:, :, 0].reshape(-1, 2), (1,))
        b = _scale((behind @ back[:, None, :, None])[..., 0].reshape(-1, 2), (1,))
        good = a[:, 1] * b[:, 1] / (a * b).sum(1)
        before = np.concatenate([np.ones((1, 2)), a[:-1]])
        pairs = before[:, :, None] * factor.reshape(-1, 2, 2) * b[:, None, :]
        return good[:n], (pairs / pairs.sum((1, 2), keepdims=True))[:n]

    def train(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> None:
        """Adam on the log-likelihood per line of chains laid end to end; rarer labels weigh as much in total as common ones."""
        first, label = starts_of(sizes), np.repeat(y, sizes)
        x = with_neighbours(x, first)
        share = y.mean()
        weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / len(x)
        inner = weight * ~first
        m, v = np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4)
        for k in range(1, epochs + 1):
            good, pairs = self.marginals(x @ self.w, first)
            steps = -(pairs * inner[:, None, None]).sum(0)
            for i in (0, 1):
                steps[i, i] += inner[label == i].sum()
            g = np.concatenate([(weight * (label - good)) @ x, steps.ravel()]) - ridge * np.concatenate([self.w, self.step.ravel()])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            d = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            self.w += d[:-4]
            self.step += d[-4:].reshape(2, 2)
        self.trained = True

    def raw(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log-odds of the length-weighted mean marginals; minus infinity for a document without lines."""
        out = np.full(len(docs), -np.inf)
        some = [i for i, (x, _) in enumerate(docs) if len(x)]
        if some:
            sizes = np.array([len(docs[i][0]) for i in some])
            first = starts_of(sizes)
            good, _ = self.marginals(with_neighbours(np.concatenate([docs[i][0] for i in some]), first) @ self.w, first)
            lens, at = np.concatenate([docs[i][1] for i in some]), np.cumsum(sizes) - sizes
            mean = np.clip(np.add.reduceat(good * lens, at) / np.add.reduceat(lens, at), 1e-6, 1 - 1e-6)
            out[some] = np.log(mean / (1 - mean))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        docs = [features(t) for t in texts]
        if not self.trained:
            return np.array([self.fallback if len(x) else 0.0 for x, _ in docs])
        raw = self.raw(docs)
        z = np.clip(self.curve[0] * np.where(np.isfinite(raw), raw, 0) + self.curve[1], -30, 30)
        return np.where(np.isfinite(raw), 1 / (1 + np.exp(-z)), 0.0)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of all lines in place of texts, as 32-bit floats; a row for each document."""
    for batch in slices(batches):
        found = [features(t) for t in batch.column("text").to_pylist()]
        x, lens = (pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), x, lens], ["doc_id", "y", "x", "lens"])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS) -> Field:
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, max_labelled, max_chars)
    rows = sample.select("doc_id", F.col("y").cast("int"), "text").mapInArrow(_chains, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, x binary, lens binary").orderBy("doc_id").collect()
    field = Field(3 * N_OWN)
    rows = [r for r in rows if r.lens]
    y = np.array([r.y for r in rows])
    field.fallback = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return field
    chains = [(np.frombuffer(r.x, np.float32).reshape(-1, N_OWN), np.frombuffer(r.lens, np.float64)) for r in rows]
    field.train(np.concatenate([x for x, _ in chains]), np.array([len(x) for x, _ in chains]), y)
    field.curve = logistic(field.raw(chains), y, ridge=1e-2)
    return field


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, held_out, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = field.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    out = F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out")
    df = docs.select(F.col("doc_id").cast("long"), out, "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return df.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
