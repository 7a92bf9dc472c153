"""Operator 2: toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Every word of the labelled examples is a term; its weight is (1 + log n) * idf, n being its number in the text and idf
the logarithm of documents by documents with it, over all documents. Vectors have length one, words that no example has counting with the idf of
an unseen word. The index has a posting list for each term, in blocks of 64 examples, and for each block of a list the
largest weight. A text is cut into passages of at most `PASSAGE` words that cover it whole, and each is a query: blocks are
taken in the order of their upper bound (query weights times block maxima, summed over the terms) until no block can
reach the k-th best example, so the k nearest are exact. So is every single word, whose nearest examples are those that give
it the largest weight; their votes are known beforehand. Examples vote weighted by their similarity relative to the
nearest, and words, which may have few examples, with the weight of `PRIOR` examples of the common share of label 1.

A text has two votes: that of its most toxic passage and the mean of those of its two most toxic words. A logistic curve of
both makes them a probability; it is fitted to the examples themselves, an example and its exact copies having no vote on
it. `evidence` has the three nearest examples of the passage with their similarities.

Fitting uses at most `MAX_LABELLED` labelled rows of at most `MAX_CHARS` characters together (smallest id hash, held-out
fold left out), which bounds the index that is broadcast; nothing else is bounded.

A null text counts as empty. A text without any term gets the share of label 1 among such examples, or among all if there
are none. Without labelled rows of both kinds every score is the share of label 1, or 0 if there is no labelled row. Equal
similarities go to the smaller id, equal votes to the earlier passage. Repeated rows give repeated results, an empty
table an empty one; very long texts make more passages; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import fold, labelled_sample, shuffle_partitions, slices

#: Bounds of the labelled rows that are used.
MAX_LABELLED = 3072
MAX_CHARS = 64 << 20
NEIGHBOURS = 64
PRIOR = 4.0
TOP_WORDS = 2
PASSAGE = 1024
BLOCK = 64
PIVOTS = 16
WORDS = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def passages(found: list[str], most: int = PASSAGE) -> list[list[str]]:
    """Cut into the fewest parts of like length, none longer than `most`."""
    n = -(-len(found) // most)
    step = -(-len(found) // n) if n else 1
    return [found[i : i + step] for i in range(0, len(found), step)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of x, and the offset, of a logistic curve by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def document_frequencies(docs: DataFrame, place: dict[str, int]) -> tuple[np.ndarray, int]:
    """How many documents have each term of `place`, and how many there are, over all rows."""
    held = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        terms, counts, n = frozenset(at), Counter(), 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(terms.intersection(words(text)))
            n += batch.num_rows
        some = [*(at[w] for w in counts), *[len(at)] * (n > 0)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([*counts.values(), *[n] * (n > 0)], pa.int64())], ["i", "n"])

    rows = docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(place) + 1, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Posting lists of the examples in blocks with their maxima, and what is needed to score a text."""

    def __init__(self, place: dict[str, int], idf: np.ndarray, unseen: float, k: int):
        self.place, self.idf, self.unseen, self.k = place, idf.astype(np.float64), unseen, k
        self.empty, self.size = 0.0, 0

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their weights in the unit vector of a text."""
        at = np.fromiter(map(self.place.get, counts, repeat(-1)), np.int64, len(counts))
        tf = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        known = at >= 0
        terms = at[known]
        weights = tf[known] * self.idf[terms]
        norm = np.sqrt((weights**2).sum() + ((tf[~known] * self.unseen) ** 2).sum())
        return terms, weights / norm if norm else weights

    def fill(self, ids: np.ndarray, y: np.ndarray, keys: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Similar examples share blocks: they are ordered by the nearest of some of them. keys are equal for equal texts."""
        pivots = np.zeros((len(self.idf), min(PIVOTS, len(vectors))))
        for j in range(pivots.shape[1]):
            terms, weights = vectors[j]
            pivots[terms, j] = weights
        near = [weights @ pivots[terms] for terms, weights in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (int(near[i].argmax()), -float(near[i].max()), int(ids[i])))
        self.size = len(order)
        self.ids, self.y, self.keys = ids[order], y[order], keys[order]
        sizes = [len(vectors[i][0]) for i in order]
        terms, weights = (np.concatenate([vectors[i][j] for i in order]) for j in (0, 1))
        example = np.repeat(np.arange(self.size), sizes)
        by_term = np.lexsort((example, terms))
        # Every list by falling weight as well, for queries of one word.
        heavy = np.lexsort((self.ids[example], -weights, terms))
        self.post = np.searchsorted(terms[heavy], np.arange(len(self.idf) + 1))
        self.heavy, self.heavy_weight = example[heavy].astype(np.int32), weights[heavy]
        self.share = float(self.y.mean())
        self.word_votes = self.votes_of(np.arange(len(self.idf)))
        terms, self.example, self.weight = terms[by_term], example[by_term].astype(np.int64), weights[by_term]
        # One entry for each term and block: where its postings start, how many there are, and the largest weight.
        cell = terms * (-(-self.size // BLOCK)) + self.example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.start, self.length = first, np.diff(np.append(first, len(cell)))
        self.block = (self.example[first] // BLOCK).astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.list = np.searchsorted(terms[first], np.arange(len(self.idf) + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k nearest examples with a positive similarity, exactly; without: a key to leave out."""
        sizes = self.list[terms + 1] - self.list[terms]
        entry = ranges(self.list[terms], sizes)
        share = np.repeat(weights, sizes)
        block = self.block[entry]
        bounds = np.bincount(block, share * self.most[entry], -(-self.size // BLOCK))
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[block]
        found, sims = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, 16
        while done < len(order):
            top = bounds[order[done]]
            if top <= 0 or (len(sims) == self.k and top < sims[-1] - 1e-9):
                break
            here = np.flatnonzero((rank >= done) & (rank < done + step))
            taken = entry[here]
            lengths = self.length[taken]
            at = ranges(self.start[taken], lengths)
            s = np.round(np.bincount(self.example[at], np.repeat(share[here], lengths) * self.weight[at], self.size), 12)
            new = np.flatnonzero(s)
            if without is not None:
                new = new[self.keys[new] != without]
            found, sims = np.concatenate([found, new]), np.concatenate([sims, s[new]])
            if len(sims) > self.k:
                keep = sims >= np.partition(sims, -self.k)[-self.k]
                found, sims = found[keep], sims[keep]
            best = np.lexsort((self.ids[found], -sims))[: self.k]
            found, sims = found[best], sims[best]
            done, step = done + step, step * 2
        return found, sims

    def votes_of(self, terms: np.ndarray, without: int | None = None) -> np.ndarray:
        """The vote of the k nearest examples of each word alone."""
        sizes = self.post[terms + 1] - self.post[terms]
        at, word = ranges(self.post[terms], sizes), np.repeat(np.arange(len(terms)), sizes)
        if without is not None:
            keep = self.keys[self.heavy[at]] != without
            at, word = at[keep], word[keep]
        first = np.searchsorted(word, np.arange(len(terms)))
        keep = np.arange(len(at)) - first[word] < self.k
        weight = self.heavy_weight[at[keep]] / self.heavy_weight[at[first[word[keep]]]]
        word, y = word[keep], self.y[self.heavy[at[keep]]]
        return (np.bincount(word, weight * y, len(terms)) + PRIOR * self.share) / (np.bincount(word, weight, len(terms)) + PRIOR)

    def votes(self, text: str | None, without: int | None = None) -> tuple[tuple[float, float] | None, list[tuple[int, float]]]:
        """The two votes on a text, and the nearest examples of its most toxic passage; None if the text has no neighbour."""
        found = words(text)
        best: tuple = (None, np.zeros(0, np.int64), np.zeros(0))
        seen = []
        for part in passages(found) if self.size else []:
            terms, weights = self.vector(Counter(part))
            at, sims = self.nearest(terms, weights, without)
            seen.append(terms)
            if len(sims):
                vote = float(sims @ self.y[at] / sims.sum())
                if best[0] is None or vote > best[0]:
                    best = vote, at, sims
        if best[0] is None:
            return None, []
        terms = np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0]
        single = np.sort(self.word_votes[terms] if without is None else self.votes_of(terms, without))
        return (best[0], float(single[-TOP_WORDS:].mean())), [(int(self.ids[i]), float(s)) for i, s in zip(best[1][:3], best[2][:3], strict=True)]

    def score(self, text: str | None, curve: np.ndarray) -> tuple[float, list[tuple[int, float]]]:
        votes, evidence = self.votes(text)
        if votes is None:
            return self.empty, []
        return float(1 / (1 + np.exp(-np.clip(curve[:-1] @ votes + curve[-1], -30, 30)))), evidence


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in place of texts."""
    for batch in slices(batches):
        found = [words(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("key"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "y", "key", "words"])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS, k: int = NEIGHBOURS) -> tuple[Broadcast, np.ndarray]:
    """The index, broadcast, and the curve."""
    sample = labelled_sample(docs, labels, "toxic", modulus, held_out, max_labelled, max_chars)
    sample = sample.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), F.xxhash64("text").alias("key"), "text")
    rows = sample.mapInArrow(_examples, "doc_id long, y int, key long, words array<string>").orderBy("doc_id").toArrow()
    ids, y, keys = (rows.column(c).to_numpy() for c in ("doc_id", "y", "key"))
    found = rows.column("words").to_pylist()
    place = {w: i for i, w in enumerate(sorted({w for f in found for w in f}))}
    df, n_docs = document_frequencies(docs, place)
    index = Index(place, np.log((1 + n_docs) / (1 + df)), float(np.log(1 + n_docs)), k)
    index.empty = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) > 1 and place:
        index.fill(ids, y.astype(np.float64), keys, [index.vector(Counter(f)) for f in found])
    held = docs.sparkSession.sparkContext.broadcast(index)
    if not index.size:
        return held, np.zeros(3)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [held.value.votes(t, key)[0] for t, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            columns = [pa.array([v and v[i] for v in got], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *columns], ["doc_id", "y", "passage", "word"])

    # A curve and a share from at most max_labelled rows of four numbers.
    votes = sample.repartition(shuffle_partitions(docs.sparkSession)).mapInArrow(own_votes, "doc_id long, y int, passage double, word double").orderBy("doc_id").toArrow()
    y, x = votes.column("y").to_numpy(), np.column_stack([votes.column(c).to_numpy() for c in ("passage", "word")])
    has = ~np.isnan(x[:, 0])
    if not has.all():
        index.empty = float((y[~has].sum() + 0.5) / ((~has).sum() + 1))
        held = docs.sparkSession.sparkContext.broadcast(index)
    return held, logistic(x[has], y[has].astype(np.float64)) if has.any() else np.zeros(3)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence for every row of docs (doc_id, text)."""
    index, curve = fit(docs, labels, modulus, held_out, **options)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for batch in slices(batches):
            scored = [at.score(t, curve) for t in batch.column("text").to_pylist()]
            evidence = [[{"doc_id": i, "similarity": s} for i, s in e] for _, e in scored]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in scored], pa.float64()), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "evidence"])

    out = F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out")
    df = docs.select(F.col("doc_id").cast("long"), out, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, evidence array<struct<doc_id: bigint, similarity: double>>")
    return df.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
