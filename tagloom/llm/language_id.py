"""Operator 5: language identification by a byte convolutional network.

Texts are lower-cased and cut into windows of `WINDOW` UTF-8 bytes that cover them whole. Bytes are embedded, filters
of widths 2, 3 and 4 slide over a window, each filter keeps its largest response, and a softmax gives the languages.
A document's probabilities are its windows' mean, weighted by their bytes. The network is trained in numpy on the
driver. Each of n languages gives at most `max_labelled` / n documents (one at least, smallest id hashes), and each
document at most `max_windows` / `max_labelled` of its windows, chosen by hash over its whole text.

A text that is null or has no letter (`str.isalpha`) gives `und` with score 0, as do all texts if there is nothing to learn
from. Languages of equal probability go to the first in order. Repeated rows give repeated results, an empty table an
empty one; rows with a null id are scored and never learned from; long texts make more windows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import fold, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
#: Bounds of what is learned from.
MAX_LABELLED = 2000
MAX_WINDOWS = 6000


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text as rows of bytes, the last one filled up with zeros, and their lengths."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW), np.minimum(WINDOW, np.maximum(1, len(data) - WINDOW * np.arange(n)))


class Network:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        wide, total = max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS
        self.mask = np.zeros((wide, total), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, (wide, total)) * self.mask).astype(np.float32),
            "bias": np.zeros(total, np.float32),
            "out": rng.normal(0, 0.1, (total, len(languages))).astype(np.float32),
            "off": np.zeros(len(languages), np.float32),
        }

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, widest filter x embedding)."""
        e = self.p["embed"][x]
        shown = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), max(WIDTHS) * EMBED, axis=1)
        return shown[:, ::EMBED]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Response of every filter at every position, before pooling."""
        cols = self.columns(x)
        flat = np.ascontiguousarray(cols).reshape(-1, cols.shape[2])
        return cols, (flat @ self.p["conv"]).reshape(len(x), -1, len(self.p["bias"]))

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["off"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.softmax(self.hidden(x[i : i + 128])[1].max(1)) for i in range(0, len(x), 128)])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, h = self.hidden(x)
        at = h.argmax(1)
        pooled = np.take_along_axis(h, at[:, None], 1)[:, 0] + self.p["bias"]
        act = np.maximum(pooled, 0)
        d = self.softmax(pooled - self.p["bias"])
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.p["out"].T) * (pooled > 0)
        chosen = cols[np.arange(len(x))[:, None], at]  # (windows, filters, widest)
        conv = np.einsum("nf,nfk->kf", back, chosen) * self.mask
        into = (back[:, :, None] * self.p["conv"].T[None]).reshape(*at.shape, max(WIDTHS), EMBED)
        embed = np.zeros_like(self.p["embed"])
        spots = at[:, :, None] + np.arange(max(WIDTHS))
        np.add.at(embed, x[np.arange(len(x))[:, None, None], spots], into)
        return {"embed": embed, "conv": conv, "bias": back.sum(0), "out": act.T @ d, "off": d.sum(0)}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over shuffled batches."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2, max_labelled: int = MAX_LABELLED, max_windows: int = MAX_WINDOWS) -> Network | None:
    """Train on documents with a language, outside the held-out fold; None if there is none. An id gives one text per language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), modulus) != held_out)).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    each = max(1, max_labelled // max(1, sizes.count()))
    # Only hashes below a bound that lets some 2 x each (16 at least) of a language's ids through are ranked.
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * F.greatest(F.lit(2 * each), F.lit(16)) / F.col("ids")
    ranked = usable.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(low).select("doc_id", "lang").distinct()
    at = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    chosen = ranked.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= each).select("doc_id", "lang")
    per_doc = max(1, max_windows // max_labelled)
    kinds = {"doc_id": usable.schema["doc_id"].dataType.simpleString(), "lang": "string", "parts": "array<binary>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            has = pa.array([has_letter(t) for t in batch.column("text").to_pylist()], pa.bool_())
            parts = []
            for t in batch.column("text").filter(has).to_pylist():
                cut = windows(t)[0]
                order = sorted(range(len(cut)), key=lambda i: (crc32(i.to_bytes(8) + cut[i].tobytes()), i))
                parts.append([cut[i].tobytes() for i in sorted(order[:per_doc])])
            arrays = [batch.column("doc_id").filter(has), batch.column("lang").filter(has), pa.array(parts, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    found = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    rows = found.groupBy("doc_id", "lang").agg(F.min("parts").alias("parts")).orderBy(F.xxhash64("doc_id"), "lang").collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    place = {k: i for i, k in enumerate(languages)}
    x = np.frombuffer(b"".join(w for r in rows for w in r.parts), np.uint8).reshape(-1, WINDOW)
    y = np.concatenate([np.full(len(r.parts), place[r.lang]) for r in rows])
    net = Network(languages)
    net.train(x, y)
    return net


def languages(docs: DataFrame, modulus: int = 4, held_out: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang)."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, modulus, held_out, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = net.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if at is not None and has_letter(t)]
            if rows:
                cut = [windows(texts[i]) for i in rows]
                lens = np.concatenate([n for _, n in cut]).astype(np.float64)
                probs = at.predict(np.concatenate([x for x, _ in cut])) * lens[:, None]
                starts = np.concatenate([[0], np.cumsum([len(n) for _, n in cut])[:-1]])
                mean = np.add.reduceat(probs, starts, axis=0) / np.add.reduceat(lens, starts)[:, None]
                for i, m in zip(rows, mean, strict=True):
                    names[i], scores[i] = at.languages[int(m.argmax())], float(min(1.0, m.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    out = F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), out, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
