"""Operator 7: benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised (lower case, everything but letters and digits becomes one space) and compared as
UTF-8 bytes. An item is cut into patterns of some `WINDOW` bytes that overlap by half, so a document that holds
a part of an item is found as well, for sure from one and a half windows on; an item that is shorter is one pattern,
with the space before and after it. A pattern may have `EDIT_RATE` edits a byte, rounded down. A pattern of m bytes with k
edits shares at least m - q + 1 - kq q-grams with the place where it occurs, all within k + 1 neighbouring diagonals;
q is 12, 6 or 3 by the pattern's length, so that this bound is positive for every pattern and no item goes without. Shared
q-grams are counted in bands of diagonals that overlap by half, each band being wide enough to hold any such
alignment; bands that meet the bound are verified by banded semi-global alignment, many at a time.

Every document is searched whole, in overlapping segments of `SEGMENT` bytes, and the q-grams shared in a segment are
taken by `HITS` at a time, so that repetitive texts and items take time but no more memory. The benchmark is a
stated set; it is taken in blocks of at most `BLOCK_BYTES` bytes, each broadcast and held against all documents.

Null and empty texts, and texts without a letter or digit, contain nothing and, as items, are found nowhere. Repeated rows
give repeated results; an item id may be null and stands for all items without one; items of one id are counted as
one. An empty table on either side gives no matches; extra columns are ignored by `contaminated` and kept by
`decontaminate`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import slices

WINDOW = 112
#: Shortest pattern of each q; a shorter item is one pattern with the spaces around it.
SIZES = ((12, 96), (6, 8), (3, 1))
EDIT_RATE = 0.07
SEGMENT = 1 << 14
HITS = 1 << 20
ALIGNED = 1 << 10
BLOCK_BYTES = 8 << 20
TABLE_BITS = 22
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: A multiplier to the powers 1, 2 and 4, modulo 2**64.
POWERS = [np.uint64(pow(0x100000001B3, n, 1 << 64)) for n in (1, 2, 4)]
SPLIT = re.compile(r"[\W_]+").sub


def normalise(text: str | None) -> bytes:
    return SPLIT(" ", (text or "").lower()).strip().encode()


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes from each position, by doubling."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    h2 = h[:-1] * POWERS[0] + h[1:]
    if q == 3:
        return (h2[:-1] * POWERS[0] + h[2:]) * PRIME
    h4 = h2[:-2] * POWERS[1] + h2[2:]
    if q == 6:
        return (h4[:-2] * POWERS[1] + h2[4:]) * PRIME
    h8 = h4[:-4] * POWERS[2] + h4[4:]
    return (h8[:-4] * POWERS[2] + h4[8:]) * PRIME


class Grams:
    """The q-grams of the patterns of one q, and the bands of a text that share enough of them."""

    def __init__(self, q: int, parts: list[bytes]):
        self.q, self.parts = q, parts
        self.size = np.array([len(p) for p in parts], np.int64)
        self.edits = np.floor((self.size - 2 * (q < 12)) * EDIT_RATE).astype(np.int64)
        self.bound = self.size - q + 1 - self.edits * q
        # One width for all bands: the most edits of any pattern, plus the diagonal itself.
        self.half, self.longest = int(self.edits.max()) + 1, int(self.size.max())
        hashes = [grams(np.frombuffer(p, np.uint8), q) for p in parts]
        flat = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(parts)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(flat >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def bands(self, data: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(shared q-grams, first diagonal) of the bands that meet their pattern's bound, by pattern."""
        out: dict[int, list[tuple[int, int]]] = {}
        if len(data) < self.q:
            return out
        h = grams(data, self.q)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if len(at) < self.bound.min():
            return out
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[key] == h[at]
        at, key = at[ok], key[ok]
        # The bands that start in a segment need the positions up to one pattern and one band after it.
        reach = self.longest + 2 * self.half
        for start in range(0, len(data), SEGMENT):
            low, high = np.searchsorted(at, (start, start + SEGMENT + reach))
            if high > low:
                self._segment(at[low:high], key[low:high], start, out)
        return out

    def _segment(self, at: np.ndarray, key: np.ndarray, start: int, out: dict[int, list[tuple[int, int]]]) -> None:
        n = self.count[key]
        ends = np.cumsum(n)
        if ends[-1] < self.bound.min():
            return
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(HITS, ends[-1], HITS)), len(at)))
        parts = [(int(a), int(b)) for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True) if b > a]

        def hits(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            """Pattern and diagonal of what is shared from the a-th to the b-th position."""
            m = n[a:b]
            sums = np.cumsum(m)
            hit = np.repeat(self.first[key[a:b]] - sums + m, m) + np.arange(sums[-1])
            return self.owner[hit], np.repeat(at[a:b], m) - self.place[hit]

        total = np.zeros(len(self.size), np.int64)
        for a, b in parts:
            total += np.bincount(hits(a, b)[0], minlength=len(total))
        enough = total >= self.bound
        if not enough.any():
            return
        span, off = (SEGMENT + 2 * self.longest) // self.half + 8, self.longest // self.half + 3
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in parts:
            who, diagonal = hits(a, b)
            keep = enough[who]
            low = (diagonal[keep] - start) // self.half
            # Band b holds the diagonals [b * half, (b + 2) * half): each diagonal is in the bands low and low - 1.
            code = who[keep] * span + low + off
            code, got = np.unique(np.concatenate([code, code - 1]), return_counts=True)
            codes, back = np.unique(np.concatenate([codes, code]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, got]), len(codes)).astype(np.int64)
        for c, shared in zip(codes[good := counts >= self.bound[codes // span]].tolist(), counts[good].tolist(), strict=True):
            diagonal = start + (c % span - off) * self.half
            if start == 0 or start <= diagonal + self.half:
                out.setdefault(c // span, []).append((shared, diagonal))

    def align(self, padded: np.ndarray, pad: int, pattern: int, diagonals: np.ndarray) -> np.ndarray:
        """Fewest edits of the pattern against any part of the text within each band of diagonals.

        Beyond the ends of the text stand bytes that equal none; meeting one costs as much as a missing byte.
        """
        column = np.arange(2 * self.half + 1)
        spot = diagonals[:, None] + column + pad
        row = np.zeros(spot.shape, np.int64)
        for i, byte in enumerate(self.parts[pattern]):
            fresh = row + (padded[spot + i] != byte)  # match or replace
            fresh[:, :-1] = np.minimum(fresh[:, :-1], row[:, 1:] + 1)  # a byte of the pattern is missing
            row = column + np.minimum.accumulate(fresh - column, axis=1)  # a byte of the text is extra
        return row.min(1)

    def search(self, data: bytes) -> dict[int, int]:
        """Fewest edits of the patterns that the text holds."""
        found: dict[int, int] = {}
        pad = self.longest + 2 * self.half + 4
        padded = None
        for pattern, bands in self.bands(np.frombuffer(data, np.uint8)).items():
            if self.parts[pattern] in data:
                found[pattern] = 0
                continue
            best = int(self.edits[pattern]) + 1
            bands.sort(reverse=True)
            if padded is None:
                padded = np.pad(np.frombuffer(data, np.uint8), pad + 2 * self.half, constant_values=255)
            for i in range(0, len(bands), ALIGNED):
                # So many shared q-grams need so many edits at least.
                least = -(-(int(self.size[pattern]) - self.q + 1 - bands[i][0]) // self.q)
                if best <= max(least, 1):
                    break
                best = min(best, int(self.align(padded, pad + 2 * self.half, pattern, np.array([d for _, d in bands[i : i + ALIGNED]])).min()))
            if best <= self.edits[pattern]:
                found[pattern] = best
        return found


class Patterns:
    """Patterns of a block of items (id, text), by their q."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.of: dict[int | None, int] = {}
        by_q: dict[int, list[tuple[int | None, bytes]]] = {}
        for item, text in items:
            data = normalise(text)
            for part in self.cut(data):
                q = next(q for q, least in SIZES if len(part) >= least)
                by_q.setdefault(q, []).append((item, part))
                self.of[item] = self.of.get(item, 0) + 1
        self.grams = [(Grams(q, [p for _, p in some]), [i for i, _ in some]) for q, some in by_q.items()]

    @staticmethod
    def cut(data: bytes) -> Iterator[bytes]:
        if not data:
            return
        if len(data) < SIZES[0][1]:
            yield b" " + data + b" "
            return
        for at in range(0, len(data), WINDOW // 2):
            if len(data) - at <= WINDOW * 5 // 4:
                yield data[at:]
                return
            yield data[at : at + WINDOW]

    def search(self, text: str | None) -> dict[int | None, tuple[int, int]]:
        """By item that the text holds: fewest edits of a pattern, and how many patterns are there."""
        data = b" " + normalise(text) + b" "
        found: dict[int | None, tuple[int, int]] = {}
        if len(data) > 2:
            for grams_, items in self.grams:
                for pattern, edits in grams_.search(data).items():
                    least, n = found.get(items[pattern], (edits, 0))
                    found[items[pattern]] = min(least, edits), n + 1
        return found


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The stated set of items in blocks of bounded bytes, in the order of their ids."""
    block, held = [], 0
    for r in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r.text.encode())
        if block and held + n > limit:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += n
    if block:
        yield block


KIND = "array<struct<item_id: bigint, edits: int, parts: int, of: int>>"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, items): for every row of docs and block of items, an array<struct<item_id, edits, parts, of>>, empty if there is none."""
    sc = docs.sparkSession.sparkContext
    df = docs.select("doc_id", "text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("parts", pa.int32()), ("of", pa.int32())]))
    out = None
    for block in blocks(benchmark):
        held = sc.broadcast(Patterns(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            patterns = held.value
            for batch in slices(batches):
                found = []
                for text in batch.column("text").to_pylist():
                    items = sorted(patterns.search(text).items(), key=lambda x: (x[0] is None, x[0] or 0))
                    found.append([{"item_id": i, "edits": e, "parts": n, "of": patterns.of[i]} for i, (e, n) in items])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "items"])

        part = df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, items {KIND}")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = df.select("doc_id", F.array().cast(KIND).alias("items"))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, parts, of: a row for each document and item that it holds in whole or in part.

    `edits` is the least of the item's patterns that are there, `parts` how many those are, `of` how many it has.
    """
    return matches(docs, benchmark).select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item in whole or in part.

    For one block of items, the texts pass through the search with their rows; for more, the search of one block runs on
    what the block before has left.
    """
    sc, columns = docs.sparkSession.sparkContext, docs.columns
    # The row travels whole in one column, so its own columns can have any names.
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), "text")
    for block in blocks(benchmark):
        held = sc.broadcast(Patterns(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            patterns = held.value
            for batch in slices(batches):
                yield batch.filter(pa.array([not patterns.search(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
