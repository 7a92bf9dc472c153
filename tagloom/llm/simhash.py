"""Operator 3: SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits: for each bit, whether over half the shingle hashes have it set. The anchors are the words of
a covering code, the direct sum of repetition codes over consecutive blocks of `block` bits; every block has covering
radius (block - 1) / 2, so each fingerprint has a home anchor (the majority of every block). If two fingerprints
differ in at most t bits, the home anchor of one lies within the covering radius plus, summed over all blocks, t of
the other: changing a block's majority takes (distance of the block to the anchor's block) - radius flips. Each
distinct fingerprint is therefore replicated to all anchors within that distance and met there with the fingerprints
at home; what is compared in an anchor is kept if the bits differ in at most t places. No pair is missed.

With blocks of three there are 2**22 anchors and about 150 replicas; for more than some 10**9 distinct fingerprints,
blocks of one bit make anchors finer (2081 replicas, and no comparison that fails).

Documents are grouped by fingerprint before any pair is formed, so copies make no pairs; links are closed by
min-label star contraction with a checkpoint for each round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import checkpoint, parts_for, shuffle_partitions, slices

SEED = 42
PART = 1 << 16


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, in arrays of at most PART; ASCII letters lower-cased.

    A text of fewer words than `width` is one shingle, one without words none.
    """
    data = np.frombuffer(text.encode().lower(), np.uint8)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    # One space stays after each word.
    keep = ~space
    keep[1:] |= ~space[:-1]
    joined = np.where(space[keep], 0x20, data[keep]).astype(np.uint8)
    joined = joined[:-1] if len(joined) and joined[-1] == 0x20 else joined
    if not len(joined) or joined[0] == 0x20:
        joined = joined[1:]
    if not len(joined):
        return
    ends = np.append(np.flatnonzero(joined == 0x20), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(ends) - width + 1)
    starts, ends, whole, xx = starts[:n], ends[-n:], joined.tobytes(), xxhash.xxh64_intdigest
    for i in range(0, n, PART):
        at = list(zip(starts[i : i + PART].tolist(), ends[i : i + PART].tolist(), strict=True))
        yield np.fromiter((xx(whole[a:b], SEED) for a, b in at), np.uint64, len(at))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that over half of all hashes have."""
    held, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        held += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * held > n).tobytes(), "big")


def fingerprint(text: str, width: int = 3) -> int:
    """64 majority bits of the hashes of the word shingles of a text; zero without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A null text counts as empty, which gives zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t or "", width) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=4)
def _code(block: int) -> tuple[np.ndarray, np.ndarray]:
    """First bit and length of every block."""
    rest = 64 % block
    length = np.array([block] * (64 // block) + ([rest] if rest % 2 else [rest - 1, 1] if rest else []))
    return np.cumsum(length) - length, length


def anchors(fps: np.ndarray, block: int, threshold: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Home anchor of each fingerprint, and the rows and anchors of all replicas, home included."""
    first, length = _code(block)
    if block % 2 == 0:
        raise ValueError("blocks have an odd number of bits each")
    bits = (fps.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    ones = np.add.reduceat(bits.astype(np.int64), first, axis=1)
    home = 2 * ones > length
    cost = np.abs(2 * ones - length) // 2 + 1  # flips that turn a block's majority
    place = np.int64(1) << np.arange(len(first), dtype=np.int64)
    base = (home * place).sum(1)
    rows, out = [np.arange(len(fps))], [base]
    for k in range(1, threshold + 1):
        for blocks in combinations(range(len(first)), k):
            ok = np.flatnonzero(cost[:, blocks].sum(1) <= threshold)
            rows.append(ok)
            out.append(base[ok] ^ place[list(blocks)].sum())
    return base, rows, out


def links(fps: DataFrame, threshold: int = 2, block: int = 3) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints that differ in at most `threshold` bits; fps has distinct fp."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(anchors(x, block, 0)[0]), pa.array(x)], ["anchor", "a"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                x = batch.column("fp").to_numpy()[start : start + 2048]
                _, rows, out = anchors(x, block, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(x[np.concatenate(rows)])], ["anchor", "b"])

    # The rows are few bytes each, so that they would be read by few tasks; their replicas are many.
    dealt = fps.select("fp").repartition(shuffle_partitions(fps.sparkSession), "fp")
    home = dealt.mapInArrow(at_home, "anchor long, a long")
    # Spark sizes the replicas by the few rows that they are made of, and would broadcast them.
    near = dealt.mapInArrow(replicate, "anchor long, b long").hint("merge")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return home.join(near, "anchor").where(close).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for all ends of edges (a, b); two fingerprints have one root if links reach from one to the other.

    Alternates large-star and small-star contraction until no edge changes; each round is one checkpoint. Edges never become
    more, so all steps run in as many partitions as the first edges need.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = parts_for(edges.count())
    edges = edges.coalesce(n)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(n).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = checkpoint(small.coalesce(n).distinct().coalesce(n))
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("fp"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionAll(roots)


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 2, block: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the document's own included. Null and empty texts have
    fingerprint zero and link like any other. Rows with a null id are kept; they take part through their fingerprint
    and get a null component only if no id is in reach. Repeated rows give repeated results, an empty table an empty one;
    texts of any length are hashed whole, by parts; extra columns are ignored.
    """
    fps = checkpoint(fingerprints(docs, width))
    vertices = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = vertices.join(components(links(vertices, threshold, block)), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    roots = checkpoint(roots)
    labels = roots.join(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
