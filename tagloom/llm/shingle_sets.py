"""Near-duplicates by SimHash, completed by MinHash bands and verified by Jaccard similarity, for the pipeline.

Fingerprints of 64 bits that differ in 2 bits find few of the pairs whose five-word shingles have a similarity of 0.8
(they differ in some 10 bits), and no covering code reaches so far. So the texts that operator 3 links meet, all of them, and so do
those that share one of `BANDS` bands of `ROWS` MinHash values each, of which two texts of similarity s share one with
probability 1 - (1 - s**5)**20: 0.9996 at 0.8 and more above. A text has that many keys, whatever its length.

Only texts that meet are held against each other, first by a bound and then by their whole shingle sets, so every link is
exact. The bound is that of bitmaps of 1024 bits in which each shingle turns one bit: they can't differ in more bits than
the sets in shingles, and differ in nearly as many while these are few. Of the near copies of one text, many are less similar to
each other than the limit; the bound keeps nearly all of these from becoming pairs. Texts with one set are one vertex before any
pair is formed.

Pairs are formed in rounds. At first each text is held against one other at most: the smallest key within 2 bits, then,
a few times, one that it meets in another group. The last round takes all that meet, by a band or by their fingerprints, are still in
different groups and pass the bound, so no pair that meets is left out that could change a group. There, the texts of the commonest
group of a band are held against the others only, not against each other, as they are in one group already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import checkpoint, shuffle_partitions, slices
from tagloom.llm.simhash import SEED, components, links, majority, shingle_hashes

#: Rounds in which a text is held against one other at most.
ROUNDS = 2
BANDS = 20
ROWS = 5
CHUNK = 4096
SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Longs of a bitmap; with as many bits as most texts have shingles, few of those that differ fall together.
WORDS = 16


def hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The hashes of the word shingles of a text, repeats included."""
    return np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text or "", width)])


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(hashes(text, width))


def key_of(found: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)


def bands_of(found: np.ndarray) -> list[int]:
    """A key for each band of MinHash values of a set; none for an empty set."""
    if not len(found):
        return []
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max)
    for i in range(0, len(found), CHUNK):
        x = (found[None, i : i + CHUNK] ^ SEEDS) * MULTIPLIER
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(1))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def bitmap_of(found: np.ndarray) -> list[int]:
    """64 * WORDS bits, each the parity of the shingles that fall on it."""
    bits = (np.bincount((found % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, stamp, key, fp, n, bits, bands) of every row: stamp of its text; key, SimHash, size, bitmap and bands of its set."""
    kinds = {"doc_id": pa.int64(), "stamp": pa.int64(), "key": pa.int64(), "fp": pa.int64(), "n": pa.int32(), "bits": pa.list_(pa.int64()), "bands": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[list] = [[] for _ in range(5)]
            for text in batch.column("text").to_pylist():
                every = hashes(text, width)
                found = np.unique(every)
                fp = int(np.uint64(majority([every])).view(np.int64))
                for column, value in zip(rows, (int(key_of(found)), fp, len(found), bitmap_of(found), bands_of(found)), strict=True):
                    column.append(value)
            arrays = [batch.column("doc_id"), batch.column("stamp"), *(pa.array(x, k) for x, k in zip(rows, list(kinds.values())[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    return docs.select(F.col("doc_id").cast("long"), stamp(), "text").mapInArrow(run, "doc_id long, stamp long, key long, fp long, n int, bits array<long>, bands array<long>")


def stamp() -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("stamp")


def _can(a: str, b: str, similarity: float) -> Column:
    """Whether the structs a and b (n, bits) leave their sets similar enough."""
    differ = F.lit(0)
    for i in range(WORDS):
        differ = differ + F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i))))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = F.least(n, m) >= F.greatest(n, m) * F.lit(similarity) - F.lit(1e-6)
    return near & (differ <= (n + m) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6))


def confirm(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are similar enough; texts (key, text) has one text for each key.

    texts is partitioned by key, so only the pairs and the text of one side of each are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "y"):
            ok = []
            for i in range(batch.num_rows):
                x, y = (shingles(batch.column(c)[i].as_py(), width) for c in ("x", "y"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    x, y = texts.select(F.col("key").alias("a"), F.col("text").alias("x")), texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _apart(met: DataFrame, linked: DataFrame) -> DataFrame:
    """met (s, v) with the group that each text is in so far, without the bands in which one group alone meets.

    Groups only grow, so what is left out has nothing more to say. common: whether it is the commonest group of its band.
    """
    at = Window.partitionBy("s")
    rooted = met.select("s", "v", F.col("v.key").alias("key")).join(linked.withColumnRenamed("fp", "key"), "key", "left").select("s", "v", F.coalesce("root", "key").alias("root"))
    ends = rooted.select("*", F.min("root").over(at).alias("low"), F.max("root").over(at).alias("high"), F.mode("root").over(at).alias("most"))
    return checkpoint(ends.where("low <> high").select("s", "v", "root", (F.col("root") == F.col("most")).alias("common")))


def _one_each(met: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b): for each text the smallest key that it meets in another group and could be similar to, if any.

    It is looked for among the smallest texts of the smallest and the largest group in a band, and the texts before and
    after in an order that changes with the round.
    """
    at = Window.partitionBy("s")
    line, me = at.orderBy(F.xxhash64("v.key", F.lit(turn)), "v.key"), F.struct("root", "v")
    others = F.array(F.min(me).over(at), F.max(me).over(at), F.lag(me).over(line), F.lead(me).over(line))
    rows = met.select("v", "root", others.alias("others")).select("v", "root", F.explode("others").alias("o"))
    rows = rows.where("o.root <> root").select("v", F.col("o.v").alias("o"))
    rows = rows.where(_can("v", "o", similarity)).groupBy(F.col("v.key").alias("key")).agg(F.min("o.key").alias("o"))
    return rows.select(F.least("key", "o").alias("a"), F.greatest("key", "o").alias("b")).distinct()


def _across(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of keys that meet, are in different groups and could be similar; one side is not in a band's commonest."""
    other = met.select("s", F.col("v").alias("w"), F.col("root").alias("root2"), F.col("common").alias("common2"))
    once = F.col("common2") | (F.col("v.key") < F.col("w.key"))
    pairs = met.where(~F.col("common")).join(other, "s").where(once & (F.col("root") != F.col("root2")) & _can("v", "w", similarity))
    return pairs.select(F.least("v.key", "w.key").alias("a"), F.greatest("v.key", "w.key").alias("b")).distinct()


def groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """(doc_id, stamp, root) for every row of docs (doc_id, text): texts that links reach have one root."""
    rows = checkpoint(sketches(docs, width))
    vertices = checkpoint(rows.groupBy("key").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("bands").alias("bands"), F.min(F.struct("doc_id", "stamp")).alias("row")))
    # Equal sets have several fingerprints if their repeats differ.
    marks = checkpoint(rows.select("key", "fp").distinct())
    heads = checkpoint(marks.groupBy("fp").agg(F.min("key").alias("key")))
    beside = checkpoint(links(heads, bits))
    # What meets in a band, or at a fingerprint: the texts that have it, and those of the larger ones that differ in a few bits.
    places = marks.unionAll(beside.select("a", F.col("b").alias("fp")).join(marks, "fp").select("key", F.col("a").alias("fp"))).distinct()
    at = Window.partitionBy("s")
    met = vertices.select("key", F.explode("bands").alias("s")).unionAll(places.select("key", F.col("fp").alias("s")))
    met = met.select("s", "key", F.count("*").over(at).alias("size")).where("size > 1").select("s", "key")
    met = checkpoint(met.join(vertices.select("key", F.struct("key", "n", "bits").alias("v")), "key").select("s", "v"))
    # At first, for each text the smallest key with its fingerprint, or with one that differs in a few bits.
    near = beside.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("a")).join(heads, "fp").join(heads.select(F.col("fp").alias("a"), F.col("key").alias("o")), "a").where("key <> o").select("key", "o")
    equal = marks.join(heads.withColumnRenamed("key", "o"), "fp").where("key <> o").select("key", "o")
    sides = vertices.select("key", F.struct("key", "n", "bits").alias("v"))
    pairs = near.unionAll(equal).distinct().join(sides, "key").join(sides.select(F.col("key").alias("o"), F.col("v").alias("w")), "o").where(_can("v", "w", similarity))
    tried = checkpoint(pairs.select(F.least("key", "o").alias("a"), F.greatest("key", "o").alias("b")).distinct())
    # The texts of what meets or has a link, one for each key.
    ends = met.select("v.key").unionAll(tried.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    id_ = lambda c: F.struct(c.isNull(), F.coalesce(c, F.lit(0)))
    whose = vertices.join(ends, "key", "left_semi").select("key", id_(F.col("row.doc_id")).alias("id"), F.col("row.stamp").alias("stamp"))
    texts = docs.select(id_(F.col("doc_id").cast("long")).alias("id"), stamp(), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(whose, ["id", "stamp"]).groupBy("key").agg(F.min("text").alias("text"))
    texts = checkpoint(texts.repartition(shuffle_partitions(docs.sparkSession), "key"))
    edges = checkpoint(confirm(tried, texts, width, similarity))
    for turn in range(ROUNDS):
        met = _apart(met, checkpoint(components(edges)))
        more = checkpoint(_one_each(met, similarity, turn).join(tried, ["a", "b"], "left_anti"))
        edges = checkpoint(edges.unionAll(confirm(more, texts, width, similarity)))
        tried = tried.unionAll(more)
    met = _apart(met, checkpoint(components(edges)))
    rest = checkpoint(_across(met, similarity).join(tried, ["a", "b"], "left_anti"))
    linked = checkpoint(components(edges.unionAll(confirm(rest, texts, width, similarity))))
    return rows.select("doc_id", "stamp", "key").join(linked.withColumnRenamed("fp", "key"), "key", "left").select("doc_id", "stamp", F.coalesce("root", "key").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """doc_id and component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links of the given similarity reach. Null texts and texts without words are
    one group, a text shorter than a shingle is one shingle. Rows with a null id take part through their text and get a null
    component only if no id is in reach. Repeated rows give repeated results, an empty table an empty one; texts of any length
    are compared whole; extra columns are ignored.
    """
    rows = checkpoint(groups(docs, width, similarity, bits))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """docs with one row for each group: the smallest id, then the smallest stamp of its text, then the least row.

    A row without an id stays only if its group has no other. Different texts of one id are told apart by their stamps.
    """
    # The row travels whole in one column, so its own columns can have any names.
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    keep = groups(docs, width, similarity, bits).groupBy("root").agg(F.min(F.struct(id_.alias("i"), "stamp")).alias("k")).select("k.i", "k.stamp").distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), id_.alias("i"), stamp())
    # Repeated rows become one before they are shuffled.
    rows = rows.groupBy("i", "stamp").agg(F.min("_row").alias("_row")).join(keep, ["i", "stamp"], "left_semi")
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
