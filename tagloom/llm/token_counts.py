"""Operator 1: token counts from pre-token frequencies.

Every document is cut into normalised pre-tokens and reduced to (pre-token, frequency) pairs. The pairs of a group of
some hundred documents are dealt to buckets by the hash of the pre-token, one row for each bucket that has any, so that
all copies of a pre-token meet in one task while no task gets more than one entry of it for each document, and what is
shuffled grows with the pairs, however many buckets there are. There each distinct pre-token is run through the merges
once, its piece count is joined to the frequencies and summed per document; a second aggregation adds up the
buckets. Ids are never materialised. A task keeps the counts of up to `KEPT` distinct pre-tokens; buckets are as
many as shuffle partitions, so with partitions of the usual size it never has so many.

Pre-tokens that are entries of the vocabulary (a table of fixed size) are counted where they are found.

A null or empty text has 0 tokens and 0 bytes. Repeated rows give repeated results, a null doc_id is kept, an empty table
gives an empty one; a very long text is a group of its own; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm.common import shuffle_partitions, slices

#: Distinct pre-tokens whose piece counts a task keeps; beyond it starts anew.
KEPT = 1_000_000
SPACE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Pretokens:
    """Normalisation and pre-tokenisation as the tokenizer's file states them, and piece counts of pre-tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("unsupported pre-tokenizer")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("unsupported added token")
        pattern = split["pattern"]["Regex"]
        # The library's \s is Unicode white space, which leaves out the separators 1C to 1F.
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}")).findall
        ascii_only = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.find_ascii = re.compile(ascii_only).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None
        self.lower = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.normal = self.tokenizer.normalizer.normalize_str
        self.tokenize = self.tokenizer.model.tokenize
        codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in codes]
        self.level = {b: chr(b) for b in codes} | {b: chr(256 + i) for i, b in enumerate(rest)}
        end = spec["model"]["end_of_word_suffix"] or ""
        back = {c: b for b, c in self.level.items()}
        self.known: dict[str, int] = {}
        for entry in spec["model"]["vocab"]:
            if end and entry.endswith(end):
                try:
                    word = bytes(back[c] for c in entry[: -len(end)]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if word:
                    self.known[word] = self.pieces(word)

    def pieces(self, pretoken: str) -> int:
        return len(self.tokenize(pretoken.encode().decode("latin-1").translate(self.level)))

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings among them."""
        if self.split_special and any(s in text for s in self.special):
            out: list[str] = []
            parts = self.split_special(text)
            for part in parts:
                out += self.cut(part)[0]
            return out, len(parts) - 1
        if self.lower and text.isascii():
            return self.find_ascii(text.lower()), 0
        return self.find(self.normal(text)), 0


@lru_cache(maxsize=2)
def _load(path: str) -> Pretokens:
    return Pretokens(path)


def _frequencies(path: str, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group of documents: one with their ids, sizes and pieces counted here, and one for each bucket with pairs.

    A bucket's row has, for each document with pairs a line, the document's place in the group and its pre-tokens, with
    frequencies over one as `word<tab>n`. Pre-tokens hold no white space. Lines are compressed, as pre-tokens make up most
    of what is shuffled. The key of a group comes from its rows and partition, so that it is the same in a second run.
    """
    at = _load(path)
    known, pack = at.known, zstandard.ZstdCompressor(level=3).compress
    task = TaskContext.get()
    partition = task.partitionId() if task else 0
    for batch in slices(batches):
        stamp, ids, sizes, counted = blake2b(b"%d " % partition, digest_size=8), [], [], []
        lines: dict[int, list[str]] = {}
        for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            data = (text or "").encode()
            stamp.update(b"%a %d " % (doc_id, len(data)) + zlib.crc32(data).to_bytes(4, "little"))
            pretokens, pieces = at.cut(text or "")
            own: dict[int, list[str]] = {}
            for word, n in Counter(pretokens).items():
                if word in known:
                    pieces += n * known[word]
                else:
                    own.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word if n == 1 else f"{word}\t{n}")
            for b, entries in own.items():
                lines.setdefault(b, []).append(f"{k} {' '.join(entries)}")
            ids.append(doc_id)
            sizes.append(len(data))
            counted.append(pieces)
        key = int.from_bytes(stamp.digest(), "little", signed=True)
        order = sorted(lines)
        packed = [pack("\n".join(lines[b]).encode()) for b in order]
        none = [None] * len(order)
        out = [
            pa.array([key] * (1 + len(order)), pa.int64()),
            pa.array([key % buckets, *order], pa.int32()),
            pa.array([ids, *none], pa.list_(pa.int64())),
            pa.array([sizes, *none], pa.list_(pa.int64())),
            pa.array([list(range(len(ids))), *none], pa.list_(pa.int32())),
            pa.array([counted, *none], pa.list_(pa.int64())),
            pa.array([None, *packed], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(out, ["key", "bucket", "ids", "sizes", "at", "sums", "lines"])


def _partial_sums(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count each distinct pre-token of a bucket once, join the counts to the frequencies, sum per document."""
    tokens, unpack = _load(path), zstandard.ZstdDecompressor().decompress
    count: dict[str, int] = {}
    for batch in batches:
        places, sums = batch.column("at").to_pylist(), batch.column("sums").to_pylist()
        for i, packed in enumerate(batch.column("lines").to_pylist()):
            if packed is None:
                continue
            if len(count) > KEPT:
                count = {}
            places[i], sums[i] = [], []
            for line in unpack(packed).decode().split("\n"):
                k, *entries = line.split(" ")
                total = 0
                for entry in entries:
                    word, _, n = entry.partition("\t")
                    if word not in count:
                        count[word] = tokens.pieces(word)
                    total += count[word] * int(n or 1)
                places[i].append(int(k))
                sums[i].append(total)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "ids", "sizes")), pa.array(places, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int64()))], ["key", "ids", "sizes", "at", "sums"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a group: the sums of its parts, which equal groups of a partition have in common."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for ids, sizes, copies, at, sums in zip(*(batch.column(n).to_pylist() for n in ("ids", "sizes", "copies", "at", "sums")), strict=True):
            total = np.bincount(np.concatenate(at), np.concatenate(sums), len(ids)).astype(np.int64) // copies if ids else []
            for _ in range(copies):
                for column, values in zip(out, (ids, sizes, list(total)), strict=True):
                    column += values
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of docs (doc_id, text)."""
    buckets = buckets or shuffle_partitions(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: _frequencies(tokenizer_path, buckets, it),
        "key long, bucket int, ids array<long>, sizes array<long>, at array<int>, sums array<long>, lines binary",
    )
    parts = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda it: _partial_sums(tokenizer_path, it), "key long, ids array<long>, sizes array<long>, at array<int>, sums array<long>")
    whole = parts.groupBy("key").agg(F.count("ids").cast("int").alias("copies"), F.max("ids").alias("ids"), F.max("sizes").alias("sizes"), F.collect_list("at").alias("at"), F.collect_list("sums").alias("sums"))
    rows = whole.select("ids", "sizes", "copies", "at", "sums").mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
