"""Operator 11: secret scans by base formats and by the entropy of sliding windows.

Base formats are assignments to names such as `token`, access keys with a known prefix and lower-case hexadecimal runs. The
method adds what looks random without fitting any of them. Candidate strings are the maximal runs of characters that
keys are written in. Within a candidate, each character class (hexadecimal, letters and digits, base64 with its variants)
has its own runs, its own window and its own threshold: a window slides along a run, and the Shannon entropy of its
characters follows from the counts, of which one goes down and one up in a step. Windows at or above the threshold
that overlap or lie less than a window apart are one span; it reaches to the end of the run where less than a window is
left, since so little can't be judged alone. A span inside one of a narrower class is left out.

An allow-list suppresses spans of the method: values (published examples, alphabets, runs of digits or of letters alone,
UUIDs) and contexts before them (addresses, checksums with their names, embedded data). Base spans always stay.

Entropies are sums of integers, c * log2(c) scaled by 2**32, so they don't depend on the way a window was reached. Offsets are
code points. A null text counts as empty and has no spans; texts of any length are scanned whole, in time that grows with
their length. Repeated rows give repeated results, an empty table an empty one; spans of different kinds may overlap and
are all given; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import slices, texts_of

# Base kinds in their order: pattern, and the group that has a least length.
BASE = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


class CharacterClass(NamedTuple):
    """Runs of `run`, each at least as long as the window, whose windows of so many characters reach `bits` of entropy each."""

    name: str
    run: str
    window: int
    bits: float


#: From narrow to wide. Random strings have about 3.5, 4.0 and 4.2 bits in such windows, words and paths 3 to 3.8.
CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]+", 24, 3.1),
    CharacterClass("entropy_word", r"[A-Za-z0-9]+", 24, 3.8),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_-]+={0,2}", 24, 4.05),
)
KINDS = (*BASE, *(c.name for c in CLASSES))
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Values that are no secrets, searched for in a span.
ALLOWED_VALUES = (
    r"^[0-9+/_=-]*$",
    r"^[A-Za-z+/_=-]*$",
    r"(?i)example",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
)
#: What stands before a candidate that is no secret: addresses, named checksums, embedded data.
ALLOWED_CONTEXTS = (r"(?i)[a-z]://[^\x20\x09-\x0D\"'<>]*$", r"(?i)(?:sha-?(?:1|2|224|256|384|512)|md5|checksum|digest|commit|revision|integrity)\x20?[-:=]?\x20?[\"']?$", r"(?i)base64,$")
CONTEXT = 64
UNIT = 1 << 32
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entropy", T.DoubleType())])


def weights(window: int) -> list[int]:
    """c * log2(c) for counts up to a window's, in units of 2**-32."""
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def entropy(total: int, window: int) -> float:
    """Bits for each character of a window whose weights add up to total."""
    return math.log2(window) - total / (UNIT * window)


def hot_windows(run: str, window: int, bits: float) -> Iterator[tuple[int, float]]:
    """First character and entropy of each window of a run that reaches so many bits."""
    w, counts, total = weights(window), dict.fromkeys(run, 0), 0
    most = math.floor((math.log2(window) - bits) * UNIT * window)
    for i, new in enumerate(run):
        c = counts[new]
        total += w[c + 1] - w[c]
        counts[new] = c + 1
        if i >= window - 1:
            if total <= most:
                yield i - window + 1, entropy(total, window)
            old = run[i - window + 1]
            c = counts[old]
            total += w[c - 1] - w[c]
            counts[old] = c - 1


def random_spans(run: str, window: int, bits: float) -> list[tuple[int, int, float]]:
    """(start, end, largest entropy) of what the hot windows of a run cover."""
    out: list[list] = []
    for at, value in hot_windows(run, window, bits) if len(run) >= window else ():
        if out and at - out[-1][1] < window:
            out[-1][1:] = at + window, max(out[-1][2], value)
        else:
            out.append([at if at >= window else 0, at + window, value])
    if out and len(run) - out[-1][1] < window:
        out[-1][1] = len(run)
    return [(a, b, v) for a, b, v in out]


class Scanner:
    """Finds all spans of a text; classes and allow-lists are parameters."""

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, values: tuple[str, ...] = ALLOWED_VALUES, contexts: tuple[str, ...] = ALLOWED_CONTEXTS) -> None:
        self.classes = [(c, re.compile(c.run)) for c in classes]
        self.values, self.contexts = [re.compile(v) for v in values], [re.compile(c) for c in contexts]

    def allowed(self, text: str, start: int, end: int) -> bool:
        value, before = text[start:end], text[max(0, start - CONTEXT) : start]
        return any(v.search(value) for v in self.values) or any(c.search(before) for c in self.contexts)

    def added(self, text: str) -> Iterator[tuple[str, int, int, float]]:
        """The method's spans."""
        for candidate in CANDIDATE.finditer(text):
            found: list[tuple[str, int, int, float]] = []
            for c, runs in self.classes:
                for run in runs.finditer(text, *candidate.span()):
                    for a, b, bits in random_spans(run[0], c.window, c.bits):
                        start, end = run.start() + a, run.start() + b
                        if not any(s <= start and end <= e for _, s, e, _ in found):
                            found.append((c.name, start, end, bits))
            yield from (f for f in found if not self.allowed(text, f[1], f[2]))

    def spans(self, text: str) -> list[tuple[str, int, int, float | None]]:
        """(kind, start, end, entropy) of all spans by start, then kind; the entropy of base ones is None."""
        out = [(k, m.start(), m.end(), None) for k, (p, group, least) in BASE.items() for m in p.finditer(text) if len(m[group]) >= least]
        rank = {k: i for i, k in enumerate((*BASE, *(c.name for c, _ in self.classes)))}
        return sorted([*out, *self.added(text)], key=lambda s: (s[1], rank[s[0]], s[2]))


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, values: tuple[str, ...] = ALLOWED_VALUES, contexts: tuple[str, ...] = ALLOWED_CONTEXTS) -> DataFrame:
    """(doc_id, spans) for every row of docs (doc_id, text); spans has kind, start, end, and the entropy where the method found it."""
    kinds = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(SPAN))])
    scanner = Scanner(classes, values, contexts)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entropy", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[dict(zip(SPAN.names, s, strict=True)) for s in scanner.spans(t)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, arrow)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with every span of `text`, overlapping ones together, replaced by a mark; null texts stay null."""
    scanner = Scanner()

    @F.pandas_udf("string")
    def hidden(texts):  # noqa: ANN001, ANN202
        def one(text: str | None) -> str | None:
            out, reach = [], 0
            for _, start, end, _ in scanner.spans(text or ""):
                if start >= reach:
                    out += [text[reach:start], mark]
                reach = max(reach, end)
            return "".join([*out, text[reach:]]) if out else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", hidden("text"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy (the method's spans) for every row of docs."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    added: Column = F.filter("spans", lambda s: s["entropy"].isNotNull())
    base = F.filter("spans", lambda s: s["entropy"].isNull())
    return scan(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(added).cast("long").alias("n_entropy"))
