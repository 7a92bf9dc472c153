"""Operator 6: SentencePiece encoding and decoding with source offsets.

A text is normalised by longest-prefix rewriting through the model's compiled character map while the source byte
of every normalised byte is recorded. The normalised text is cut before each run of word marks; no piece of the
vocabulary crosses such a cut (checked when the model is loaded), so every distinct unit is merged once per task and
documents are put together from units. Pieces are then projected through the alignment to source byte spans.

Merging is done for a batch of distinct units at once on numpy matrices: the best-scored, then leftmost pair of
every unit is merged until none is left, which is the order of the library's agenda. The library's model file is read
with its protocol-buffer class; its encoder and decoder are used in the tests only.

Null and empty texts have no pieces (only the end id if asked for); repeated rows give repeated results; extra
columns are ignored by `encode` unless named in `keep`.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from tagloom.llm.common import slices, texts_of

MARK = "▁"
#: Units longer than this are merged one by one with a heap.
WIDE = 64
#: Distinct units that a Python worker keeps; beyond it starts anew.
KEPT_UNITS = 250_000
#: Units of one matrix, which bounds what merging takes beside them.
MERGED_AT_ONCE = 16_384
NONE = np.int32(2**31 - 1)


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes and zero-ended replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.out = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that data has at `at`."""
        units, node, found = self.units, 0, None
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.out[start : self.out.index(b"\0", start)], found[1]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Normalizer:
    """Normalised text with the source byte of every normalised byte and, last, the end of what was consumed."""

    def __init__(self, spec: pb.NormalizerSpec, suffix: bool = False):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.space = MARK.encode() if self.escape else b" "

    @property
    def plain(self) -> bool:
        """Only spaces change, so the alignment follows from the text itself."""
        return self.map is None and not self.squeeze and self.escape and not self.suffix

    def text(self, text: str) -> str:
        """The normalised text alone."""
        if not self.plain:
            return self.align(text)[0]
        return (MARK if self.dummy and text else "") + text.replace(" ", MARK)

    def align(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int32)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            wide = np.where(raw == 32, 3, 1)
            source = np.repeat(np.arange(len(raw), dtype=np.int32), wide)
            lead = np.zeros(3 if self.dummy else 0, np.int32)
            return self.text(text), np.concatenate([lead, source, np.array([len(raw)], np.int32)])
        out, source, at, space, blank = bytearray(), [], 0, self.space, self.squeeze
        parts = list(self._prefixes(data))
        first = 0
        if self.squeeze:
            while first < len(parts) and parts[first][0] == b" ":
                at += parts[first][1]
                first += 1
            if first == len(parts):
                return "", np.zeros(1, np.int32)
        if self.dummy and not self.suffix:
            out += space
            source += [at] * len(space)
        for part, length in parts[first:]:
            if blank:
                part = part.lstrip(b" ")
            if part:
                for byte in part:
                    piece = space if byte == 32 else bytes([byte])
                    out += piece
                    source += [at] * len(piece)
                blank = part.endswith(b" ")
            at += length
            blank = blank and self.squeeze
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[len(out)]
                del source[len(out) :]
        if self.dummy and self.suffix:
            out += space
            source += [at] * len(space)
        return out.decode("utf-8", "replace"), np.array([*source, at], np.int32)

    def _prefixes(self, data: bytes) -> Iterator[tuple[bytes, int]]:
        at = 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map else None
            if found is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = data[at : at + n], n
            yield found
            at += found[1]


class Model:
    """Vocabulary, merge table and normaliser of a BPE model file."""

    def __init__(self, path: str):
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE models are supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.normalizer = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.size = len(self.pieces)
        self.unk = self.types.index(2)
        self.unk_surface = proto.trainer_spec.unk_surface
        self.eos = next((i for i, p in enumerate(self.pieces) if p == (proto.trainer_spec.eos_piece or "</s>")), -1)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == 1}
        scores = [p.score for p in proto.pieces]
        # Equal scores tie by position only, so equal scores get one rank.
        rank = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        table: dict[int, tuple[int, int]] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    table[left * self.size + right] = (rank[scores[i]], i)
        self.table = table
        keys = sorted(table)
        self.keys = np.array(keys or [-1], np.int64)
        self.key_rank = np.array([table[k][0] for k in keys] or [0], np.int32)
        self.key_id = np.array([table[k][1] for k in keys] or [0], np.int32)
        # Cutting before word marks is exact if no piece holds a mark after another character.
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.find = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if self.cuts else (lambda text: [text] if text else [])
        if not set("".join(self.ids)) <= set(self.ids):
            raise ValueError("a character of a piece is no piece itself")
        self.of_char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.id_text = [str(i) for i in range(self.size)]
        self.piece_bytes = [len(p.encode()) for p in self.pieces]
        #: The surface of pieces that are plain text.
        self.plain_text = {i: p.replace(MARK, " ") for p, i in self.ids.items()}

    def start(self, text: str) -> np.ndarray:
        """Piece ids of the characters; a character without a piece is its code point beyond the vocabulary."""
        return self.of_char[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def merge_one(self, ids: list[int]) -> list[int]:
        """Merge with a heap of (rank, position): for long units."""
        n, table, size = len(ids), self.table, self.size
        ids = list(ids)
        before, after, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and max(ids[i], ids[j]) < size and (hit := table.get(ids[i] * size + ids[j])):
                heapq.heappush(heap, (hit[0], i, j, ids[i], ids[j], hit[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, j, a, b, new = heapq.heappop(heap)
            if ids[i] != a or ids[j] != b or after[i] != j:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [x for x in ids if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left < self.size) & (right < self.size) & (left >= 0) & (right >= 0)
        return np.where(hit, self.key_rank[at], NONE), self.key_id[at]

    def merge_many(self, units: list[str]) -> list[list[int]]:
        """Merge many units of at most WIDE characters, all at once for each step."""
        out: list[list[int]] = [[]] * len(units)
        lens = np.array([len(u) for u in units], np.int64)
        low = 0
        for width in (8, 12, 16, 24, WIDE):
            row = np.flatnonzero((lens > low) & (lens <= width))
            low = width
            if not len(row):
                continue
            ids = np.full((len(row), width + 1), -1, np.int32)
            ids[:, :width][np.arange(width) < lens[row, None]] = self.start("".join([units[k] for k in row.tolist()]))
            rank, new = self._rank(ids[:, :-1], ids[:, 1:])
            col = np.arange(width + 1, dtype=np.int64)
            while len(row):
                best = rank.argmin(1)
                lines = np.arange(len(row))
                merged = new[lines, best]
                go = rank[lines, best] != NONE
                if not go.all():
                    for k, x in zip(row[~go].tolist(), ids[~go].tolist(), strict=True):
                        out[k] = x[: x.index(-1)]
                    row, ids, rank, new, best, merged = row[go], ids[go], rank[go], new[go], best[go], merged[go]
                    lines = np.arange(len(row))
                    if not len(row):
                        break
                take = np.minimum(col + (col > best[:, None]), width)
                ids = np.take_along_axis(ids, take, 1)
                ids[lines, best] = merged
                ids[:, width] = -1
                take = np.minimum(take[:, :width], width - 1)
                rank, new = np.take_along_axis(rank, take, 1), np.take_along_axis(new, take, 1)
                rank[:, width - 1] = NONE
                for at in (best - 1, best):
                    ok = np.flatnonzero(at >= 0)
                    at = at[ok]
                    rank[ok, at], new[ok, at] = self._rank(ids[ok, at], ids[ok, at + 1])
        return out

    def finish(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Final ids and their normalised byte lengths; characters without a piece become bytes or the unknown id."""
        if not ids or max(ids) < self.size:
            sizes = self.piece_bytes
            return ids, [sizes[i] for i in ids]
        out, lens = [], []
        for x in ids:
            if x < self.size:
                out.append(x)
                lens.append(len(self.pieces[x].encode()))
            elif self.bytes:
                data = chr(x - self.size).encode()
                out += [self.bytes[b] for b in data]
                lens += [0] * (len(data) - 1) + [len(data)]
            elif out and out[-1] == self.unk:
                lens[-1] += len(chr(x - self.size).encode())
            else:
                out.append(self.unk)
                lens.append(len(chr(x - self.size).encode()))
        return out, lens

    def encode_units(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        merged = self.merge_many(units)
        return [self.finish(m if len(u) <= WIDE else self.merge_one(self.start(u).tolist())) for u, m in zip(units, merged, strict=True)]

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and source byte spans of one text."""
        norm, source = self.normalizer.align(text)
        ids, lens = [], []
        for a, b in self.encode_units(self.find(norm)):
            ids += a
            lens += b
        ends = np.cumsum(lens, dtype=np.int64) if lens else np.zeros(0, np.int64)
        begins = ends - np.array(lens, np.int64)
        return ids, list(zip(source[begins].tolist(), source[ends].tolist(), strict=True))

    def surface(self, ids: list[int]) -> str:
        """The text of some ids, word marks as spaces; bytes that are no UTF-8 become U+FFFD each."""
        plain = self.plain_text
        try:
            return "".join([plain[i] for i in ids])
        except KeyError:
            pass
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            while held:
                for n in range(min(4, len(held)), 0, -1):
                    try:
                        out.append(held[:n].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�")
                del held[:n]
            if i is not None and self.types[i] != 3:
                out.append(self.unk_surface if i == self.unk else self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library: the first piece loses one leading word mark if encoding put one there."""
        text = self.surface(ids)
        spec = self.normalizer
        first = next((i for i in ids if self.types[i] != 3), None)
        if first is not None and self.pieces[first].startswith(MARK) and (spec.dummy or spec.squeeze):
            text = text[1:]
            if spec.squeeze:
                text = text.lstrip(" ")
        return text


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


class Units(dict):
    """What a worker knows of distinct units: a slot for each, and all slots' pieces and lengths in two flat arrays.

    Looking up a unit that isn't known gives it the next slot; `settle` then encodes all such units at once.
    """

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pending: list[str] = []
        self.starts, self.ids, self.lens = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __missing__(self, unit: str) -> int:
        slot = self[unit] = len(self)
        self.pending.append(unit)
        return slot

    def settle(self) -> None:
        counts, ids, lens = [], [], []
        for start in range(0, len(self.pending), MERGED_AT_ONCE):
            parts = self.model.encode_units(self.pending[start : start + MERGED_AT_ONCE])
            counts.append(np.array([len(i) for i, _ in parts], np.int64))
            ids.append(np.array([x for i, _ in parts for x in i], np.int32))
            lens.append(np.array([x for _, n in parts for x in n], np.int32))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])
        self.ids, self.lens = np.concatenate([self.ids, *ids]), np.concatenate([self.lens, *lens])
        self.pending = []

    def pieces(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and normalised byte lengths of all pieces of a row of units."""
        start, n = self.starts[slots], self.starts[slots + 1] - self.starts[slots]
        ends = np.cumsum(n)
        at = np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[at], self.lens[at]


@lru_cache(maxsize=2)
def _units(path: str) -> Units:
    return Units(load(path))


def _digests(path: str, end: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, known = load(path), _units(path)
    tail = [str(model.eos)] if end else []
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for batch in slices(batches):
        texts = texts_of(batch)
        if len(known) > KEPT_UNITS:
            known.reset()
        rows = [[known[u] for u in model.find(model.normalizer.text(t))] for t in texts]
        known.settle()
        id_text, surface = model.id_text, model.surface
        out: list[list] = [[], [], [], []]
        for text, at in zip(texts, rows, strict=True):
            found, lens = known.pieces(np.array(at, np.int64))
            ids = found.tolist()
            _, source = model.normalizer.align(text)
            ends = np.cumsum(lens, dtype=np.int64)
            spans = np.stack([source[ends - lens], source[ends]], 1).astype("<i4")
            decoded = surface(ids)
            if decoded.startswith(" ") and (model.normalizer.dummy or model.normalizer.squeeze):
                decoded = decoded[1:]
            out[0].append(len(lens) + len(tail))
            out[1].append(sha(" ".join([id_text[i] for i in ids] + tail).encode()))
            out[2].append(sha(decoded.encode()))
            out[3].append(sha(spans.tobytes()))
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])], [*names, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])


def encode_digests(docs: DataFrame, model_path: str, add_end: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: `keep`, n_tokens and the sha256 of the ids, of the decoded text and of the piece spans.

    spans_sha256 is over the (begin, end) source bytes of every piece as little-endian 32-bit integers. A byte piece
    but the last of its character has an empty span at the character's begin.
    """
    df = docs.select(*keep, "text")
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "text")
    return df.mapInArrow(lambda it: _digests(model_path, add_end, it), f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def encode(docs: DataFrame, model_path: str, add_end: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: `keep`, ids array<int> and spans array<struct<begin, end>> in source bytes (the end id has none)."""
    df = docs.select(*keep, "text")
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "text")
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in slices(batches):
            done = [model.encode(t) for t in texts_of(batch)]
            ids = pa.array([i + [model.eos] * add_end for i, _ in done], pa.list_(pa.int32()))
            spans = pa.array([[{"begin": a, "end": b} for a, b in s] for _, s in done], span)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, spans], [*names, "ids", "spans"])

    return df.mapInArrow(run, f"{kinds}, ids array<int>, spans array<struct<begin: int, end: int>>")


def decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: `keep` and the text of column ids; a null list gives an empty text."""
    df = encoded.select(*keep, "ids")
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "ids"]
            texts = pa.array([model.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, "text"])

    return df.mapInArrow(run, f"{kinds}, text string")
