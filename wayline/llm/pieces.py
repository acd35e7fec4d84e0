"""SentencePiece encoding with exact source spans, and decoding.

A model file gives pieces with scores, byte pieces, and the normaliser's settings: a character map, compiled as a double-array trie with
its replacements, and the treatment of white space. Encoding a text

1. normalises it by the longest prefix that the map knows, again and again, and records for each normalised byte the source byte that it
   comes from; a space stands for the white-space symbol,
2. cuts it where no piece of the vocabulary spans two neighbour bytes, so merges on either side can't meet,
3. merges each distinct stretch of a batch once (best score first, the leftmost of equals), and writes what is in no piece as bytes,
4. projects each piece's normalised span to source bytes.

Decoding writes the pieces' bytes on end. Models are of the BPE kind, with byte pieces.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_bytes

SYMBOL = "▁".encode()
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2  # fixed values of the file format
MOST_KEPT = 3 << 19  # ids of stretches that a worker remembers
SHORT, NEVER = 32, float("inf")
REPLACEMENT = "�".encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer: whole numbers, or bytes (also of fixed-size numbers)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """A compiled character map: replacements of byte strings, looked up by longest prefix in a double-array trie."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units, self.texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of text[at:], and what replaces it."""
        if not self.units:
            return None
        found, node = None, self._child(0)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.texts[start : self.texts.index(0, start)]
        return found

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 512) >> 6)


_CHAR = re.compile(rb"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}")

_ANY = re.compile(_CHAR.pattern + rb"|[\x80-\xFF]")


class Model:
    """A model file's tables, the normaliser, and the pieces of stretches met so far."""

    def __init__(self, data: bytes):
        self.chars, self.prefix, self.trim, kind, self.unknown_text = CharMap(b""), True, True, 1, " ⁇ ".encode()
        pieces, self.escape = [], True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b""), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                kind, self.unknown_text = f.get(3, 1), f.get(44, self.unknown_text)
                if f.get(24, 0):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                f = dict(_fields(value))
                self.chars, self.prefix, self.trim, self.escape = CharMap(f.get(2, b"")), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if kind != BPE or not self.escape or any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, t in pieces):
            raise ValueError("only BPE models of plain and byte pieces are supported")
        self.score: dict[bytes, tuple[float, int]] = {}
        self.byte_id, self.text_of, self.kind_of = [-1] * 256, [], np.array([t for _, _, t in pieces], np.int8)
        self.joined = np.zeros((256, 256), bool)  # neighbour bytes that some piece holds
        self.joined[:, 0x80:0xC0] = True
        self.begin_id = self.end_id = -1
        for k, (piece, score, t) in enumerate(pieces):
            text = piece.replace(SYMBOL, b" ")
            if t == NORMAL:
                self.score[text] = (score, k)
                both = np.frombuffer(text, np.uint8)
                self.joined[both[:-1], both[1:]] = True
            elif t == BYTE:
                text = bytes([int(piece[3:5], 16)])
                self.byte_id[text[0]] = k
            elif t == UNKNOWN:
                text = self.unknown_text
            else:
                self.begin_id, self.end_id = (k if piece == b"<s>" else self.begin_id), (k if piece == b"</s>" else self.end_id)
                text = b""
            self.text_of.append(text)
        if min(self.byte_id) < 0:
            raise ValueError("only models with byte pieces are supported")
        self.rank = {text: -score for text, (score, _) in self.score.items()}
        self.blob, self.blob_at = np.frombuffer(b"".join(self.text_of), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in self.text_of])])
        self._forget()

    # ------------------------------------------------------------ normalisation

    def normalise(self, text: bytes) -> tuple[bytes, list[int]]:
        """(normalised bytes with plain spaces, source byte of each; one more entry for the end)."""
        out, source, at, n = bytearray(), [], 0, len(text)

        def next_part(at: int) -> tuple[int, bytes]:
            if found := self.chars.longest(text, at):
                return found
            m = _CHAR.match(text, at)
            return (m.end() - at, m.group()) if m else (1, REPLACEMENT)

        if self.trim:
            while at < n and (part := next_part(at))[1] == b" ":
                at += part[0]
        if at == n:
            return b"", [0]
        if self.prefix:
            out += b" "
            source.append(at)
        after_space = self.trim
        while at < n:
            used, part = next_part(at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                after_space = self.trim and part.endswith(b" ")
                part = part.replace(SYMBOL, b" ")
                out += part
                source += [at] * len(part)
            at += used
        if self.trim:
            while out.endswith(b" "):
                del out[-1]
                at = source.pop()
        return bytes(out), [*source, at]

    def normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows: normalised bytes, each row's start, and the source byte (within its row) of each byte; a row has an entry more
        than bytes in the last, for its end."""
        sizes = np.diff(offsets)
        symbol = (data[:-2] == SYMBOL[0]) & (data[1:-1] == SYMBOL[1]) & (data[2:] == SYMBOL[2]) if len(data) > 2 else np.zeros(0, bool)
        if self.chars.units or self.trim or symbol.any():
            rows = [self.normalise(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            lengths = np.array([len(r) for r, _ in rows], np.int64)
            return np.frombuffer(b"".join(r for r, _ in rows), np.uint8), np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([np.array(s, np.int64) for _, s in rows] or [np.zeros(0, np.int64)])
        more = ((sizes > 0) & self.prefix).astype(np.int64)
        at = offsets + np.concatenate([[0], np.cumsum(more)])
        out = np.full(at[-1], 32, np.uint8)
        out[np.arange(len(data)) + np.repeat(at[:-1] + more - offsets[:-1], sizes)] = data
        lengths = np.diff(at) + 1
        source = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) - np.repeat(more, lengths)
        return out, at, np.maximum(source, 0)

    # ------------------------------------------------------------ merging

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.starts, self.ends, self.first = array("i"), array("i"), array("i"), array("q", [0])

    def merge(self, text: bytes) -> list[tuple[int, int, int]]:
        """(id, start, end) of the pieces of a stretch."""
        marks = [m.start() for m in _CHAR.finditer(text)] + [len(text)]
        n = len(marks) - 1
        if n <= SHORT:
            return self._merge_short(text, marks)
        score, end, right, left = self.score, marks[1:], [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def look(a: int, b: int) -> None:
            if found := score.get(text[marks[a] : end[b]]):
                heapq.heappush(heap, (-found[0], a, b, end[b]))

        for k in range(n - 1):
            look(k, k + 1)
        live = [True] * n
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not live[a] or not live[b] or right[a] != b or end[b] != stop:
                continue
            end[a], live[b], right[a] = stop, False, right[b]
            if right[b] >= 0:
                left[right[b]] = a
                look(a, right[a])
            if left[a] >= 0:
                look(left[a], a)
        parts, k = [], 0
        while 0 <= k < n:
            parts.append(text[marks[k] : end[k]])
            k = right[k]
        return self._named(parts)

    def _merge_short(self, text: bytes, marks: list[int]) -> list[tuple[int, int, int]]:
        """The same for a few characters: all pairs are looked through for the best."""
        parts, rank = [text[a:b] for a, b in zip(marks, marks[1:])], self.rank
        pairs = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < NEVER:
            k = pairs.index(best)
            parts[k] += parts.pop(k + 1)
            del pairs[k]
            if k < len(pairs):
                pairs[k] = rank.get(parts[k] + parts[k + 1], NEVER)
            if k:
                pairs[k - 1] = rank.get(parts[k - 1] + parts[k], NEVER)
        return self._named(parts)

    def _named(self, parts: list[bytes]) -> list[tuple[int, int, int]]:
        out, a = [], 0
        for part in parts:
            b = a + len(part)
            if found := self.score.get(part):
                out.append((found[1], a, b))
            else:
                raw = SYMBOL if part == b" " else part
                out += [(self.byte_id[x], a, a) for x in raw[:-1]] + [(self.byte_id[raw[-1]], a, b)]
            a = b
        return out

    def _slot(self, text: bytes) -> int:
        k = self.slots.get(text)
        if k is None:
            for i, a, b in self.merge(text):
                self.ids.append(i)
                self.starts.append(a)
                self.ends.append(b)
            self.first.append(len(self.ids))
            k = self.slots[text] = len(self.first) - 2
        return k

    def encode(self, col: pa.Array, begin: bool, end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all rows on end: ids, start and end byte in the source, and each row's first id (one more than rows)."""
        data, offsets = text_bytes(col)
        text, at, source = self.normalised(data, offsets)
        rows = len(offsets) - 1
        cut = np.ones(len(text), bool)
        if len(text):
            cut[1:] = ~self.joined[text[:-1], text[1:]]
            cut[at[:-1][at[:-1] < len(text)]] = True
        from_ = np.flatnonzero(cut)
        bounds = np.append(from_, len(text)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(from_), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(text))]).dictionary_encode()
        if len(self.ids) > MOST_KEPT:
            self._forget()
        slot = np.array([self._slot(x) for x in parts.dictionary.to_pylist()], np.int64)[parts.indices.to_numpy(zero_copy_only=False)] if len(from_) else np.zeros(0, np.int64)
        ids, starts, ends, first = (np.frombuffer(x, t) for x, t in ((self.ids, np.int32), (self.starts, np.int32), (self.ends, np.int32), (self.first, np.int64)))
        count = first[slot + 1] - first[slot]
        before = np.concatenate([[0], np.cumsum(count)])
        pick = np.arange(before[-1]) + np.repeat(first[slot] - before[:-1], count)
        own = before[np.searchsorted(from_, at)]  # first id of each row
        row = np.repeat(np.arange(rows), np.diff(own))
        shift = np.repeat(from_, count) + row  # source has an entry more than bytes, per row
        one, two, three = ids[pick], source[starts[pick] + shift], source[ends[pick] + shift]
        del ids, starts, ends, first
        if not (begin or end):
            return one, two, three, own
        extra, sizes = int(begin) + int(end), np.diff(own)
        bounds = own + extra * np.arange(rows + 1)
        to = np.arange(len(one)) + extra * row + int(begin)
        full = [np.zeros(bounds[-1], np.int64) for _ in range(3)]
        for x, y in zip(full, (one, two, three)):
            x[to] = y
        if begin:
            full[0][bounds[:-1]] = self.begin_id
        if end:
            full[0][bounds[1:] - 1] = self.end_id
            for x in full[1:]:
                x[bounds[1:] - 1] = np.diff(offsets)
        return (*full, bounds)

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        """The text of each row's ids; rows: first id of each, one more than rows."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.text_of)):
            raise ValueError("an id outside the vocabulary")
        begin, size = self.blob_at[ids], np.diff(self.blob_at)[ids]
        spoken = np.flatnonzero(self.kind_of[ids] != CONTROL)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[spoken]
        lead = spoken[np.append(True, row[1:] != row[:-1])[: len(row)]] if len(row) else spoken
        if self.prefix or self.trim:  # the space that encoding put in front goes
            lead = lead[(self.kind_of[ids[lead]] == NORMAL) & (self.blob[np.minimum(begin[lead], len(self.blob) - 1)] == 32)]
            begin[lead] += 1
            size[lead] -= 1
        before = np.concatenate([[0], np.cumsum(size)])
        out = self.blob[np.arange(before[-1]) + np.repeat(begin - before[:-1], size)]
        at = before[rows]
        silent = np.flatnonzero(self.kind_of[ids] == CONTROL)
        silent = silent[(silent > 0) & (silent < len(ids) - 1)]
        parted = self.kind_of[ids[silent - 1]] == BYTE  # a silent id between bytes: they make no character together
        parted &= np.isin(self.kind_of[ids[silent + 1]], (BYTE, CONTROL)) & ~np.isin(silent + 1, rows)
        try:
            out.tobytes().decode()
            whole = not parted.any()
        except UnicodeDecodeError:
            whole = False
        if not whole:  # each byte that is in no character gives a replacement
            ends = np.unique(np.concatenate([at, before[:-1][self.kind_of[ids] == CONTROL]]))
            parts = [b"".join(m.group() if _CHAR.fullmatch(m.group()) else REPLACEMENT for m in _ANY.finditer(out[a:b].tobytes())) for a, b in zip(ends, ends[1:])]
            own = np.searchsorted(ends, at)
            return pa.array([b"".join(parts[a:b]).decode() for a, b in zip(own, own[1:])], pa.string())
        return pa.Array.from_buffers(pa.string(), len(rows) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])


@lru_cache(maxsize=2)
def _model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _lists(values: np.ndarray, rows: np.ndarray, packed: bool) -> pa.Array:
    if packed:
        return pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer((rows * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, "<u4"))])
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True, packed: bool = False, decoded: bool = False) -> DataFrame:
    """id, n_tokens, ids, starts, ends: the ids of each text's pieces, and the UTF-8 bytes of the text that each stands for. decoded adds
    what decode() makes of the ids, in the same pass.

    model: a model file that every executor can read under this path. Null and empty texts have only the begin and end ids. packed:
    lists are binary, as little-endian unsigned 32-bit numbers, else arrays. Of a character that is written in byte pieces the last one
    stands for it, the others for nothing; so do begin and end ids. One row in, one row out, repeated ids included; other columns are ignored.
    Nothing is shuffled; a task holds the pieces of 1 MB of texts at a time, or of one text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in small_batches(batches, "__text", 1 << 20):
            ids, starts, ends, rows = m.encode(b.column(1), begin, end)
            back = [m.decode(ids, rows)] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(rows)), *(_lists(x, rows, packed) for x in (ids, starts, ends)), *back], names=names)

    lists, names = "binary" if packed else "array<int>", ["__id", "n_tokens", "ids", "starts", "ends", *["decoded"] * decoded]
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, f"__id {kind}, n_tokens long, ids {lists}, starts {lists}, ends {lists}" + ", decoded string" * decoded).withColumnRenamed("__id", id_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """keep, and decoded: the text of the ids (array<int>, or packed as by encode()). Null ids give an empty text; ids outside the
    vocabulary are an error. Begin and end ids are silent, the leading space that encoding adds goes, and bytes that make no
    character become replacement characters."""
    packed = encoded.schema[ids_col].dataType.simpleString() == "binary"
    names = [f"__k{k}" for k in range(len(keep))]
    schema = ", ".join([*(f"{a} {encoded.schema[c].dataType.simpleString()}" for a, c in zip(names, keep)), "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                col = part.column(len(keep))
                if packed:
                    raw, at = text_bytes(col)
                    ids, rows = np.ascontiguousarray(raw).view("<u4").astype(np.int64), at // 4
                else:
                    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    ids, rows = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(keep))), m.decode(ids, rows)], names=[*names, "decoded"])

    picked = encoded.select(*[F.col(c).alias(a) for c, a in zip(keep, names)], F.col(ids_col).alias("__ids"))
    return picked.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep)))
