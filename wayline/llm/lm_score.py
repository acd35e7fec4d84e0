"""N-gram language model in an Elias-Fano trie, counted, built and queried in parallel.

Level 1 holds the words, as a monotone sequence of 64-bit hashes with exact cumulative counts. A node of level k stands
for k words: its parent is the node of the first k - 1, and its number among the parent's children is that of its last word
among the successors of the words between (context-relative; on level 2 the word itself). A level is one
Elias-Fano sequence of parent * width + number, a second one of child pointers, quantised log probabilities, and
quantised back-off weights of the parents. A node is found by successor search in its level.

Level 1 is cut into shards by hash. Every other level is cut at places (parent, number) that give each shard an equal weight
of tokens, counted on the level above; a parent of more weight than that, such as a very common word, is cut between its
children. A shard is one memory-mapped file in the folder that executors share; a worker touches only the
pages that its texts ask for, and nothing of the model passes through the driver but one row per shard. What is known of a
cut parent only from all its shards (its back-off weight and first child) stands in that row, for two parents at most.

Smoothing is interpolated absolute discounting down to the add-half unigram of the contract, so the probabilities of
all known words and one unknown word sum to 1. All n-grams are kept; `least_count` above 1 leaves out rarer ones of two words
or more (their mass goes to the back-off weight).

Counts travel as sorted, compressed arrays, one row per task and shard, added up before the shuffle.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .shared import scratch_path, small_batches, stage, word_codes

ORDER = 3
DISCOUNT = 0.75
LEAST_COUNT = 1
FLUSH = 1_500_000
SHARD_BYTES = 24 << 20
BATCH_BYTES = 12 << 20
#: Shards that a worker keeps open, and bytes of them that it holds where the shared folder is not mounted.
OPEN_SHARDS, HELD_BYTES = 4096, 256 << 20
END = xxhash.xxh3_64_intdigest(b"\x00end of text")
#: Quantised logarithms: 16 bits for [-STEPS_TO, 0]; a count of 1 is within it for contexts of up to 10^15 tokens.
STEPS_TO = 16.0


def quantise(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-np.log10(np.maximum(p, 1e-300)) / STEPS_TO, 0, 1) * 65535).astype(np.uint16)


_RESTORED = 10.0 ** (np.arange(65536) * (-STEPS_TO / 65535))


def restore(q: np.ndarray) -> np.ndarray:
    return _RESTORED[q]


# ---------------------------------------------------------------- files


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """One file of named arrays, each at a multiple of 64 bytes; its name."""
    store, root = fs.FileSystem.from_uri(folder)
    head, at = {}, 0
    for k, x in arrays.items():
        head[k] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    store.create_dir(root, recursive=True)
    name = f"{root}/{uuid.uuid4().hex}.trie"
    with store.open_output_stream(name) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            f.write(x.tobytes() + b"\0" * (-x.nbytes % 64))
    return name


_open: OrderedDict[str, tuple[int, dict[str, np.ndarray]]] = OrderedDict()


def read_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted, else read; those used last stay open."""
    if name in _open:
        _open.move_to_end(name)
        return _open[name][1]
    if folder.startswith("file:") or "://" not in folder:
        raw, held = np.memmap(name, np.uint8, "r").view(np.ndarray), 0
    else:
        with fs.FileSystem.from_uri(folder)[0].open_input_file(name) as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
        held = len(raw)
    start = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8:start].tobytes())
    _open[name] = held, {k: raw[start + at : start + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in head.items()}
    while len(_open) > 1 and (len(_open) > OPEN_SHARDS or sum(x[0] for x in _open.values()) > HELD_BYTES):
        _open.popitem(last=False)
    return _open[name][1]


def _pack(name: str, e: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in e.parts().items()}


def _sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in EliasFano.NAMES})


# ---------------------------------------------------------------- the model


def fits(shard: np.ndarray, span: int) -> bool:
    """Whether pairs of these shards are numbers of 64 bits."""
    return len(shard) > 0 and (int(shard.max()) + 1) * span <= 2**64


def joined(shard: np.ndarray, local: np.ndarray, span: int) -> np.ndarray:
    return shard.astype(np.uint64) * np.uint64(span % 2**64) + local.astype(np.uint64)


def by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """An order by shard alone."""
    return np.argsort(shard.astype(np.int16) if shards < 2**15 else shard, kind="stable")


def distinct(shard: np.ndarray, local: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of pairs by (shard, local), and where in it each distinct pair begins. span: more than any local."""
    if fits(shard, span):
        order = np.argsort(joined(shard, local, span))
    else:
        order = np.lexsort((local, shard))
    s, x = shard[order], local[order]
    return order, np.flatnonzero(np.insert((s[1:] != s[:-1]) | (x[1:] != x[:-1]), 0, True)) if len(s) else np.zeros(0, np.int64)


def _inverse(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return out


@dataclass
class Level:
    """starts: first node of each shard, one more than shards. From level 2 on: width, how many numbers a child may have; parent
    and number, where each shard begins; and the parents that are cut, with their back-off weights and first children."""

    files: list[str | None]
    starts: np.ndarray
    width: int = 0
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    number: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cut_gamma: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cut_first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def last_parent(self, parents: int) -> np.ndarray:
        """The last parent that may have children in each shard."""
        return np.append(self.parent[1:] - (self.number[1:] == 0), parents - 1)

    def place(self, parent: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, code in it) of children."""
        low, high = np.searchsorted(self.parent, parent, side="left"), np.searchsorted(self.parent, parent, side="right")
        while (open_ := np.flatnonzero(low < high)).size:  # of the shards that begin in this very parent
            mid = (low[open_] + high[open_]) >> 1
            before = self.number[mid] <= number[open_]
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        shard = low - 1
        return shard, (parent - self.parent[shard]) * self.width + number


@dataclass
class Model:
    folder: str
    shards: int
    levels: list[Level] = field(default_factory=list)
    tokens: int = 0

    @property
    def words(self) -> int:
        return int(self.levels[0].starts[-1])

    def span(self, level: int) -> int:
        """More than any code within a shard of the level."""
        if not level:
            return 2**64 // self.shards
        lev = self.levels[level]
        return int((lev.last_parent(int(self.levels[level - 1].starts[-1])) - lev.parent + 1).max()) * lev.width + 1

    def _each_shard(self, shard: np.ndarray, level: int) -> Iterator[tuple[int, slice, dict[str, np.ndarray]]]:
        """Stretches of equal shards (the argument is sorted) that have a file."""
        edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        for a, z in zip(edges[:-1], edges[1:]):
            if name := self.levels[level].files[shard[a]]:
                yield int(shard[a]), slice(a, z), read_arrays(self.folder, name)

    def counts(self, level: int, a: int, z: int) -> np.ndarray:
        """How often each of the nodes a to z - 1 of a level occurs."""
        out, starts = np.zeros(z - a, np.int64), self.levels[level].starts
        for s in range(int(np.searchsorted(starts, a, side="right")) - 1, int(np.searchsorted(starts, z, side="left"))):
            lo, hi = max(a, int(starts[s])), min(z, int(starts[s + 1]))
            if lo < hi:
                total = _sequence(read_arrays(self.folder, self.levels[level].files[s]), "total")
                out[lo - a : hi - a] = np.diff(total.get(np.arange(lo, hi + 1) - starts[s]))
        return out

    def find_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node (-1: unknown) and count of each hash; hashes must be sorted."""
        node, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard, local = word_places(hashes, self.shards)
        for s, at, arrays in self._each_shard(shard, 0):
            e, total = _sequence(arrays, "nodes"), _sequence(arrays, "total")
            k, exact = e.locate(local[at])
            ok = np.flatnonzero(exact)
            node[at][ok] = self.levels[0].starts[s] + k[ok]
            count[at][ok] = total.get(k[ok] + 1) - total.get(k[ok])
        return node, count

    def find(self, level: int, shard: np.ndarray, code: np.ndarray, weights: bool = True, firsts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For children at places in order of shards: node or -1, its probability over the parent's count (0 if unknown) and the
        parent's back-off weight (if `weights`), and the number of the parent's first child (if `firsts`)."""
        lev = self.levels[level]
        node, first = np.full(len(code), -1, np.int64), np.zeros(len(code), np.int64)
        alpha, gamma = np.zeros(len(code)), np.ones(len(code))
        local = code // lev.width
        for s, at, arrays in self._each_shard(shard, level):
            e, pointers = _sequence(arrays, "nodes"), _sequence(arrays, "pointers")
            if firsts:
                each = np.flatnonzero(np.diff(local[at], prepend=-1))  # neighbours of one parent once
                first[at] = np.repeat(lev.starts[s] + pointers.get(local[at][each]), np.diff(each, append=at.stop - at.start))
            k, exact = e.locate(code[at])
            ok = np.flatnonzero(exact)
            node[at][ok] = lev.starts[s] + k[ok]
            if weights:
                gamma[at] = restore(arrays["gamma"][local[at]])
                alpha[at][ok] = restore(arrays["alpha"][k[ok]])
        if len(lev.cut):
            parent = lev.parent[shard] + local
            k = np.minimum(np.searchsorted(lev.cut, parent), len(lev.cut) - 1)
            mine = np.flatnonzero(lev.cut[k] == parent)
            gamma[mine], first[mine] = lev.cut_gamma[k[mine]], lev.cut_first[k[mine]]
        return node, alpha, gamma, first


def word_places(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, hash within it) of words."""
    wide = np.uint64(2**64 // shards)
    return (hashes // wide).astype(np.int64), (hashes % wide).astype(np.int64)


@dataclass
class Tokens:
    """The tokens of a batch of texts: words, and an end after each text."""

    node: np.ndarray
    count: np.ndarray
    place: np.ndarray  # place of a token in its text, from 0
    rows: np.ndarray  # first token of each text, one more than texts


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word and the end, sorted; index of each token in it; first token of each text)."""
    codes, words, rows = word_codes(col, lower=True)
    hashes, inverse = np.unique(np.array([*map(xxhash.xxh3_64_intdigest, words), END], np.uint64), return_inverse=True)
    at = np.insert(inverse[codes], rows[1:], inverse[-1]) if len(codes) else np.full(len(rows) - 1, inverse[-1])
    return hashes, at, rows + np.arange(len(rows))


def read_tokens(model: Model, col: pa.Array) -> Tokens:
    hashes, at, rows = word_hashes(col)
    node, count = model.find_words(hashes)
    place = np.arange(len(at)) - np.repeat(rows[:-1], np.diff(rows))
    return Tokens(node[at], count[at], place, rows)


def walk(model: Model, t: Tokens, levels: int, scoring: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: (level, tokens whose context is a node on it, alpha and gamma of these, and of all tokens their node on
    the level and its number among its parent's children; -1 where there is none).

    The token's own nodes of one level are the contexts of its successor on the next. When scoring, nothing asks for numbers on
    the last level, nor, when counting, for weights.
    """
    node, rank = t.node, t.node
    for level in range(1, levels):
        j = np.flatnonzero(t.place >= level)
        j = j[node[j - 1] >= 0]
        known = rank[j] >= 0
        # An unknown continuation still needs the context's weight: number 0 is asked for, and its probability dropped.
        shard, code = model.levels[level].place(node[j - 1], np.where(known, rank[j], 0))
        firsts = not scoring or level < levels - 1
        if firsts:
            order, each = distinct(shard, code, model.span(level))
            inverse = _inverse(order, each)
            order = order[each]
        else:
            order = by_shard(shard, model.shards)
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.arange(len(order))
        found, alpha, gamma, first = (x[inverse] for x in model.find(level, shard[order], code[order], scoring, firsts))
        node, rank = np.full(len(t.node), -1, np.int64), np.full(len(t.node), -1, np.int64)
        node[j] = np.where(known, found, -1)
        rank[j] = np.where(node[j] >= 0, node[j] - first, -1)
        yield level, j, np.where(known, alpha, 0.0), gamma, node, rank


def token_logs(model: Model, t: Tokens, order: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's unigram and of its full probability."""
    base = (t.count + 0.5) / (model.tokens + 0.5 * (model.words + 1))
    p = base.copy()
    for _, j, alpha, gamma, _, _ in walk(model, t, order):
        p[j] = alpha + gamma * p[j]
    return np.log10(base), np.log10(p)


# ---------------------------------------------------------------- counting


class Counter:
    """Adds up counts at places (shard, code) and gives them out as compressed rows per shard."""

    def __init__(self, span: int):
        self.span, self.parts, self.size = min(span, 2**64 - 1), [], 0  # no code is that large

    def add(self, shard: np.ndarray, code: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if counts is None and fits(shard, self.span):  # ones: sorting the numbers is enough
            x = np.sort(joined(shard, code, self.span))
            first = np.flatnonzero(np.insert(x[1:] != x[:-1], 0, True))
            n = np.diff(np.append(first, len(x)))
            shard, code = np.divmod(x[first], np.uint64(self.span))
            self.parts.append((shard.astype(np.int64), code.astype(np.int64), n))
            self.size += len(first)
        else:
            self._put(shard, code, np.ones(len(code), np.int64) if counts is None else counts)
        if self.size > FLUSH:
            parts, self.parts, self.size = self.parts, [], 0
            self._put(*(np.concatenate(x) for x in zip(*parts)))
            if self.size > FLUSH // 2:
                yield self.give()

    def _put(self, shard: np.ndarray, code: np.ndarray, counts: np.ndarray) -> None:
        order, first = distinct(shard, code, self.span)
        if len(first):
            self.parts.append((shard[order][first], code[order][first], np.add.reduceat(counts[order], first)))
            self.size += len(first)

    def give(self) -> pa.RecordBatch:
        rows, z = [], zstandard.ZstdCompressor(level=1)
        if len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            self._put(*(np.concatenate(x) for x in zip(*parts)))
        for shard, code, counts in self.parts:
            edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            for a, b in zip(edges[:-1], edges[1:]):
                n = counts[a:b] if counts[a:b].max() >= 2**32 else counts[a:b].astype(np.uint32)
                rows.append((int(shard[a]), z.compress(np.diff(code[a:b], prepend=0).tobytes()), z.compress(n.tobytes()), n.itemsize))
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int32())], names=["shard", "codes", "counts", "wide"])


PACKED = "shard int, codes binary, counts binary, wide int"


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each shard of a partition with its codes and counts added up."""
    rows: dict[int, list[tuple[bytes, bytes, int]]] = {}
    for b in batches:
        for s, *row in zip(*(x.to_pylist() for x in b.columns)):
            rows.setdefault(s, []).append(row)
    z = zstandard.ZstdDecompressor()
    for s in sorted(rows):
        parts = rows.pop(s)
        codes = np.concatenate([np.cumsum(np.frombuffer(z.decompress(k), np.int64)) for k, _, _ in parts])
        counts = np.concatenate([np.frombuffer(z.decompress(c), np.uint32 if wide == 4 else np.int64).astype(np.int64) for _, c, wide in parts])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.insert(codes[1:] != codes[:-1], 0, True))
        yield s, codes[first], np.add.reduceat(counts[order], first)


BUILT = "shard int, file string, n long, total long, width long, cut array<struct<parent:long,begin:long,children:long,alpha:double>>"


def _built(row: dict) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("parent", pa.int64()), ("begin", pa.int64()), ("children", pa.int64()), ("alpha", pa.float64())]))
    return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("width", pa.int64()), ("cut", kind)]))


def _edges(model: Model, level: int, totals: np.ndarray, spark) -> tuple[np.ndarray, np.ndarray]:
    """Where the shards of the next level begin: (parent, number). Equal weights of tokens of this level; within a
    parent, numbers are taken to be even, as words are in order of their hashes."""
    shards, before = model.shards, np.concatenate([[0], np.cumsum(totals)])
    width = model.levels[level + 1].width
    want = [int(before[-1]) * j // shards for j in range(1, shards)]
    own = np.searchsorted(before, want, side="right") - 1
    asked = [(j + 1, int(s), model.levels[level].files[s], w - int(before[s])) for j, (s, w) in enumerate(zip(own, want)) if s < len(totals) and w]
    starts, folder = model.levels[level].starts, model.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for j, s, file, at in zip(*(c.to_pylist() for c in b.columns)):
                total = _sequence(read_arrays(folder, file), "total")
                k, exact = total.locate(np.array([at]))
                k = int(k[0]) - (not exact[0])
                a, z = (int(x) for x in total.get(np.array([k, k + 1])))
                out.append((j, int(starts[s]) + k, (at - a) * width // (z - a)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["j", "parent", "number"])

    parent, number = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
    if asked:
        found = spark.createDataFrame(asked, "j long, s long, file string, at long").mapInArrow(run, "j long, parent long, number long").collect()  # a row per shard
        for r in found:
            parent[r.j], number[r.j] = r.parent, r.number
    return parent, number


def train(texts: DataFrame, order: int = ORDER, folder: str | None = None, least_count: int = LEAST_COUNT, shards: int | None = None) -> Model:
    """A model of the column `text`; nulls count as empty. Any number of rows, none included."""
    spark = texts.sparkSession
    texts = texts.select("text")
    folder = folder or scratch_path(spark, "lm")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or 1 << max(3, int(np.ceil(np.log2(max(1, size / SHARD_BYTES)))))
    model = Model(folder, shards)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(2**64 // shards)
        for b in small_batches(batches, "text", BATCH_BYTES):
            hashes, at, _ = word_hashes(b.column(0))
            n = np.bincount(at, minlength=len(hashes))
            yield from counter.add(*word_places(hashes[n > 0], shards), n[n > 0])
        yield counter.give()

    def build_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, codes, counts in _shards_of(batches):
            total = np.concatenate([[0], np.cumsum(counts)])
            name = write_arrays(folder, _pack("nodes", EliasFano.build(codes, 2**64 // shards)) | _pack("total", EliasFano.build(total, int(total[-1]) + 1)))
            yield _built({"shard": s, "file": name, "n": len(codes), "total": int(total[-1]), "width": 0, "cut": []})

    def gather(packed: DataFrame, build, name: str) -> tuple[Level, np.ndarray, list]:
        """A task builds one shard; a row per shard is all that reaches the driver."""
        rows = sorted(stage(packed.repartitionById(shards, "shard").mapInArrow(build, BUILT), name).collect(), key=lambda r: r.shard)
        files, sizes, totals = [None] * shards, np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        for r in rows:
            files[r.shard], sizes[r.shard], totals[r.shard] = r.file, r.n, r.total
        return Level(files, np.concatenate([[0], np.cumsum(sizes)])), totals, rows

    level, totals, _ = gather(texts.mapInArrow(count_words, PACKED), build_words, "words")
    model.levels.append(level)
    model.tokens = int(totals.sum())

    width = model.words
    for k in range(1, order):
        if not width:
            break
        model.levels.append(Level([None] * shards, np.zeros(shards + 1, np.int64), width))
        parent, number = _edges(model, k - 1, totals, spark)
        model.levels[k].parent, model.levels[k].number = parent, number

        def count_level(batches: Iterator[pa.RecordBatch], k=k, model=model) -> Iterator[pa.RecordBatch]:
            counter = Counter(model.span(k))
            for b in small_batches(batches, "text", BATCH_BYTES):
                t = read_tokens(model, b.column(0))
                if k == 1 and least_count > 1:  # a pair seen so often has two words seen as often
                    t.node[t.count < least_count] = -1
                yield from counter.add(*next_places(model, t, k))
            yield counter.give()

        def build_level(batches: Iterator[pa.RecordBatch], k=k, model=model) -> Iterator[pa.RecordBatch]:
            lev, upper = model.levels[k], int(model.levels[k - 1].starts[-1])
            last = lev.last_parent(upper)
            for s, codes, counts in _shards_of(batches):
                codes, counts = codes[counts >= least_count], counts[counts >= least_count]
                first, parents = int(lev.parent[s]), int(last[s] - lev.parent[s]) + 1
                of = codes // lev.width
                alpha = (counts - DISCOUNT) / model.counts(k - 1, first, first + parents)[of]
                taken = np.bincount(of, alpha, minlength=parents)
                total = np.concatenate([[0], np.cumsum(counts)])
                children = np.bincount(of, minlength=parents)
                name = write_arrays(
                    model.folder,
                    _pack("nodes", EliasFano.build(codes, parents * lev.width))
                    | _pack("pointers", EliasFano.build(np.concatenate([[0], np.cumsum(children)]), len(codes) + 1))
                    | _pack("total", EliasFano.build(total, int(total[-1]) + 1))
                    | {"alpha": quantise(alpha), "gamma": quantise(1.0 - taken)},
                )
                # Parents that other shards have children of too: the first, the last, or both in one.
                cut = {0} if lev.number[s] else set()
                if s + 1 < shards and lev.number[s + 1]:
                    cut.add(parents - 1)
                begin = np.cumsum(children) - children
                rows = [{"parent": first + x, "begin": int(begin[x]), "children": int(children[x]), "alpha": float(taken[x])} for x in sorted(cut) if children[x]]
                yield _built({"shard": s, "file": name, "n": len(codes), "total": int(total[-1]), "width": int(children.max(initial=0)), "cut": rows})

        level, totals, rows = gather(texts.mapInArrow(count_level, PACKED), build_level, f"level{k + 1}")
        level.width, level.parent, level.number = width, parent, number
        cut: dict[int, list] = {}
        for r in rows:
            for x in r.cut:
                known = cut.setdefault(x.parent, [int(level.starts[r.shard]) + x.begin, 0, 0.0])
                known[1] += x.children
                known[2] += x.alpha
        level.cut = np.array(sorted(cut), np.int64)
        level.cut_first = np.array([cut[x][0] for x in sorted(cut)], np.int64)
        level.cut_gamma = np.array([1.0 - cut[x][2] for x in sorted(cut)])
        model.levels[k] = level
        width = max([r.width for r in rows] + [x[1] for x in cut.values()], default=0)
    return model


def next_places(model: Model, t: Tokens, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on a level, of the tokens whose context is a node of the level above and whose last word succeeds it."""
    node = rank = t.node
    for *_, node, rank in walk(model, t, level, scoring=False):
        pass
    j = np.flatnonzero(t.place >= level)
    j = j[(node[j - 1] >= 0) & (rank[j] >= 0)]
    return model.levels[level].place(node[j - 1], rank[j])


def score(docs: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """docs' doc_id and held_out with n_tokens, n_known, train_tokens, base_score and score of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", BATCH_BYTES):
            t = read_tokens(model, b.column(2))
            base, full = token_logs(model, t, min(order, len(model.levels)))
            at = t.rows[:-1]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(np.diff(t.rows)), pa.array(np.add.reduceat((t.count > 0).astype(np.int64), at)),
                pa.array(np.full(len(at), model.tokens)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(full, at)),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, order: int = ORDER, folds: int = 5, fold: int = 1, least_count: int = LEAST_COUNT, shards: int | None = None) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) modulo folds is not fold, and score every row.

    Null texts are empty: one token, the end. A null doc_id is learned from. Repeated rows count as often as they occur.
    Other columns are ignored.
    """
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    marked = docs.select("doc_id", (rest == fold).alias("held_out"), "text")
    return score(marked, train(marked.where(~F.col("held_out")), order, least_count=least_count, shards=shards), order)
