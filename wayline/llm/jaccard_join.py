"""N-gram Jaccard join: groups of shingles as points, R-trees over them, exact verification.

A text is its set of 4-word shingles (64-bit hashes; texts with equal sets are one class and are compared once). Shingles
are dealt into groups by hash. A text's counts in `DIMS` groups are a point; the overlap of two texts is at most the sum
of the smaller counts, so a packed R-tree whose nodes hold the largest count per group bounds the overlap of whole
subtrees, and a join of a tree with itself descends only where the bound allows a link.

One tree over all texts would be joined with itself in one place, and random texts would fill its boxes. So trees
are planted per bucket, without losing a pair: two texts that link differ in D shingles at most, D known from their size; dealt
into more than D groups, some groups are the same in both. A bucket is the texts of one size range with the same
content in one group. (Where only empty groups are the same, there are at least `slack + 1` of them; texts with as
many also meet in a bucket for each three of their empty groups.)

A bucket of more than `BLOCK` texts is cut into blocks, and a task holds one of them, or two.

Buckets give links in rounds. First the members are tried against the member nearest to the bucket's mean, which
joins a group of near copies by as many links as it has members; buckets that still hold several components try once more
with a member of the smaller ones. Then trees are joined with themselves, but only pairs of different components count, and
only those that pass the same bound over FINE groups, which few unlinked pairs do. All pairs are verified on the whole sets, and links make components. No list of links,
members or sets reaches the driver, and texts with equal sets or one component are never paired.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_words, possible
from .components import components
from .shared import discard, mix64, small_batches, stage, word_codes

SHINGLE = 4
PERCENT = 85
DIMS = 32
LEAF = 16
MAX_POINT = 65_535
#: Groups of the finer point that pairs between components must also pass.
FINE = 256
#: Keys that a task holds at once, and members of a bucket that one holds; larger buckets are cut into blocks.
SHARD_ROWS = 500_000
BLOCK = 8_192
#: A key with more classes than this among SHARD_ROWS keys is dealt by class, not by key; with many shards it takes fewer, so
#: that what a key just below it brings to its shard from all tasks stays near SHARD_ROWS.
HOT = 256
#: Bytes that a Python worker gets at once where rows hold sets or points.
WIDE_BATCH = 8 << 20
U64 = np.uint64


def _bounds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 8 // 5))
    return np.array(out, np.int64)


#: First size of each size range.
RANGES = _bounds()


def groups_of_range(k: int, percent: int = PERCENT) -> tuple[int, int]:
    """(groups, slack) of a size range: linked texts of it have slack + 1 or more of their groups in common."""
    largest = int(RANGES[k + 1]) - 1
    differ = 2 * largest * (100 - percent) // (100 + percent)
    # Below PERCENT groups are smaller and more of them are empty: with little slack most texts would need keys of three.
    slack = max(2, -(-differ // (10 if percent >= PERCENT else 3)))
    return differ + 1 + slack, slack


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest overlap at which sets of a and b shingles link."""
    return -(-(percent * (a + b)) // (100 + percent))


# ---------------------------------------------------------------- texts to sets


def shingle_sets(col: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words has none."""
    codes, words, rows = word_codes(col, lower=True)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U64, len(words))[codes] if len(codes) else np.zeros(0, U64)
    with np.errstate(over="ignore"):
        runs = mix64(h)
        for j in range(1, size):
            runs[:-j] = mix64(runs[:-j] * U64(3) + h[j:])
    out = []
    for a, z in zip(rows[:-1], rows[1:]):
        if z - a >= size:
            out.append(np.unique(runs[a : z - size + 1]))
        elif z > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:z].tobytes(), seed=int(z - a))], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def bucket_keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the buckets of a set: two sets that link share one at least."""
    if not len(s):
        return np.zeros(0, np.int64)
    n, out = len(s), []
    own = int(np.searchsorted(RANGES, n, side="right")) - 1
    spread = mix64(s)
    for k in (own, own + 1):
        if k > own and n * 100 // percent < RANGES[k]:
            break
        g, slack = groups_of_range(k, percent)
        at = (spread % U64(g)).astype(np.int64)
        sums, counts = np.zeros(g, U64), np.bincount(at, minlength=g)
        np.add.at(sums, at, spread)
        with np.errstate(over="ignore"):
            keys = mix64(sums ^ mix64(np.arange(g, dtype=U64) + U64((k + 1) << 32)))
        out.append(keys[counts > 0])
        empty = np.flatnonzero(counts == 0)
        if len(empty) > slack:
            three = np.array(list(itertools.combinations(empty.tolist(), 3)), U64)
            with np.errstate(over="ignore"):
                out.append(mix64(mix64(three[:, 0] * U64(1 << 40) + three[:, 1] * U64(1 << 20) + three[:, 2]) ^ U64((k + 1) << 48)))
    return np.concatenate(out).view(np.int64)


def point(s: np.ndarray) -> np.ndarray:
    """Counts per group; a set of more than MAX_POINT shingles is not bounded by it."""
    return np.bincount((mix64(s ^ U64(0x5851F42D4C957F2D)) % U64(DIMS)).astype(np.int64), minlength=DIMS)


def fine_point(s: np.ndarray) -> np.ndarray:
    """Counts in FINE groups, at most 255; a set with such a count is not bounded by it."""
    return np.minimum(np.bincount((mix64(s ^ U64(0x2545F4914F6CDD1D)) % U64(FINE)).astype(np.int64), minlength=FINE), 255).astype(np.uint8)


def _pack48(keys: np.ndarray) -> bytes:
    """The upper 48 bits of each key: where two keys fall together, a bucket has members more, and none less."""
    return np.ascontiguousarray((keys.view(U64) >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


def describe(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, class, keys, point, fine): class is a hash of the set, null for an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 4 << 20):
            sets = shingle_sets(b.column(1), size)
            yield pa.RecordBatch.from_arrays([
                b.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets], pa.int64()),
                pa.array([_pack48(bucket_keys(s, percent)) for s in sets], pa.binary()),
                pa.array([np.minimum(point(s), MAX_POINT).astype(np.uint16).tobytes() for s in sets], pa.binary()),
                pa.array([fine_point(s).tobytes() for s in sets], pa.binary()),
            ], names=["doc_id", "n", "class", "keys", "point", "fine"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, class long, keys binary, point binary, fine binary")


# ---------------------------------------------------------------- buckets


def _distinct(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, class) pairs in order of both."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    new = np.insert((keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1]), 0, True) if len(keys) else np.zeros(0, bool)
    return keys[new], classes[new]


def shared_buckets(texts: DataFrame) -> DataFrame:
    """(key, class) of the buckets that two classes or more share; a row may come twice.

    Keys travel as packed arrays, deduplicated before the shuffle: one row per task and shard, the shards being ranges of
    keys, with the classes as places in a list of those that the row holds. A key that is frequent among those of one task
    is known to be shared: its rows go to further shards by class, and two of them to the key's own shard, where the rows of
    tasks in which it is rare then find company.
    """
    total = texts.agg(F.sum(F.octet_length("keys") / 6)).first()[0] or 0
    shards = int(max(8, -(-total // SHARD_ROWS)))
    wide = -(-(1 << 48) // shards)
    most = min(HOT, max(2, SHARD_ROWS // shards))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, z = 0, zstandard.ZstdCompressor(level=1)

        def out() -> pa.RecordBatch:
            keys, classes = _distinct(*(np.concatenate(x) for x in zip(*held)))
            starts = np.flatnonzero(np.insert(keys[1:] != keys[:-1], 0, True))
            n = np.diff(np.append(starts, len(keys)))
            hot, nth = np.repeat(n > most, n), np.arange(len(keys)) - np.repeat(starts, n)
            rest = ~hot | (nth < 2)
            rows = list(dealt(keys[rest], classes[rest], np.searchsorted(keys[rest], np.arange(shards + 1) * wide), 0))
            if hot.any():
                keys, classes = keys[hot], classes[hot]
                to = (mix64(classes.view(U64)) % U64(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                rows += dealt(keys[order], classes[order], np.searchsorted(to[order], np.arange(shards + 1)), shards)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))], names=["shard", "keys", "places", "classes"])

        def dealt(keys: np.ndarray, classes: np.ndarray, cuts: np.ndarray, first: int) -> Iterator[tuple]:
            for k, (a, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if e > a:
                    named, place = np.unique(classes[a:e], return_inverse=True)
                    yield first + k, small(np.diff(keys[a:e], prepend=0)), small(place.astype(np.int64)), named.tobytes()

        def small(x: np.ndarray) -> bytes:
            return z.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())

        for b in batches:
            for c, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = _unpack48(keys)
                held.append((part, np.full(len(part), c, np.int64)))
                size += len(part)
            if size > SHARD_ROWS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, parts, sure = zstandard.ZstdDecompressor(), [], []

        def wide_again(x: bytes) -> np.ndarray:
            return np.frombuffer(z.decompress(x), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()

        for b in batches:
            for k, keys, places, classes in zip(*(c.to_pylist() for c in b.columns)):
                (parts if k < shards else sure).append((np.cumsum(wide_again(keys)), np.frombuffer(classes, np.int64)[wide_again(places)]))
        if sure:
            yield from rows(*_distinct(*(np.concatenate(x) for x in zip(*sure))))
        if parts:
            keys, classes = _distinct(*(np.concatenate(x) for x in zip(*parts)))
            same = keys[1:] == keys[:-1]
            shared = np.append(same, False) | np.insert(same, 0, False)
            yield from rows(keys[shared], classes[shared])

    def rows(keys: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(classes[k : k + (1 << 16)])], names=["key", "class"])

    packed = texts.where("class is not null").select("class", "keys").mapInArrow(pack, "shard int, keys binary, places binary, classes binary")
    return packed.repartitionById(2 * shards, "shard").mapInArrow(meet, "key long, class long")


# ---------------------------------------------------------------- R-trees


class Tree:
    """Packed R-tree over points: levels[0] are the points in order, each node above holds LEAF of the nodes below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points.T[:4], sizes))
        top, least, wide = points[self.order], sizes[self.order], sizes[self.order] > MAX_POINT
        self.levels, self.wide = [(top, least)], [wide]
        while len(top) > 1:
            cuts = np.arange(0, len(top), LEAF)
            top, least, wide = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts), np.logical_or.reduceat(wide, cuts)
            self.levels.append((top, least))
            self.wide.append(wide)

    def join(self, percent: int = PERCENT, other: Tree | None = None, block: int = 1 << 10) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points whose bound allows a link, each once, in blocks: of this tree, or of this one with another.

        Pairs of nodes wait unexpanded and are expanded `block` at a time, the deepest first, so that no more than
        block * LEAF**2 of them wait per level.
        """
        that = other or self
        high = max(len(self.levels), len(that.levels))
        of = lambda tree, level: (*tree.levels[min(level, len(tree.levels) - 1)], tree.wide[min(level, len(tree.levels) - 1)])
        stack = [(high - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > block:
                stack.append((level, i[block:], j[block:]))
                i, j = i[:block], j[:block]
            if level < high - 1:  # the pairs are of nodes one level up
                (a, ia), (b, jb) = below(self, level, i), below(that, level, j)
                i, j = np.repeat(a, jb.shape[1], axis=1).ravel(), np.tile(b, (1, ia.shape[1])).ravel()
                fit = np.repeat(ia, jb.shape[1], axis=1).ravel() & np.tile(jb, (1, ia.shape[1])).ravel()
                if other is None:
                    fit &= (i < j) if level == 0 else (i <= j)
                i, j = i[fit], j[fit]
            elif other is None and level == 0:
                return  # a single point
            (top, least, wide), (top2, least2, wide2) = of(self, level), of(that, level)
            bound = np.minimum(top[i], top2[j]).sum(axis=1, dtype=np.int64)
            ok = (bound >= least_overlap(least[i], least2[j], percent)) | (wide[i] & wide2[j])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level:
                stack.append((level - 1, i, j))
            else:
                yield self.order[i], that.order[j]


def below(tree: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a level under those of the level above, a row each, and which of them exist; a tree may be lower than the level."""
    if level >= len(tree.levels) - 1:
        return nodes[:, None], np.ones((len(nodes), 1), bool)
    at = nodes[:, None] * LEAF + np.arange(LEAF)
    there = at < len(tree.levels[level][0])
    return np.where(there, at, 0), there


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole groups of equal keys and blocks (the first two columns), with the groups' edges, of batches sorted by both."""
    rest: list[np.ndarray] = []
    for b in batches:
        kinds = {"point": (np.uint16, DIMS), "fine": (np.uint8, FINE)}
        cols = [np.frombuffer(b"".join(c.to_pylist()), kinds[name][0]).reshape(-1, kinds[name][1]) if name in kinds else c.to_numpy(zero_copy_only=False) for name, c in zip(b.schema.names, b.columns)]
        cols = [np.concatenate(x) for x in zip(rest, cols)] if rest else cols
        edges = np.insert(np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1, 0, 0)
        rest = [c[edges[-1] :] for c in cols]
        if len(edges) > 1:
            yield [c[: edges[-1]] for c in cols], edges
    if rest and len(rest[0]):
        yield rest, np.array([0, len(rest[0])])


def _bounded(p: np.ndarray, q: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the summed coordinate minima allow a link of points p and q of sizes m and n."""
    return (np.minimum(p, q).sum(axis=1, dtype=np.int64) >= least_overlap(m, n, percent)) | (m > MAX_POINT) & (n > MAX_POINT)


def _star(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each bucket: its members with the one nearest to their mean."""
    out: set[tuple[int, int]] = set()
    for (_, _, classes, sizes, points), edges in _whole_groups(batches):
        n = np.diff(edges)
        two = edges[:-1][n == 2]
        two = two[classes[two] != classes[two + 1]]
        two = two[_bounded(points[two], points[two + 1], sizes[two], sizes[two + 1], percent)]
        out.update(zip(np.minimum(classes[two], classes[two + 1]).tolist(), np.maximum(classes[two], classes[two + 1]).tolist()))
        for a, z in zip(edges[:-1][n > 2].tolist(), edges[1:][n > 2].tolist()):
            c, s, p = classes[a:z], sizes[a:z], points[a:z]
            near = int(np.argmax(np.minimum(p, p.mean(axis=0)).sum(axis=1) / np.maximum(s, s.mean())))
            ok = _bounded(p, p[near], s, s[near], percent)
            hub = int(c[near])
            ok &= c != hub
            out.update((min(x, hub), max(x, hub)) for x in c[ok].tolist())
        if len(out) > 100_000:
            yield _pairs(out)
            out = set()
    yield _pairs(out)


def _star_again(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each bucket with several components: all members with one of the smaller components' that is
    nearest to the mean, where the components differ."""
    out: set[tuple[int, int]] = set()
    for (_, _, classes, sizes, points, roots), edges in _whole_groups(batches):
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            c, s, p, r = classes[a:z], sizes[a:z], points[a:z], roots[a:z]
            score = np.minimum(p, p.mean(axis=0)).sum(axis=1) / np.maximum(s, s.mean())
            names, inverse, n = np.unique(r, return_inverse=True, return_counts=True)
            if len(names) == 1:  # a block of a larger bucket
                continue
            score[inverse == int(np.argmax(n))] = -1.0
            near = int(np.argmax(score))
            ok = _bounded(p, p[near], s, s[near], percent) & (r != r[near])
            hub = int(c[near])
            out.update((min(x, hub), max(x, hub)) for x in c[ok].tolist())
        if len(out) > 100_000:
            yield _pairs(out)
            out = set()
    yield _pairs(out)


def _across(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each bucket between different components, by joining its tree with itself; of two blocks of a
    larger bucket (sides 1 and 2), by joining the tree of one with that of the other."""
    out: set[tuple[int, int]] = set()
    for cols, edges in _whole_groups(batches):
        for k, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            _, _, classes, sizes, points, roots, side, fine = (c[k:z] for c in cols)
            full = (fine == 255).any(axis=1)
            parts = [np.flatnonzero(side == x) for x in ((0,) if not side[0] else (1, 2))]
            if not all(map(len, parts)):
                continue
            trees = [Tree(points[x], sizes[x]) for x in parts]
            for i, j in trees[0].join(percent, *trees[1:]):
                i, j = parts[0][i], parts[-1][j]
                other = roots[i] != roots[j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                least = least_overlap(sizes[i], sizes[j], percent)
                ok = np.concatenate([np.minimum(fine[i[m : m + 20_000]], fine[j[m : m + 20_000]]).sum(axis=1, dtype=np.int64) for m in range(0, len(i), 20_000)]) >= least
                ok |= full[i] | full[j]
                a, b = classes[i[ok]], classes[j[ok]]
                out.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
                if len(out) > 100_000:
                    yield _pairs(out)
                    out = set()
    yield _pairs(out)


def _pairs(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


# ---------------------------------------------------------------- verification


def within_bound(pairs: DataFrame, member: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes whose FINE groups allow a link: 256 bytes a side are read for it, not whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, FINE) for k in (4, 5))
            ok = np.minimum(x, y).sum(axis=1, dtype=np.int64) >= least_overlap(m, n, percent)
            yield b.select([0, 1]).filter(pa.array(ok | (x == 255).any(axis=1) | (y == 255).any(axis=1)))

    of = lambda c, n, f: member.select(F.col("class").alias(c), F.col("n").alias(n), F.col("fine").alias(f))
    d = pairs.join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
    return d.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, member: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of classes that link. member: (class, doc_id, n, fine), a text for each class."""
    found = stage(pairs.distinct(), "found", WIDE_BATCH)
    pairs = stage(within_bound(found, member, percent), "pairs", WIDE_BATCH)
    discard(found)
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(member, "class").select("class", F.col("doc_id").alias("__d"))
    wanted = stage(wanted, "wanted")
    # Only texts that may be wanted are shuffled.
    texts = possible(docs, "doc_id", bloom_words(wanted, "__d")).join(wanted, F.col("doc_id") == F.col("__d")).select("class", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 4 << 20):
            found = shingle_sets(b.column(1), size)
            # A doc_id with several texts brings those too; only the class's own set may pass.
            own = [k for k, (c, s) in enumerate(zip(b.column(0).to_pylist(), found)) if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 == c]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array([found[k].tobytes() for k in own], pa.binary())], names=["class", "set"])

    found = stage(texts.mapInArrow(sets, "class long, set binary").dropDuplicates(["class"]), "sets", WIDE_BATCH)
    discard(wanted)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = found.withColumnsRenamed({"class": "a", "set": "x"})
    right = found.withColumnsRenamed({"class": "b", "set": "y"})
    links = stage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links", WIDE_BATCH)
    discard(pairs, found)
    return links


def linked(pairs: DataFrame, links: DataFrame | None, docs: DataFrame, member: DataFrame, percent: int, size: int) -> DataFrame:
    """links and enough of the pairs' links to have the components of all of them.

    First each class is held against the partner that it shares most buckets with; of the other pairs only those between
    different components are verified. So about two sets travel per class, not per pair.
    """
    counted = stage(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "counted", WIDE_BATCH)
    pair = F.struct("n", "a", "b")
    ends = counted.select(F.col("a").alias("u"), pair.alias("p")).union(counted.select("b", pair))
    best = stage(ends.groupBy("u").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct(), "best")
    own = verified(best, docs, member, percent, size)
    links = own if links is None else links.union(own)
    roots = stage(components(links), "roots")
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    rest = counted.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    links = links.union(verified(rest.join(best, ["a", "b"], "left_anti"), docs, member, percent, size))
    discard(counted, best, roots)
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id reachable by links.

    Null or empty texts have no shingles and their own id as component. Rows with a null doc_id get a null component and
    link nothing. A doc_id with several texts belongs to each text's component, a row each. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    described = stage(describe(docs, percent, size), "described", WIDE_BATCH)
    texts = stage(described.select("doc_id", "n", "class"), "texts")
    named = described.where("class is not null and doc_id is not null")
    member = stage(named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("point").alias("point"), F.min("fine").alias("fine")), "classes")
    buckets = stage(shared_buckets(named), "buckets", WIDE_BATCH)
    discard(described)
    big = stage(buckets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).alias("__blocks")), "big")
    points = member.select("class", "n", "point")

    def in_blocks(rows: DataFrame) -> DataFrame:
        """Larger buckets cut into blocks of about `block` members each, others than in other buckets of the same members."""
        d = rows.join(big, "key", "left")
        return d.withColumn("block", F.coalesce(F.pmod(F.xxhash64("class", "key"), F.col("__blocks")), F.lit(0).cast("long")))

    def sorted_by(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select("key", "block", *columns).repartition("key", "block").sortWithinPartitions("key", "block")

    stars = sorted_by(in_blocks(buckets).join(points, "class"), "class", "n", "point")
    links = linked(stars.mapInArrow(partial(_star, percent=percent), "a long, b long"), None, docs, member, percent, size)

    def between_components() -> DataFrame:
        """Rows of the buckets that still hold several components, with their roots."""
        roots = stage(components(links), "roots")
        rooted = stage(buckets.join(roots.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("root", "class").alias("root")), "rooted")
        mixed = stage(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "mixed")
        several = stage(rooted.join(mixed, "key", "left_semi"), "several")
        discard(roots, rooted, mixed)
        return several

    several = between_components()
    again = sorted_by(in_blocks(several).join(points, "class"), "class", "n", "point", "root")
    links = linked(again.mapInArrow(partial(_star_again, percent=percent), "a long, b long"), links, docs, member, percent, size)
    discard(several)
    several = between_components()
    discard(buckets)
    # Each block of a larger bucket meets itself (side 0) and each other one (sides 1 and 2).
    pairs = in_blocks(several).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__blocks", F.lit(1)) - 1)))
    pairs = pairs.withColumn("side", F.when(F.col("block") == F.col("__other"), 0).when(F.col("block") < F.col("__other"), 1).otherwise(2))
    pairs = pairs.withColumn("block", F.least("block", "__other") * F.coalesce("__blocks", F.lit(1)) + F.greatest("block", "__other"))
    pairs = sorted_by(pairs.join(member.select("class", "n", "point", "fine"), "class"), "class", "n", "point", "root", "side", "fine")
    more = verified(pairs.mapInArrow(partial(_across, percent=percent), "a long, b long"), docs, member, percent, size)
    discard(several)
    ends = stage(components(links.union(more)), "roots")
    labelled = member.join(ends, member["class"] == ends["node"]).select("class", "doc_id", "root")
    first = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = stage(labelled.join(first, "root").select(F.col("class").alias("__c"), "component_id"), "components")
    least = member.select(F.col("class").alias("__m"), F.col("doc_id").alias("__first"))
    out = texts.select("doc_id", "n", "class").join(of_class, F.col("class") == F.col("__c"), "left").join(least, F.col("class") == F.col("__m"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "__first", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
