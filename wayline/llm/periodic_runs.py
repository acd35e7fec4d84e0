"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Words of a text are numbers. Three steps find its runs of exponent e or more:

1. Breaks that no run can span are found for a whole batch of texts: within such a run every pair of neighbour words occurs at least
   e - 1 times. Stretches are split at rarer pairs and counted anew until nothing changes. What is left is rarely more than
   the repeated part; no run is lost.
2. The first phase of Baier's suffix sorter groups the suffixes of each stretch. When a group is final, its size is the length of
   the longest Lyndon word at its positions. Done under both orders of the words, this gives both Lyndon arrays, and no suffix
   array is built. Each run has a Lyndon root among them.
3. Roots are extended by longest common extensions, looked up in tables of equal blocks of 2^k words (no hashes): what a root of
   period p reaches, p at least, is a run.

Long texts cost O(n log n) memory in what step 1 leaves, and time O(n log n); only one text (or batch) is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _IS_GAP, mix64, small_batches, text_bytes, word_array, word_spans

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def candidates(codes: np.ndarray, rows: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of words outside of which no run of the exponent and length is. codes: words of texts on end, rows: first word of each."""
    if len(codes) < 2:
        return []
    left = np.ones(len(codes) - 1, bool)  # pairs (k, k + 1) that a run may hold
    left[rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(codes))] - 1] = False
    at = np.flatnonzero(left)
    pair = mix64(codes[at].astype(np.uint64) << np.uint64(32) | codes[at + 1].astype(np.uint64))
    while len(at):
        first = np.empty(len(at), bool)
        first[0], first[1:] = True, np.diff(at) > 1
        piece = np.cumsum(first) - 1
        if not np.any(short := np.bincount(piece) < least - 1):
            short = None
        # Pairs are counted in a table by hash: a collision only keeps a pair that could go.
        size = 1 << max(10, int(4 * len(at)).bit_length())
        key = (mix64(pair + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(size - 1)).astype(np.int64)
        keep = np.bincount(key, minlength=size)[key] >= exponent - 1
        if short is not None:
            keep &= ~short[piece]
        if keep.all():
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(at)) - 1
            return list(zip(at[starts].tolist(), (at[ends] + 2).tolist()))
        at, pair = at[keep], pair[keep]
    return []


def lyndon_lengths(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position, by the grouping phase of Baier's suffix sorter.

    Groups hold positions with a common start; they stand in a list by order. The greatest unfinished group is taken: each of its positions
    looks left for the nearest one in a lower group. Those found so move out of their groups to one just above, the more
    often found the higher, for they are followed by so many copies of the group's word.
    """
    n = len(word)
    order = sorted(set(word))
    number = {c: k for k, c in enumerate(order)}
    group = [number[c] for c in word]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    size, below, above = [1] * len(order), list(range(-1, len(order) - 1)), list(range(1, len(order) + 1))
    done, back, length, count = [False] * len(order), [-1] * n, [0] * n, [0] * n
    top = len(order) - 1
    while top >= 0:
        width, found = size[top], []
        for i in members[top]:
            if group[i] != top:
                continue
            length[i], j = width, i - 1
            while j >= 0 and ((g := group[j]) == top or done[g]):
                j = back[j]
            back[i] = j
            if j >= 0:
                if not count[j]:
                    found.append(j)  # in rising order, for links don't cross
                count[j] += 1
        done[top] = True
        parts: dict[tuple[int, int], list[int]] = {}
        for j in found:
            parts.setdefault((count[j], group[j]), []).append(j)
            count[j] = 0
        for times, old in sorted(parts, reverse=True):
            new, upper = len(size), above[old]
            size.append(size[old] + times * width)
            members.append(parts[times, old])
            done.append(False)
            below.append(old)
            above.append(upper)
            below[upper], above[old] = new, new
            for j in parts[times, old]:
                group[j] = new
        top = below[top]
    return length


def _equal_blocks(word: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Tables of numbers: entry i of table k tells blocks of 2^k words from i apart. cut: number of the stretch of each position;
    blocks over the end of a stretch are all different."""
    level, tables, span = np.unique(word, return_inverse=True)[1].astype(np.int64), [], 1
    while True:
        tables.append(level)
        n = len(level) - span
        if n <= 0:
            return tables
        whole = cut[:n] == cut[np.minimum(np.arange(n) + 2 * span - 1, len(cut) - 1)]
        whole &= np.arange(n) + 2 * span <= len(cut)
        if not whole.any():
            return tables
        pair = level[:n] * (int(level.max()) + 1) + level[span : span + n]
        level = np.empty(n, np.int64)
        _, inner = np.unique(pair[whole], return_inverse=True)
        level[whole] = inner
        level[~whole] = int(inner.max()) + 1 + np.arange(int((~whole).sum()))
        span *= 2


def _common(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray, cut: np.ndarray, back: bool) -> np.ndarray:
    """How many words are equal from a and b on (or, going back, before a and b), within a stretch."""
    got, n = np.zeros(len(a), np.int64), len(cut)
    for k in range(len(tables) - 1, -1, -1):
        table, span = tables[k], 1 << k
        x, y = (a - got - span, b - got - span) if back else (a + got, b + got)
        home = cut[np.minimum(a, n - 1)] if not back else cut[np.maximum(a - 1, 0)]
        inside = (x >= 0) & (y < len(table)) & (x < len(table))
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        inside &= (table[x] == table[y]) & (cut[x] == home) & (cut[y] == home)
        got += np.where(inside, span, 0)
    return got


def runs_of(codes: np.ndarray, rows: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Runs of texts whose words, as numbers, stand on end: (first word, length, period) by row, start and period, starts counted
    over all texts. rows: first word of each text. A run has length >= max(least, exponent * period); exponent is 2 at least."""
    pieces = candidates(codes, rows, least, exponent)
    if not pieces:
        return np.zeros((0, 3), np.int64)
    ends = np.array(pieces)
    sizes = ends[:, 1] - ends[:, 0]
    begin = np.cumsum(sizes) - sizes
    cut = np.repeat(np.arange(len(pieces)), sizes)
    word = codes[np.repeat(ends[:, 0] - begin, sizes) + np.arange(len(cut))]
    root = []
    for (a, b), at in zip(pieces, begin.tolist()):
        own = word[at : at + b - a]
        for order in (own, -own):
            root.append(np.array(lyndon_lengths(order.tolist()), np.int64))
    starts = [np.arange(at, at + b - a) for (a, b), at in zip(pieces, begin.tolist()) for _ in range(2)]
    i, p = np.concatenate(starts), np.concatenate(root)
    fits = exponent * p <= sizes[cut[i]]
    i, p = i[fits], p[fits]
    tables = _equal_blocks(word, cut)
    right = i + p + _common(tables, i, np.minimum(i + p, len(cut)), cut, False)
    left = i - _common(tables, i, i + p, cut, True)
    long = right - left >= np.maximum(least, exponent * p)
    found = np.unique(np.stack([left, right - left, p], axis=1)[long], axis=0)
    found[:, 0] += (ends[:, 0] - begin)[cut[found[:, 0]]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _collapsed(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by a space."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    k = np.flatnonzero(kept)
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[k]] += 1
    step[ends[k]] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    follows = np.flatnonzero(row[k[:-1]] == row[k[1:]])  # a later word of the row is kept, so a gap stands behind this one
    mask[ends[k[follows]]] = True
    body = np.where(_IS_GAP[data], np.uint8(32), data)[mask]
    at = np.concatenate([[0], np.cumsum(mask)])[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """id, n_words, runs (array of start, length, period by start, then period) and collapsed.

    Words are what stands between gaps; a run is a stretch of words with smallest period q, maximal for it, of length
    max(least, exponent * q) or more; starts count words from 0. collapsed joins by one space the words that no run holds after its first q
    words. Null and empty texts have no words and an empty collapsed text. One row in, one row out, repeated ids included;
    other columns are ignored. Nothing is shuffled.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run repeats its period at least once")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "__text"):
            data, offsets = text_bytes(b.column(1))
            starts, ends, rows = word_spans(data, offsets)
            codes = word_array(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = runs_of(codes, rows, least, exponent)
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.add.at(gone, found[:, 0] + found[:, 1], -1)
            text = _collapsed(data, offsets, starts, ends, rows, np.cumsum(gone[:-1]) == 0)
            row = np.searchsorted(rows, found[:, 0], side="right") - 1
            first = np.searchsorted(row, np.arange(len(rows))).astype(np.int32)
            parts = [pa.array(found[:, 0] - rows[row]), pa.array(found[:, 1].copy()), pa.array(found[:, 2].copy())]
            runs = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(rows).astype(np.int64)), runs, text], names=["__id", "n_words", "runs", "collapsed"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, f"__id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("__id", id_col)
