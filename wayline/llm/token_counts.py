"""Token counts by compiled finite-state transducers.

Two deterministic machines stand for a byte-level BPE tokenizer:

* The *splitter* has 13 states over 12 character classes and marks where pre-tokens begin. A text is cut into
  chunks of equal length; every chunk gives a map from each state it may be entered in to the state it is left
  in, all chunks at once. The maps compose (they form a monoid), so a parallel prefix scan over them tells each
  chunk's true first state, and one more pass emits the marks. No chunk waits for the chunk before it.
* The *merger* reads the bytes of a pre-token. A state holds what can still matter: the suffix that may grow
  into a longer token, with the last token and the relative count at each of its positions. Each transition is
  annotated with the change in the number of emitted tokens. BPE has one segmentation in which all neighbours
  are a valid pair, so the last token of every prefix is determined and the machine is deterministic. States
  are made when they are first reached; beyond `MAX_STATES` the machine starts anew, with the same counts.

Only the splitter's maps are composed by the scan. Once pre-tokens are marked they are independent, so the merger runs over
distinct ones, each with its count of emitted tokens, and the counts are added up; no state is carried across.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_bytes

CHUNK = 256
MAX_STATES = 400_000
MAX_MEMO = 1_000_000

# ---------------------------------------------------------------- splitter

SPACE, WHITE, LETTER, DIGIT, OTHER, APOS, C_STMD, C_R, C_V, C_L, C_E, STOP = range(12)
START, S_LET, S_DIG, S_OTH, S_APO, S_AR, S_AV, S_AL, S_CON, S_1S, S_1W, S_2S, S_2W = range(13)
#: Marks of a transition: a pre-token begins at this character, or at the one before it.
HERE, BEFORE = 1, 2
_LETTERS = {LETTER, C_STMD, C_R, C_V, C_L, C_E}


def _fresh(c: int) -> int:
    """State after a pre-token's first character."""
    if c in _LETTERS:
        return S_LET
    return {SPACE: S_1S, WHITE: S_1W, DIGIT: S_DIG, OTHER: S_OTH, APOS: S_APO, STOP: START}[c]


def _move(s: int, c: int) -> tuple[int, int]:
    if s in (S_AR, S_AV, S_AL):  # an apostrophe and r, v or l: a contraction if the right letter follows
        if c == (C_L if s == S_AL else C_E):
            return S_CON, 0
        state, marks = _move(S_LET, c)
        return state, marks | BEFORE
    if c == STOP:
        return START, 0
    white, letter = c in (SPACE, WHITE), c in _LETTERS
    if s == S_LET and letter or s == S_DIG and c == DIGIT or s == S_OTH and c in (OTHER, APOS):
        return s, 0
    if s == S_APO:
        if c == C_STMD:
            return S_CON, 0
        if c in (C_R, C_V, C_L):
            return {C_R: S_AR, C_V: S_AV, C_L: S_AL}[c], 0
        if c in (OTHER, APOS):
            return S_OTH, 0
    if s in (S_1S, S_1W, S_2S, S_2W):
        if white:
            return (S_2S if c == SPACE else S_2W), 0
        marks = (BEFORE if s in (S_2S, S_2W) else 0) | (HERE if s in (S_1W, S_2W) else 0)
        joined = S_LET if letter else S_DIG if c == DIGIT else S_OTH
        return (joined if s in (S_1S, S_2S) else _fresh(c)), marks
    return _fresh(c), HERE


NEXT = np.array([[_move(s, c)[0] for s in range(13)] for c in range(12)], np.uint8)
MARKS = np.array([[_move(s, c)[1] for s in range(13)] for c in range(12)], np.uint8)
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties of the `regex` library."""
    global _classes
    if _classes is None:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\p{White_Space}+", WHITE)):
            for m in regex.finditer(pattern, every):
                low, high = ord(every[m.start()]), ord(every[m.end() - 1])
                out[low : high + 1] = c
        out[0xD800:0xE000] = OTHER
        for chars, c in ((" ", SPACE), ("'", APOS), ("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
            for x in chars:
                out[ord(x)] = c
        _classes = out
    return _classes


def first_states(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunks x states) in log steps; the state each chunk begins in."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.concatenate([[START], out[:-1, START]]).astype(np.uint8)


def split_marks(classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character. `classes` must end with STOP."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, STOP, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    flat, wide = NEXT.ravel(), np.arange(13, dtype=np.uint8)
    maps = np.broadcast_to(wide, (chunks, 13)).copy()
    for c in columns:
        maps = flat[c[:, None].astype(np.int16) * 13 + maps]
    state, marks, flat_marks = first_states(maps), np.empty((CHUNK, chunks), np.uint8), MARKS.ravel()
    for j, c in enumerate(columns):
        at = c.astype(np.int16) * 13 + state
        marks[j], state = flat_marks[at], flat[at]
    marks = marks.T.ravel()[:n]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return begins


# ---------------------------------------------------------------- merger


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeMachine:
    """Lazily determinised transducer from bytes to emitted-token counts."""

    def __init__(self, tokens: set[bytes], merges: list[tuple[bytes, bytes]]):
        self.tokens, self.rank = tokens, {m: i for i, m in enumerate(merges)}
        self.prefixes = {t[:k] for t in tokens for k in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (b"", ((None, 0),))
        self.states, self.ids, self.moves = [start], {start: 0}, [{}]

    def segments(self, data: bytes) -> list[bytes]:
        """BPE by its definition: merge the lowest-ranked neighbours first, the leftmost of equals."""
        parts: list[bytes | None] = [data[k : k + 1] for k in range(len(data))]
        right, left = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, k) for k in range(len(parts) - 1) if (r := self.rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if parts[k] is None or right[k] < 0 or self.rank.get((parts[k], parts[right[k]])) != r:
                continue
            gone = right[k]
            parts[k], parts[gone] = parts[k] + parts[gone], None
            right[k] = right[gone]
            if right[k] >= 0:
                left[right[k]] = k
            for a in (left[k], k):
                if a >= 0 and right[a] >= 0 and (x := self.rank.get((parts[a], parts[right[a]]))) is not None:
                    heapq.heappush(heap, (x, a))
        return [p for p in parts if p is not None]

    def valid(self, a: bytes | None, b: bytes) -> bool:
        """Whether token b may follow token a (None: the beginning)."""
        if (known := self.pairs.get((a, b))) is None:
            known = self.pairs[(a, b)] = self.segments((a or b"") + b) == ([b] if a is None else [a, b])
        return known

    def _reach(self, at: int, byte: int) -> tuple[int, int]:
        suffix, chain = self.states[at]
        grown = suffix + bytes((byte,))
        for k in range(len(grown)):
            token = grown[k:]
            if token in self.tokens and self.valid(chain[k][0], token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        emitted = chain[k][1] + 1
        keep = next(j for j in range(len(grown) + 1) if grown[j:] in self.prefixes)
        chain = (*((t, n - emitted) for t, n in chain[keep:]), (token, 0)) if keep <= len(suffix) else ((token, 0),)
        state = (grown[keep:], chain)
        if (to := self.ids.get(state)) is None:
            to = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        self.moves[at][byte] = (to, emitted)
        return to, emitted

    def count(self, data: bytes) -> int:
        at = total = 0
        moves = self.moves
        for byte in data:
            move = moves[at].get(byte)
            at, n = move if move is not None else self._reach(at, byte)
            total += n
        if len(self.states) > MAX_STATES or len(self.pairs) > 4 * MAX_STATES:
            self.clear()
            self.pairs.clear()
        return total


class Tokenizer:
    """Counts what the library gives for a byte-level BPE file, special strings in texts included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or spec["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files can be compiled")
        self.special = [t["content"].encode() for t in spec["added_tokens"] if t["special"]]
        letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.machine = MergeMachine({raw(t) for t in spec["model"]["vocab"] if t not in special}, [(raw(a), raw(b)) for a, b in merges])
        self.memo: dict[bytes, int] = {}

    def _counts(self, words: list[bytes]) -> np.ndarray:
        memo, count = self.memo, self.machine.count
        if len(memo) > MAX_MEMO:
            memo.clear()
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            n = memo.get(w)
            if n is None:
                n = count(w)
                if len(w) <= 64:
                    memo[w] = n
            out[k] = n
        return out

    def count_column(self, col: pa.Array) -> np.ndarray:
        """Tokens of each row; null counts as empty."""
        data, offsets = text_bytes(col)
        body, rows = data.tobytes(), len(offsets) - 1
        total, cuts = np.zeros(rows, np.int64), []
        for s in self.special:
            at = body.find(s)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(s) <= offsets[row + 1]:
                    cuts.append((at, at + len(s), row))
                    at = body.find(s, at + len(s))
                else:
                    at = body.find(s, at + 1)
        # Segments of texts, each on its own row, without the special strings.
        cuts.sort()
        if cuts:
            pieces, owner, k = [], [], 0
            for row in range(rows):
                at = int(offsets[row])
                while k < len(cuts) and cuts[k][2] == row:
                    if cuts[k][0] >= at:
                        pieces.append(body[at : cuts[k][0]])
                        owner.append(row)
                        at = cuts[k][1]
                        total[row] += 1
                    k += 1
                pieces.append(body[at : int(offsets[row + 1])])
                owner.append(row)
            body, owner = b"".join(pieces), np.array(owner)
            data = np.frombuffer(body, np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        else:
            owner = np.arange(rows)
        if not len(data):
            return total
        points = np.frombuffer(body.decode("utf-8", "strict").encode("utf-32-le"), np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.searchsorted(leads, offsets[1:])  # characters before each segment's end
        classes = np.insert(char_classes()[points], ends, STOP)
        begins = split_marks(classes)
        starts = leads[np.delete(begins, ends + np.arange(len(ends))).nonzero()[0]]
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(body)])
        coded = cut.dictionary_encode()
        each = self._counts(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        sums = np.concatenate([[0], np.cumsum(each)])
        at = np.searchsorted(starts, offsets)
        np.add.at(total, owner, sums[at[1:]] - sums[at[:-1]])
        return total


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row; other columns are ignored.
    `tokenizer_path` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = tokenizer(tokenizer_path)
        for b in small_batches(batches, "__text", 4 << 20):
            n = machine.count_column(b.column(1))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=["__id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = picked.mapInArrow(run, f"__id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("__id", id_col)
