"""Personal data in texts, disguised or not, as spans of the text itself.

Four detectors find e-mail addresses, IP addresses, card and phone numbers. They run on the text, which gives the base
spans, and once more on a normalised text, made by a transducer that rewrites

* homoglyphs, full-width forms and other scripts' digits to ASCII, and drops zero-width characters,
* runs of spelled digits (four languages) to digits, and "plus" before digits to +,
* disguised signs: (at), [dot], "name at host dot org", and the like.

The transducer writes, for each character of its output, the span of the source it stands for, so a match of the
normalised text maps back to exact source characters. A text without anything to rewrite is not normalised, nor is one whose
rewritten form shows nothing. Detectors
are linear in the text's length, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---------------------------------------------------------------- detectors

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that could begin within a run of digits could begin at the run's first digit, so others need no try.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        local = at - free - len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if local and (m := _DOMAIN.match(text, at + 1)):
            yield at - local, m.end()
            free = m.end()
        at = text.find("@", free)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: list(f(text)) for kind, f in DETECTORS.items()}


# ---------------------------------------------------------------- transducer

# Letters of other scripts that look like a Latin letter.
_LOOKALIKES = dict(zip("асеорхуіјѕԁһԛԝАВЕКМНОРСТХІЈЅοανρΑΒΕΖΗΙΚΜΝΟΡΤΥΧıⅼ", "aceopxyijsdhqwABEKMHOPCTXIJSoavpABEZHIKMNOPTYXil", strict=True))
_SIGNS = {"﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
_DROPPED = "­​‌‍⁠﻿"
# Digits as words, from zero on.
_DIGITS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_VALUE = {w: str(k) for words in _DIGITS.values() for k, w in enumerate(words.split())}
_WORD = "(?:" + "|".join(sorted(_VALUE, key=lambda w: (-len(w), w))) + ")"
_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_AT, _DOT = "(?:at|ät|arroba|arobase|@)", r"(?:dot|punkt|punto|point|\.)"
_RULES = re.compile(
    rf"(?P<at>\s?{_OPEN}{_AT}{_CLOSE}\s?|(?<=[\w.%+-])\s{{1,3}}at\s{{1,3}}(?=[\w-]+(?:\s?{_OPEN}{_DOT}{_CLOSE}\s?|\s{{1,3}}dot\s{{1,3}})\w))"
    rf"|(?P<dot>\s?{_OPEN}{_DOT}{_CLOSE}\s?|(?<=\w)\s{{1,3}}dot\s{{1,3}}(?=\w))"
    rf"|(?P<plus>\bplus\s{{1,3}}(?=[0-9]|{_WORD}\b))"
    rf"|(?P<run>\b{_WORD}\b(?:[\s,-]{{1,3}}{_WORD}\b)*)",
    re.IGNORECASE,
)
_ONE = re.compile(_WORD, re.IGNORECASE)
def _letter(c: str) -> str:
    if c in _DROPPED:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _SIGNS:
        return _SIGNS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    value = unicodedata.decimal(c, None)
    return c if value is None else str(value)


def _ranges(chars: list[str]) -> str:
    """An RE2 class of the sorted characters."""
    out: list[list[int]] = []
    for x in map(ord, chars):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


_ALL = [chr(x) for x in range(0x80, sys.maxunicode + 1) if not 0xD800 <= x < 0xE000]
#: What the first transducer rewrites, and other characters that the rules take for a space or for an ASCII letter.
_ODD = [c for c in _ALL if _letter(c) != c or c.isspace() or re.match("[a-z]", c, re.IGNORECASE)]
_REWRITTEN = str.maketrans({c: x for c in _ODD if (x := _letter(c)) != c})
_SPACE = r"[\s\x{b}\x{1c}-\x{1f}]"
#: Texts without this (RE2) have nothing to rewrite: odd characters, or what one of the rules needs at least.
TRIGGER = rf"(?i)[{_ranges(_ODD)}]|[\[({{<]{_SPACE}?(?:{_AT[3:-1]}|{_DOT[3:-1]}){_SPACE}?[\])}}>]|{_SPACE}dot{_SPACE}|\bplus{_SPACE}|\b{_WORD}\b"


def _digit(word: str) -> str:
    """The digit that a word of _WORD spells, with letters that only equal ASCII ones without their case."""
    return _VALUE.get(word.lower()) or next(v for w, v in _VALUE.items() if re.fullmatch(w, word, re.IGNORECASE))


def rewritten(text: str) -> str:
    """The normalised text alone."""

    def of(m: re.Match) -> str:
        if m["run"]:
            return "".join(map(_digit, _ONE.findall(m["run"])))
        return "@" if m["at"] else "." if m["dot"] else "+"

    return _RULES.sub(of, text if text.isascii() else text.translate(_REWRITTEN))


def normalise(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """The rewritten text; for each of its characters, where its source begins and ends, and whether it was rewritten."""
    # First transducer: letter by letter.
    out, start = [], []
    for k, c in enumerate(text):
        if x := c if c < "\x80" else _letter(c):
            out.append(x)
            start.append(k)
    plain = "".join(out)
    start.append(len(text))
    # Second transducer: disguised signs and spelled digits, over the first one's output.
    chars: list[str] = []
    begins: list[int] = []
    ends: list[int] = []
    new: list[bool] = []

    def copy(a: int, b: int) -> None:
        for k in range(a, b):
            chars.append(plain[k])
            begins.append(start[k])
            ends.append(start[k] + 1)
            new.append(text[start[k]] != plain[k] or k > a and start[k] != start[k - 1] + 1)

    def put(x: str, a: int, b: int) -> None:
        chars.append(x)
        begins.append(start[a])
        ends.append(start[b - 1] + 1)
        new.append(True)

    at = 0
    for m in _RULES.finditer(plain):
        copy(at, m.start())
        if m["run"]:
            for w in _ONE.finditer(plain, m.start(), m.end()):
                put(_digit(w[0]), w.start(), w.end())
        else:
            put("@" if m["at"] else "." if m["dot"] else "+", m.start(), m.end())
        at = m.end()
    copy(at, len(plain))
    return "".join(chars), begins, ends, new


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows; none overlaps a base span of its kind."""
    plain, begins, ends, new = normalise(text)
    out: dict[str, list[Span]] = {}
    for kind, found in base_spans(plain).items():
        known = base[kind]
        fresh = [(begins[a], ends[b - 1]) for a, b in found if any(new[a:b])]
        k, out[kind] = 0, []
        for a, b in fresh:
            while k < len(known) and known[k][1] <= a:
                k += 1
            if k == len(known) or known[k][0] >= b:
                out[kind].append((a, b))
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


EMPTY = {kind: [] for kind in KINDS}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans (all), n_added.

    spans and the digest's source list kind:start:end by kind, then start; offsets count code points, end exclusive.
    Null and empty texts have no spans. One row in, one row out, without a shuffle; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for b in small_batches(batches, "__text"):
            text = pc.fill_null(b.column(1), "")
            plain = pc.match_substring_regex(text, "[0-9@]").to_pylist()
            odd = pc.match_substring_regex(text, TRIGGER).to_pylist()
            n = b.num_rows
            counts, digests, spans, added = [[0] * n for _ in KINDS], [nothing] * n, [""] * n, [0] * n
            for k in range(n):
                if not (plain[k] or odd[k]):
                    continue
                t = text[k].as_py()
                base = base_spans(t) if plain[k] else EMPTY
                own = joined(base)
                digests[k], spans[k] = hashlib.sha256(own.encode()).hexdigest(), own
                for c, x in zip(counts, KINDS):
                    c[k] = len(base[x])
                if odd[k] and (other := rewritten(t)) != t and any(base_spans(other).values()):
                    more = added_spans(t, base)
                    added[k] = sum(map(len, more.values()))
                    if added[k]:
                        spans[k] = joined({x: base[x] + more[x] for x in KINDS})
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(added, pa.int64())], names=["__id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans", "n_added"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, f"__id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumnRenamed("__id", id_col)
