"""Secret scans: fixed patterns plus sliding-window entropy.

Besides the three base patterns, long runs of key-like characters are searched
for stretches that look random. A window slides over each candidate; the counts
of its characters are kept up to date by one step in and one step out, and with
them the Shannon entropy of the window and its character class (digits, hex
digits, letters of one case, with or without - _ / + between them, letters of
both, or letters with digits). Windows
above their own class's threshold are joined into one span; letters of one
case must also be short of vowels, which words are not. An allow-list takes out strings that are long and mixed
but known: UUIDs, file paths, dates, version numbers and placeholders.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilework.llm.common import UPPER_TO_LOWER, portions, table, texts

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character over a window of 20; random strings of the class lie above.
THRESHOLDS = {"digits": 2.9, "hex": 3.0, "mixed": 3.6, "letters": 3.7, "lower": 3.65, "upper": 3.65, "parted": 3.7}
#: A window of letters of both cases has so many of either at least; words and names have fewer.
CASES = WINDOW // 4
#: A window of letters of one case has so many vowels at most; words have more.
VOWELS = WINDOW // 4
#: A window of letters of one case with - _ / + between them has so many letters at least.
PARTED = WINDOW * 3 // 4
ALLOW = (
    rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    rb"[A-Za-z_-]*\d{1,6}",  # unless the letters look random
    rb"(\d{1,19}[_/-]+)*\d{1,19}",
    rb"(?i:.*(example|placeholder|changeme|xxxx|0123456789|abcdefgh).*)",
    rb"([A-Za-z_-]+\d{0,4}/)+[A-Za-z_-]*\d{0,4}",
)

ENDS = re.compile(rb"[A-Za-z_-]+\d{1,6}")


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGITS = b"0123456789"
_HEX = _members(DIGITS + b"abcdef")
_KEYLIKE = _members(DIGITS + bytes(range(65, 91)) + bytes(range(97, 123)) + b"+/_-")
_HEXLIKE = frozenset(DIGITS + b"abcdefABCDEF")
_VOWELS = frozenset(b"aeiouAEIOU")


def runs(buf: np.ndarray, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of member bytes, at least so long: starts and ends."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = members[buf]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = end - start >= least
    return start[long], end[long]


def window_class(window: int, digits: int, hexes: int, upper: int, lower: int, vowels: int) -> str | None:
    """The class of a window by how many characters of each kind it has; None for what words and names look like."""
    if digits == window:
        return "digits"
    if hexes == window:
        return "hex"
    if digits:
        return "mixed"
    if lower == window or upper == window:
        one = "lower" if lower else "upper"
        return one if vowels * WINDOW <= VOWELS * window else None
    letters = upper + lower
    if min(upper, lower) == 0 and letters >= PARTED:
        return "parted" if vowels * WINDOW <= VOWELS * letters else None
    return "letters" if min(upper, lower) >= CASES else None


def entropy_spans(word: bytes, window: int = WINDOW, thresholds=THRESHOLDS) -> list[tuple[int, int]]:
    """Stretches of a candidate whose windows are above the threshold of their own class."""
    if len(word) < window:
        return []
    hexes = digits = upper = lower = vowels = 0  # in the window
    plogp = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # one steps in before one steps out
    counts: dict[int, int] = {}
    total = 0.0  # sum of c * log2(c) over the characters in the window
    spans: list[list[int]] = []
    for i, c in enumerate(word):
        n = counts.get(c, 0)
        total += plogp[n + 1] - plogp[n]
        counts[c] = n + 1
        hexes += c in _HEXLIKE
        digits += c in DIGITS
        vowels += c in _VOWELS
        upper += 65 <= c <= 90
        lower += c >= 97
        if i >= window:
            gone = word[i - window]
            n = counts[gone]
            total += plogp[n - 1] - plogp[n]
            counts[gone] = n - 1
            hexes -= gone in _HEXLIKE
            digits -= gone in DIGITS
            vowels -= gone in _VOWELS
            upper -= 65 <= gone <= 90
            lower -= gone >= 97
        if i < window - 1:
            continue
        kind = window_class(window, digits, hexes, upper, lower, vowels)
        if kind and math.log2(window) - total / window >= thresholds[kind] - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [tuple(s) for s in spans]


def scan(data: bytes, window: int = WINDOW, thresholds=THRESHOLDS, allow=ALLOW) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, over many texts joined by a zero byte."""
    found: list[tuple[int, int, int]] = []
    low = data.translate(UPPER_TO_LOWER)
    at = []
    for word in KEYWORDS:
        i = low.find(word)
        while i >= 0:
            at.append(i)
            i = low.find(word, i + 1)
    done = 0
    for i in sorted(at):
        if i >= done and (m := ASSIGN.match(data, i)):
            done = m.end()
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if len(m[0]) >= 20]
    buf = np.frombuffer(data, np.uint8)
    found += [(int(s), 2, int(e)) for s, e in zip(*runs(buf, _HEX, 24))]
    start, end = runs(buf, _KEYLIKE, window)
    if len(start):
        known = re.compile(b"|".join(b"(?:" + a + b")" for a in allow)) if allow else None
        base = sorted((s, e) for s, _, e in found)
        starts = [s for s, _ in base]
        reach = list(np.maximum.accumulate([e for _, e in base])) if base else []
        for s, e in zip(start.tolist(), end.tolist()):
            word = data[s:e]
            if known and known.fullmatch(word) and not (ENDS.fullmatch(word) and entropy_spans(word.rstrip(DIGITS), window, thresholds)):
                continue
            for a, b in entropy_spans(word, window, thresholds):
                before = int(np.searchsorted(starts, s + b))
                if not (before and reach[before - 1] > s + a):
                    found.append((s + a, 3, s + b))
    return sorted(found)


def secrets(docs: DataFrame, window: int = WINDOW, thresholds=THRESHOLDS, allow=ALLOW) -> DataFrame:
    """One row per input row: doc_id, counts by kind and all spans.

    Offsets are code points, ends exclusive. base_sha256 covers the spans of
    the three base kinds, ``spans`` all; an entropy span that overlaps a base
    span is not added. Null and empty texts have no spans. Ids may be null or
    repeated; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch, "text")
            ends = np.cumsum([len(t) + 1 for t in rows]) if rows else np.zeros(0, int)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in rows]
            for i, part in portions(rows):
                base = int(ends[i]) - len(rows[i]) - 1
                for s, kind, e in scan(b"\0".join(part), window, thresholds, allow):
                    doc = int(np.searchsorted(ends, base + s, side="right"))
                    spans[doc].append((base + s, kind, base + e))
            out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "n_entropy": [], "base_sha256": [], "spans": []}
            for i, (t, found) in enumerate(zip(rows, spans)):
                first = int(ends[i]) - len(t) - 1
                if found:
                    lead = np.concatenate(([0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)))
                    found = [(int(lead[s - first]), k, int(lead[e - first])) for s, k, e in found]
                said = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in found]
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(x == k for x, _ in said))
                out["base_sha256"].append(hashlib.sha256(",".join(x for k, x in said if k < 3).encode()).hexdigest())
                out["spans"].append(",".join(x for _, x in said))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], ["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secrets(table(spark, sf_dir, "documents"))
