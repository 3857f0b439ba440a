"""Language-model scores by online logistic context mixing.

The model predicts a text bit by bit. For each of ORDERS context lengths it is
known what followed: a probability (kept as a logit) and how often the context
was seen. A gate (how many letters of the word are written, and the longest
context that is known) picks the weights that mix the logits, a weight for
each order and each degree of confidence in it; the mixed logit is refined by
an adaptive table over (bits of this byte so far, logit), and the
log-probabilities of all bits add up to the text's.

All that the model says of a byte depends on the byte and the six before it,
so one score for each distinct gram of seven bytes serves the whole corpus:

1. One scan counts words and grams, apart for the texts that give the counts
   (seven eighths of the training texts, by a hash of the id), those that the
   weights are learned on (the last eighth) and the others. Counts are exact
   and grow with the corpus.
2. What followed one and two bytes is a table whose size the alphabet sets; it
   is broadcast. Longer contexts are dealt by their last three bytes, so that
   each task has all counts of its contexts. Where much of the text follows the
   same three bytes, they are dealt by four, and so on up to six; what followed the
   shorter ends (a bounded number) is broadcast with the tables.
3. Weights are learned online, minibatch by minibatch, in streams of about
   STREAM grams that a hash deals; their number depends on the corpus alone.
   The streams' weights are averaged by the text they saw. Sums are whole
   numbers, so weights, refinement and scores do not depend on the
   partitioning.
4. With the counts of all training texts every distinct gram gets its score.
   A second scan adds them up text by text: the most frequent grams (GRAMS at
   most) are broadcast, rarer ones meet their scores in a join.

A word unigram score with add-one smoothing comes along as a base line; its
words meet their counts in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import UPPER_TO_LOWER, crc_mod, discard, portions, scramble, settle, table, texts, word_bounds, word_hashes

ORDERS = (1, 2, 3, 4, 5, 6)
SHORT, LONG = ORDERS[:2], ORDERS[2:]
BUCKET = 4 << 20  # bytes of text for each bucket of counts
WIDE, SHARE = 1 << 20, 1 << 14  # an end of contexts is wide if it has so many bytes of text, and this part of all
SLOTS = 18  # bits of the places in which the text of ends is added up
PIECE = 1 << 17  # grams of a bucket that are worked on at once
COUNTS_A_FILE = 2  # rows of counts in a file; a row is a bucket
STREAM = 1 << 17  # grams that one online learner sees
WORDS, GRAMS = 1 << 20, 1 << 21  # broadcast at most
TUNE_ONE_IN = 8
PORTION = 1 << 19
STEP = 1 << 14  # grams scored at once, so that what a step makes stays in the cache
HELD = 1_000_000  # keys that a counting task gathers before it hands them on
CURVE = 33  # points of a refinement curve
UNIT = float(1 << 20)  # scores are summed in whole units of log10
END = b"\xff"  # never part of UTF-8
_LONGEST = ORDERS[-1]
_DEGREE = np.array([0] + [1] * 2 + [2] * 5 + [3] * 24 + [4] * 224, np.uint8)  # confidence by times seen
DEGREES = 5
GATES = (_LONGEST + 1) * (len(ORDERS) + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True


class Index:
    """Places of values among distinct sorted keys, by one probe for most."""

    def __init__(self, keys: np.ndarray, bits: int = 0):
        self.keys = keys
        self.bits = bits or max(12, int(len(keys)).bit_length() + 2)
        self.table = np.zeros(1 << self.bits, np.int32)
        for a in range(0, len(keys), STEP):
            self.table[self._slot(keys[a : a + STEP])] = np.arange(a, min(a + STEP, len(keys)), dtype=np.int32)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each value (undefined where missing), and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(k), np.int32), np.zeros(len(k), bool)
        at = self.table[self._slot(k)]
        good = self.keys[at] == k
        rest = np.flatnonzero(~good)
        if len(rest):
            other = np.minimum(np.searchsorted(self.keys, k[rest]), len(self.keys) - 1)
            at[rest] = other
            good[rest] = self.keys[other] == k[rest]
        return at, good


def merged(parts: list[tuple[np.ndarray, np.ndarray]], kind: type | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts (a number or a row of them for each key), as ``kind``."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")  # quick on runs that are sorted already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first, dtype=kind or counts.dtype) if len(first) else counts.astype(kind or counts.dtype)


def byte_grams(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of context and byte for every byte and the end of each lower-case text; where each text begins."""
    pad = b"\0" * _LONGEST
    buf = np.frombuffer(b"".join(pad + t + END for t in part).translate(UPPER_TO_LOWER), np.uint8)
    size = np.array([len(t) + 1 for t in part])
    key = np.zeros(max(len(buf) - _LONGEST, 0), np.uint64)
    for j in range(_LONGEST + 1):
        key <<= np.uint64(8)
        key |= buf[j : len(buf) - _LONGEST + j]
    real = np.ones(len(key), bool)
    begin = np.cumsum(size + _LONGEST)[:-1]
    for j in range(_LONGEST):
        real[begin - _LONGEST + j] = False
    return key[real], np.concatenate(([0], np.cumsum(size)[:-1]))


def words_of(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of texts, and where each text's begin."""
    buf = np.frombuffer(b"\n".join(part).translate(UPPER_TO_LOWER), np.uint8)
    start, end = word_bounds(buf)
    return word_hashes(buf, start, end, 91), np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in part]))


def _planes(v: np.ndarray) -> bytes:
    """An array's first bytes, then its second ones, and so on: sorted keys and small counts are packed well so."""
    return v.view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes()


def _of_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _slots(context: np.ndarray, order: int) -> np.ndarray:
    """Places of the last ``order`` bytes of contexts."""
    return (((context << np.uint64(64 - 8 * order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).view(np.int64)


@dataclass
class Ends:
    """The wide ends of contexts, and what followed them in all buckets."""

    wide: np.ndarray | None = None  # (end of three bytes or more, slot); None: no end is wide
    followed: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by order: sorted keys and counts

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many of the last bytes of its context each gram is dealt by: the fewest that are no wide end."""
        out = np.full(len(keys), LONG[0])
        if self.wide is not None:
            rest = np.arange(len(keys))
            for wide, order in zip(self.wide, LONG[:-1]):
                rest = rest[wide[_slots(keys[rest] >> np.uint64(8), order)]]
                out[rest] = order + 1
        return out

    def dealt(self, keys: np.ndarray) -> np.ndarray:
        """A hash of the bytes that each gram is dealt by."""
        level = self.levels(keys).astype(np.uint64)
        context = (keys >> np.uint64(8)) & ((np.uint64(1) << (np.uint64(8) * level)) - np.uint64(1))
        return scramble(context | ((level - np.uint64(LONG[0])) << np.uint64(56)), 19)

    def after(self, order: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of what followed the wide ends among the asked contexts."""
        keys, n = self.followed.get(order, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        some = np.isin(keys >> np.uint64(8), asked >> np.uint64(8))
        return keys[some], n[some]


def wide_ends(rows: DataFrame, size: int) -> Ends:
    """The ends of three bytes and more that are followed by WIDE bytes of the text, and by 1 / SHARE of it.

    A task names the slots with half that share of its own text, so half the
    text of a wide end is named at least. At most 2 * SHARE slots of an order are wide.
    """
    least = max(WIDE, size // SHARE)
    if size < least:
        return Ends()
    ends = LONG[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ends), 1 << SLOTS), np.int64)
        for batch in batches:
            for _, part in portions(texts(batch, "text"), PORTION):
                buf = np.frombuffer(b"".join(b"\0" * ends[-1] + t for t in part).translate(UPPER_TO_LOWER), np.uint8)
                context = np.zeros(len(buf) - ends[-1] + 1, np.uint64)
                for j in range(ends[-1]):
                    context <<= np.uint64(8)
                    context |= buf[j : j + len(context)]
                for i, order in enumerate(ends):
                    total[i] += np.bincount(_slots(context, order), minlength=1 << SLOTS)
        i, slot = np.nonzero(total > total[0].sum() // (2 * SHARE))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(slot), pa.array(total[i, slot])], ["i", "slot", "n"])

    named = rows.select("text").mapInArrow(run, "i long, slot long, n long").groupBy("i", "slot").agg(F.sum("n").alias("n"))
    out = np.zeros((len(ends), 1 << SLOTS), bool)
    for r in named.filter(F.col("n") >= least // 2).collect():  # 2 * SHARE rows of an order at most
        out[r["i"], r["slot"]] = True
    return Ends(out if out.any() else None)


def _packed(kind: bool, keys: np.ndarray, n: np.ndarray, buckets: int, ends: Ends) -> Iterator[pa.RecordBatch]:
    """Keys and counts by bucket, a row for each: grams are dealt by the last bytes of their contexts, words by their hash."""
    of = (ends.dealt(keys) if kind else scramble(keys, 19)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    names, first = np.unique(of[order], return_index=True)
    ends = np.append(first[1:], len(order))
    for i in range(0, len(names), 16):  # a few at once: each batch is held several times over
        cut = [order[a:b] for a, b in zip(first[i : i + 16], ends[i : i + 16])]
        columns = [pa.array([_planes(v[c].ravel()) for c in cut], pa.binary()) for v in (keys, n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), kind)), pa.array(names[i : i + 16].astype(np.int32)), *columns], ["gram", "bucket", "keys", "counts"])


def _unpacked(keys: list[bytes], counts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts, of four bytes each where the largest allows that."""
    return [(_of_planes(k, np.uint64), _of_planes(c, np.uint32 if len(c) * 2 == len(k) * 3 else np.int64).reshape(-1, 3)) for k, c in zip(keys, counts)]


def corpus_counts(rows: DataFrame, buckets: int, ends: Ends) -> DataFrame:
    """One row per bucket: gram, bucket, tuned, keys, counts (n1, n2, n3 of each key).

    rows: (text, part). Grams of parts 1 to 3, and words (gram false) of parts
    1 and 2; tuned is the number of keys that occur in part 2. Keys and counts
    are packed arrays, and equal keys of all tasks meet in one bucket.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ends)

    def counted(keys: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        keys, times = np.unique(keys, return_counts=True)
        n = np.zeros((len(keys), 3), np.uint32)  # no task reads 2**32 bytes of text
        n[:, part - 1] = times
        return keys, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for i, some in portions(texts(batch, "text"), PORTION):
                for p in (1, 2, 3):
                    mine = [t for t, q in zip(some, parts[i : i + len(some)]) if q == p]
                    if mine:
                        held[True].append(counted(byte_grams(mine)[0], p))
                    if mine and p < 3:
                        held[False].append(counted(words_of(mine)[0], p))
                for gram, have in held.items():
                    if sum(len(k) for k, _ in have) > HELD:
                        have[:] = [merged(have)]
                        if len(have[0][0]) > HELD * 3 // 4:
                            yield from _packed(gram, *have.pop(), buckets, shared.value)
        for gram, have in held.items():
            if have:
                yield from _packed(gram, *merged(have), buckets, shared.value)

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        keys, n = merged(_unpacked(group["keys"].to_pylist(), group["counts"].to_pylist()), np.int64)
        least = n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n
        return pa.table({"gram": [key[0].as_py()], "bucket": pa.array([key[1].as_py()], pa.int32()), "tuned": [int((n[:, 1] > 0).sum())], "keys": pa.array([_planes(keys)], pa.binary()), "counts": pa.array([_planes(least.ravel())], pa.binary())})

    found = rows.select("text", "part").mapInArrow(run, "gram boolean, bucket int, keys binary, counts binary")
    return found.groupBy("gram", "bucket").applyInArrow(meet, "gram boolean, bucket int, tuned long, keys binary, counts binary")


def word_counts(counts: DataFrame) -> DataFrame:
    """(key, n) of the words of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in _unpacked(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.sum(1, dtype=np.int64))], ["key", "n"])

    return counts.filter("not gram").select("keys", "counts").mapInArrow(run, "key long, n long")


def _bits(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bit of bytes, the highest first: (bits before it with a leading one, the bit)."""
    byte = byte.astype(np.int64)
    for j in range(7, -1, -1):
        yield (256 | byte) >> (j + 1), (byte >> j) & 1


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _logit_bytes(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.clip(np.round((stretch((one + 0.05) / (zero + one + 0.1)) + 8) * 16), 0, 255).astype(np.uint8)


def _degrees(total: np.ndarray) -> np.ndarray:
    return _DEGREE[np.minimum(total, 255).astype(np.int64)]


class ShortTable:
    """Logit and confidence of what followed the contexts of one or two bytes that were seen."""

    def __init__(self, order: int, key: np.ndarray, n: np.ndarray):
        key, n = merged([(key & np.uint64((1 << (8 * order + 8)) - 1), n)])
        self.order = order
        context = (key >> np.uint64(8)).astype(np.int64)
        used, row = np.unique(context, return_inverse=True)
        self.place = np.full(1 << (8 * order), len(used), np.int32)  # the last row: never seen
        self.place[used] = np.arange(len(used))
        zero, one = np.zeros((len(used) + 1) * 256), np.zeros((len(used) + 1) * 256)
        for node, bit in _bits(key & np.uint64(255)):
            zero += np.bincount(row * 256 + node, n * (1 - bit), len(zero))
            one += np.bincount(row * 256 + node, n * bit, len(one))
        self.logit, self.degree = _logit_bytes(zero, one), _degrees(zero + one)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where the row of each gram's context begins."""
        context = (keys >> np.uint64(8)) & np.uint64((1 << (8 * self.order)) - 1)
        return self.place[context.astype(np.int64)].astype(np.int64) * 256


def long_states(key: np.ndarray, n: np.ndarray, asked: np.ndarray, ends: Ends | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logit and confidence bytes (asked gram, order, bit) of what followed the LONG contexts.

    key and n have all grams of the contexts that are asked for, but of wide
    ends; ends has those.
    """
    logit, degree = (np.zeros((len(asked), len(LONG), 8), np.uint8) for _ in range(2))
    ends = ends or Ends()
    level = ends.levels(key)
    for i, order in enumerate(LONG):
        mask = np.uint64((1 << (8 * order + 8)) - 1)
        want, place = np.unique(asked & mask, return_inverse=True)
        mine = level <= order
        have, count = merged([(key[mine] & mask, n[mine]), ends.after(order, want)])
        below = np.concatenate(([0], np.cumsum(count)))
        low = want & ~np.uint64(255)
        at, end = below[np.searchsorted(have, low)], below[np.searchsorted(have, low + np.uint64(256))]
        for j, (_, bit) in enumerate(_bits(want & np.uint64(255))):
            half = np.uint64(1 << (7 - j))
            middle = below[np.searchsorted(have, low + half)]
            zero, one = middle - at, end - middle
            logit[:, i, j] = _logit_bytes(zero, one)[place]
            degree[:, i, j] = _degrees(zero + one)[place]
            low = np.where(bit == 1, low + half, low)
            at, end = np.where(bit == 1, middle, at), np.where(bit == 1, end, middle)
    return logit, degree


def by_bucket(grams: DataFrame, ends: Ends, use: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``use(key, n1, n2, n3)`` for pieces of buckets; a piece has all grams of its contexts (but wide ends).

    A bucket is cut by another hash of what its grams are dealt by.
    """
    wide = grams.sparkSession.sparkContext.broadcast(Ends(ends.wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (keys, n), = _unpacked([batch.column("keys")[i].as_py()], [batch.column("counts")[i].as_py()])
                pieces = -(-len(keys) // PIECE)
                of = scramble(wide.value.dealt(keys), 23) % np.uint64(max(pieces, 1))
                for piece in range(pieces):
                    mine = of == piece
                    if mine.any():
                        yield from use(keys[mine], *n[mine].T.astype(np.int64))

    return grams.select("keys", "counts").mapInArrow(run, schema)


def tune_states(grams: DataFrame, streams: int, ends: Ends) -> DataFrame:
    """(stream, keys, n, logit, degree), packed: the distinct grams that weights and refinement are learned on, under the counts of part 1."""
    shared = grams.sparkSession.sparkContext.broadcast(ends)

    def use(key: np.ndarray, n1: np.ndarray, n2: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        mine, known = n2 > 0, n1 > 0
        if not mine.any():
            return
        key, n, known_key = key[mine], n2[mine], key[known]
        logit, degree = long_states(known_key, n1[known], key, shared.value)
        of = (scramble(key, 13) % np.uint64(streams)).astype(np.int64)
        for stream in np.unique(of):
            some = of == stream
            yield pa.RecordBatch.from_arrays([pa.array([stream]), *[pa.array([v[some].tobytes()], pa.binary()) for v in (key, n, logit, degree)]], ["stream", "keys", "n", "logit", "degree"])

    return by_bucket(grams, ends, use, "stream long, keys binary, n binary, logit binary, degree binary")


def _states(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Keys, counts and long states, in an order that a hash of the key sets."""
    keys, n, logit, degree = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("n", np.int64), ("logit", np.uint8), ("degree", np.uint8)))
    order = np.argsort(scramble(keys, 17))
    return keys[order], n[order].astype(float), tuple(s.reshape(-1, len(LONG), 8)[order] for s in (logit, degree))


def _start() -> np.ndarray:
    """Weights (gate, order and a constant, confidence) before learning."""
    out = np.zeros((GATES, len(ORDERS) + 1, DEGREES))
    out[:, :-1, 1:] = 0.15 + 0.05 * np.arange(DEGREES - 1)
    return out


@dataclass
class Model:
    """Tables of the short contexts, mixing weights, refinement, and the wide ends."""

    short: list[ShortTable]
    weights: np.ndarray = field(default_factory=_start)
    refined: np.ndarray | None = None  # (256, CURVE) probabilities
    ends: Ends | None = None

    def gate(self, keys: np.ndarray) -> np.ndarray:
        """Letters since the last space among the bytes of the context."""
        letters, inside = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        for back in range(1, _LONGEST + 1):
            inside &= ~_SPACE[((keys >> np.uint64(8 * back)) & np.uint64(255)).astype(np.int64)]
            letters += inside
        return letters * (len(ORDERS) + 1)

    def inputs(self, begins: list[np.ndarray], gate: np.ndarray, bit: int, node: np.ndarray, longer: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all orders and a constant, and the place of each one's weight."""
        x = np.empty((len(node), len(ORDERS) + 1), np.float32)
        degree = np.zeros((len(node), len(ORDERS) + 1), np.int64)
        for i, (t, begin) in enumerate(zip(self.short, begins)):
            x[:, i], degree[:, i] = t.logit[begin + node], t.degree[begin + node]
        x[:, len(SHORT) : -1], degree[:, len(SHORT) : -1] = longer[0][:, :, bit], longer[1][:, :, bit]
        x[:, :-1] = x[:, :-1] / np.float32(16) - np.float32(8)
        known = degree[:, :-1] > 0
        x[:, :-1] *= known
        x[:, -1] = 0.3
        longest = np.where(known.any(1), len(ORDERS) - known[:, ::-1].argmax(1), 0)
        place = ((gate + longest)[:, None] * (len(ORDERS) + 1) + np.arange(len(ORDERS) + 1)) * DEGREES + degree
        return x, place

    def steps(self, keys: np.ndarray, longer: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit of the grams' last bytes: (bits before, the bit, inputs, places of weights)."""
        begins, gate = [t.find(keys) for t in self.short], self.gate(keys)
        for j, (node, bit) in enumerate(_bits(keys & np.uint64(255))):
            yield node, bit, *self.inputs(begins, gate, j, node, longer)

    def mixed(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights.ravel()[place]).sum(1), -12, 12)

    def refine(self, node: np.ndarray, z: np.ndarray) -> np.ndarray:
        p = squash(z)
        if self.refined is not None:
            low, part = _points(z)
            p = (p + self.refined[node, low] * (1 - part) + self.refined[node, low + 1] * part) / 2
        return np.clip(p, 1e-6, 1 - 1e-6)

    def score(self, keys: np.ndarray, longer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of the byte of each key after its context."""
        out = np.zeros(len(keys))
        for a in range(0, len(keys), STEP):
            sums = out[a : a + STEP]
            for node, bit, x, place in self.steps(keys[a : a + STEP], tuple(s[a : a + STEP] for s in longer)):
                p = self.refine(node, self.mixed(x, place))
                sums += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def learn(self, keys: np.ndarray, n: np.ndarray, longer: tuple[np.ndarray, np.ndarray], batch: int = 1024, passes: int = 2, rate: float = 0.05) -> np.ndarray:
        """Move the weights online, minibatch by minibatch; the text seen under each weight."""
        w, square, seen = self.weights.ravel(), np.full(self.weights.size, 1e-4), np.zeros(self.weights.size)
        for turn in range(passes):
            for i in range(0, len(keys), batch):
                c = n[i : i + batch]
                for _, bit, x, place in self.steps(keys[i : i + batch], tuple(s[i : i + batch] for s in longer)):
                    error = (bit - squash(self.mixed(x, place))) * c
                    total = np.bincount(place.ravel(), np.repeat(c, place.shape[1]), w.size)
                    step = np.bincount(place.ravel(), (error[:, None] * x).ravel(), w.size) / np.maximum(total, 1)
                    square += step * step
                    w += rate * step / np.sqrt(square)
                    if not turn:
                        seen += total
        self.weights = w.reshape(self.weights.shape)
        return seen


def _points(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (np.clip(z, -7.999, 7.999) + 8) * ((CURVE - 1) / 16)
    low = place.astype(np.int64)
    return low, place - low


def learn_weights(tune: DataFrame, model: Model) -> np.ndarray:
    """Weights learned online in streams that a hash deals, averaged by the text seen under each."""
    shared = tune.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.Table) -> pa.Table:
        m = Model(shared.value.short)
        seen = m.learn(*_states(rows))
        at = np.flatnonzero(seen)
        whole = np.round(m.weights.ravel()[at] * UNIT).astype(np.int64)
        return pa.table({"i": at, "w": whole, "n": seen[at].astype(np.int64)})

    each = tune.groupBy("stream").applyInArrow(run, "i long, w long, n long")
    # Whole numbers of any size add up alike in any order.
    sums = each.groupBy("i").agg(F.sum(F.col("w").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).alias("wn"), F.sum("n").alias("n"))
    out = model.weights.copy().ravel()
    for r in sums.collect():  # one row for each weight
        out[r["i"]] = float(r["wn"]) / r["n"] / UNIT
    return out.reshape(model.weights.shape)


def learn_refinement(tune: DataFrame, model: Model) -> np.ndarray:
    """Share of ones by (bits before, point of the mixed logit), drawn to the point's own where few were seen."""
    shared = tune.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ones, total = np.zeros(256 * CURVE), np.zeros(256 * CURVE)
        for batch in batches:
            keys, n, longer = _states(pa.Table.from_batches([batch]))
            for node, bit, x, place in m.steps(keys, longer):
                low, rest = _points(m.mixed(x, place))
                part = np.floor(rest * 1024)  # whole shares: sums do not depend on their order
                for at, share in ((low, 1024 - part), (low + 1, part)):
                    cell = node * CURVE + at
                    ones += np.bincount(cell, n * share * bit, len(ones))
                    total += np.bincount(cell, n * share, len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ones[at].astype(np.int64)), pa.array(total[at].astype(np.int64))], ["cell", "ones", "total"])

    sums = tune.mapInArrow(run, "cell long, ones long, total long").groupBy("cell").agg(F.sum("ones").alias("ones"), F.sum("total").alias("total"))
    prior = np.tile(squash((np.arange(CURVE) * 16 / (CURVE - 1)) - 8), 256)
    ones, total = prior * 20, np.full(256 * CURVE, 20.0)
    for r in sums.collect():  # 256 * CURVE rows at most
        ones[r["cell"]] += r["ones"] / 1024
        total[r["cell"]] += r["total"] / 1024
    return (ones / total).reshape(256, CURVE)


def context_tables(grams: DataFrame, ends: Ends) -> list[tuple[list[ShortTable], Ends]]:
    """The tables of one and two bytes and what followed the wide ends, under the counts of part 1, and under those of parts 1 and 2."""
    shared = grams.sparkSession.sparkContext.broadcast(ends)

    def use(key: np.ndarray, n1: np.ndarray, n2: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, level = np.stack([n1, n2], 1), shared.value.levels(key)
        for order in (SHORT[-1], *LONG[:-1]):
            some = level > order
            if some.any():
                keys, sums = merged([(key[some] & np.uint64((1 << (8 * order + 8)) - 1), n[some])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), order)), pa.array(keys.view(np.int64)), *[pa.array(sums[:, p]) for p in (0, 1)]], ["order", "key", "n1", "n2"])

    sums = by_bucket(grams, ends, use, "order long, key long, n1 long, n2 long").groupBy("order", "key").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).filter("n1 + n2 > 0")
    rows = sums.toArrow()  # trigrams of bytes, and what follows SHARE ends: the alphabet bounds them, not the corpus
    orders, keys, n1, n2 = rows["order"].to_numpy(), rows["key"].to_numpy().view(np.uint64), rows["n1"].to_numpy(), rows["n2"].to_numpy()
    out = []
    for n in (n1, n1 + n2):
        some = (orders == SHORT[-1]) & (n > 0)
        followed = {o: merged([(keys[orders == o], n[orders == o])]) for o in LONG[:-1]}
        out.append(([ShortTable(o, keys[some], n[some]) for o in SHORT], Ends(ends.wide, followed)))
    return out


def gram_scores(grams: DataFrame, model: Model) -> DataFrame:
    """(key, n, units) of every distinct gram, under the counts of all training texts."""
    shared = grams.sparkSession.sparkContext.broadcast(model)

    def use(key: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = n1 + n2 > 0
        logs = shared.value.score(key, long_states(key[known], (n1 + n2)[known], key, shared.value.ends))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n1 + n2 + n3), pa.array(np.round(logs * UNIT).astype(np.int32))], ["key", "n", "units"])

    return by_bucket(grams, model.ends or Ends(), use, "key long, n long, units int")


def most_common(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose n is so high that there are at most ``most`` of them, and the others."""
    bins = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()  # 16 for each doubling
    room, limit = most, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        room -= r["rows"]
        if room < 0:
            break
        limit = r["least"]
    if limit is None:
        return counts.filter(F.lit(False)), counts
    return counts.filter(F.col("n") >= limit), counts.filter(F.col("n") < limit)


def _fetched(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values; for tables of a bounded number of rows."""
    got = rows.select("key", value).toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got[value].to_numpy()[order]


def _scores(rows: DataFrame) -> DataFrame:
    """See lm_scores(); rows has doc_id, text, learn and ask."""
    tuned = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(TUNE_ONE_IN)) == 0
    rows = rows.withColumn("part", F.when(~F.col("learn"), 3).when(tuned, 2).otherwise(1))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = wide_ends(rows, int(size))
    counts = settle(corpus_counts(rows, max(64, int(size) // BUCKET), wide), "counts", COUNTS_A_FILE)
    words = settle(word_counts(counts), "words")
    grams = counts.filter("gram")
    tuned = grams.agg(F.sum("tuned")).first()[0] or 0
    ends = rows.filter("learn").count()
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, types = total + ends, types + (ends > 0)
    (first, first_ends), (whole, whole_ends) = context_tables(grams, wide)
    model = Model(first)
    tune = settle(tune_states(grams, max(1, -(-int(tuned) // STREAM)), first_ends), "tune")
    model.weights = learn_weights(tune, model)
    model.refined = learn_refinement(tune, model)
    model.short, model.ends = whole, whole_ends
    scores = settle(gram_scores(grams, model), "scores")
    discard(tune, counts)
    common_words, rare_words = most_common(words, WORDS)
    common_grams, rare_grams = most_common(scores, GRAMS)
    values = common_words.select("key", F.log10(F.col("n") + 1.0).alias("value"))
    shared = rows.sparkSession.sparkContext.broadcast((*_fetched(values, "value"), *_fetched(common_grams, "units")))
    end_value = float(np.log10(ends + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_keys, values, gram_keys, units = shared.value
        word_index, gram_index = Index(word_keys), Index(gram_keys)

        def split(missing: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
            left = np.cumsum(np.concatenate(([0], missing)))[bounds]
            rest = keys[missing].view(np.int64)
            return [rest[a:b] for a, b in zip(left[:-1], left[1:])]

        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_tokens", "known", "base", "rare_words", "units", "rare_grams", "size")}
            for _, part in portions(texts(batch, "text"), PORTION // 4):
                h, bounds = words_of(part)
                at, good = word_index.find(h)
                sums = np.concatenate(([0.0], np.cumsum(np.where(good, values[at] if len(values) else 0.0, 0.0))))[bounds]
                out["n_tokens"].append(np.diff(bounds) + 1)
                out["known"].append(np.diff(np.concatenate(([0], np.cumsum(good)))[bounds]) + (ends > 0))
                out["base"].append(np.diff(sums) + end_value)
                out["rare_words"] += split(~good, h, bounds)
                keys, begin = byte_grams(part)
                at, good = gram_index.find(keys)
                bounds = np.append(begin, len(keys))
                out["units"].append(np.add.reduceat(np.where(good, units[at] if len(units) else 0, 0).astype(np.int64), begin))
                out["rare_grams"] += split(~good, keys, bounds)
                out["size"].append(np.diff(bounds))
            longs = pa.list_(pa.int64())
            arrays = [pa.array(v, longs) if c.startswith("rare") else pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if c == "base" else pa.int64()) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *out])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.filter("ask").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, known long, base double, rare_words array<long>, units long, rare_grams array<long>, size long")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    met_words = scored.select("row", F.explode("rare_words").alias("key")).join(rare_words, "key")
    met_words = met_words.groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_base"))
    met_grams = scored.select("row", F.explode("rare_grams").alias("key")).join(rare_grams.select("key", "units"), "key")
    met_grams = met_grams.groupBy("row").agg(F.sum(F.col("units").cast("long")).alias("more_units"))
    out = scored.drop("rare_words", "rare_grams").join(met_words, "row", "left").join(met_grams, "row", "left")
    norm = float(np.log10(total + types + 1.0))
    score = (F.col("units") + F.coalesce("more_units", F.lit(0))) / F.lit(UNIT)
    return out.select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        score.alias("score"),
        (-score / (F.log10(F.lit(2.0)) * F.col("size"))).alias("bits_per_byte"),
    )


def lm_scores(docs: DataFrame, train: DataFrame | Column) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    train: a table of doc_id and text, or a condition on docs (then docs are
    scanned once for both). Null and empty texts are an end and nothing else.
    bits_per_byte divides by the bytes and the end. Without training rows
    every bit is even and base_score is 0. Words are told apart by 64-bit
    hashes. Ids may be null or repeated; an empty table gives no rows; extra
    columns are not read.
    """
    if isinstance(train, Column):
        rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("learn"), F.lit(True).alias("ask"))
    else:
        rows = docs.select("doc_id", "text", F.lit(False).alias("learn"), F.lit(True).alias("ask"))
        rows = rows.union(train.select("doc_id", "text", F.lit(True), F.lit(False)))
    return _scores(rows)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learned from the documents outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 7) == 2
    out = lm_scores(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), *[c for c in out.columns if c != "doc_id"])
