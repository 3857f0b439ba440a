"""BPE encoding and decoding by a tokenization automaton.

The merges of a public tokenizer are compiled, one merge gadget after another,
into a deterministic automaton over tokens that accepts exactly the sequences
which the merges give. A gadget for (a, b) -> c takes the arc b out of the
state behind a, gives every state that had the arc a the arc c, and makes the
state behind c a copy of the one behind b. States and arcs that behave alike
are then merged, which leaves a small table.

A pre-split word is encoded by walking a byte trie and this table side by
side: exactly one path through the word is accepted, and its arcs are the
tokens. Decoding emits the label of each arc. Scoring is one map over the
texts; words that were met before are looked up, as words are few.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tilework.llm.common import small_batches, table

NAME = "word_bpe_49k.json"
#: Words that a worker keeps; beyond this number it starts anew.
KNOWN_WORDS = 200_000
#: Words longer than this are not kept.
KEPT_LENGTH = 64
#: Marks of a node of the trie: its token inside a word, at the end of one.
WHOLE, LAST = 256, 257
#: Characters of a text that are split into words at a time.
PORTION = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merge_gadgets(n_base: int, pairs: list[tuple[int, int, int]], n: int, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """may[s, t]: whether token t may follow the token of state s, after all merges (a, b, c); and which tokens arise at all.

    ``inner`` numbers the tokens that something can follow; a token that ends
    a word has -1, as no arc leaves its state. Bits are packed over t. Where
    earlier merges leave no path a, b, the merge has no effect and its token
    no arc.
    """
    may = np.zeros((int(inner.max()) + 1, (n + 7) // 8), np.uint8)
    begun = [t for t in range(n) if t < n_base]
    row = np.zeros(n, np.uint8)
    row[begun] = 1
    may[inner[: n_base][inner[: n_base] >= 0]] = np.packbits(row, bitorder="little")
    states = int((inner[:n_base] >= 0).sum())
    arises = np.ones(n, bool)
    for a, b, c in pairs:
        if not (arises[a] and arises[b] and may[inner[a], b >> 3] >> (b & 7) & 1):
            arises[c] = False
            states += int(inner[c] >= 0)
            continue
        if inner[c] >= 0:
            may[inner[c]] = may[inner[b]]  # what may follow b may follow c
            states += 1
        may[inner[a], b >> 3] &= 255 ^ (1 << (b & 7))  # a and b are always merged
        arcs = (may[:states, a >> 3] >> (a & 7)) & 1  # c starts where a does
        may[:states, c >> 3] |= arcs << (c & 7)
    return may, arises


def alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the number of each row's own among them."""
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(r.tobytes(), len(seen)) for r in rows], np.int64)
    return np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), rows.shape[1]), of


@dataclass
class Automaton:
    """Tables that encode words and decode ids; ``specials`` are matched in the raw text."""

    table: bytes  # for each state the bits of the kinds that may follow
    width: int  # bytes of a state
    state: list[int]  # by token; -1: ends a word
    kind: list[int]  # by token
    label: list[str]  # by id
    ids: list[int]  # by token
    spelled: list[bytes | None]  # by token; None: it never arises
    ends: list[bool]
    specials: dict[str, int]
    splitter: str  # the tokenizer's own normaliser and pre-tokenizer, as JSON
    rows: list[bytes] = field(default_factory=list)
    trie: dict = field(default_factory=dict)
    longest: int = 0

    def ready(self) -> Automaton:
        """Lay out the trie of the labels; done once in a worker."""
        if not self.rows:
            self.rows = [self.table[i : i + self.width] for i in range(0, len(self.table), self.width)]
            for t, text in enumerate(self.spelled):
                node = self.trie
                if text is None:
                    continue
                for b in text:
                    node = node.setdefault(b, {})
                node[LAST if self.ends[t] else WHOLE] = t
            self.longest = max((len(t) for t in self.spelled if t), default=0) + 1
        return self

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word: the labels of its only accepted path.

        Arcs are tried longest first. An end that led nowhere is not tried
        again, as at most one path leads from the start to it.
        """
        n, kind, rows, state = len(word), self.kind, self.rows, self.state
        if not n:
            return []
        out: list[int] = []
        open_arcs = [self.arcs(word, 0)]
        closed = bytearray(n + 1)
        while True:
            row = rows[state[out[-1]]] if out else None
            for end, t in open_arcs[-1]:
                if not closed[end] and (row is None or row[kind[t] >> 3] >> (kind[t] & 7) & 1):
                    closed[end] = 1
                    out.append(t)
                    if end == n:
                        return out
                    open_arcs.append(self.arcs(word, end))
                    break
            else:
                open_arcs.pop()
                out.pop()

    def arcs(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of the tokens that begin there, longest first."""
        node, found, end = self.trie, [], at
        for b in word[at : at + self.longest]:
            node = node.get(b)
            if node is None:
                break
            end += 1
            if WHOLE in node:
                found.append((end, node[WHOLE]))
        else:
            if end == len(word):
                found = found[:-1] if WHOLE in node else found
                if LAST in node:
                    found.append((end, node[LAST]))
        found.reverse()
        return found


def compile_automaton(spec: dict) -> Automaton:
    """The automaton of a tokenizer file whose words end in a suffix of their own."""
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    byte_of = {c: b for b, c in byte_letters().items()}
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    results = set(made)
    base = [t for t in vocab if t not in results]
    order = base + made
    if len(set(order)) != len(order) or set(order) != set(vocab):
        raise ValueError("every token must be a base symbol or the result of one merge")
    number = {t: i for i, t in enumerate(order)}
    ends = [t.endswith(suffix) for t in order]
    inner = np.full(len(order), -1, np.int64)
    inner[~np.array(ends)] = np.arange(len(order) - sum(ends))
    may, arises = merge_gadgets(len(base), [(number[a], number[b], number[c]) for (a, b), c in zip(merges, made)], len(order), inner)
    states, state_of = alike(may)
    columns = (np.packbits(np.unpackbits(states[:, i : i + 128], axis=1, bitorder="little"), axis=0).T for i in range(0, states.shape[1], 128))
    kinds, kind_of = alike(np.concatenate(list(columns))[: len(order)])
    arcs = np.concatenate([np.packbits(np.unpackbits(kinds[:, i : i + 128], axis=1)[:, : len(states) - 8 * i], axis=0, bitorder="little").T for i in range(0, kinds.shape[1], 128)])
    label = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for t, i in [*vocab.items(), *special.items()]:
        label[i] = t
    state = np.where(inner >= 0, state_of[np.maximum(inner, 0)], -1)
    return Automaton(
        arcs.tobytes(), arcs.shape[1], state.tolist(), kind_of.tolist(), label, [vocab[t] for t in order],
        [bytes(byte_of[c] for c in (t.removesuffix(suffix) if e else t)) if up else None for t, e, up in zip(order, ends, arises)], ends, special,
        json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}),
    )


@lru_cache(maxsize=4)
def load(path: str) -> Automaton:
    """Read and compile a tokenizer file; once in a driver."""
    with open(path, encoding="utf-8") as f:
        return compile_automaton(json.load(f))


# The words of this vocabulary's pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def portions(text: str, most: int = PORTION) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, cut at spaces; words and accents don't reach over one."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Coder:
    """Encodes texts with the words it has met in mind."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton.ready()
        self.known: dict[str, tuple[int, str, str]] = {}
        self.seen: set[str] = set()  # characters whose properties this Python knows
        self.special = regex.compile("(" + "|".join(map(regex.escape, automaton.specials)) + ")") if automaton.specials else None
        self.other = None

    def words(self, text: str) -> list[str]:
        """The normalised words of a text."""
        if text.isascii():
            return WORDS.findall(text.lower())
        new = set(text) - self.seen
        if any(unicodedata.category(c) == "Cn" for c in new):
            return self._by_library(text)
        self.seen |= new
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        """Splits as the library itself does, where characters are newer than this Python."""
        from tokenizers import Tokenizer

        if self.other is None:
            self.other = Tokenizer.from_str(self.automaton.splitter)
            self.bytes_of = {c: b for b, c in byte_letters().items()}
        pieces = self.other.pre_tokenizer.pre_tokenize_str(self.other.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in p).decode() for p, _ in pieces]

    def look_up(self, words: list[str]) -> list[tuple[int, str, str]]:
        """For each word the number of its ids, the ids and their labels, joined by spaces."""
        a, known = self.automaton, self.known
        new = set(words).difference(known)
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = set(words)
        for word in new:
            ids = [a.ids[t] for t in a.encode_word(word.encode())]
            known[word] = len(ids), " ".join(map(str, ids)), self.decode(ids)
        found = [known[w] for w in words]
        for word in new:
            if len(word) > KEPT_LENGTH:
                del known[word]
        return found

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by spaces, as this tokenizer has no decoder of its own."""
        return " ".join([self.automaton.label[i] for i in ids])

    def runs(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """What look_up() says of the words of a text, portion by portion."""
        for i, piece in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield [(1, str(self.automaton.specials[piece]), piece)]
            else:
                yield from (self.look_up(self.words(part)) for part in portions(piece))

    def encode(self, text: str) -> list[int]:
        return [int(i) for run in self.runs(text) for _, ids, _ in run for i in ids.split(" ")]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text; never all of them at once."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for run in self.runs(text):
            if run:
                gap = " " if n else ""
                n += sum([r[0] for r in run])
                of_ids.update((gap + " ".join([r[1] for r in run])).encode())
                of_text.update((gap + " ".join([r[2] for r in run])).encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


_CODERS: dict[int, Coder] = {}


def _coder(sent) -> Coder:
    """This worker's coder of a broadcast automaton."""
    key = sent._jbroadcast_id if hasattr(sent, "_jbroadcast_id") else id(sent)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(sent.value)
    return _CODERS[key]


def _mapped(docs: DataFrame, path: str, fields: str, make) -> DataFrame:
    """doc_id and what ``make(coder, texts)`` gives as columns, in one map over the rows."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(load(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for batch in batches:
            columns = make(coder, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text; null counts as empty and has no ids.

    One row for each row, in any order, repeated rows and ids included; other
    columns are not read; an empty table gives no rows. Strings of special
    tokens in a text become these tokens.
    """
    return _mapped(docs, path, "ids array<int>", lambda coder, rows: {"ids": pa.array([coder.encode(t) for t in rows], pa.list_(pa.int32()))})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of each row's ids; null counts as no ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(load(path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for batch in batches:
            told = [coder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text.

    As encode() followed by decode(), but ids and decoded texts are hashed as
    they come, so a text of any length takes little memory.
    """

    def make(coder: Coder, rows: list[str]):
        told = [coder.digest(t) for t in rows]
        return {
            "n_tokens": pa.array([t[0] for t in told], pa.int64()),
            "ids_sha256": pa.array([t[1] for t in told], pa.string()),
            "decoded_sha256": pa.array([t[2] for t in told], pa.string()),
        }

    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of what they decode to.

    Nulls count as empty; every row has a result, also repeated ones.
    """
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(NAME))
