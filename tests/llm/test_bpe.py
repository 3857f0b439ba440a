"""BPE by the automaton against the tokenizers library and against plain merging."""

import hashlib
import random

import pytest

from tilework.llm import bpe


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path(bpe.NAME)


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def coder(path):
    return bpe.Coder(bpe.load(path))


def spec(merges, letters="ab"):
    base = [*letters, *[c + "</w>" for c in letters]]
    vocab = {t: i for i, t in enumerate(base + [a + b for a, b in merges])}
    return {"model": {"type": "BPE", "vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}, "added_tokens": []}


def merged(word, merges):
    """Plain BPE: the first merge of the list that fits somewhere, at its leftmost places, again and again."""
    parts = [*word[:-1], word[-1] + "</w>"]
    while True:
        best = next((m for m in merges if any((a, b) == tuple(m) for a, b in zip(parts, parts[1:]))), None)
        if best is None:
            return parts
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == list(best):
                out.append("".join(best))
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_random_merges_as_plain():
    r = random.Random(4)
    for _ in range(30):
        tokens, merges = ["a", "b", "a</w>", "b</w>"], []
        while len(merges) < 12:
            a, b = r.choice([t for t in tokens if not t.endswith("</w>")]), r.choice(tokens)
            if a + b not in tokens:
                merges.append([a, b])
                tokens.append(a + b)
        coder = bpe.Coder(bpe.compile_automaton(spec(merges)))
        for n in range(1, 9):
            for code in range(2**n):
                word = "".join("ab"[code >> i & 1] for i in range(n))
                ids = [coder.automaton.ids[t] for t in coder.automaton.encode_word(word.encode())]
                assert [coder.automaton.label[i] for i in ids] == merged(word, merges), (merges, word)


def test_gadget_of_a_pair_of_equals():
    """a a a is aa a: a may not stand before aa, but aa before a, and before aa."""
    coder = bpe.Coder(bpe.compile_automaton(spec([["a", "a"]])))
    told = lambda w: [coder.automaton.label[coder.automaton.ids[t]] for t in coder.automaton.encode_word(w.encode())]
    assert told("aaaaaa") == ["aa", "aa", "a", "a</w>"] and told("aaaa") == ["aa", "a", "a</w>"] and told("aa") == ["a", "a</w>"]


def test_one_accepted_path(coder):
    """Every beginning of a word has exactly one accepted sequence of tokens."""
    a, r = coder.automaton, random.Random(8)
    for _ in range(300):
        word = "".join(r.choice("aeinothsrl") for _ in range(r.randint(1, 10))).encode()
        ways = [[None]] + [[] for _ in word]
        for k in range(len(word)):
            for end, t in a.arcs(word, k):
                for before in ways[k]:
                    if before is None or a.rows[a.state[before]][a.kind[t] >> 3] >> (a.kind[t] & 7) & 1:
                        ways[end].append(t)
        assert all(len(w) == 1 for w in ways[1:])


TEXTS = [
    "", " \t\n", "Hello World's they'll I'm 12345 !!", "a <|startoftext|> b<|endoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ ΟΔΟΣ σς", "İstanbul ŞIŞLI", "é ́x Å", "日本語のテキスト 12", "🙂👩‍👩‍👧 ok", "a\0b\x01c", "﻿x y z",
    "a" * 3000, "ab" * 2000 + " c", "x" * 70 + " " + "don't can't 'S 'T 'RE", "͸͹ new Ɤ \U0001df25 letters", "ﬁ ½ ² ⅷ ٣ ४", "_under_score__ a_b", "''' 's's 'll've", "हिन्दी ไทย עברית العربية",
]


def test_texts_as_library(coder, library):
    for text in TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, text
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def test_characters_as_library(coder, library):
    """Every eleventh code point, in and outside a word."""
    rows = [f"a{chr(c)}b {chr(c)}" for c in range(0, 0x30000, 11) if not 0xD800 <= c < 0xE000]
    for text, told in zip(rows, library.encode_batch(rows, add_special_tokens=False)):
        assert coder.encode(text) == told.ids, ascii(text)


def test_given_documents_as_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = bpe.op13_bpe(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_edges(spark, path, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    long = " ".join(["one two three", "é" * 100, "x" * 90] * 30_000)
    rows = [(1, None), (1, None), (None, "Null id"), (2, ""), (3, long), (3, long), (4, "tie"), (4, "other")] + [(10 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as ids", "8 as n_tokens")
    told = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.digests(df, path).collect()), key=str)
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert told == sorted(((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids), key=str)
    assert bpe.digests(df.limit(0), path).collect() == []
    coded = bpe.encode(df.filter("doc_id <> 3 or doc_id is null"), path)
    back = sorted(((r["doc_id"], r["text"]) for r in bpe.decode(coded, path).collect()), key=str)
    assert back == sorted(((i, library.decode(x, skip_special_tokens=False)) for i, x in ids if i != 3), key=str)
    assert bpe.decode(coded.limit(0), path).collect() == []


def test_portions_join_to_the_text():
    text = "ab cd  e" * 40 + "f" * 100
    assert "".join(bpe.portions(text, 10)) == text and max(map(len, bpe.portions("a b " * 50, 10))) <= 12


def test_words_that_merge_twice_are_refused():
    with pytest.raises(ValueError, match="one merge"):
        bpe.compile_automaton(spec([["a", "b"], ["ab", "a"], ["a", "ba"]]) | {})
