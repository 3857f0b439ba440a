"""That the text operators keep nothing less than the whole job needs."""

import collections
import math
import random
import re
import string

import pytest

from tilework.llm import secrets


@pytest.mark.parametrize("lead,chars,n,missed", [("v1/", "0123456789ABCDEF", 32, 0.01), ("id_", "0123456789ABCDEF", 32, 0.01), ("v1/", "0123456789ABCDEF", 20, 0.06), ("", string.ascii_letters, 32, 0.1)])
def test_a_window_has_its_own_class(lead, chars, n, missed):
    r = random.Random(2)
    keys = [lead + "".join(r.choice(chars) for _ in range(n)) for _ in range(1000)]
    found = [any(kind == 3 for _, kind, _ in secrets.scan(f"see {k} there".encode())) for k in keys]
    assert sum(found) >= (1 - missed) * len(keys)


def test_letters_of_words_are_no_keys():
    for word in ("internationalizationOfConfigurations2", "get_user_account_balance_from_history", "well-known-and-state-of-the-art-methods", "https-server/with/path/names/only", "2024-11-28_2024-11-29_00"):
        assert not [x for x in secrets.scan(f"see {word} there".encode()) if x[1] == 3]


@pytest.mark.parametrize("chars,n,missed", [(string.ascii_lowercase, 40, 0.15), (string.ascii_uppercase, 40, 0.15), (string.ascii_lowercase + "-_", 40, 0.2), (string.ascii_uppercase + "+/", 40, 0.3), ("0123456789", 23, 0.4), ("0123456789abcdef", 22, 0.06), (string.ascii_letters + "0123456789+/", 32, 0.01)])
def test_keys_of_each_class_are_found(chars, n, missed):
    r = random.Random(7)
    keys = ["".join(r.choice(chars) for _ in range(n)) for _ in range(1000)]
    found = [any(kind == 3 for _, kind, _ in secrets.scan(f"see {k} there".encode())) for k in keys]
    assert sum(found) >= (1 - missed) * len(keys)


def plain_entropy_spans(text):
    """All windows of 20 key-like characters by definition, joined, less those that meet a base span or are known strings."""
    base = [(m.start(), m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [m.span() for m in re.finditer(rb"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [m.span() for m in re.finditer(rb"[0-9a-f]+", text) if len(m[0]) >= 24]
    out = []

    def above(w):
        kinds = [sum(c in group for c in w) for group in (b"0123456789", b"0123456789abcdefABCDEF", string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), b"aeiouAEIOU")]
        digits, hexes, upper, lower, vowels = kinds
        if digits == 20:
            limit = 2.9
        elif hexes == 20:
            limit = 3.0
        elif digits:
            limit = 3.6
        elif 20 in (lower, upper):
            limit = 3.65 if vowels <= 5 else 9
        elif 0 in (lower, upper) and lower + upper >= 15:
            limit = 3.7 if vowels * 20 <= 5 * (lower + upper) else 9
        else:
            limit = 3.7 if min(upper, lower) >= 5 else 9
        return -sum(n / 20 * math.log2(n / 20) for n in collections.Counter(w).values()) >= limit - 1e-9

    def stretches(word):
        spans = []
        for i in range(len(word) - 19):
            if above(word[i : i + 20]):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 20
                else:
                    spans.append([i, i + 20])
        return spans

    for m in re.finditer(rb"[A-Za-z0-9+/_-]{20,}", text):
        known = any(re.fullmatch(a, m[0]) for a in secrets.ALLOW)
        if known and not (re.fullmatch(rb"[A-Za-z_-]+\d{1,6}", m[0]) and stretches(m[0].rstrip(b"0123456789"))):
            continue
        out += [(m.start() + a, m.start() + b) for a, b in stretches(m[0])]
    return sorted((a, b) for a, b in out if not any(s < b and a < e for s, e in base))


def test_entropy_spans_equal_brute_force():
    r = random.Random(5)
    sets = [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, "0123456789", "0123456789abcdef", string.ascii_letters + "0123456789+/", "ab", "/_-"]
    for _ in range(400):
        text = ""
        for _ in range(r.randint(1, 5)):
            text += "".join(r.choice(r.choice(sets) if r.random() < 0.1 else s) for s in [r.choice(sets)] * r.randint(1, 45)) + r.choice(["", "/", "_", " ", "=", " token=", " AKIA"])
        found = [(a, b) for a, kind, b in secrets.scan(text.encode()) if kind == 3]
        assert found == plain_entropy_spans(text.encode()), text
