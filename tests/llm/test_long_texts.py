"""Texts longer than what an operator holds at a time give the same as when it holds them whole."""

import random

import numpy as np
import pytest
from test_dedup import digest, simhash_of, substrings
from test_text import brute_rules

from ocellus.llm import repetition, rolling, simhash, substring


@pytest.mark.parametrize("block", [1, 7, 300])
def test_words_in_blocks(monkeypatch, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab é日 \n\t#") for _ in range(rng.randint(0, 200))).encode() for _ in range(30)]
    words = rolling.Words(texts)
    whole = words.chars(), words.hashes()
    monkeypatch.setattr(rolling, "BLOCK", block)
    assert all((a == b).all() for a, b in zip(whole, (words.chars(), words.hashes()), strict=True))
    got = repetition.measure(texts)
    for k, t in enumerate(texts):
        want = brute_rules(t.decode())
        assert {c: got[c][k] for c in want} == want


@pytest.mark.parametrize("length", [1, 5, 100])
def test_chunks_hold_each_string_once(monkeypatch, length):
    monkeypatch.setattr(substring, "SLICE", 40)
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 3, 39, 40, 41, 79, 80, 139, 140, 500)]
    some, of, at = substring.chunks(texts, length)
    found = sorted((int(k), int(a) + s) for t, k, a in zip(some, of, at, strict=True) for s in range(len(t) - length + 1))
    assert found == [(k, s) for k, t in enumerate(texts) for s in range(len(t) - length + 1)]
    assert all(texts[k][a : a + len(t)] == t for t, k, a in zip(some, of, at, strict=True))


def test_long_text_with_repeats(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = noise(400)
    near = substring.SLICE - 200  # a passage over the first chunk's end
    long = noise(near) + shared + noise(300_000) + shared[:150] + noise(100)
    rows = [(1, noise(50) + shared), (2, long), (3, long[near - 500 : near + 900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(substring.substring_dedup(df)) == substrings(rows)


@pytest.mark.parametrize("part", [1, 9, 60])
def test_fingerprints_part_by_part(monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(part)
    texts = [" \n".join(rng.choice(["a", "bb", "Ccc", "é", "w" * 30]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 50, 200)]
    texts += ["", "  ", "x" * 100, "x" * 100 + " y", " lead and trail "]
    assert simhash.fingerprints([t.encode() for t in texts]).tolist() == [simhash_of(t) for t in texts]
