"""Exact, line, unit, substring and near dedup against brute force on one awkward corpus."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ocellus.llm import bloom, bwt, components, exact_dedup, line_dedup, simhash, substring, unit_dedup
from ocellus.llm.common import merge_spans, span_digest

LOW = -(2**63)


def key(i):
    return LOW if i is None else i


def lower(t):
    return (t or "").encode().lower()


def test_exact(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(key(i))
    want = Counter()
    for i, t in rows:
        g = groups[lower(t)]
        want[(i, None if max(g) == LOW else max(g), len(g), key(i) == max(g), hashlib.sha256(lower(t)).hexdigest())] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == want


def line_key(x):
    k = x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    return k if len(k) >= 20 else None


def lines_of(rows):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if line_key(x):
                held[line_key(x)].add(key(i))
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if not (line_key(x) and len(held[line_key(x)]) >= 3 and max(held[line_key(x)]) != key(i))]
        out.append((i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return out


def test_lines(docs, rows):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(docs).collect())
    assert got == Counter(lines_of(rows))


def test_drop_lines_keeps_columns(docs, rows):
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    want = Counter((i, None if t is None else w[3]) for (i, t), w in zip(rows, lines_of(rows), strict=True))
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text or "") for r in got)


def place(i, t):
    """Ranks a row: by doc_id, then by the signed 64-bit digest of its text."""
    return key(i), (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64 - 2**63


def removed(rows, spans):
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s, e in spans(place(i, t), b):
            gone[s:e] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def digest(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in span_digest(df).collect())


def plain_units(text, min_words, min_bytes):
    """Normalised unit, start and end."""
    spans, at = [], 0
    for full, group in itertools.groupby(text.split(b"\n"), key=lambda x: bool(x.strip())):
        lines = list(group)
        ends = list(itertools.accumulate((len(x) + 1 for x in lines), initial=at))
        if full:
            spans += [(a, b - 1) for a, b in itertools.pairwise(ends)]
            spans += [(at, ends[-1] - 1)] * (len(lines) > 1)
            for a, b in itertools.pairwise(ends):
                cuts = [a, *(a + x.start() + 1 for x in re.finditer(rb"[.!?] ", text[a : b - 1])), b - 1]
                spans += list(itertools.pairwise(cuts)) if len(cuts) > 2 else []
        at = ends[-1]
    out = []
    for a, b in spans:
        x = text[a:b]
        s, e = a + len(x) - len(x.lstrip()), a + len(x.rstrip())
        if e - s >= min_bytes and (len(x.split()) >= min_words or e - s >= 80):
            out.append((b" ".join(x.lower().split()), s, e))
    return out


def units_removed(rows, least=(13, 40)):
    first = {}
    for i, t in rows:
        for d, s, _ in plain_units((t or "").encode(), *least):
            first[d] = min(first.get(d, (*place(i, t), s)), (*place(i, t), s))
    return removed(rows, lambda at, b: [(s, e) for d, s, e in plain_units(b, *least) if first[d] != (*at, s)])


def test_units(docs, rows):
    assert digest(unit_dedup.unit_dedup(docs)) == units_removed(rows)


def shared_ids():
    """One id, or none, for different texts, of which some repeat passages; and equal rows."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"t{rng.randrange(5000)}" for _ in range(n))
    passage = prose(40)
    rows = [(5, f"{prose(20)}\n{passage}\n{prose(20)}"), (5, f"{prose(60)}\n{prose(30)}"), (None, f"{passage}\n{prose(10)}"), (None, prose(30)), (None, prose(200)), (None, None)]
    rows += [(5, f"{prose(3)}\n{passage}"), (6, f"{passage}\n{passage}"), (None, rows[3][1]), (2, rows[1][1]), (2, ""), (5, rows[0][1]), (7, f"{prose(5)}\n\n{rows[1][1]}\n\n{prose(5)}")]
    return rows


def test_rows_that_share_an_id(spark):
    """No row loses what only another row of its id repeats."""
    rows = shared_ids()
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, row string").repartition(3)
    assert digest(unit_dedup.unit_dedup(df)) == units_removed(rows)
    assert digest(substring.substring_dedup(df)) == substrings(rows)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(df).collect())
    assert got == Counter(lines_of(rows))
    assert line_dedup.drop_lines(df).columns == ["text", "doc_id", "row"]


def test_unit_offsets():
    text = b"One two three four five six. Seven eight nine ten eleven twelve!\n  a line of its own, long enough \n \nand one that is another paragraph"
    found = [text[s:e] for _, s, e in unit_dedup.units(text, 5, 20)]
    one, two, _, three = text.split(b"\n")
    assert found == [b"One two three four five six.", b"Seven eight nine ten eleven twelve!", one, two.strip(), text[: text.index(b" \n")], three]


def substrings(rows, n=100):
    first = {}
    for i, t in rows:
        b, at = (t or "").encode(), place(i, t)
        for s in range(len(b) - n + 1):
            x = b[s : s + n]
            first[x] = min(first.get(x, (*at, s)), (*at, s))
    return removed(rows, lambda at, b: [(s, s + n) for s in range(len(b) - n + 1) if first[b[s : s + n]] != (*at, s)])


def test_substrings(docs, rows):
    assert digest(substring.substring_dedup(docs)) == substrings(rows)


def hot_rows():
    rng = np.random.default_rng(1)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = noise(90)
    return [(k, noise(40) + shared + (noise(40) if k % 3 else "same tail " * 8)) for k in range(60)]


def test_substrings_of_hot_anchors(spark, monkeypatch):
    """The way for anchors with very many pieces gives the same."""
    monkeypatch.setattr(substring, "HOT", 3)
    monkeypatch.setattr(bloom, "CHUNK", 64)
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    _, hot = bloom.repeated_and_frequent(df, substring._Keys(100), 200, 3)
    assert len(hot)
    assert digest(substring.substring_dedup(df)) == substrings(rows)


def test_substrings_of_large_groups(spark, monkeypatch):
    """So does the way for groups that turn out too large for a bundle."""
    monkeypatch.setattr(substring, "MOST_OCCURRENCES", 20)
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert digest(substring.substring_dedup(df)) == substrings(rows)


@pytest.mark.parametrize("seed", range(8))
def test_transform_finds_all_repeats(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.choice(list(b"abc"), rng.integers(1, 60)).tolist()) for _ in range(9)]
    n = int(rng.integers(2, 9))
    want = defaultdict(set)
    for k, t in enumerate(texts):
        for s in range(len(t) - n + 1):
            want[t[s : s + n]].add((k, s))
    got = defaultdict(set)
    for k, s, g in zip(*bwt.classes(texts, n), strict=True):
        got[g].add((k, s))
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_every_string_lies_around_an_anchor():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (99, 100, 400, 3, 0, 250)] + [b"z" * 500, b"ab" * 200]
    text, _, at, lo, hi = substring.anchors(texts, 100)
    for k, t in enumerate(texts):
        for s in range(len(t) - 99):
            inside = (text == k) & (lo <= s) & (hi >= s + 100) & (at >= s) & (at + substring.GRAM <= s + 100)
            assert inside.any(), (k, s)


def simhash_of(t):
    w = lower(t).split()
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near(docs, rows):
    prints = [simhash_of(t) for _, t in rows]
    reach = [key(i) for i, _ in rows]
    while True:
        new = [min(reach[b] for b in range(len(rows)) if bin(prints[a] ^ prints[b]).count("1") <= 3) for a in range(len(rows))]
        if new == reach:
            break
        reach = new
    want = Counter((i, f"{p:016x}", None if c == LOW else c) for (i, _), p, c in zip(rows, prints, reach, strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(docs).collect())
    assert got == want


@pytest.mark.parametrize(("deal", "load"), [(1 << 16, 16_000_000), (1, 4000)])
def test_links_over_cells(spark, monkeypatch, deal, load):
    """Many fingerprints a few bits apart, in tiles that are dealt to several cells, in parts, by several tasks."""
    monkeypatch.setattr(simhash, "CELL", 7)
    monkeypatch.setattr(simhash, "DEAL", deal)
    monkeypatch.setattr(simhash, "TASK_BYTES", load)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(12)] + [base, rng.integers(0, 2**63, 200, dtype=np.uint64)])).view(np.int64)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    got = {r.u: r.label for r in components.components(simhash.links(df)).collect()}
    u = prints.view(np.uint64)
    close = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = prints.copy()
    while True:
        new = np.array([label[close[k]].min() for k in range(len(prints))])
        if (new == label).all():
            break
        label = new
    assert [got.get(int(p), int(p)) for p in prints] == label.tolist()


def test_planned_work():
    """Comparisons and bytes as counted tile by tile."""
    rng = np.random.default_rng(6)
    counts = np.zeros(simhash.N_TILES, np.int64)
    counts[simhash.tiles(rng.integers(0, 2**63, 3000, dtype=np.uint64))] = rng.integers(1, 9, 3000)
    steps, at = simhash.offsets(3), np.flatnonzero(counts)
    pairs, size = 0.0, 0
    for t in at.tolist():
        owners = simhash._owners(t, steps)
        pairs += counts[t] ** 2 / 2 + counts[t] * counts[owners].sum()
        size += 8 * counts[t] * (1 + np.count_nonzero(counts[owners]))
    assert simhash.planned(counts, 3) == (int(pairs), size)


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.u: r.label for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(1, n + 1)} | {101: 100}


def test_filter_has_no_false_negative(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    twice = np.concatenate([keys, keys[:500]])
    df = spark.createDataFrame([(int(k),) for k in twice.view(np.int64)], "k long").repartition(7)

    def read(batch):
        yield batch.column(0).to_numpy().view(np.uint64)

    again = bloom.repeated(df, read, len(twice)).value
    ok = bloom.maybe_repeated(again, keys)
    assert ok[:500].all() and ok[500:].mean() < 0.1


def test_merged_spans():
    s, e = merge_spans(np.array([5, 0, 10, 3, 20]), np.array([8, 4, 12, 10, 21]))
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == [(0, 12), (20, 21)]


def test_empty_tables(none):
    for df in (exact_dedup.exact_dedup(none), line_dedup.line_dedup(none), unit_dedup.unit_dedup(none), substring.substring_dedup(none), simhash.near_dedup(none), line_dedup.drop_lines(none)):
        assert df.select(F.count("*")).first()[0] == 0
