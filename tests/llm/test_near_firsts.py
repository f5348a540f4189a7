"""What the near stage moves: shingles are counted exactly, whatever their number, and only sets that can have a near copy are kept."""

import math
import random
from collections import Counter

from ocellus.llm import near_copies


def test_sets_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BUCKET", 300)
    monkeypatch.setattr(near_copies, "DEAL", 500)
    monkeypatch.setattr(near_copies, "CELL", 5)  # more than 20 sets: hot
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = prose(60)
    texts = [" ".join(prose(rng.randint(1, 300))) for _ in range(60)]
    texts += [" ".join(passage + prose(rng.randint(0, 90))) for _ in range(40)]
    texts += texts[:5] + [" ".join([*t.split(), "end"]) for t in texts[:20]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = {r.node: r for r in near_copies._sets(rows, 5, 0.8).collect()}
    sets = {near_copies._node(s): s.view("int64").tolist() for s in (near_copies.shingles(t.encode(), 5) for t in texts)}
    firsts = {k: s[: len(s) - math.ceil(0.8 * len(s) - 1e-9) + math.ceil(len(s) / 20)] for k, s in sets.items()}
    held = Counter(x for s in firsts.values() for x in s)
    wanted = {}
    for k, s in firsts.items():
        need = math.ceil(math.ceil(0.8 * len(sets[k]) - 1e-9) / 20)
        some = [x for x in s if held[x] > 1]
        if len(some) >= need:
            wanted[k] = (len(some), len(some) - need + 1, {x for x in some if held[x] <= 10})
    assert got.keys() == wanted.keys() and 20 < len(got) < len(sets)
    for k, (many, sent, rare) in wanted.items():
        assert (got[k].n, got[k].many, len(got[k].tokens)) == (len(sets[k]), many, sent)
        assert rare.issuperset(got[k].tokens) or rare.issubset(got[k].tokens)  # the rare ones come first


def test_whole_sets_of_the_wanted_alone(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdefgh"] * 2
    sets = [near_copies.shingles(t.encode(), 5) for t in texts[:8]]
    ends = spark.createDataFrame([(near_copies._node(s),) for s in sets[:3]], "node long")
    got = near_copies._whole(spark.createDataFrame([(t,) for t in texts], "text string"), ends, 5).collect()
    assert {r.node: r.found for r in got} == {near_copies._node(s): s.view("int64").tolist() for s in sets[:3]} and len(got) == 3


def test_tables_that_are_read_no_more_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ocellus.llm.common.shared_dir", lambda spark: str(tmp_path))
    texts = [" ".join(f"{c}{k}" for k in range(n)) for c in "abc" for n in (40, 41, 42)]
    links = near_copies.links(spark.createDataFrame([(t,) for t in texts], "text string"))
    left = {p.name[:-33] for p in tmp_path.iterdir()}
    assert links.count() >= 6 and left >= {"star", "rest"}
    assert not left & {"firsts", "told", "held", "labelled", "cells", "star-sets", "rest-sets", "star-pairs", "rest-pairs"}
