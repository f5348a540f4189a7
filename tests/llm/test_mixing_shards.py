"""Mixes of several output shards at the production block, against the words counted one by one."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ocellus.llm import mixing


def corpus():
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows = [(k, prose(rng.choice([3, 40, 90, 400, 1500])), rng.choice("ccccab")) for k in range(220)]
    rows += [(None, prose(200), "a"), (None, prose(300), "c"), (7, prose(500), "b"), (7, rows[7][1], "b"), (8, *rows[8][1:]), (8, *rows[8][1:])]
    return rows + [(400, "", "a"), (401, None, "b"), (402, prose(30000), None), (403, prose(5), "d")]


@pytest.mark.parametrize("rng_", [1, 37])
def test_shards_against_single_words(spark, monkeypatch, rng_):
    monkeypatch.setattr(mixing, "SLOTS", 64)
    monkeypatch.setattr(mixing, "RANGE", rng_)
    monkeypatch.setattr(mixing, "TASK", 400)
    rows = corpus()
    mix = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), seed=3)
    words = defaultdict(int)
    for _, t, s in rows:
        words[s] += len((t or "").split())
    order = sorted(words, key=lambda s: (s is None, s))
    # targets by weight; what a source can't take is dealt again
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, aim = set(), {}
    while True:
        left = 1.5 * sum(words.values()) - sum(2 * words[s] for s in full)
        aim = {s: 2 * words[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and aim[s] > 2 * words[s]}
        if not over:
            break
        full |= over
    # each source's words in a row, by the document that holds them
    layout = [r for r in mix.layout.collect() if r.size]
    owner = {}
    for s in {r.src for r in layout}:
        mine = sorted((r for r in layout if r.src == s), key=lambda r: r.start)
        owner[s] = [(r.doc_id, r.same, r.copy) for r in mine for _ in range(r.size)]
        assert [r.start for r in mine] == np.cumsum([0, *(r.size for r in mine)])[:-1].tolist()
    by_label = {("b" if s is None else "a" + s): s for s in order}
    assert {s: len(w) for s, w in owner.items()} == {k: words[s] for k, s in by_label.items() if words[s]}
    slots = mix.slots.collect()
    assert mix.slots.rdd.getNumPartitions() == -(-len(slots) // 400)
    places = defaultdict(list)
    blocks = defaultdict(lambda: defaultdict(list))
    taken = Counter()
    for r in slots:
        places[(r.shard, r.src)].append(r.slot)
        blocks[r.src][r.round].append(r.block)
        taken.update(owner[r.src][64 * r.block : 64 * r.block + 64])
    assert len({s for s, _ in places}) > 3
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    for s, rounds in blocks.items():
        n = -(-len(owner[s]) // 64)
        last = max(rounds)
        assert last <= 1 and all(sorted(rounds[k]) == list(range(n)) for k in range(last))
        assert len(set(rounds[last])) == len(rounds[last])
        assert sorted(rounds[0]) != rounds[0] or n < 4
        given = sum(min(64, len(owner[s]) - 64 * b) for x in rounds.values() for b in x)
        assert abs(given - aim[by_label[s]]) <= 128
    sizes = Counter()
    for (shard, _), x in places.items():
        sizes[shard] += len(x)
    assert max(sizes.values()) - min(sizes.values()) <= len(sizes)
    held = Counter((r.doc_id, r.size, taken[(r.doc_id, r.same, r.copy)]) for r in mix.layout.collect())
    got = mix.taken().collect()
    assert Counter((mixing.NULL_ID if r.doc_id is None else r.doc_id, r.size, r.taken) for r in got) == held
    assert all(r.taken <= 2 * r.size for r in got)
    assert sum(len(r.text.split()) for r in mix.documents().collect()) == sum(r.taken for r in got)
