"""The pipeline's near stage against brute force: five words, similarity 0.8, and one row of each group."""

import random
from collections import Counter

import pytest
from test_dedup import key, lower

import corpus_pipeline as cp
from ocellus.llm import near_copies


def sets(text, n=5):
    w = lower(text).split()
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()


def brute(rows):
    found = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if found[a] == found[b] or 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(find(k), []).append((key(i), t or "", i, t))
    return Counter(min(g)[2:] for g in groups.values())


def near_rows():
    """Prose with a few words changed, similarities to both sides of 0.8, in chains and stars; hot passages; null and repeated ids."""
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]

    def change(words, n):
        out = list(words)
        for k in rng.sample(range(len(out)), n):
            out[k] = f"x{rng.randint(0, 10**9)}"
        return out

    rows = []
    for g in range(12):
        base = prose(rng.randint(60, 250))
        rows.append((len(rows), " ".join(base)))
        for _ in range(6):
            base_or_last = base if g % 2 else rows[-1][1].split()
            rows.append((len(rows), " ".join(change(base_or_last, rng.randint(1, max(2, len(base) // 35))))))
    passage = prose(80)
    rows += [(len(rows) + k, " ".join(passage + prose(n))) for k, n in enumerate((5, 10, 15, 18, 25, 40, 60, 9))]
    rng.shuffle(rows)
    rows += [(None, " ".join(prose(70))) for _ in range(3)] + [(None, rows[0][1])]
    rows += [(900, " ".join(prose(50))), (900, " ".join(prose(50))), (900, rows[1][1])]
    same = prose(100)
    rows += [(901, " ".join([*same, "b"])), (901, " ".join([*same, "a"])), (901, " ".join([*same, "a"])), (902, " ".join(same))]
    return rows + [(903, "one two"), (904, "One  two"), (905, "one"), (906, None), (907, " ")]


@pytest.mark.parametrize("cell", [3, 1000])
def test_near_stage_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(near_copies, "CELL", cell)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.text) for r in cp.near(spark, df, "").collect()) == brute(rows)


def test_tiles_give_pairs(spark):
    """Sets within the radius are compared, whatever shingles they share."""
    rows = [tuple(near_copies.shingles(t.encode(), 5) for t in ("a b c d e f g", "a b c d e f g h"))]
    prints = {near_copies.fingerprint(x) for x in rows[0]}
    assert len(prints) == 2
    told = spark.createDataFrame([(k, p) for k, p in enumerate([7, 7, 5, 1 << 40, (1 << 40) + 7, -1])], "node long, fp long")
    got = {(r.u, r.v) for r in near_copies._alike(told, 3).collect()}
    assert got >= {(0, 1)} and {x for p in got for x in p} == {0, 1, 2, 3, 4}
    assert all(bin([7, 7, 5, 1 << 40, (1 << 40) + 7][u] ^ [7, 7, 5, 1 << 40, (1 << 40) + 7][v]).count("1") <= 3 for u, v in got)
