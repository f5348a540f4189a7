"""Chains of fingerprints that cross tiles and cells stay whole."""

import random

import numpy as np

from ocellus.llm import simhash


def bits(*at):
    return sum(1 << k for k in at)


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[find(a)] = find(b)
    return {frozenset(m for m in nodes if find(m) == find(n)) for n in nodes}


def test_guests_of_later_calls_keep_earlier_merges():
    a, b, c = bits(0, 1), bits(2, 3), bits(4, 5)
    guests = [bits(0, 2, 16), bits(2, 3, 4)]
    nodes = [a, b, c, *guests]
    close = [(x, y) for x in nodes for y in nodes if x != y and bin(x ^ y).count("1") <= 3 and not {x, y} <= set(guests)]
    rng = random.Random(0)
    for _ in range(60):
        own = rng.sample([a, b, c], 3)
        cell = simhash._Cell(np.array(own, np.uint64), 3)
        for g in rng.sample(guests, 2):
            cell.meet(np.array([g], np.uint64))
        u, v = cell.links()
        assert groups(nodes, zip(u.tolist(), v.tolist(), strict=True)) == groups(nodes, close)


def test_chains_in_one_cell():
    """A chain's links through one cell, its fingerprints guests or own in any order, join what brute force joins."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        now, chain = int(rng.integers(0, 2**62)), []
        for _ in range(120):
            now ^= bits(*rng.choice(62, 3, replace=False).tolist())
            chain.append(now)
        chain = list(dict.fromkeys(chain))
        rng.shuffle(chain)
        own, guests = chain[::2], chain[1::2]
        cell = simhash._Cell(np.array(own, np.uint64), 3)
        for g in guests:
            cell.meet(np.array([g], np.uint64))
        u, v = (x.view(np.uint64).tolist() for x in cell.links())
        close = [(x, y) for x in own for y in chain if x != y and bin(x ^ y).count("1") <= 3]
        assert groups(chain, zip(u, v, strict=True)) == groups(chain, close)
