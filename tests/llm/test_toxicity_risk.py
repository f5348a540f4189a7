"""The positive-unlabelled risk, its gradient, the statistics and the threshold against plain recomputation."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import toy

from ocellus.llm import toxicity as tox


def sparse(rng, n):
    rows = [sorted(rng.choice(tox.DIMENSIONS, int(rng.integers(0, 6)), replace=False).tolist()) for _ in range(n)]
    at = np.cumsum([0, *map(len, rows)])
    return tox.Sparse(at, np.array([i for r in rows for i in r], np.int32), rng.random(at[-1]).astype(np.float32))


def plain_risk(pos, unl, prior, w, b):
    def scores(x):
        return [b + sum(float(x.value[k]) * w[x.index[k]] for k in range(x.start[r], x.start[r + 1])) for r in range(len(x.start) - 1)]

    loss = lambda z, y: math.log1p(math.exp(-y * z))
    zp, zu = scores(pos), scores(unl)
    clean = sum(loss(z, -1) for z in zu) / len(zu) - prior * sum(loss(z, -1) for z in zp) / len(zp)
    return prior * sum(loss(z, 1) for z in zp) / len(zp), clean


@pytest.mark.parametrize("seed", range(6))
def test_risk_and_gradient(seed):
    rng = np.random.default_rng(seed)
    pos, unl, prior = sparse(rng, 7), sparse(rng, 11), 0.2 + 0.1 * seed
    w = np.zeros(tox.DIMENSIONS)
    used = np.unique(np.r_[pos.index, unl.index])
    w[used] = rng.normal(0, 2, len(used))
    b = -4.0 if seed % 2 else 0.3  # a text that all call clean lets the part for clean texts fall below zero
    if seed % 2:
        w[pos.index] = 9
    got, gw, gb = tox.risk(pos, unl, prior, w, b)
    toxic, clean = plain_risk(pos, unl, prior, w, b)
    assert np.isclose(got, toxic + max(0, clean), rtol=1e-5)

    def followed(w, b):
        t, c = plain_risk(pos, unl, prior, w, b)
        return t + c if clean >= 0 else -c

    for k in used[:6]:
        up, down = w.copy(), w.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        assert np.isclose(gw[k], (followed(up, b) - followed(down, b)) / 2e-4, rtol=1e-3, atol=1e-6)
    assert np.isclose(gb, (followed(w, b + 1e-4) - followed(w, b - 1e-4)) / 2e-4, rtol=1e-3, atol=1e-6)


def test_both_sides_of_zero_are_seen():
    rng = np.random.default_rng(1)
    pos, unl = sparse(rng, 7), sparse(rng, 11)
    w = np.zeros(tox.DIMENSIONS)
    w[pos.index] = 9
    assert plain_risk(pos, unl, 0.3, w, -4.0)[1] < 0 < plain_risk(pos, unl, 0.3, 0 * w, 0.0)[1]


def test_scores_by_hand(spark):
    docs, labels, _ = toy(spark)
    model, prior = tox.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learnt = labels.where(~tox.held_out(F.col("doc_id"))).collect()
    assert prior == sum(r.toxic for r in learnt) / len(learnt)
    words = [Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for _, t in rows]
    held = Counter(x for w in words for x in w)
    feature = {x: int(tox.features([x.encode()])[1][0]) for x in held}
    assert len(set(feature.values())) == len(feature)
    for x, n in held.items():
        assert np.isclose(model.idf[feature[x]], math.log((1 + len(rows)) / (1 + n)) + 1)
    logits, apart = [], []
    for (i, _), w in zip(rows, words, strict=True):
        v = {x: (1 + math.log(n)) * model.idf[feature[x]] for x, n in w.items()}
        norm = math.sqrt(sum(y * y for y in v.values())) or 1
        z = [b + sum(y / norm * weights[feature[x]] for x, y in v.items()) for weights, b in zip(model.weights, model.offsets, strict=True)]
        logits.append(sum(z) / len(z))
        apart.append(z[int(tox.part_of(np.array([-(2**63) if i is None else i]))[0])])
    top = sorted(apart, reverse=True)[: int(prior * len(apart))]
    got = tox.toxicity(docs, labels).collect()
    cuts = {round(z - math.log(r.score / (1 - r.score)), 3) for z, r in zip(sorted(logits), sorted(got, key=lambda r: r.score), strict=True)}
    assert max(cuts) - min(cuts) <= 0.002
    assert abs(sum(z >= min(cuts) for z in apart) - len(top)) <= 3


def test_bounds_of_the_fit(spark):
    docs, labels, _ = toy(spark)
    assert tox.train(docs, labels, most_entries=3) is None
    model, _ = tox.train(docs, labels, most_positive=20, most_unlabelled=60, most_entries=2000)
    assert np.isfinite(model.weights).all()
    long = docs.withColumn("text", F.concat_ws(" ", *["text"] * 40))
    got = tox.toxicity(long, labels)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
