"""Hot anchors give the same whatever order a task reads its rows in."""

import numpy as np
from test_dedup import digest, substrings

from ocellus.llm import bloom, substring


def test_hot_anchors_in_descending_order(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 3)
    monkeypatch.setattr(bloom, "CHUNK", 64)
    rng = np.random.default_rng(1)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = noise(160)
    copy = noise(40) + shared + noise(40)
    rows = [(k, copy if k in (3, 57, 500) else noise(40) + shared + noise(40)) for k in [*range(1, 60), 200, 500]]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1)
    assert len(bloom.repeated_and_frequent(df, substring._Keys(100), 200, 3)[1])
    assert digest(substring.substring_dedup(df)) == substrings(rows)
