"""The pipeline's stages take effect, and clean documents go through."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp


def test_stages(spark, docs, none):
    now = docs
    for name, step in cp.STAGES[:-1]:
        out = cp.stage(step(spark, now, ""), "test")
        assert out.columns == docs.columns, name
        now = out
    quality = cp.quality(spark, docs, "")
    clean = docs.where("doc_id between 2 and 4").count()
    assert quality.where("doc_id between 2 and 4").count() == clean
    assert quality.where("doc_id in (74, 80, 81, 83)").count() == 0
    near = cp.near(spark, docs, "").collect()
    ids = Counter(r.doc_id for r in near)
    assert max(ids.values()) == 1 and 0 in ids and 20 not in ids and 30 not in ids
    last = cp.tokens(spark, now, "")
    assert last.count() == now.count() and last.where(~F.col("parity")).count() == 0
    for _, step in cp.STAGES:
        assert step(spark, none, "").count() == 0


def test_first_stages_against_brute_force(spark, docs, rows):
    from test_dedup import key, lines_of, simhash_of
    from test_text import brute_rules

    kept = [(i, t) for i, t in rows if brute_rules(t)["kept"]]
    lines = [(i, w[3]) for (i, _), w in zip(kept, lines_of(kept), strict=True)]
    prints = [simhash_of(t) for _, t in lines]
    reach = [key(i) for i, _ in lines]
    while True:
        new = [min(reach[b] for b in range(len(lines)) if bin(prints[a] ^ prints[b]).count("1") <= 3) for a in range(len(lines))]
        if new == reach:
            break
        reach = new
    want: dict = {}
    for (i, t), c in zip(lines, reach, strict=True):
        if key(i) == c:
            want[i] = min(want.get(i, t), t)
    now = docs
    for _, step in cp.STAGES[:3]:
        now = cp.stage(step(spark, now, ""), "brute")
    assert Counter((r.doc_id, r.text) for r in now.collect()) == Counter(want.items())
    words = sum(len(t.split()) for t in want.values())
    mixed = cp.mix(spark, now, "").collect()
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * words) <= 64 * 6
    assert all(set(r.text.split()) <= set(want[r.doc_id].split()) for r in mixed)


def test_run_leaves_its_result_alone(spark, docs, tmp_path, monkeypatch):
    """Whatever the stages stage is removed; the result is there."""
    from ocellus.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path / "shared"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path))
    assert [p.name for p in (tmp_path / "shared").iterdir()] == [got._staged_at.rsplit("/", 1)[1]] and got.count() > 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest

    from ocellus.llm.common import shared_dir

    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return {}

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), type("Conf", (), {"get": staticmethod(lambda k, d: d)})

    assert shared_dir(Session("local[8]"))
    for master in ("yarn", "k8s://x", "spark://x:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            shared_dir(Session(master))
