"""Blocks of documents meet their slots by a shuffle: both grow with the corpus, so the driver never holds them."""

from ocellus.llm import mixing


def test_slots_and_blocks_are_not_broadcast(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 300, "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    pieces = mixing.mix(docs).pieces()
    assert pieces.where("word_from >= word_to").count() == 0
    pieces.collect()  # the plan is final only after a run
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
