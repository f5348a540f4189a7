"""Clean documents with null or repeated ids go through the near stage."""

from collections import Counter

import corpus_pipeline as cp


def test_null_and_repeated_ids_of_other_groups_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4]), (3, texts[3]), (9, texts[5]), (9, texts[5])]
    got = cp.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[3]), (7, texts[4]), (9, texts[5])])
