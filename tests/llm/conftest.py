import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("drop", T.StringType())]
)
LINE = "A line that many documents hold, word for word."


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, periodic and very long texts, empty and null ones, a null id, repeated rows."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(60) + "."
    rows: list[tuple[int | None, str | None]] = [(k, prose(rng.randint(60, 140))) for k in range(20)]
    rows += [(20 + k, rows[k][1]) for k in range(3)] + [(30, rows[0][1].upper()), (31, rows[1][1] + " tail")]
    rows += [(40 + k, f"{prose(30)}\n{LINE}\n{prose(20)}") for k in range(4)] + [(50, f"{LINE}\n{LINE} \n\t{LINE.upper()}")]
    rows += [(60 + k, f"{prose(25)} {shared} {prose(25)}") for k in range(4)]
    rows += [(70, "ab" * 300), (71, "x" * 450), (72, "é" * 200 + prose(20) + "é" * 200), (73, prose(9000)), (74, (prose(12) + "\n") * 30)]
    rows += [(80, ""), (81, None), (82, " \n\t "), (83, "one"), (84, "two words"), (85, "日本語 のテキスト 🎉 x  y ")]
    rows += [(None, prose(70)), (90, rows[5][1]), (90, rows[5][1]), (91, LINE)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    sources = ["b", "a", None, "A", "ä"]
    full = [(i, t, "en", sources[k % 5], len(t or ""), "k", "s", "d") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
