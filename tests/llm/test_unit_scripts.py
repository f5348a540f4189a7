"""Long lines and sentences without blanks are units too."""

from test_dedup import digest, removed

from ocellus.llm import unit_dedup

LINE = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(136))
SENTENCE = "".join(chr(0x4E00 + 53 * k % 4000) for k in range(30)) + "。"
ADDRESS = "https://example.org/" + "path/" * 12


def test_repeats_without_blanks(spark):
    other = "".join(chr(0x5E00 + k) for k in range(30)) + "！"
    rows = [(1, LINE), (2, f"頭\n{LINE}\n尾"), (3, f"短い。{SENTENCE}{other}"), (4, f"別の。{SENTENCE}終わり"), (5, ADDRESS), (6, f"see\n{ADDRESS}\n"), (7, "短い。"), (8, "短い。")]
    gone = {2: LINE, 4: SENTENCE, 6: ADDRESS}

    def spans(at, b):
        x = gone.get(at[0], "").encode()
        return [(b.index(x), b.index(x) + len(x))] if x else []

    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(unit_dedup.unit_dedup(df)) == removed(rows, spans)
