"""Quality rules by repetition coverage: characters inside repeated word n-grams and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, per_batch, public_id, slim
from .rolling import Prefix, Words, mix, repeats

#: n-gram length: most percent of a text's word characters that may lie in n-grams found twice or more (Gopher's bounds).
MOST = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most percent of lines with a word that may equal an earlier line, and of their bytes.
MOST_LINES, MOST_LINE_BYTES = 30, 20
MIN_WORDS, MOST_REPEAT_WORDS = 50, 50
#: Bytes of text measured at once, about: some twenty arrays of eight bytes for each word. A longer text is measured alone.
SLICE = 500_000
_SYMBOLS = b"#*$%&|<>"


def covered(words: Words, hashes: Prefix, n: int) -> np.ndarray:
    """True for each word inside an n-word window that its text holds twice or more."""
    total = len(words.doc)
    if total < n:
        return np.zeros(total, bool)
    h = hashes.every(n)
    ok = words.doc[n - 1 :] == words.doc[: total - n + 1]
    at = np.flatnonzero(ok)
    hit = at[repeats(mix(h[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    edge = np.zeros(total + 1, np.int32)
    edge[hit] += 1
    edge[hit + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], most: dict[int, int] = MOST) -> dict[str, np.ndarray]:
    words = Words(texts)
    chars = words.chars()
    hashes = Prefix(words.hashes())
    out = {"n_words": words.counts(), "word_chars": words.totals(chars)}
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    out["n_symbols"] = words.count(symbol)
    lines = np.zeros((4, len(texts)), np.int64)
    for k, t in enumerate(texts):
        seen: set[bytes] = set()
        for line in t.split(b"\n"):
            if line and not line.isspace():
                again = line in seen
                lines[:, k] += (1, len(line), again, again * len(line))
                seen.add(line)
    out["n_lines"], out["line_bytes"], out["n_dup_lines"], out["dup_line_bytes"] = lines
    out["n_repeat_words"] = words.totals(covered(words, hashes, 3))
    for n in most:
        out[f"dup_chars_{n}"] = words.totals(covered(words, hashes, n) * chars)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEAT_WORDS * out["n_words"])
    bad = out["base_failed"] | (100 * out["n_dup_lines"] > MOST_LINES * out["n_lines"]) | (100 * out["dup_line_bytes"] > MOST_LINE_BYTES * out["line_bytes"])
    for n, pct in most.items():
        bad |= 100 * out[f"dup_chars_{n}"] > pct * out["word_chars"]
    out["kept"] = ~bad
    return out


LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup_chars_{n}" for n in MOST), "dup_line_bytes"]
MEASURES = ", ".join(["doc_id long", *(f"{x} long" for x in LONGS), "base_failed boolean", "kept boolean"])


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    got = measure(bytes_of(batch, "text"))
    cols = [batch.column(0), *(pa.array(got[x].astype(np.int64)) for x in LONGS), pa.array(got["base_failed"]), pa.array(got["kept"])]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", *LONGS, "base_failed", "kept"])


def repetition_rules(docs: DataFrame) -> DataFrame:
    r"""Measures and verdict of every whole text.

    Words are ``[^\x20\x09-\x0D]+``. A text fails the base rules with under 50 words, or with over half of its words inside
    3-word windows that it holds twice or more. It then also fails where the characters of words inside repeated n-grams pass the
    bounds of MOST, or repeated lines pass MOST_LINES or MOST_LINE_BYTES. Null and empty texts have zeros and fail. A null doc_id
    comes back null; repeated rows are measured alike; an empty table gives no rows. A very long text is measured whole, with some twenty
    bytes of memory for each of its own; all other columns are left out, whatever their names.
    """
    return slim(docs).mapInArrow(per_batch(_measure, SLICE), MEASURES).withColumn("doc_id", public_id())


def passes(text: F.Column) -> F.Column:
    """The verdict as a column, for filters that keep all other columns and rows that repeat. A null or empty text doesn't pass."""

    @F.arrow_udf("boolean")
    def verdict(col: pa.Array) -> pa.Array:
        texts = [t or b"" for t in col.cast(pa.large_binary()).to_pylist()]
        out, at, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size > SLICE or k == len(texts) - 1:
                out.append(measure(texts[at : k + 1])["kept"])
                at, size = k + 1, 0
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return verdict(text)


def _grams(n: int) -> str:
    gram = "hash(" + ", ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))]) + ")"
    return f"""
c{n} AS (
  SELECT doc_id, {"count(*)" if n == 3 else "sum(length(w))"} AS v FROM (
    SELECT doc_id, w, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit
    FROM (SELECT doc_id, i, w, CASE WHEN whole AND count(*) OVER (PARTITION BY doc_id, whole, g) > 1 THEN 1 ELSE 0 END AS dup
          FROM (SELECT doc_id, i, w, lead(w, {n - 1}) OVER o IS NOT NULL AS whole, {gram} AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)))
  ) WHERE hit = 1 GROUP BY doc_id
)"""


ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
l AS (
  SELECT doc_id, count(*) AS n_lines, sum(octet_length(encode(line)))::BIGINT AS line_bytes, count(*) FILTER (WHERE rn > 1) AS n_dup_lines,
         coalesce(sum(octet_length(encode(line))) FILTER (WHERE rn > 1), 0)::BIGINT AS dup_line_bytes
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS rn FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))
  GROUP BY doc_id
), {",".join(_grams(n) for n in (3, *MOST))}, m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c3.v, 0) AS n_repeat_words,
    {", ".join(f"coalesce(c{n}.v, 0)::BIGINT AS dup_chars_{n}" for n in MOST)}, coalesce(dup_line_bytes, 0) AS dup_line_bytes, coalesce(n_lines, 0) AS n_lines, coalesce(line_bytes, 0) AS line_bytes
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id {" ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = w.doc_id" for n in (3, *MOST))}
), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_WORDS} * n_words AS base_failed FROM m)
SELECT doc_id, {", ".join(LONGS)}, base_failed,
  NOT (base_failed OR 100 * n_dup_lines > {MOST_LINES} * n_lines OR 100 * dup_line_bytes > {MOST_LINE_BYTES} * line_bytes OR {" OR ".join(f"100 * dup_chars_{n} > {p} * word_chars" for n, p in MOST.items())}) AS kept
FROM b
"""
