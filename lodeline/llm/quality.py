"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; versioned policies (masks) are applied to the bits
afterwards, and ablations are bitwise aggregates over the ledger, so neither
reads a text again.

Words are [^\\x20\\x09-\\x0D]+ of the whole text. n_repeat_words counts the word
positions covered by a 3-word window that occurs twice or more in the text.

Defined cases: a null or empty text has zero measurements and fails too_few_words
only; a text whose words hold no letter A-Z or a-z can't fail shouting; repeated
rows come back each; doc_id may be null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, lean, table, text_batches

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines")

#: rule -> SQL of its failure over the measurements; its bit is its place here.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "10 * n_upper > 3 * n_letters",
    "long_words": "word_chars > 20 * n_words",
}
#: version -> rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "long_words"),
}
POLICY = "v1"


def mask(policy: str) -> int:
    names = [*RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def repeat_words(words: list[bytes]) -> int:
    """Positions covered by a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(index) + ids[1:]
    if n > 1_000_000:  # beyond, three ids might not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(index) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def measure(data: bytes) -> tuple[int, ...]:
    """MEASURES of one text's UTF-8 bytes."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    bare = data.translate(None, SPACES)
    upper = len(bare) - len(bare.translate(None, UPPER))
    return (
        len(words),
        len(bare.decode()),
        len(bare) - len(bare.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        upper,
        upper + len(bare) - len(bare.translate(None, LOWER)),
        len(lines),
    )


@lean
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column(1)]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, MEASURES, failures): one bit per failed rule."""
    schema = ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)])
    measured = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data")).mapInArrow(_measure, schema)
    bits = " | ".join(f"if({sql}, {1 << i}L, 0L)" for i, sql in enumerate(RULES.values()))
    return measured.withColumn("failures", F.expr(bits))


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return rows.withColumn("base_failed", F.expr(f"failures & {mask('base')} <> 0")).withColumn("kept", F.expr(f"failures & {mask('base') | mask(policy)} = 0"))


def ablations(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """(rule, failed, only): documents that fail a rule, and those that the policy
    would keep without it. One aggregate over the bits; no rows are regrouped."""
    used = mask(policy)
    names = [*RULES]
    sums = [F.expr(f"count_if(failures & {1 << i} <> 0)").alias(f"failed_{i}") for i in range(len(names))]
    sums += [F.expr(f"count_if(failures & {used} = {1 << i})").alias(f"only_{i}") for i in range(len(names))]
    stack = ", ".join(f"'{n}', failed_{i}, only_{i}" for i, n in enumerate(names))
    return rows.agg(*sums).select(F.expr(f"stack({len(names)}, {stack}) as (rule, failed, only)"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", *MEASURES[:5], "base_failed", "kept", "failures")


#: The same in DuckDB over distinct doc_ids.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM d
), m AS (
  SELECT doc_id, words, len(words) AS n_words, length(bare) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters, len(lines) AS n_lines
  FROM w
), g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM m, unnest(range(1, n_words - 1)) AS t(i) WHERE n_words > 3
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g), unnest([0, 1, 2]) AS u(k)
  WHERE c >= 2 GROUP BY doc_id
), a AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_upper, n_letters, n_lines
  FROM m LEFT JOIN r ON m.doc_id = r.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_upper > 3 * n_letters THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS failures
  FROM a
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  failures & 3 <> 0 AS base_failed, failures = 0 AS kept, CAST(failures AS BIGINT) AS failures
FROM b
"""
