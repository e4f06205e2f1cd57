"""Quality rules with a bitmask ledger (operator 5).

``ledger`` evaluates every rule once over the whole text and keeps the measurements and one bit for each rule that fails. Policies are
versioned masks over those bits, so that another policy, or leaving one rule out, reads the ledger and never the text:
``apply_policy`` tests bits, and ``ablation`` sums documents by their failure bits (at most 2^rules rows) and answers for each rule how
many documents it alone drops.

Measurements: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line),
n_repeat_words (words inside 3-word windows that the text has twice or more), n_upper (A-Z).

Edge cases: a null or empty text has no words and fails ``few_words``; texts of any length are read whole; a measurement that equals a
rule's limit (a tie) doesn't fail it; repeated rows and null ids are rows of their own; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: Rules in the order of their bits: name, and when a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
    ("long_words", "word_chars > 15 * n_words"),
    ("duplicate_lines", "n_dup_lines > 20 AND 10 * n_dup_lines > n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules whose failure drops a document.
POLICIES = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "shouting"),
    "v2": ("few_words", "repeats", "symbols", "shouting", "long_words", "duplicate_lines"),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes divide at the six ASCII white-space characters alone
    space = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeat = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        start = np.flatnonzero(times[window] > 1)
        inside = np.zeros(len(words), bool)
        for k in range(3):
            inside[start + k] = True
        repeat = int(inside.sum())
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - space, gone(SYMBOLS), len(lines) - len(set(lines)), repeat, gone(UPPER)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failures``: bit i is set where rule i fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(MEASURES)))], ["doc_id", *MEASURES])

    kind = dict(docs.dtypes)["doc_id"]
    measured = map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    failures = F.lit(0)
    for name, rule in RULES:
        failures = failures.bitwiseOR(F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)))
    return measured.withColumn("failures", failures)


def policy_mask(policy: str, without: tuple[str, ...] = ()) -> int:
    return sum(BITS[name] for name in POLICIES[policy] if name not in without)


def apply_policy(policy: str = "v1", without: tuple[str, ...] = ()) -> Column:
    """Whether a row of the ledger is kept."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy, without))) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, documents that fail it alone, and what is kept without it. Reads the ledger's bits only."""
    patterns = rows.groupBy("failures").agg(F.count("*").alias("n"))
    mask = policy_mask(policy)
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).alias("bit")) for n in POLICIES[policy]])).alias("r")
    each = patterns.select("n", F.col("failures").bitwiseAND(F.lit(mask)).alias("f"), rules).select("n", "f", "r.*")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("f").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        count(F.col("f") == F.col("bit")).alias("failed_alone"),
        count(F.col("f").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )


def quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    rows = ledger(docs)
    base = ~apply_policy("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & apply_policy(policy)).alias("kept"), "failures")
