"""Which of many terms stand in which texts: one automaton over the terms, one pass over the texts.

Terms are gathered in blocks of ``BLOCK`` terms and ``BLOCK_BYTES`` of UTF-8, so that the driver and a task never hold more than one block;
beyond that the texts are read once for each block. What a text holds is written once for each term, not for each place. A
worker builds the automaton of a block once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, BLOCK_BYTES, BATCH_BYTES = 100_000, 8 << 20, 4 << 20
_kept: list = []


def hits(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", words: bool = False) -> DataFrame:
    """``texts`` without its text, with a row for each of the distinct non-empty terms (column ``term``) that it holds.

    As a substring, or with ``words`` only where no letter, digit or underscore (of ASCII) continues the term on a side where it has one.
    """
    distinct = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    keys = [c for c in texts.columns if c != text]
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // BLOCK), -(-size.bytes // BLOCK_BYTES))
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    out = None
    for k in range(blocks):
        own = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        found = _pass(texts.select(*keys, F.col(text).alias("__text")), sorted(r.term for r in own.collect()), term, words)
        out = found if out is None else out.union(found)
    return out


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _stands(text: str, end: int, term: str) -> bool:
    """Whether the term that ends at a place is a word or row of words there."""
    start = end - len(term) + 1
    before = start > 0 and _word(term[0]) and _word(text[start - 1])
    after = end + 1 < len(text) and _word(term[-1]) and _word(text[end + 1])
    return not (before or after)


def _pass(texts: DataFrame, terms: list[str], out: str, words: bool) -> DataFrame:
    shared, key = texts.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField(out, T.StringType())])

    def automaton():
        import ahocorasick

        if not _kept or _kept[0] != key:
            built = ahocorasick.Automaton()
            for t in shared.value:
                built.add_word(t, t)
            built.make_automaton()
            _kept[:] = [key, built]
        return _kept[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton()
        for batch in batches:
            rows, found = [], []
            if shared.value:
                for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    held = {x for end, x in built.iter(t) if not words or _stands(t, end, x)} if t else ()
                    rows.extend([i] * len(held))
                    found.extend(held)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.array(found, pa.string())], [*batch.schema.names[:-1], out])

    return texts.mapInArrow(run, schema)
