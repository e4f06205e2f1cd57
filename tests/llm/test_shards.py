"""Shards along the Hilbert curve: ranks rebuilt by brute force, pruning, and what is written."""

import random
import zlib

from graphspark.llm import hilbert_shard


def _docs(spark, n=3_000, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i % 700, i]), "x" * int(rng.paretovariate(0.5) % 50_000), rng.choice([None, "de", "en", "fr"]), "hot" if i % 3 == 0 else f"s{rng.randint(0, 90):02d}", 1) for i in range(n)]
    return spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string, source string, cell int")


def test_ranks_follow_the_curve(spark):
    """Every rank once; cells in the order of the curve; and the shard and slot that the rank gives."""
    docs = _docs(spark)
    rows = sorted(hilbert_shard.ranked(hilbert_shard.metadata(docs)).collect(), key=lambda r: r.rank)
    n = docs.count()
    assert [r.rank for r in rows] == list(range(n)) and all(a.cell <= b.cell for a, b in zip(rows, rows[1:]))
    shards = sorted((r.shard, r.slot) for r in hilbert_shard.shard(docs, 7).collect())
    counts = [sum(s == k for s, _ in shards) for k in range(7)]
    assert max(counts) - min(counts) <= 1 and shards == [(k, i) for k in range(7) for i in range(counts[k])]


def test_shards_cover_short_ranges(spark):
    """Of the sources that a shard could cover, and of a filter's shards: fewer than half are read, where a hash reads all."""
    docs = _docs(spark)
    ranges = hilbert_shard.shard_ranges(docs, 20).collect()
    assert sum(r.rows for r in ranges) == docs.count() and all(r.min_source <= r.max_source and r.min_size <= r.max_size for r in ranges)
    read = [sum(r.min_source <= s <= r.max_source for r in ranges) / 20 for s in [f"s{i:02d}" for i in range(91)]]
    by_size = [sum(r.min_size <= x <= r.max_size for r in ranges) / 20 for x in (20, 100, 1_000, 30_000)]
    assert sum(read) / len(read) < 0.6 and sum(by_size) / len(by_size) < 0.6


def test_written_shards_hold_every_row_once(spark, tmp_path):
    docs = _docs(spark, 400).drop("cell").withColumnRenamed("lang", "lang")
    rows = [(1, "a", "en", "s"), (1, "b", "en", "s"), (None, "c", None, None), (None, "c", None, None), (2, None, "de", "t")]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    hilbert_shard.write_shards(docs, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: tuple(str(x) for x in (r.doc_id, r.text, r.lang, r.source))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    counts = {}
    for r in back.collect():
        counts.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in counts.values()) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1


def test_edges(spark):
    frame = spark.createDataFrame([(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, "é" * 500_000, "en", "b")], "doc_id long, text string, lang string, source string")
    got = sorted((r["size"], r.text_crc32) for r in hilbert_shard.shard(frame).collect())
    assert got == [(16, 0), (16, 0), (16, 0), (1_000_016, zlib.crc32(("é" * 500_000).encode()))]
    assert hilbert_shard.shard(frame.limit(0)).count() == 0 and hilbert_shard.shard_ranges(frame.limit(0)).count() == 0
