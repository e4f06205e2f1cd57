"""SimHash near-duplicates by covering locality-sensitive hashing (operator 7).

A fingerprint has 64 bits: bit i is 1 if set in over half of the 64-bit hashes of the text's word shingles. Documents link when their
fingerprints differ in ``RADIUS`` = 3 bits or fewer; a component is what links reach.

Candidates: bit i is given a non-zero vector m(i) of RADIUS + 1 bits. For each of the 15 non-zero vectors v, mask v holds the bits i
where m(i) and v have an odd product. Three differing bits span at most three dimensions of four, so some v is orthogonal to
all of them: its mask has none of these bits and the two fingerprints agree under it. Every pair within the radius thus meets in one
of 15 tables, by structure and not by chance.

At scale: equal fingerprints are one class before anything is shuffled by bucket. Buckets are counted with map-side sums. A bucket
of two is checked by an expression; a bucket of up to ``BUCKET`` classes is checked in one array and returns a spanning forest, not
its pairs. A larger bucket is covered again over the bits that its mask leaves free, and once more after that, which leaves at most
7 free bits, or 128 classes: no bucket is dropped or cut. Components are found by star contraction with a checkpoint a round.

Edge cases: null and empty texts have no shingle, fingerprint 0, and link as any other; texts with one or two words have one
shingle of the whole sequence; texts of any length are read in chunks; repeated rows fall in one component; the component id is the
smallest non-null doc_id in it, and null where all of them are null; a bit set in exactly half of the hashes (a tie) is 0; an empty table
gives an empty result; other columns are ignored by ``components`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, map_batches

SHINGLE, SEED, RADIUS, BUCKET, CHUNK = 3, 42, 3, 2_048, 1 << 20


def shingle_counts(text: str | None, shingle: int = SHINGLE) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit set, and how many hashes there are; the text is read in chunks of about a MB."""
    from xxhash import xxh64_intdigest

    raw, ones, total, carried, start = (text or "").encode().lower(), np.zeros(64, np.int64), 0, [], 0
    while start < len(raw):
        end = start + CHUNK
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = carried + raw[start:end].split()
        start = end
        if start >= len(raw) and not total and 0 < len(words) < shingle:
            hashes = [xxh64_intdigest(b" ".join(words), SEED)]
        else:
            hashes = list(map(xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))), repeat(SEED)))
            carried = words[-(shingle - 1) :] if len(words) >= shingle else words
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            total += len(hashes)
    return ones, total


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    ones, total = shingle_counts(text, shingle)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, fp long")


def cover(places: list[int], dimensions: int = RADIUS + 1) -> list[int]:
    """Masks over the given bit places that cover every set of ``dimensions - 1`` or fewer of them."""
    vectors = (1 << dimensions) - 1
    masks = []
    for v in range(1, vectors + 1):
        masks.append(sum(1 << p for k, p in enumerate(places) if ((k % vectors + 1) & v).bit_count() % 2))
    return masks


def masks_of(level: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(bucket path above, path, mask) of a level; a mask holds those above it. The number is fixed: for a radius of 3 it is 15, 225 or 3,375."""
    rows, ways = [(0, 0, 0)], 1 << radius + 1
    for _ in range(level):
        rows = [(path, path * ways + u + 1, mask | m) for _, path, mask in rows for u, m in enumerate(cover([i for i in range(64) if not mask >> i & 1], radius + 1))]
    return [(a, b, m - (1 << 64) if m >> 63 else m) for a, b, m in rows]


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join what links within a bucket, each to a representative: fewer than the bucket has members."""
    values = np.unique(values)
    left, edges = np.ones(len(values), bool), []
    for i in range(len(values)):
        if not left[i]:
            continue
        left[i] = False
        frontier = values[i : i + 1]
        while len(frontier):  # breadth first; each member is a frontier once
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = np.zeros(len(rest), bool)
            for k in range(0, len(frontier), 256):
                near |= (np.bitwise_count(values[rest][None, :] ^ frontier[k : k + 256, None]) <= radius).any(0)
            left[rest[near]] = False
            frontier = values[rest[near]]
            edges.extend((int(values[i]), int(f)) for f in frontier)
    return edges


def _forests(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for members in batch.column(0) for e in forest(members.values.to_numpy(), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b), a < b, that span the components of the distinct fingerprints ``classes.fp``; a path of exact links joins what is linked."""
    spark = classes.sparkSession
    rows, found = classes.select(F.lit(0).alias("path"), "fp"), []
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    for level in (1, 2, 3):
        if level == 1:
            masked = rows.select("fp", F.explode(F.array(*[F.struct(F.lit(path).alias("path"), F.lit(mask).cast("long").alias("mask")) for _, path, mask in masks_of(1, radius)])).alias("m")).select("fp", "m.*")
        else:
            masks = spark.createDataFrame(masks_of(level, radius), "above int, path int, mask long")  # 225 or 3,375 rows for a radius of 3
            masked = rows.withColumnRenamed("path", "above").join(F.broadcast(masks), "above")
        keyed = masked.select("path", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = cut(keyed.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        found.append(sizes.where("n = 2").where(near).select("a", "b"))
        most = bucket if level < 3 else 1 << 60  # at most 128 by then, for a radius of 3
        some = keyed.join(sizes.where((F.col("n") > 2) & (F.col("n") <= most)).select("path", "key"), ["path", "key"], "left_semi")
        whole = some.groupBy("path", "key").agg(F.collect_list("fp").alias("members"))
        found.append(whole.select("members").mapInArrow(_forests(radius), "a long, b long"))
        large = sizes.where(F.col("n") > most).select("path", "key")
        if large.isEmpty():
            break
        rows = keyed.join(large, ["path", "key"], "left_semi").select("path", "fp")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge, root the smallest node of its component, by alternating large-star and small-star steps.

    A node's smallest neighbour is a map-side minimum; it is written before it is joined, so that Spark can split a node with very
    many neighbours.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a > b from here on: every edge points from a node to a smaller one
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while (mark := state(now)) != before:
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours move to the smallest
        now = cut(large.where("a <> b").distinct())
        least = cut(now.groupBy("a").agg(F.min("b").alias("m")))
        small = now.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = contract(links(classes, radius))
    rooted = cut(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that Spark can split a large component
    named = cut(rooted.join(ids, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` whose id is that of their component; its columns stay as they are. Rows without an id stay.

    The ids that go are counted; they are broadcast where they are few and joined by shuffling where not. Rows that repeat an id that
    stays are not told apart here: exact de-duplication comes first.
    """
    gone = cut(components(docs, shingle, radius).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    gone = broadcast_if_small(gone)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
