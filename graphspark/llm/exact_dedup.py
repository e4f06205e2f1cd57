"""Exact de-duplication against a history, through a minimal perfect hash (operator 4).

The history's distinct digests (SHA-256 of the text with A-Z lower-cased) are dealt into buckets by their first bytes, about ``BUCKET``
a bucket of the history's or the arrivals' digests, whichever are more. Each bucket gets a minimal perfect hash of its own: levels of bit arrays, where a digest's bit stays set if no
other digest of the level falls on it, and the others go on to the next level; a digest's slot is the rank of its bit. A slot holds
the full digest, the winner's locator (largest doc_id) and the number of copies. Arrivals are summed by digest with map-side
sums, meet the bucket's table, and are members only where all 32 bytes of the slot's digest are theirs: members' copies join
the slot, nonmembers are groups of their own.

``deduplicate(docs, history)`` tells of the rows of one table what another and the table itself hold. Over one table ``deduplicate_one``
takes about half of the rows, by a hash of the id, as history and the others as arrivals; every row is in one of the two.

Edge cases: a null text counts as empty; a null doc_id loses to any other; rows that repeat both doc_id and text are one
candidate, of which one copy alone is kept (the history's, where it has one); texts of any length are read once; ties can't occur, as
the largest id stays; an empty table, or an empty history, gives an empty result or one over the other rows; other columns are
ignored, whatever their names, and kept as they are by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, map_batches

BUCKET, SPREAD, DIGEST, _NONE = 32_768, 1.5, 32, -(1 << 63)
#: Of each slot, packed: winner (64 bits), whether the winner has no id (a byte), copies (64 bits).
_SLOTS = "bucket int, levels binary, digests binary, winners binary, nameless binary, copies binary"
_GROUP = "digest binary, keep_id long, n long"


def digest_of(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode().lower()).digest()  # bytes.lower() changes A-Z alone


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digest of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest_of(t.as_py()) for t in batch.column(1)], pa.binary())], ["doc_id", "digest"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], run, "doc_id long, digest binary")


def _parts(table: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) as four 64-bit numbers each."""
    return np.ascontiguousarray(table).view("<u8").reshape(-1, 4)


def _bit(parts: np.ndarray, level: int, size: int) -> np.ndarray:
    """A digest's bit on a level."""
    with np.errstate(over="ignore"):
        x = np.zeros(len(parts), np.uint64)
        for k in range(4):
            x = (x ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15 + 2 * level) + np.uint64(level)
            x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def build(table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels' bit arrays for distinct digests, and each digest's slot."""
    parts, left, levels, slots, used = _parts(table), np.arange(len(table)), [], np.full(len(table), -1, np.int64), 0
    while len(left):
        size = max(8, math.ceil(SPREAD * len(left)))
        at = _bit(parts[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        slots[left[alone[at]]] = used + (np.cumsum(alone) - 1)[at[alone[at]]]
        used += int(alone.sum())
        left = left[~alone[at]]
        levels.append(alone)
    return levels, slots


def find(levels: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 where no level takes it. Only the slot's digest tells a member."""
    parts, left, slots, used = _parts(table), np.arange(len(table)), np.full(len(table), -1, np.int64), 0
    for n, bits in enumerate(levels):
        at = _bit(parts[left], n, len(bits))
        hit = bits[at]
        slots[left[hit]] = used + (np.cumsum(bits) - 1)[at[hit]]
        used += int(bits.sum())
        left = left[~hit]
    return slots


def _pack(levels: list[np.ndarray]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in levels)


def _unpack(raw: bytes) -> list[np.ndarray]:
    levels, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at + 8), count=size).astype(bool))
        at += 8 + (size + 7) // 8
    return levels


def _table(digest_column) -> np.ndarray:
    return np.frombuffer(b"".join(digest_column), np.uint8).reshape(-1, DIGEST)


def groups_of(rows: DataFrame) -> DataFrame:
    """digest, keep_id (largest doc_id) and n of each distinct digest; summed before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket")


def _ids(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the smallest number for null, and where they are null."""
    ids = column.astype("Int64")
    return ids.fillna(_NONE).to_numpy(np.int64), ids.isna().to_numpy(bool)


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: its hash, and its slots in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = _table(rows["digest"])
        levels, slots = build(table)
        order = np.argsort(slots)
        winners, nameless = _ids(rows["keep_id"])
        packed = {"digests": table, "winners": winners, "nameless": nameless, "copies": rows["n"].to_numpy(np.int64)}
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "levels": [_pack(levels)], **{k: [v[order].tobytes()] for k, v in packed.items()}})

    return groups.select(_bucket(buckets), "digest", "keep_id", "n").groupBy("bucket").applyInPandas(run, _SLOTS)


def look_up(index: DataFrame, arrivals: DataFrame, buckets: int) -> DataFrame:
    """Groups (digest, keep_id, n) of the history and the arrivals' groups together."""

    def run(slots: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        held = slots.iloc[0] if len(slots) else {k: b"" for k in ("levels", "digests", "winners", "nameless", "copies")}
        table, asked = _table([held["digests"]]), _table(new["digest"])
        winners, nameless, copies = (np.frombuffer(held[k], kind).copy() for k, kind in (("winners", np.int64), ("nameless", bool), ("copies", np.int64)))
        (ids, none), n = _ids(new["keep_id"]), new["n"].to_numpy(np.int64)
        at = find(_unpack(held["levels"]), asked)
        member = at >= 0
        member[member] = (table[at[member]] == asked[member]).all(1)  # all 32 bytes
        slot, other = at[member], ~member
        winners[slot], nameless[slot], copies[slot] = np.maximum(winners[slot], ids[member]), nameless[slot] & none[member], copies[slot] + n[member]
        keep = pd.array(np.concatenate([winners, ids[other]]), "Int64")
        keep[np.concatenate([nameless, none[other]])] = pd.NA
        digests = np.concatenate([table, asked[other]]).view(f"V{DIGEST}").ravel().tolist()
        return pd.DataFrame({"digest": digests, "keep_id": keep, "n": np.concatenate([copies, n[other]])})

    asked = arrivals.select(_bucket(buckets), "digest", "keep_id", "n")
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(run, _GROUP)


def joint_groups(history: DataFrame, arrivals: DataFrame) -> DataFrame:
    """From rows (doc_id, digest) of both: the groups of equal texts."""
    past, new = cut(groups_of(history)), cut(groups_of(arrivals))
    buckets = max(1, math.ceil(max(past.count(), new.count()) / BUCKET))
    return look_up(build_index(past, buckets), new, buckets)


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return rows.where(old), rows.where(~old)


def _told(rows: DataFrame, groups: DataFrame) -> DataFrame:
    joined = rows.join(groups, rows.digest == groups.text_digest)
    # Rows that repeat doc_id and text: one is kept. Only winners are numbered, so a group is one row unless rows repeat.
    first = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("doc_id")) == 1
    winners = joined.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", first)
    others = joined.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    return winners.union(others).select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, history: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``; groups are of the rows of both tables."""
    new, old = cut(digests(docs)), cut(digests(history))
    told = _told(new, cut(joint_groups(old, new).withColumnRenamed("digest", "text_digest")))
    held = old.select(F.col("doc_id").alias("__id"), F.lower(F.hex("digest")).alias("__sha")).distinct().withColumn("__held", F.lit(True))
    told = told.join(held, (F.col("text_sha256") == F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return told.select("doc_id", "keep_id", "group_size", (F.col("kept") & F.col("__held").isNull()).alias("kept"), "text_sha256")


def deduplicate_one(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = cut(digests(docs))
    return _told(rows, cut(joint_groups(*_halves(rows)).withColumnRenamed("digest", "text_digest")))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, one for each text; the columns stay as they are.

    Where every row has an id of its own, the ids that go are counted: few are broadcast, more are joined by shuffling. Else rows are
    told apart by id and digest.
    """
    rows = cut(digests(docs))
    groups = cut(joint_groups(*_halves(rows)).withColumnRenamed("digest", "text_digest"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        joined = rows.join(groups, rows.digest == groups.text_digest)
        gone = cut(joined.where("doc_id <> keep_id").select(F.col("doc_id").alias("__gone")))
        gone = broadcast_if_small(gone)
        return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti").select(*names)
    # Ids that several rows share: rows are told apart by id and digest, and numbered among those that agree in both.
    marked = docs.select(F.struct(*names).alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.unhex(F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256)).alias("__digest"))
    kept = marked.join(groups, (F.col("__digest") == F.col("text_digest")) & F.col("__id").eqNullSafe(F.col("keep_id")))
    one = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__digest").orderBy("__id"))).where("__n = 1")
    return one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
