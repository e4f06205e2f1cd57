"""Mixing sources to target weights (operator 6).

Every source's words stand in one row, document after document, and are cut into blocks of ``BLOCK`` words (a source's last block may be
shorter). The mix is a row of slots, cut into output shards of ``SHARD_SLOTS``. Each slot draws its source by the sources' shares from a
hash of the seed, its shard and its place, so that a shard's counts are a multinomial draw that any executor can make alone. Sources
drawn more often than planned (by about the root of their slots) hand their last slots over to those drawn less often: totals come
out as planned to the word. A source's j-th slot takes block perm(j mod n) of its n blocks, where perm is a pseudorandom permutation of the
indices (a keyed Feistel network, another key in each pass), and blocks are joined to documents by index. Of the last pass a source takes
as many blocks as its target needs, and of the last block or two only the first words.

Targets: weights share 100 % of all words; a target stops at ``MOST`` times its source's size and what is over goes to the others by
weight until none is above.

At scale: sources are a table, never gathered; the driver learns sums alone. Slots are made, drawn, permuted and counted where Spark puts
them; the sources' shares are joined to slots by ranges of the draw, broadcast if they are small. A source's place sums go by buckets
of its documents, and sums over a source's buckets and shards by ranges, so no task holds all of a source.

Edge cases: a null text has no word; a null source is a source of its own, after the others; sources without words have target 0; one
long text is many blocks; rows that repeat, and null ids, are rows of their own; ties in a source's order change nothing but which of
two equal rows is meant; an empty table gives an empty result; other columns are ignored, and kept by ``take``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, cut, fraction_of, running, running_within

WEIGHTS, MOST, BLOCK, SHARD_SLOTS, PLACE_ROWS, RUN_SLOTS, RANGE_SLOTS, SEED = (5.0, 2.0, 1.0), 3, 512, 1 << 14, 1_000, 4_096, 1 << 20, 20240607
#: A word with the white space behind it, and for the first word that before it: the pieces of a text add up to the text.
_WORD_AND_SPACE = rf"(?:\A[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"))


def sources_of(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """From (source, size): one row a source, with its number ``k`` by code point (null last), ``source_size``, ``docs`` and ``weight``."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    numbered = running(totals, [F.col("source").asc_nulls_last()], F.lit(1), "k")
    return cut(numbered.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights)).cast("int"))))


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """``sources`` with ``target``: shares of all words by weight, stopped at ``most`` times a source's size, the excess shared by weight.

    A source stops where its share at some level of words a weight is above its stop, and levels only rise: each round stops all sources
    that are above at its level, and the driver learns three sums of it.
    """
    stop, level = most * F.col("source_size").cast("double"), 0.0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while total:
        free = (F.col("source_size") > 0) & (level * F.col("weight") <= stop)
        held, weight = sources.agg(F.coalesce(F.sum(F.when(~free, stop)), F.lit(0.0)), F.sum(F.when(free, F.col("weight")))).first()
        if weight is None or (risen := (total - held) / weight) <= level:
            break
        level = risen
    return sources.withColumn("target", F.least(level * F.col("weight"), stop))


def planned(sources: DataFrame) -> DataFrame:
    """``sources`` with ``target``, ``blocks``, ``passes`` (whole ones), ``rest`` (words of the last pass), ``fulls`` (its whole blocks) and ``slots``.

    The last pass takes ``fulls`` blocks, of which one may be the shorter last block, and the words that are then lacking from one or
    two more.
    """
    words = F.round("target").cast("long")
    size = F.greatest("source_size", F.lit(1))
    short = (F.col("blocks") * BLOCK - F.col("source_size")).alias("short")
    table = targets(sources).select("*", F.ceil(F.col("source_size") / BLOCK).cast("long").alias("blocks"), ((words - words % size) / size).cast("long").alias("passes"), (words % size).alias("rest"))
    table = table.select("*", short, F.expr(f"rest div {BLOCK}").alias("fulls"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # where the last pass takes the last block: only then is it known how many words the whole blocks have
            n = np.maximum(batch["blocks"].to_numpy(np.int64), 1)
            at = permuted(n - 1, n, keys(batch["k"].to_numpy(np.int64), batch["passes"].to_numpy(np.int64)), back=True)
            lacking = batch["rest"] - batch["fulls"] * BLOCK + np.where(at < batch["fulls"], batch["short"], 0)
            third = (at == batch["fulls"]) & (lacking > BLOCK - batch["short"]) | (lacking > BLOCK)  # one more block is not enough
            yield batch.assign(lacking=lacking, slots=np.where(batch["source_size"] > 0, batch["passes"] * batch["blocks"] + batch["fulls"] + (lacking > 0) + (third & (lacking > 0)), 0))

    return cut(table.mapInPandas(place, ", ".join(f"{n} {t}" for n, t in table.dtypes) + ", lacking long, slots long"))


def keys(k: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Of the permutation of a source's pass."""
    return SEED + 7_919 * k + 104_729 * turn


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 takes each index, or whence: a Feistel network over the next even number of bits, walked until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo, key = index.astype(np.uint64), np.ones(len(index), bool), np.asarray(key).astype(np.uint64)

    def mixed(b: np.ndarray, k: np.ndarray, turn: int, m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            f = (b + k + np.uint64(turn)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (f ^ (f >> np.uint64(30))) & m

    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for turn in range(4):
            if back:
                a, b = b ^ mixed(a, k, 3 - turn, m), a
            else:
                a, b = b, a ^ mixed(b, k, turn, m)
        x[todo] = (a << h) | b
        todo[todo] = x[todo] >= n[todo].astype(np.uint64)
    return x.astype(np.int64)


def shard_counts(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, k, first, n): how many slots each shard takes of each source, and the number of the first of them among the source's.

    ``plan`` has ``k`` and ``slots``. Every slot draws; what a source got beyond its ``slots`` goes, slot by slot, to the sources that got
    fewer.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("slots")).first()[0] or 0
    upto = running(plan.where("slots > 0").select("k", "slots"), [F.col("k")], F.col("slots"), "low")
    # The shares as ranges of [0, total); a draw meets the ranges that reach into its bucket.
    ranges = max(1, total // RANGE_SLOTS, min(total, plan.count()))
    width = -(-total // ranges) if total else 1
    shares = cut(upto.select("k", "low", (F.col("low") + F.col("slots")).alias("high")).select("*", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("bucket")))
    slots = spark.range(0, total, 1, max(1, min(total // RANGE_SLOTS + 1, 100_000)) if total > RANGE_SLOTS else min(8, max(1, total // 4096)))
    shard = F.expr(f"id div {shard_slots}")
    draw = F.floor(F.pmod(F.xxhash64(F.lit(seed), shard, "id"), F.lit(1 << 52)) / float(1 << 52) * total).cast("long")
    drawn = slots.select(shard.alias("shard"), draw.alias("u")).withColumn("bucket", F.expr(f"u div {width}")).join(broadcast_if_small(shares), "bucket").where("u >= low AND u < high")
    counts = cut(drawn.groupBy("shard", "k").agg(F.count("*").alias("n")))
    firsts = cut(running_within(counts, "k", ["shard"], F.col("n"), "first").join(broadcast_if_small(cut(plan.select("k", "slots"))), "k"))
    kept = firsts.where("first < slots").select("shard", "k", "first", F.least("n", F.col("slots") - F.col("first")).alias("n"))
    over = firsts.where("first + n > slots").select("shard", "k", (F.col("n") - F.greatest(F.lit(0), F.col("slots") - F.col("first"))).alias("n"))
    got = counts.groupBy("k").agg(F.sum("n").alias("got"))
    lacking = plan.select("k", "slots").join(got, "k", "left").select("k", F.coalesce("got", F.lit(0)).alias("first"), (F.col("slots") - F.coalesce("got", F.lit(0))).alias("n")).where("n > 0")
    # Slots handed over and slots lacking are as many: the r-th of the ones is the r-th of the others.
    one_by_one = lambda df, order, out: running(df, order, F.col("n"), "r").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select((F.col("r") + F.col("i")).alias("r"), *out)
    given = one_by_one(over, [F.col("shard"), F.col("k")], ["shard"])
    taken = one_by_one(lacking, [F.col("k")], ["k", (F.col("first") + F.col("i")).alias("first")])
    return kept.union(given.join(taken, "r").select("shard", "k", "first", F.lit(1).cast("long").alias("n")))


def block_counts(plan: DataFrame, shards: DataFrame) -> DataFrame:
    """(k, block, words, times) of the blocks that the mix takes: every slot of every shard, permuted to a block of its source, and counted.

    ``words``: how many of the block's words a slot takes, from its first on.
    """
    runs = shards.join(broadcast_if_small(plan), "k").select("k", "blocks", "passes", "fulls", "short", "lacking", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN_SLOTS).cast("long"))).alias("skip"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = batch.to_numpy(np.int64)
            size = np.minimum(RUN_SLOTS, runs[:, 7] - runs[:, 8])
            for at in np.array_split(np.arange(len(runs)), max(1, size.sum() // 65_536)):
                k, blocks, passes, fulls, short, lacking, first, _, skip = np.repeat(runs[at], size[at], axis=0).T
                slot = first + skip + np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
                turn, index = slot // blocks, slot % blocks
                block = permuted(index, blocks, keys(k, turn))
                whole = np.where(block == blocks - 1, BLOCK - short, BLOCK)
                # Slots behind the last pass's whole blocks take what is lacking: the first all it has, the second the rest.
                behind, held = index - fulls, np.zeros_like(block)
                second = (turn == passes) & (behind == 1)
                if second.any():
                    one = permuted(index[second] - 1, blocks[second], keys(k[second], turn[second]))
                    held[second] = np.where(one == blocks[second] - 1, BLOCK - short[second], BLOCK)
                words = np.where((turn == passes) & (behind >= 0), np.minimum(whole, lacking - held), whole)
                yield pd.DataFrame({"k": k, "block": block, "words": words})

    return runs.mapInPandas(place, "k long, block long, words long").groupBy("k", "block", "words").agg(F.count("*").alias("times"))


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size and others) with their source's number, size and target, and with ``start``, their place among its words."""
    sources = plan.select("k", F.col("source").alias("__source"), "source_size", "target", F.ceil(F.col("docs") / PLACE_ROWS).alias("buckets"))
    size = rows.join(broadcast_if_small(cut(sources)), F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source").withColumn("docs_bucket", (fraction_of(F.col("doc_id"), F.col("size")) * F.col("buckets")).cast("int"))
    sums = cut(size.groupBy("k", "docs_bucket").agg(F.sum("size").alias("bucket_size")))
    starts = cut(running_within(sums, "k", ["docs_bucket"], F.col("bucket_size"), "bucket_start").drop("bucket_size"))
    within = Window.partitionBy("k", "docs_bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return cut(size.join(starts, ["k", "docs_bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("bucket_start", "docs_bucket", "buckets"))


def pieces(places: DataFrame, counts: DataFrame) -> DataFrame:
    """(k, start, size, from, words, times): the parts of documents that the mix takes, by blocks; ``start`` is a row's own among rows with words."""
    first, last = F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")
    parts = places.where("size > 0").select("k", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    words = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("words")) - begin
    return parts.join(counts, ["k", "block"]).select("k", "start", "size", (begin - F.col("start")).alias("from"), words.alias("words"), "times").where("words > 0")


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """From (doc_id, source, size): size, source_size, target and taken words of every row.

    The i-th source by code point (null last) weighs ``weights[i % len(weights)]``.
    """
    rows = cut(rows.select("doc_id", "source", "size"))
    plan = planned(sources_of(rows, weights))
    places = placed(rows, plan)
    taken = pieces(places, block_counts(plan, shard_counts(plan))).groupBy("k", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("words"))
    return places.join(taken, ["k", "start", "size"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: for every block taken and every document in it one row of ``docs``, with the words of that document in the block as ``text``.

    The other columns stay as they are. A document's parts add up to its text as often as it is taken whole.
    """
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))  # numbered before it is written: the numbers stay
    plan_rows = cut(rows.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), "__row"))
    plan = planned(sources_of(plan_rows, weights))
    places = placed(plan_rows, plan)
    parts = places.select("k", "start", "size", "__row").join(pieces(places, block_counts(plan, shard_counts(plan))), ["k", "start", "size"])
    # A row's parts by its number: at most three for each 512 words and each part of a block taken in part.
    wanted = cut(parts.groupBy(F.col("__row").alias("__id")).agg(F.collect_list(F.struct("from", "words", "times")).alias("__parts")))
    again = rows.join(wanted, rows["__row"] == wanted["__id"])
    words = F.regexp_extract_all("text", F.lit(_WORD_AND_SPACE), 0)
    part = lambda w, p: F.array_repeat(F.array_join(F.slice(w, (p["from"] + 1).cast("int"), p["words"].cast("int")), ""), p["times"].cast("int"))
    texts = F.transform(F.array(words), lambda w: F.flatten(F.transform("__parts", lambda p: part(w, p))))[0]  # bound to w, a text is divided once
    return again.withColumn("__text", F.explode(texts)).select(*[F.col("__text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
