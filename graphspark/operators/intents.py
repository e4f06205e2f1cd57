"""Intents: filters, de-duplication, clustering and batches."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import broadcast_if_small, cut, numbered_within, ranges_for
from ..functions.text import normalize_intent, split_persona
from ..functions.values import BRANCH_TYPES, BRANCH_WORDS, NON_FUNCTIONAL, QUERY_WORDS, ROUTE_WORDS
from . import metric_tree

#: Vectors of a block; a pair of blocks is one task's work.
BLOCK = 4_096

def filter_non_functional(intents: DataFrame, keywords=NON_FUNCTIONAL) -> DataFrame:
    """Intents whose text holds none of the keywords. The text is split off once a row: as the one item of an array, and not again for each keyword."""
    said = lambda text: reduce(lambda a, k: a | text.contains(k), keywords, F.lit(False))
    return intents.where(~F.transform(F.array(split_persona("intent")[1]), said)[0])


def normalized_dedup(intents: DataFrame) -> DataFrame:
    """One row a normalised text: the longest intent (ties: first in order) and how many were merged."""
    rows = intents.select("intent").distinct().withColumn("norm", normalize_intent("intent"))
    return rows.groupBy("norm").agg(F.min(F.struct((-F.length("intent")).alias("n"), "intent")).alias("m"), F.count("*").alias("merged")).select("norm", F.col("m.intent").alias("intent"), "merged")


def attach_embeddings(intents: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intents with the embedding of their normalised text, and the texts that have none."""
    rows = intents.withColumn("norm", normalize_intent("intent")).join(cache, "norm", "left")
    return rows, rows.where("embedding IS NULL").select("norm").distinct()


def _blocks(vectors: DataFrame, eps: float, block: int) -> DataFrame:
    """(grp, i, j, part, id, embedding): every pair of blocks of a group that can hold linked vectors, by a metric tree."""
    rows, wanted = metric_tree.block_pairs(vectors, eps, block)
    both = wanted.select("grp", "i", "j", F.col("i").alias("part")).union(wanted.where("i < j").select("grp", "i", "j", F.col("j").alias("part")))
    return rows.join(broadcast_if_small(both), ["grp", "part"])


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (id, grp, embedding, n) for equal vectors of a group, with the smallest id, and (id, rep, n) of the others: copies are compared once."""
    rows = vectors.where("embedding IS NOT NULL").select("id", "grp", "embedding")
    one = cut(rows.groupBy("grp", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    others = rows.join(one.where("n > 1"), ["grp", "embedding"]).where("id <> rep").select("id", "rep", "n")
    return one.select(F.col("rep").alias("id"), "grp", "embedding", "n"), others


def _with_direction(embedding: str = "embedding") -> Column:
    """Whether a vector isn't zero: only such are linked to their copies."""
    return F.exists(embedding, lambda x: x != 0)


def _close(t: pd.DataFrame, key: tuple, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a pair of blocks: ids of some rows of the one and of all of the other, and which of them are linked."""
    a, b = t[t["part"] == key[1]], t[t["part"] == key[2]]
    if not len(a) or not len(b):
        return
    x, y, p, q = metric_tree.unit(a["embedding"]), metric_tree.unit(b["embedding"]), a["id"].to_numpy(), b["id"].to_numpy()
    for k in range(0, len(x), 512):
        yield p[k : k + 512], q, (x[k : k + 512] @ y.T >= 1 - eps - 1e-12) & (p[k : k + 512, None] != q[None, :])


def similar_pairs(vectors: DataFrame, eps: float = 0.20, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, of one group at cosine distance eps or less: all pairs. ``similar_links`` and ``cluster`` write no pairs."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": np.minimum(p[x], q[y]), "b": np.maximum(p[x], q[y])}) for p, q, close in _close(t, key, eps) for x, y in [np.nonzero(close)]]
        return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"a": [], "b": []})

    return _blocks(vectors, eps, block).groupBy("grp", "i", "j").applyInPandas(run, "a long, b long").distinct()


def similar_links(vectors: DataFrame, eps: float = 0.20, block: int = BLOCK) -> DataFrame:
    """(id, links): how many other vectors of its group are at cosine distance eps or less; ids are unique. Equal vectors are compared once and counted with their number."""
    one, others = classes(vectors)

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        found, times = [], dict(zip(t["id"], t["n"]))
        for p, q, close in _close(t, key, eps):
            found.append(pd.DataFrame({"id": p, "links": close @ np.array([times[i] for i in q], np.int64)}))
            if key[1] != key[2]:
                found.append(pd.DataFrame({"id": q, "links": np.array([times[i] for i in p], np.int64) @ close}))
        return pd.concat(found).groupby("id", as_index=False)["links"].sum() if found else pd.DataFrame({"id": [], "links": []})

    blocks = _blocks(one, eps, block).join(one.select("id", "n"), "id")
    met = blocks.groupBy("grp", "i", "j").applyInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    own = F.when((F.lit(eps) >= 1) | _with_direction(), F.col("n") - 1).otherwise(0)
    whole = cut(one.select("id", own.alias("copies")).join(met, "id", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies")).alias("links")))
    return whole.union(others.select("id", "rep").join(whole.withColumnRenamed("id", "rep"), "rep").select("id", "links"))


def similar_forest(vectors: DataFrame, eps: float = 0.20, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the same vectors as all linked pairs do, fewer than rows in each pair of blocks."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        ids, parts = t["id"].to_numpy(), t["part"].to_numpy()
        a, b = np.flatnonzero(parts == key[1]), np.flatnonzero(parts == key[2])
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        unit, left, edges = metric_tree.unit(t["embedding"]), np.zeros(len(t), bool), [pd.DataFrame({"a": ids[:0], "b": ids[:0]})]
        for k in range(0, len(a), 512):
            close = (unit[a[k : k + 512]] @ unit[b].T >= 1 - eps - 1e-12) & (a[k : k + 512, None] != b[None, :])
            left[a[k : k + 512]] |= close.any(1)
            left[b] |= close.any(0)
        for seed in np.flatnonzero(left):  # those with a link
            if not left[seed]:
                continue
            left[seed], frontier = False, np.array([seed])
            while len(frontier):  # breadth first from one side to the other; each vector is a frontier once
                reached = np.zeros(len(t), bool)
                for own, other in ((a, b), (b, a)) if key[1] != key[2] else ((a, b),):
                    rest = other[left[other]]
                    part = frontier[np.isin(frontier, own)]
                    for k in range(0, len(part), 512):
                        if len(rest):
                            reached[rest] |= (unit[part[k : k + 512]] @ unit[rest].T >= 1 - eps - 1e-12).any(0)
                frontier = np.flatnonzero(reached)
                left[frontier] = False
                edges.append(pd.DataFrame({"a": np.full(len(frontier), ids[seed]), "b": ids[frontier]}))
        return pd.concat(edges)

    return _blocks(vectors, eps, block).groupBy("grp", "i", "j").applyInPandas(run, "a long, b long").where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id that links (a, b) reach. Smallest labels spread over links and jump over themselves, until none changes; each round is checkpointed."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("cluster")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("n"))
        new = label.join(near, "id").select("id", F.least("cluster", "n").alias("cluster"), F.col("cluster").alias("was"))
        jump = new.select(F.col("id").alias("cluster"), F.col("cluster").alias("further"))
        new = cut(new.join(jump, "cluster", "left").select("id", F.coalesce("further", "cluster").alias("cluster"), "was"))
        settled = new.where("cluster <> was").isEmpty()
        label = new.select("id", "cluster")
        if settled:
            return label


def cluster(vectors: DataFrame, eps: float = 0.20, block: int = BLOCK) -> DataFrame:
    """(id, grp, cluster): clusters by smallest member, null for noise and for rows without an embedding. Equal vectors are compared once."""
    one, others = classes(vectors)
    found = components(similar_forest(one, eps, block))
    linked = one.where((F.lit(eps) >= 1) | _with_direction()).where("n > 1").select("id", F.col("id").alias("own"))
    of = cut(found.join(linked, "id", "full_outer").select("id", F.coalesce("cluster", "own").alias("cluster")))  # the class has the smallest id
    of = of.union(others.select("id", "rep").join(of.withColumnRenamed("id", "rep"), "rep").select("id", "cluster"))
    return vectors.select("id", "grp").join(of, "id", "left")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.sum(F.col("cluster").isNull().cast("int")).alias("singletons"))


def fixed_batches(df: DataFrame, key: str, order: str, n: int, parts: int | None = None) -> DataFrame:
    """``df`` with ``batch``: rows of a key in order, ``n`` a batch. Numbered over ranges, so that a key with all rows is the work of many tasks."""
    return numbered_within(df, key, [order], "__at", parts).withColumn("batch", F.floor(F.col("__at") / n).cast("long")).drop("__at")


def capacity_batches(df: DataFrame, cap: int, solo_at_cap: bool = False, parts: int | None = None) -> DataFrame:
    """(grp, pos, size) with ``batch``: next-fit within a group, in the order of pos (unique in its group).

    Rows are sorted in ranges of (grp, pos), ``parts`` of them or as many as their count asks for. What a range does to a batch that is open before it depends on how full that is, but
    only until the range opens a batch of its own: a range is summed up as a few cases (one for each of its rows that could open the first
    batch). Those are chained for each group, a row a case, and the ranges are then packed each for itself.
    """
    kinds = dict(df.dtypes)
    ranges = cut(df.select("grp", "pos", "size").repartitionByRange(parts or ranges_for(df), "grp", "pos").withColumn("part", F.spark_partition_id()))

    def cases(t: pd.DataFrame) -> pd.DataFrame:
        """The rows that may open the first batch: what the range holds before them, and what follows if they do."""
        sizes = t.sort_values("pos")["size"].tolist()
        ends, rows, total = _ends(sizes, cap, solo_at_cap), [], 0
        for at, size in enumerate(sizes):
            solo = solo_at_cap and size >= cap
            rows.append((t["grp"].iloc[0], int(t["part"].iloc[0]), at, total, size, solo, *ends[at]))
            total += size
            if solo or total > cap:
                break
        return pd.DataFrame(rows, columns=["grp", "part", "at", "before", "size", "solo", "batches", "held"])

    found = ranges.groupBy("grp", "part").applyInPandas(cases, f"grp {kinds['grp']}, part int, at long, before long, size long, solo boolean, batches long, held long")

    def chain(t: pd.DataFrame) -> pd.DataFrame:
        batch, held, out = 0, 0, []
        for part, rows in t.sort_values(["part", "at"]).groupby("part"):
            out.append((t["grp"].iloc[0], int(part), batch, held))
            for r in rows.itertuples():
                fill = held + r.before
                if fill == 0 or fill + r.size > cap or r.solo:  # with nothing held the row goes into the batch that is open
                    batch, held = batch + (fill > 0) + r.batches, r.held
                    break
            else:
                held += int(r.before + r.size)
        return pd.DataFrame(out, columns=["grp", "part", "batch", "held"])

    starts = cut(found.groupBy("grp").applyInPandas(chain, f"grp {kinds['grp']}, part int, batch long, held long"))

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos")
        return t.assign(batch=_packed(t["size"].tolist(), cap, solo_at_cap, int(t["batch"].iloc[0]), int(t["held"].iloc[0]))[0][:-1])[["grp", "pos", "size", "batch"]]

    joined = ranges.join(broadcast_if_small(starts), ["grp", "part"])
    return joined.groupBy("grp", "part").applyInPandas(pack, f"grp {kinds['grp']}, pos {kinds['pos']}, size {kinds['size']}, batch long")


def _packed(sizes: list[int], cap: int, solo_at_cap: bool, batch: int, held: int) -> tuple[list[int], int]:
    """The batch of each size by next-fit and the one that is open at the end, and what is held then."""
    out = []
    for size in sizes:
        solo = solo_at_cap and size >= cap
        if held and (held + size > cap or solo):
            batch, held = batch + 1, 0
        out.append(batch)
        held += size
        if solo:
            batch, held = batch + 1, 0
    return [*out, batch], held


def _ends(sizes: list[int], cap: int, solo_at_cap: bool) -> list[tuple[int, int]]:
    """For each row: how many further batches follow up to the end if it is the first of one, and what is held then. From the end backwards."""
    n, sums = len(sizes), [0]
    for size in sizes:
        sums.append(sums[-1] + size)
    out, alone = [(0, 0)] * (n + 1), n  # alone: the next row that stands alone
    for at in range(n - 1, -1, -1):
        if solo_at_cap and sizes[at] >= cap:
            out[at], alone = (1 + out[at + 1][0], out[at + 1][1]), at
            continue
        opens = min(alone, max(at + 1, bisect_right(sums, sums[at] + cap) - 1))
        if opens >= n:
            out[at] = (0, sums[n] - sums[at])
        else:  # rows of size 0 hold nothing, so the next one joins them
            out[at] = (out[opens][0] + (sums[opens] > sums[at]), out[opens][1])
    return out[:n]


def extract_branches(statements: DataFrame) -> DataFrame:
    """(fn, pos, kind) of (fn, pos, stype, text): statements of ten characters or more that branch on a business word, route by a request, or query an entity; of more than eight in a function, the first six of the former two and the first two queries."""
    text = F.regexp_replace("text", r"\r?\n", " ")
    any_of = lambda words, t: F.exists(F.array(*map(F.lit, words)), lambda w: t.contains(w))
    kind = F.when(F.col("stype").isin(BRANCH_TYPES), F.when(any_of(BRANCH_WORDS, F.lower(text)), "BRANCH"))
    kind = kind.when(F.col("stype") == "decorator", F.when(any_of(ROUTE_WORDS, text), "ROUTE")).when(F.col("stype") == "query_statement", F.when(any_of(QUERY_WORDS, F.lower(text)), "DB"))
    rows = statements.where(F.length("text") >= 10).withColumn("kind", kind).where("kind IS NOT NULL").withColumn("q", F.col("kind") == "DB")
    n = F.count("*").over(Window.partitionBy("fn"))
    r = F.row_number().over(Window.partitionBy("fn", "q").orderBy("pos"))
    return rows.withColumns({"n": n, "r": r}).where((F.col("n") <= 8) | (F.col("q") & (F.col("r") <= 2)) | (~F.col("q") & (F.col("r") <= 6))).select("fn", "pos", "kind")


def attach_citations(scenarios: DataFrame, files: DataFrame, outcome_files: DataFrame) -> DataFrame:
    """(scenario_id, path): own relevant paths with a slash, or all paths of the outcome where there is none."""
    own = scenarios.join(files.where(F.col("path").contains("/")), "scenario_id").select("scenario_id", "path").distinct()
    bare = scenarios.join(own.select("scenario_id").distinct(), "scenario_id", "left_anti")
    return own.union(bare.join(outcome_files, "outcome_id").select("scenario_id", "path").distinct())
