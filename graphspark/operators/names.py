"""Near-duplicate names without all pairs: how many names each name links to, and which names links reach.

Two names of one label and platform link when the Jaccard score of their token sets, plain or with synonyms, is at or above a threshold.
Names with equal token sets are one class first (word order and case drop out). Of a set with n tokens only the rarest
n - ceil(threshold * n) + 1 are indexed, so that frequent tokens meet in no bucket. A bucket holds the classes that share an indexed
token; it is scored by products of 0/1 matrices of the tokens that both sides have, some columns at a time, and a pair counts in the bucket of the first indexed token that the two share. A
bucket of over ``BLOCK`` classes is divided into pairs of blocks. A bucket gives each class its number of linked names, and a spanning
forest of its links: what is written is linear in what is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut
from ..functions.text import name_tokens, platform_key
from .design import expanded
from .intents import components

BLOCK, TASK_ROWS = 2_000, 4_000


def classes_of(nodes: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Distinct lower-case names (label, platform, key, cls); and their classes (cls, label, platform, plain, wide, n), cls a 64-bit hash. Where two token sets have one hash, all are hashed anew."""
    tokens = name_tokens("name")
    names = nodes.where(F.trim("name") != "").select("label", platform_key("platform").alias("platform"), F.lower("name").alias("key"), F.array_sort(tokens).alias("plain"))
    names = names.groupBy("label", "platform", "key").agg(F.min("plain").alias("plain"))  # tokens depend on case; the first set stands for the name
    names = cut(names.withColumn("cls", F.xxhash64(F.lit(seed), "label", "platform", F.array_join("plain", " "))))
    whole = F.struct("label", "platform", "plain")
    classes = cut(names.groupBy("cls").agg(F.min(whole).alias("m"), (F.min(whole) != F.max(whole)).alias("clash"), F.count("*").alias("n")))
    if not classes.where("clash").isEmpty():
        return classes_of(nodes, seed + 1)
    classes = classes.select("cls", "m.label", "m.platform", "m.plain", "n")
    return names.select("label", "platform", "key", "cls"), classes.withColumn("wide", F.array_sort(expanded(F.col("plain"))))


#: Columns of a product at once: memory is rows x COLUMNS, whatever the number of tokens.
COLUMNS = 1_024


class _Sets:
    """Token sets of rows as (row, code) pairs; how many tokens rows share, by products of the columns that both sides have."""

    def __init__(self, lists: list[list[str]]):
        known: dict[str, int] = {}
        self.codes = np.array([known.setdefault(t, len(known)) for tokens in lists for t in tokens], np.int64)
        self.size = np.array([len(tokens) for tokens in lists], np.int64)
        self.rows, self.tokens = np.repeat(np.arange(len(lists)), self.size), len(known)

    def _columns(self, rows: np.ndarray, column: np.ndarray, low: int) -> np.ndarray:
        """The 0/1 matrix of some rows and the columns from ``low`` on."""
        place = np.full(len(self.size), -1)
        place[rows] = np.arange(len(rows))
        at, col = place[self.rows], column[self.codes] - low
        kept = (at >= 0) & (col >= 0) & (col < COLUMNS)
        out = np.zeros((len(rows), COLUMNS), np.float32)
        out[at[kept], col[kept]] = 1
        return out

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        in_a, in_b = (np.bincount(self.codes[np.isin(self.rows, x)], minlength=self.tokens) > 0 for x in (a, b))
        both = np.flatnonzero(in_a & in_b)
        column = np.full(self.tokens, -1)
        column[both] = np.arange(len(both))
        out = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, len(both), COLUMNS):
            out += self._columns(a, column, low) @ self._columns(b, column, low).T
        return out

    def jaccard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = self.shared(a, b)
        return np.round(shared / np.maximum(self.size[a][:, None] + self.size[b][None, :] - shared, 1), 4)


def _bucket(rows: pd.DataFrame, wide: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket, or a pair of its blocks (column ``side``): linked names of each row, and edges (two columns of row numbers)."""
    plain, broad, before = ([list(x) for x in rows[c]] for c in ("plain", "wide", "before"))
    a, b = np.flatnonzero(rows["side"].to_numpy() != 2), np.flatnonzero(rows["side"].to_numpy() != 1)
    if wide:  # only a name with synonyms can come closer than the plain sets
        other = np.array([len(p) != len(w) for p, w in zip(plain, broad)])
        if not other.any():
            return np.zeros(len(rows), np.int64), np.zeros((0, 2), np.int64)
    p, w, e = _Sets(plain), _Sets(broad), _Sets(before)
    linked, n, ids, joined = np.zeros(len(rows), np.int64), rows["n"].to_numpy(np.int64), rows["cls"].to_numpy(), np.zeros((len(rows), len(rows)), bool)
    for k in range(0, len(a), 512):
        part = a[k : k + 512]
        close = (w if wide else p).jaccard(part, b) >= threshold
        if wide:
            close &= (p.jaccard(part, b) < threshold) & (other[part][:, None] | other[b][None, :])
        close &= e.shared(part, b) == 0  # no token before this one is indexed by both
        if (rows["side"] == 0).all():
            close &= ids[part][:, None] < ids[b][None, :]
        linked[part] += close @ n[b]
        linked[b] += n[part] @ close
        joined[np.ix_(part, b)] |= close
        joined[np.ix_(b, part)] |= close.T
    return linked, _forest(joined)


def _forest(joined: np.ndarray) -> np.ndarray:
    """Edges that join each member of a component to one of them; ``joined`` tells which rows are linked."""
    left, edges = joined.any(1), [np.zeros((0, 2), np.int64)]
    while left.any():
        seed = int(left.argmax())
        frontier = np.array([seed])
        left[seed] = False
        while len(frontier):
            frontier = np.flatnonzero(joined[frontier].any(0) & left)
            left[frontier] = False
            edges.append(np.stack([np.full(len(frontier), seed), frontier], 1))
    return np.concatenate(edges)


def _scorer(wide: bool, threshold: float):
    def score(t: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": [], "b": [], "links": []}, dtype="Int64")]
        for _, rows in t.groupby(["label", "platform", "token", "i", "j"], sort=False):
            linked, edges = _bucket(rows, wide, threshold)
            ids, has = rows["cls"].to_numpy(), np.flatnonzero(linked)
            found.append(pd.DataFrame({"a": ids[has], "b": pd.array([None] * len(has), "Int64"), "links": linked[has]}))
            found.append(pd.DataFrame({"a": ids[edges[:, 0]], "b": pd.array(ids[edges[:, 1]], "Int64"), "links": np.zeros(len(edges), np.int64)}))
        return pd.concat(found)

    return score


def linked_classes(classes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, links): with b null, the links of class a in one bucket; with b, an edge of its forest."""
    schema, out = "a long, b long, links long", None
    for which in ("plain", "wide"):
        one = classes.select("cls", "label", "platform", F.explode(which).alias("token"))
        often = one.groupBy("label", "platform", "token").agg(F.count("*").alias("f"))
        rare = one.join(often, ["label", "platform", "token"]).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).getField("token").alias("rare"))
        rare = rare.select("cls", F.slice("rare", 1, (F.size("rare") - F.ceil(threshold * F.size("rare")) + 1).cast("int")).alias("rare"))
        index = cut(classes.join(rare, "cls").select("cls", "label", "platform", "plain", "wide", "n", "rare", F.posexplode("rare").alias("at", "token")).withColumn("before", F.slice("rare", 1, F.col("at"))).drop("rare", "at"))
        sizes = index.groupBy("label", "platform", "token").agg(F.count("*").alias("size")).where("size > 1")
        rows = index.join(sizes, ["label", "platform", "token"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        rows = rows.withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2))
        rows = rows.withColumn("bucket", F.xxhash64("label", "platform", "token", "i", "j"))
        copies = sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK))).first()[0] or 0  # rows as they meet, blocks included
        tasks = max(1, copies // TASK_ROWS)
        parts = rows.withColumn("task", F.pmod("bucket", F.lit(tasks)))

        scored = parts.select("task", "label", "platform", "token", "i", "j", "side", "cls", "plain", "wide", "n", "before").groupBy("task").applyInPandas(_scorer(which == "wide", threshold), schema)
        out = scored if out is None else out.union(scored)
    return out


def near_duplicate_links(nodes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per lower-case name of a label and platform: ``links``, the number of other names that it links to, and ``cluster``, the first name that links reach; names without a link are left out.

    Edge cases: blank names are left out; names that differ in case alone are one name; names without tokens link to nothing; names whose
    token sets are equal link to each other.
    """
    names, classes = classes_of(nodes)
    classes = cut(classes)
    found = cut(linked_classes(classes, threshold))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("far"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("id").alias("cls"), F.col("cluster").alias("root"))
    told = classes.where(F.size("plain") > 0).join(links, "cls", "left").join(roots, "cls", "left").select("cls", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "cls").alias("root")).where("links > 0")
    rows = cut(names.join(told, "cls"))
    first = rows.groupBy("root").agg(F.min("key").alias("cluster"))
    return rows.join(first, "root").select("label", "platform", "key", "links", "cluster")
