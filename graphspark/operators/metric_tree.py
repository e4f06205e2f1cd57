"""Pairs of blocks of vectors that can hold linked vectors, by a metric tree for each group.

Angles between vectors obey the triangle inequality. A node with more than ``block`` vectors is divided among pivots: directions
drawn farthest first from a sample of it and moved to the middle of their part; each vector goes to the nearest one. A node knows its pivot, the greatest angle to it (a ball), and the
ranges of angles to all pivots of the group's first level. Pairs of nodes are followed from the root down, and a pair is left out with all
below it where the balls, or the ranges of one of the pivots, are further apart than the links' angle. Leaves that can't be divided
(equal vectors, ``MAX_LEVELS``) are cut by a hash of the id.

How many pairs stay depends on the data: vectors in clusters leave few, while angles that crowd at 90 degrees leave all (no bound by angles
can tell them apart). ``kept_share`` says so for given vectors.

Each level reads the vectors of nodes that are still too large once. The pivots of ``NODES`` nodes at a time are sent to the tasks; no
vector goes to the driver but those. Nodes and pairs of nodes are tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import broadcast_if_small, cut

FAN, SAMPLE, MAX_LEVELS, NODES, ROUNDS = 8, 256, 12, 2_048, 4
_ROOT = "r"


def unit(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _share(column: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pivots(rows: DataFrame, wanted: DataFrame, level: int) -> DataFrame:
    """(grp, node, pivots): for each wanted (grp, node, n, k) up to k pivots, each a vector of a drawn sample."""
    drawn = rows.join(broadcast_if_small(wanted), ["grp", "node"]).where(_share("id", level) * F.col("n") < SAMPLE)

    def choose(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        x, k = unit(t.sort_values("id")["embedding"]), int(t["k"].iloc[0])
        chosen, near = [0], x @ x[0]
        while len(chosen) < k and near.min() < 1 - 1e-9:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        centres = x[chosen]
        for _ in range(ROUNDS):  # towards the middle of what is nearest, so that single far vectors don't stay alone
            best = (x @ centres.T).argmax(1)
            sums = np.stack([x[best == c].sum(0) if (best == c).any() else centres[c] for c in range(len(centres))])
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-30), centres)
        return pd.DataFrame({"grp": [key[0]], "node": [key[1]], "pivots": [centres.tolist()]})

    kind = dict(rows.dtypes)["grp"]
    return drawn.select("grp", "node", "id", "embedding", "k").groupBy("grp", "node").applyInPandas(choose, f"grp {kind}, node string, pivots array<array<double>>")


def _assign(rows: DataFrame, pivots: dict, first: bool) -> DataFrame:
    """Rows of the nodes that have pivots, one level down, with the angle to their pivot (and at the first level to all of them)."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    names = ["id", "grp", "embedding", "node", "far", "angle"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, nodes = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            vectors = unit(batch.column(2).to_pylist())
            child, angle, far = list(nodes), np.zeros(len(nodes)), batch.column(4).to_pylist()
            places: dict = {}
            for i, key in enumerate(zip(groups, nodes)):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                angles = np.arccos(np.clip(vectors[at] @ np.array(shared.value[key]).T, -1.0, 1.0))
                best = angles.argmin(1)
                angle[at] = angles[np.arange(len(at)), best]
                for i, b, a in zip(at, best, angles):
                    child[i] = f"{key[1]}.{b}"
                    if first:
                        far[i] = a.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(child), pa.array(far, pa.list_(pa.float64())), pa.array(angle)], names)

    return rows.select(*names[:5]).mapInArrow(run, f"id {kinds['id']}, grp {kinds['grp']}, embedding {kinds['embedding']}, node string, far array<double>, angle double")


def build(vectors: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, grp, embedding, node) with their leaf, nodes (grp, node, parent, n, centre, radius, low, high, leaf), and the number of levels."""
    kinds = dict(vectors.dtypes)
    rows = vectors.where("embedding IS NOT NULL").select("id", "grp", "embedding", F.lit(_ROOT).alias("node"), F.lit(None).cast("array<double>").alias("far"))
    counts = cut(rows.groupBy("grp", "node").agg(F.count("*").alias("n")))
    none = "CAST(NULL AS STRING) AS parent", "CAST(NULL AS ARRAY<DOUBLE>) AS centre", "CAST(NULL AS DOUBLE) AS radius", "CAST(NULL AS ARRAY<DOUBLE>) AS low", "CAST(NULL AS ARRAY<DOUBLE>) AS high"
    tree, done, level = counts.selectExpr("grp", "node", "n", *none), None, 0
    large = counts.where(F.col("n") > block)
    spark = vectors.sparkSession
    while level < MAX_LEVELS and not large.isEmpty():
        wanted = large.withColumn("k", F.least(F.lit(FAN), F.ceil(2 * F.col("n") / block)).cast("int")).select("grp", "node", "n", "k")
        wanted = cut(wanted)
        pivots = cut(_pivots(rows, wanted, level)).where(F.size("pivots") > 1)  # others can't be divided
        parts = -(-pivots.count() // NODES)
        if not parts:
            break
        rows = rows if level else cut(rows)
        open_ = rows.join(broadcast_if_small(pivots.select("grp", "node")), ["grp", "node"], "left_semi")
        closed = rows.join(broadcast_if_small(pivots.select("grp", "node")), ["grp", "node"], "left_anti").select("id", "grp", "embedding", "node")
        moved = None
        for part in range(parts):
            mine = lambda df: df if parts == 1 else df.where(F.pmod(F.xxhash64("grp", "node"), F.lit(parts)) == part)  # noqa: B023, E731
            found = _assign(mine(open_), {(r.grp, r.node): r.pivots for r in mine(pivots).collect()}, level == 0)
            moved = found if moved is None else moved.union(found)
        done = closed if done is None else done.union(closed)
        moved = cut(moved)
        far = [f(F.get("far", F.lit(k))) for k in range(FAN) for f in (F.min, F.max)]
        stats = moved.groupBy("grp", "node").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), *[c.alias(f"f{i}") for i, c in enumerate(far)])
        centres = pivots.select("grp", F.col("node").alias("parent"), F.posexplode("pivots").alias("at", "centre")).withColumn("node", F.concat_ws(".", "parent", F.col("at").cast("string")))
        lows, highs = F.array(*[f"f{2 * i}" for i in range(FAN)]), F.array(*[f"f{2 * i + 1}" for i in range(FAN)])
        new = cut(stats.join(broadcast_if_small(centres, 1_000), ["grp", "node"]).select("grp", "node", "n", "parent", "centre", "radius", lows.alias("low"), highs.alias("high")))
        tree = tree.unionByName(new)
        rows, large, level = moved.drop("angle"), new.where(F.col("n") > block), level + 1
    rest = rows.select("id", "grp", "embedding", "node")
    leaves = rest if done is None else done.union(rest)
    inner = tree.where("parent IS NOT NULL").select("grp", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    tree = cut(tree.join(inner, ["grp", "node"], "left").withColumn("leaf", F.col("inner").isNull()).drop("inner"))
    return leaves, tree, level


def node_pairs(tree: DataFrame, levels: int, eps: float) -> DataFrame:
    """(grp, a, b), a <= b: the pairs of leaves that can hold linked vectors."""
    reach = math.acos(max(-1.0, 1.0 - eps)) + 1e-6
    columns = ["node", "centre", "radius", "low", "high"]
    steps = tree.where("parent IS NOT NULL").select("grp", "parent", *columns).union(tree.where("leaf").select("grp", F.col("node").alias("parent"), *columns))
    side = lambda s: steps.select("grp", F.col("parent").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    pairs = tree.where(F.col("node") == _ROOT).select("grp", F.col("node").alias("a"), F.col("node").alias("b"))
    dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("a_radius") - F.col("b_radius") > reach
    gaps = lambda x, y: F.exists(F.zip_with(x, y, lambda low, high: low - high > reach), lambda g: g)
    out = F.coalesce(apart, F.lit(False)) | F.coalesce(gaps("a_low", "b_high"), F.lit(False)) | F.coalesce(gaps("b_low", "a_high"), F.lit(False))
    for _ in range(levels):
        met = pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"]).where((F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node")))
        met = met.where((F.col("a_node") == F.col("b_node")) | ~out)
        pairs = cut(met.select("grp", F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))
    return pairs


def _parts(tree: DataFrame, block: int) -> DataFrame:
    """(grp, node, pieces): in how many pieces a leaf is cut."""
    return tree.where("leaf").select("grp", "node", F.ceil(F.col("n") / block).cast("int").alias("pieces"))


def block_pairs(vectors: DataFrame, eps: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, grp, embedding, part), and the pairs of parts (grp, i, j), i <= j, that can hold linked vectors."""
    rows, tree, levels = build(vectors, block)
    pieces = _parts(tree, block)
    rows = rows.join(broadcast_if_small(cut(pieces)), ["grp", "node"]).withColumn("part", F.concat_ws("#", "node", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("string"))).select("id", "grp", "embedding", "part")
    each = pieces.select("grp", "node", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).select("grp", "node", F.concat_ws("#", "node", F.col("piece").cast("string")).alias("part"))
    pairs = node_pairs(tree, levels, eps)
    met = pairs.join(each.toDF("grp", "a", "i"), ["grp", "a"]).join(each.toDF("grp", "b", "j"), ["grp", "b"]).where((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
    return rows, cut(met.select("grp", "i", "j"))


def kept_share(vectors: DataFrame, eps: float, block: int) -> tuple[int, int]:
    """Pairs of parts that stay, and all."""
    rows, pairs = block_pairs(vectors, eps, block)
    n = rows.groupBy("grp").agg(F.count_distinct("part").alias("n")).select(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0]
    return pairs.count(), int(n or 0)
