"""Hard negatives by threshold joins with an index that norms keep short, in the manner of L2AP (operator 13).

Vectors are quantised to whole numbers and packed into blocks, which are written once. Anchors are rows of the table (a stated query set);
they are taken ``ANCHORS`` at a time, a bounded broadcast, and the blocks stay where they are: only the best few rows of a task for
each anchor move. A join finds all rows whose inner product with an anchor reaches its threshold. In a block:

* dimensions are in order of falling energy, in segments of ``SEGMENT``. A row's leading dimensions stay out of the index as long as the
  norm of what is left out, times the same of any anchor, is below the anchor's threshold: a pair that shares no indexed dimension can't
  reach it. Rows left out up to the last dimension are never met;
* partial scores are accumulated over the indexed dimensions, from the last segment to the first. A pair whose partial score and the
  product of the norms of what remains stay below the threshold is dropped; once few pairs are left they are scored in full.

Thresholds go down until windows are full. For an anchor's positives: from the best score of its label among the block's own anchors (so
that one row at least, and few in all, reach it), to the one that as many anchors reach as positives are wanted, to nothing. For a
positive's window, between shares of its score, likewise. A round asks only for windows that are not full and takes only scores below
the round before; the last round covers the window whole, so results are exact. A task keeps the first rows of each window alone.

Scores are whole numbers: products in doubles where those are exact (below 2**53), else in whole numbers; bounds have a margin.

Edge cases: rows with a null label, a null or empty vector, a null or non-finite entry, or another length of vector than most take no part;
null ids are last among ties and are never anchors by a rule on ids; repeated rows are rows of their own, also beside an anchor of the same
id (of equal scores and ids any may come first); an anchor without another row of its label, or whose windows hold nothing, has no
rows; positives of a score below 0 have empty windows; scores past the range of a long are an error; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, finite_vectors, shared_dir, small_batches, sum_parts

SCALE, BLOCK, ANCHORS, CHUNK, SEGMENT, SPARSE, POSITIVES, NEGATIVES = 256.0, 4_096, 2_048, 256, 8, 0.02, 5, 10
#: The id of rows without one: after all others.
_NO_ID = (1 << 63) - 1
_FOUND = "win long, score long, id long, row long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def blocks_of(table: DataFrame, anchors: Column, label: Column) -> tuple[DataFrame, int]:
    """Blocks (rows, ids, labels, asked, y) of the rows that take part, written to the shared folder, and the number of dimensions.

    ``table`` has vec_id, label and embedding; ``label`` says what counts as a row's label, ``anchors`` which rows are asked.
    """
    rows, dims = finite_vectors(table.select("vec_id", "label", "embedding").where("label IS NOT NULL"))
    rows = rows.select("embedding", F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asked"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                y = np.floor(SCALE * part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float))
                if len(y) and dims * np.abs(y).max() ** 2 >= 1 << 63:
                    raise ValueError("scores don't fit into a long")
                whole = lambda a: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), a)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([whole(pa.array(np.arange(at, at + part.num_rows))), whole(part.column(1)), whole(part.column(2)), whole(part.column(3)), pa.array([y.astype("<i8").tobytes()], pa.binary())], ["rows", "ids", "labels", "asked", "y"])
                at += part.num_rows

    return cut(small_batches(rows).mapInArrow(pack, "rows array<long>, ids array<long>, labels array<long>, asked array<boolean>, y binary")), dims


def _open(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for i in range(batch.num_rows):
            lists = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(4)]
            yield *lists, np.frombuffer(batch.column(4)[i].as_py(), "<i8").reshape(-1, dims)


def leading_norms(y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Norms of the dimensions before each edge, a little above the true ones."""
    return np.sqrt(np.concatenate([np.zeros((len(y), 1)), np.cumsum(y.astype(float) ** 2, 1)], 1)[:, edges]) * (1 + 1e-9)


def threshold_pairs(y: np.ndarray, asked: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor, score) of all pairs with score >= least[anchor] (minus infinity: all), for some anchors at a time. Columns are in the order of the index."""
    dims = y.shape[1]
    edges = np.array([*range(0, dims, SEGMENT), dims])
    own, theirs = leading_norms(y, edges), leading_norms(asked, edges)
    most = float(np.abs(y).max(initial=0)) * float(np.abs(asked).max(initial=0)) * dims
    kind = float if most < 1 << 53 else np.int64
    y, asked = y.astype(kind), asked.astype(kind)
    for k in range(0, len(asked), CHUNK):
        some, bound, norms = asked[k : k + CHUNK], least[k : k + CHUNK], theirs[k : k + CHUNK]
        if not len(bound) or not len(y):
            continue
        # The edge before which a row's dimensions are not indexed: for every anchor the part left out stays below the threshold.
        room = np.min(np.where(norms > 0, bound[:, None] / np.maximum(norms, 1e-300), np.where(bound[:, None] > 0, np.inf, -np.inf)), 0)
        # Norms grow with the edge and the room falls, so the edges below it are the first ones; none are where a threshold isn't positive.
        begins = np.maximum((own < room).sum(1) - 1, 0)
        order = np.argsort(begins, kind="stable")
        begins, x, lead = begins[order], y[order], own[order]
        score = live = pairs = None
        for s in range(len(edges) - 2, -1, -1):
            n = int(np.searchsorted(begins, s, "right"))  # the rows whose index holds this segment
            if not n:
                continue
            part = x[:n, edges[s] : edges[s + 1]] @ some[:, edges[s] : edges[s + 1]].T
            if score is None:
                score = np.zeros((n, len(some)), kind)  # rows of a later edge are never met
            score[:n] += part
            live = np.empty(score.shape, bool)
            live[:n] = score[:n] + lead[:n, s, None] * norms[None, :, s] >= bound
            held = begins[n : len(score)]  # rows that have all that is indexed
            live[n:] = score[n:] + lead[np.arange(n, len(score)), held][:, None] * norms[:, held].T >= bound
            if s and live.mean() < SPARSE:
                pairs = np.nonzero(live)
                break
        if score is None:
            continue
        if pairs is None:  # all indexed dimensions are in; rows with others still have to be completed
            whole = begins[: len(score)] == 0
            i, j = np.nonzero((score >= bound) & whole[:, None])
            if len(i):
                yield order[i], j + k, score[i, j].astype(np.int64)
            pairs = np.nonzero(live & ~whole[:, None])
        for at in range(0, len(pairs[0]), 1 << 15):
            i, j = pairs[0][at : at + (1 << 15)], pairs[1][at : at + (1 << 15)]
            exact = np.einsum("ij,ij->i", x[i], some[j])
            full = exact >= bound[j]
            if full.any():
                yield order[i[full]], j[full] + k, exact[full].astype(np.int64)


def first_of(found: list[np.ndarray], k: int) -> np.ndarray:
    """Of columns (window, score, id, row): the first k rows of each window by falling score, then id."""
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    start = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    return rows[rank < k]


def _round(blocks: DataFrame, dims: int, order: np.ndarray, anchors: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """(win, score, id, row): the first k rows of each task for windows of anchors: scores from ``low`` to ``high`` (anchors x slots), of the same or of other labels."""
    slots = low.shape[1]
    wanted = np.flatnonzero((low <= high).any(1))
    shared = blocks.sparkSession.sparkContext.broadcast((order, {c: v[wanted] for c, v in anchors.items()}, low[wanted], high[wanted], wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, mine, low, high, numbers = shared.value
        least = np.where(low <= high, low, np.inf).min(1)
        kept: list[np.ndarray] = []
        held = 0
        for rows, ids, labels, _, y in _open(batches, dims):
            for i, j, score in threshold_pairs(y[:, order], mine["y"][:, order], least):
                fits = ((labels[i] == mine["label"][j]) == same) & (rows[i] != mine["row"][j])
                i, j, score = i[fits], j[fits], score[fits]
                for slot in range(slots):
                    inside = (score >= low[j, slot]) & (score <= high[j, slot])
                    kept.append(np.stack([numbers[j[inside]] * slots + slot, score[inside], ids[i[inside]], rows[i[inside]]], 1))
                    held += int(inside.sum())
                if held > 1 << 18:
                    kept = [first_of(kept, k)]
                    held = len(kept[0])
        out = first_of(kept, k)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, c]) for c in range(4)], ["win", "score", "id", "row"])

    return blocks.mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _ladder(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors' scores with each other: the best that fits and the k-th best, infinity and minus infinity where there are too few."""
    ranked = -np.sort(-np.where(fits, scores.astype(float), -np.inf), 1)
    best = ranked[:, 0] if ranked.shape[1] else np.full(len(ranked), -np.inf)
    kth = ranked[:, k - 1] if ranked.shape[1] >= k else np.full(len(ranked), -np.inf)
    return best, kth


def _filled(blocks: DataFrame, dims: int, order: np.ndarray, anchors: dict[str, np.ndarray], steps: list[np.ndarray], high: np.ndarray, same: bool, k: int) -> DataFrame:
    """The first k rows of each window from the last of ``steps`` (falling lower ends, anchors x slots) to ``high``, by lowering thresholds."""
    kept, top, last = None, high, steps[-1]
    active = last <= top
    for step in steps:
        low = np.where(active, np.maximum(step, last), np.inf)
        found = _round(blocks, dims, order, anchors, low, np.where(active, top, -np.inf), same, k)
        kept = cut(_first(found if kept is None else kept.select("win", "score", "id", "row").union(found), k))
        full = {r.win for r in kept.groupBy("win").count().where(F.col("count") >= k).collect()}
        active = active & (low > last) & ~np.isin(np.arange(low.size), list(full)).reshape(low.shape)
        top = np.where(active, np.minimum(top, low - 1), top)  # scores are whole numbers
        if not active.any():
            break
    return kept


def mine(table: DataFrame, anchors: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (30, 90)) -> DataFrame:
    """The hard negatives of rows (vec_id, label, embedding) for the anchors among them, as ``OUT``: for each anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` of other labels whose score is within ``share`` hundredths of the positive's."""
    spark = table.sparkSession
    blocks, dims = blocks_of(table, anchors, F.col("label") if label is None else label)
    folder = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    count = blocks.select(F.sum(F.size(F.filter("asked", lambda a: a)))).first()[0] or 0
    if not count:
        return spark.createDataFrame([], OUT)

    def energy(batches):
        total = np.zeros(dims)
        for *_, y in _open(batches, dims):
            total += (y.astype(float) ** 2).sum(0)
        return total

    order = np.argsort(-sum_parts(blocks, energy), kind="stable")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, labels, asked, y in _open(batches, dims):
            at = np.flatnonzero(asked)
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at]), pa.array(labels[at]), pa.array([y[i].tobytes() for i in at], pa.binary())], ["row", "id", "label", "y"])

    everyone = blocks.mapInArrow(ask, "row long, id long, label long, y binary")
    parts = -(-count // ANCHORS)
    for part in range(parts):
        some = sorted(everyone.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).collect())
        if not some:
            continue
        own = {c: np.array([r[c] for r in some], np.int64) for c in ("row", "id", "label")} | {"y": np.stack([np.frombuffer(r.y, "<i8") for r in some])}
        shares = own["y"].astype(float) @ own["y"].T.astype(float)  # only sets where thresholds begin
        alike = own["label"][:, None] == own["label"][None, :]
        best, kth = _ladder(shares, alike & ~np.eye(len(some), dtype=bool), positives)
        low = np.full((len(some), 1), -np.inf)
        found = _filled(blocks, dims, order, own, [np.floor(best)[:, None], np.floor(kth)[:, None], low], np.full_like(low, np.inf), True, positives)
        chosen = found.collect()  # at most ``positives`` an anchor of the block
        score, ids = np.full((len(some), positives), np.nan), np.zeros((len(some), positives), np.int64)
        for r in chosen:
            score[r.win, r["rank"] - 1], ids[r.win, r["rank"] - 1] = r.score, r.id
        there = ~np.isnan(score)
        whole = np.where(there, score, 0).astype(np.int64)
        least, most = -(-share[0] * whole // 100), share[1] * whole // 100
        low, high = np.where(there & (least <= most), least, np.inf), np.where(there & (least <= most), most, -np.inf)
        ladders = [_ladder(shares, ~alike & (shares >= low[:, [s]]) & (shares <= high[:, [s]]), negatives) for s in range(positives)]
        steps = [np.maximum(np.stack([x[i] for x in ladders], 1), low) for i in (0, 1)]
        # Where no anchor shows a score inside the window, begin with its upper third.
        steps[0] = np.where((steps[0] > low) | (low > high), steps[0], most - (most - least) // 3)
        negatives_found = _filled(blocks, dims, order, own, [steps[0], steps[1], low], high, False, negatives)
        names = [(int(a * positives + s), int(own["id"][a]), int(ids[a, s]), int(whole[a, s])) for a, s in zip(*np.nonzero(there))]
        windows = spark.createDataFrame(names, "win long, anchor_id long, positive_id long, positive_score long")
        done = negatives_found.join(F.broadcast(windows), "win")  # ANCHORS x positives rows at most
        named = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
        done.select(named("anchor_id").alias("anchor_id"), named("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
    return spark.read.schema(OUT).parquet(folder)
