"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 12).

Vectors are quantised to whole numbers x and packed once into blocks, which are written to the shared folder; every product reads those.
A is the matrix of centred rows, x - S/n (S: the exact sums; the whole part of S/n is taken off in whole numbers). Each step makes the two
products of the bidiagonalisation in one pass over the blocks: u = A v, less what it has of the left vectors before, and A'u. Right
vectors are few and short (dims x dims numbers) and stay on the driver. Left vectors have a number a row and are never stored: each is A m
for a vector m of the driver, so a pass recomputes the earlier ones from the rows it reads. Both sides are fully reorthogonalised, left ones
by the products with all earlier ones that the pass sums up as well, right ones twice on the driver. The singular values of the small
bidiagonal matrix give the deviations, its right singular vectors the components. A Krylov space that ends early (equal eigenvalues,
dimensions without variance) goes on with a new vector orthogonal to those before, so no component is missed; hence as many passes as
dimensions. ``whitening`` ends sooner if ``steps`` says so, for leading components alone.

What goes to the driver in a pass is one sum for each dimension and left vector, added up by Spark.

Edge cases: rows with a null vector, an empty one, one with a null or non-finite entry, or one of another length than most are dropped;
null and repeated ids are rows of their own, repeated rows count as often as they stand; components without variance (as many as the rank
falls short) are not returned, so one row, equal rows, and no rows give an empty result; of equal eigenvalues any orthogonal components are
given; a component's sign makes its largest entry positive; entries whose whole number passes 2**51 are an error; a deviation that doesn't
fit into a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import cut, finite_vectors, small_batches, sum_parts

#: Whole numbers: floor(SCALE * entry) + SHIFT. Rows of a block; a deviation this small beside the largest is none.
SCALE, SHIFT, BLOCK, MOST, NONE, COMPONENTS, SEED = 1024.0, 100_000, 4_096, 1 << 51, 1e-11, 8, 5


@dataclass
class Whitening:
    """n rows; ``sums`` of x by dimension; ``vectors`` (dims x components) and their variances, of falling variance; the whole variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.variances))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of squares of n*x - S; null where one doesn't fit into a long."""
        most = max((max(abs(self.n * int(x[:, k].min()) - s), abs(self.n * int(x[:, k].max()) - s)) for k, s in enumerate(self.sums)), default=0) if len(x) else 0
        if most * most * len(self.sums) < 1 << 63:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(1).tolist()
        wide = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in wide]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: whole parts exactly, then the rest."""
    whole = [s // n for s in sums]
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole)])
    return (x - np.array(whole, np.int64)).astype(float) - rest


def blocks_of(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(ids, x): blocks of at most ``BLOCK`` quantised vectors, written to the shared folder, and the number of dimensions."""
    rows, dims = finite_vectors(table.select(id_column, vector), vector)
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema[id_column].dataType)), T.StructField("x", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                scaled = np.floor(SCALE * values)
                if len(scaled) and np.abs(scaled).max() >= MOST - SHIFT:
                    raise ValueError(f"an entry's whole number passes {MOST}")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([(scaled.astype("<i8") + SHIFT).tobytes()], pa.binary())], ["ids", "x"])

    return cut(small_batches(rows).mapInArrow(pack, schema)), dims


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for raw in batch.column(batch.schema.get_field_index("x")):
            yield np.frombuffer(raw.as_py(), "<i8").reshape(-1, dims)


def exact_sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows, and sums by dimension, in two halves of 32 bits, so that the sums over tasks (2**20 at most) are exact in doubles."""
    low = 1 << 32

    def part(batches):
        total = np.zeros(2 * dims + 1, np.int64)
        for x in matrices(batches, dims):
            total += np.concatenate([[len(x)], (x & (low - 1)).sum(0), (x >> 32).sum(0)])
        # Halves are carried over, so that a task's low half is below 2**32.
        carry = total[1 : dims + 1] >> 32
        return np.concatenate([total[:1], total[1 : dims + 1] & (low - 1), total[dims + 1 :] + carry])

    found = sum_parts(blocks.select("x"), part)
    if not len(found):
        return 0, [0] * dims
    return int(found[0]), [int(a) + int(b) * low for a, b in zip(found[1 : dims + 1], found[dims + 1 :])]


def bidiagonalise(blocks: DataFrame, dims: int, n: int, sums: list[int], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors (dims x steps) and the upper bidiagonal matrix."""
    only = blocks.select("x")

    def begin(batches):  # signs that rows draw: a first vector in the space of the rows
        total, rng = np.zeros(dims), np.random.default_rng(SEED)
        for x in matrices(batches, dims):
            total += rng.choice([-1.0, 1.0], len(x)) @ centred(x, n, sums)
        return total

    def products(last: np.ndarray, left: np.ndarray):
        def part(batches):
            total = np.zeros(dims + left.shape[1] + 1)
            for x in matrices(batches, dims):
                a = centred(x, n, sums)
                u = a @ last
                total += np.concatenate([a.T @ u, (a @ left).T @ u, [u @ u]])
            return total

        return sum_parts(only, part)

    rng = np.random.default_rng(SEED)
    right, left, found = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))  # v, m with u = A m, and A'u
    alphas: list[float] = []
    betas: list[float] = []

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    v, beta, fresh = sum_parts(only, begin), 0.0, False
    size = np.linalg.norm(v)
    v = v / size if size > 0 else np.eye(dims)[0]
    largest = 0.0
    while True:
        m = v - beta * left[:, -1] if beta else v
        got = products(m, left)
        along = got[dims:-1]
        alpha = float(np.sqrt(max(got[-1] - along @ along, 0.0)))
        largest = max(largest, alpha, beta)
        none = alpha <= NONE * largest or not largest
        right = np.column_stack([right, v])
        alphas.append(0.0 if none else alpha)
        betas.append(beta)
        left = np.column_stack([left, np.zeros(dims) if none else (m - left @ along) / alpha])
        found = np.column_stack([found, np.zeros(dims) if none else (got[:dims] - found @ along) / alpha])
        if len(alphas) == (steps or dims) or len(alphas) == dims or none and fresh:  # a new vector without variance: nothing else has any
            break
        rest = orthogonal(found[:, -1] - alphas[-1] * v)
        beta = float(np.linalg.norm(rest))
        if fresh := beta <= NONE * largest:
            beta, rest = 0.0, orthogonal(rng.standard_normal(dims))
        v = orthogonal(rest / np.linalg.norm(rest))
        v /= np.linalg.norm(v)
    return right, np.diag(alphas) + np.diag(betas[1:], 1)


def fit(blocks: DataFrame, dims: int, components: int = COMPONENTS, steps: int | None = None) -> Whitening:
    n, sums = exact_sums(blocks, dims)
    if not n:
        return Whitening(0, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    right, bidiagonal = bidiagonalise(blocks, dims, n, sums, steps)
    _, deviations, turned = np.linalg.svd(bidiagonal)
    kept = deviations > NONE * max(deviations[0], 1e-300) * 10
    vectors = (right @ turned.T)[:, kept][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])

    def squares(batches):
        return sum((np.array([(centred(x, n, sums) ** 2).sum()]) for x in matrices(batches, dims)), np.zeros(1))

    return Whitening(n, sums, vectors, deviations[kept][:components] ** 2 / n, float(sum_parts(blocks.select("x"), squares)[0]) / n)


def identity_error(blocks: DataFrame, dims: int, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity; means are taken off before multiplying."""
    only, k = blocks.select("x"), model.vectors.shape[1]
    mean = sum_parts(only, lambda batches: sum((model.whitened(x).sum(0) for x in matrices(batches, dims)), np.zeros(k))) / model.n

    def moments(batches):
        return sum(((z := model.whitened(x) - mean).T @ z for x in matrices(batches, dims)), np.zeros((k, k))).ravel()

    return float(np.abs(sum_parts(only, moments).reshape(k, k) / model.n - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding", steps: int | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row that takes part and each component."""
    blocks, dims = blocks_of(table, id_column, vector)
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    model = fit(blocks, dims, components, steps)
    k = model.vectors.shape[1]
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(blocks, dims, model), model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                x = next(matrices(iter([part]), dims))
                ids, each = part.column(0).flatten(), len(x)
                out = [
                    ids.take(pa.array(np.repeat(np.arange(each), k))), pa.array(np.tile(np.arange(1, k + 1), each), pa.int32()), pa.array(np.full(each * k, model.n), pa.int64()),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(each), k))), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, each)), pa.array(np.full(each * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return blocks.mapInArrow(run, schema)
