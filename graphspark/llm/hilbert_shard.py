"""Sharding in Hilbert-curve order (operator 9), with DataFrame functions alone.

Metadata dimensions are quantised to ``BITS`` bits each: source and language by the dense rank of their value in code-point order (two
or more values share a number where there are over 2^BITS), size on a log scale between the smallest and the largest. A row gets the
index of its cell on the Hilbert curve through that grid, and rows in the order of the curve are cut into runs of equal counts: the law is
``rows``. Neighbours on the curve are close in every dimension, so a shard covers a short range of each and filters on any of them prune
whole files by their smallest and largest values (``write_shards`` keeps rows in curve order; ``shard_ranges`` shows what a shard covers).

The exact rank of a row comes from sums and not from a global sort: cells are counted (2^(3 x BITS) = 32,768 at most) and their counts
summed along the curve; a cell with many rows is divided by bits of a hash of the id into bins of about ``BIN`` rows, whose counts are
summed within the cell; rows are numbered within their bin. The order is total, so reruns agree whatever the partitions.

Edge cases: a null text has size 16 and crc32 0; null source or language is a value of its own, the first; rows that agree in every
column that is read may swap their slots; null ids and repeated rows are rows of their own, here and in ``write_shards``; texts of any
length count whole; shards are 0 to ``shards`` - 1 and some are empty where there are fewer rows; an empty table gives an empty
result; other columns are ignored, whatever their names, and written by ``write_shards`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running_within, small_enough

BITS, SHARDS, BIN, OVERHEAD = 5, 40, 2_000, 16
DIMENSIONS = ("source", "lang", "size")


def hilbert_index(df: DataFrame, dimensions: list[str], bits: int, out: str) -> DataFrame:
    """``df`` with the Hilbert index of integer columns below 2^bits: from the coarsest bit down, each cell's orientation is undone by exchanging or inverting lower bits; then the bits are Gray-decoded and interleaved."""
    x = [f"__x{i}" for i in range(len(dimensions))]
    kept = df.columns
    df = df.select("*", *[F.col(d).cast("long").alias(n) for d, n in zip(dimensions, x)])
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i, name in enumerate(x):
            swap = F.when(F.col(name).bitwiseAND(F.lit(bit)) != 0, F.lit(low)).otherwise(F.col(x[0]).bitwiseXOR(F.col(name)).bitwiseAND(F.lit(low)))
            is_set = F.col(name).bitwiseAND(F.lit(bit)) != 0
            df = df.withColumn("__s", swap).withColumns({x[0]: F.col(x[0]).bitwiseXOR(F.col("__s")), **({name: F.when(is_set, F.col(name)).otherwise(F.col(name).bitwiseXOR(F.col("__s")))} if i else {})})
            if not i:
                continue
    for a, b in zip(x, x[1:]):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    # Gray decoding along each level: the parity of the last dimension's higher bits turns all of them.
    turn = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__s", turn)
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for name in x:
            index = index * 2 + F.shiftright(F.col(name).bitwiseXOR(F.col("__s")), level).bitwiseAND(F.lit(1))
    return df.withColumn(out, index).select(*[F.col(f"`{c}`") for c in kept], out)


def quantised(rows: DataFrame) -> DataFrame:
    """source, lang and size as numbers below 2^BITS."""
    top = (1 << BITS) - 1
    named = F.array(*[F.struct(F.lit(d).alias("__dimension"), F.col(d).alias("__name")) for d in ("source", "lang")])
    values = rows.select(F.explode(named).alias("v")).groupBy("v.__dimension", "v.__name").agg(F.lit(1).cast("long").alias("__one"))
    values = cut(running_within(values, "__dimension", [F.col("__name").asc_nulls_first()], F.col("__one"), "__at"))
    sizes = {r["__dimension"]: r["n"] for r in values.groupBy("__dimension").agg(F.count("*").alias("n")).collect()}  # two rows
    for name in ("source", "lang"):
        n = sizes.get(name, 0)
        code = F.expr(f"__at * {top + 1} div {max(n, top + 1)}").alias(f"q_{name}")
        own = values.where(F.col("__dimension") == name).select("__name", code)
        rows = rows.join(F.broadcast(own) if small_enough(n) else own, F.col(name).eqNullSafe(F.col("__name"))).drop("__name")
    low, high = rows.agg(F.min(F.log2("size")), F.max(F.log2("size"))).first()
    size = F.floor((F.log2("size") - F.lit(low or 0.0)) / F.lit(max((high or 0.0) - (low or 0.0), 1e-9)) * (top + 1))
    return rows.withColumn("q_size", F.least(size, F.lit(top)).cast("long"))


def metadata(docs: DataFrame, *others: str) -> DataFrame:
    """What sharding reads of a row; the text is read once, for its size and its crc32."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), *others)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (with source, lang, size, doc_id, text_crc32) with ``cell``, the exact ``rank`` from 0 along the curve, and ``total``."""
    placed = hilbert_index(quantised(cut(rows)), ["q_source", "q_lang", "q_size"], BITS, "cell").drop("q_source", "q_lang", "q_size")
    placed = cut(placed)
    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over 32,768 rows at most
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
    cells = cut(counts.select("cell", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_start"), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BIN))).cast("int").alias("bits"), F.sum("n").over(Window.partitionBy()).alias("total")))
    mixed = F.xxhash64("doc_id", "text_crc32")
    binned = placed.join(F.broadcast(cells), "cell").withColumn("bin", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(xxhash64(doc_id, text_crc32), 64 - bits)")).otherwise(F.lit(0).cast("long")))
    sums = cut(binned.groupBy("cell", "bin").agg(F.count("*").alias("bin_rows")))
    bins = cut(running_within(sums, "cell", ["bin"], F.col("bin_rows"), "bin_start").drop("bin_rows"))
    order = Window.partitionBy("cell", "bin").orderBy(mixed, "doc_id", "text_crc32", "size")
    return binned.join(bins, ["cell", "bin"]).withColumn("rank", F.col("cell_start") + F.col("bin_start") + F.row_number().over(order) - 1).drop("cell_start", "bin_start", "bits", "bin")


def _shard(rank: Column, total: Column, shards: int) -> Column:
    """Runs along the curve whose counts differ by one at most."""
    return F.floor(rank * shards / total).cast("int") if shards < 2 else F.expr(f"cast(rank * {shards} div total as int)")


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    """``rows``, ranked, with ``shard`` and ``slot``."""
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # the smallest rank of the shard
    return rows.withColumn("shard", _shard(F.col("rank"), F.col("total"), shards)).withColumn("slot", F.col("rank") - first)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    return _sharded(ranked(metadata(docs)), shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents, one folder a shard, in curve order. Rows are told apart by a number of their own, not by their ids."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("the input has a column shard or slot already")
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))  # numbered before it is written: the numbers stay
    places = _sharded(ranked(metadata(rows, "__row")), shards).select(F.col("__row").alias("__place"), "shard", "slot")
    joined = rows.join(places, rows["__row"] == places["__place"]).drop("__row", "__place")
    joined.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per shard: rows, bytes, and the range and number of values of each dimension, for pruning."""
    spans = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max), ("n", F.approx_count_distinct))]
    return _sharded(ranked(metadata(docs)), shards).groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *spans)
