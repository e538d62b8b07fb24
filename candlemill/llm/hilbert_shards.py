"""Sharding in the order of a Hilbert curve over metadata.

Several dimensions are quantised to ORDER bits each: size, and named columns such as source and language. A value's
cell is the share of all rows that come before it, so cells hold about equally many rows: sizes are counted by
their logarithm in STEPS steps a doubling, names by their value, in order; a name that is among the first
VALUES of its column's frequent values has its own place, the others share those between them. A cell's index
along the Hilbert curve is the sort key; runs of equal length are cut from the sorted rows. Neighbours on the
curve agree in several dimensions at once, so a shard covers a small range in each of them, and ``manifest`` tells
the range of each, by which filters on any dimension skip shards. Equal texts take the metadata of the one with
the smallest doc_id, so they share a cell, and they are ordered by the text's hash within it, so that they stand
together.

Law: ``rows``. Shard sizes differ by one row at most; a group of equal texts is cut only where a run ends.
The order is found by a range partitioning on (index, text hash, doc_id, more), whatever the size of a
group, and the row count of each partition.

Null text: no bytes, size 8, CRC of the empty text. Null dimensions: cell 0. Rows that repeat are rows
like others; ties follow the text's hash and the doc_id. Long texts count with all their bytes. Empty table: no
rows. Extra columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, prepare, with_rank

SHARDS, ORDER = 24, 8
#: Sizes that are told apart in a doubling; values of a column that have their own place.
STEPS, VALUES = 8, 4096


def hilbert_index(cells: list[Column], order: int = ORDER) -> Column:
    """Index along the Hilbert curve of cells with ``order`` bits in each dimension (Skilling's transform).

    The expressions are kept as columns of an array that each bit's step rewrites, so that they stay short.
    """
    n = len(cells)
    state = F.array(*[c.cast("long") for c in cells])
    item = lambda a, i: F.element_at(a, i + 1)

    def rewrite(bit: int, i: int):
        q, p = 1 << bit, F.lit((1 << bit) - 1).cast("long")

        def step(a: Column) -> Column:
            has = item(a, i).bitwiseAND(F.lit(q).cast("long")) != 0
            swap = item(a, 0).bitwiseXOR(item(a, i)).bitwiseAND(p)
            first = F.when(has, item(a, 0).bitwiseXOR(p)).otherwise(item(a, 0).bitwiseXOR(swap))
            other = F.when(has, item(a, i)).otherwise(item(a, i).bitwiseXOR(swap))
            return F.array(*[first if j == 0 else other if j == i else item(a, j) for j in range(n)])

        return step

    # lambdas bind each step's array once; a plain nesting would repeat it
    bind = lambda a, f: F.element_at(F.transform(F.array(a), f), 1)
    for bit in range(order - 1, 0, -1):
        for i in range(n):
            state = bind(state, rewrite(bit, i))

    def gray(a: Column) -> Column:
        out = [item(a, 0)]
        for i in range(1, n):
            out.append(out[-1].bitwiseXOR(item(a, i)))
        return F.array(*out)

    state = bind(state, gray)

    def undo(a: Column) -> Column:
        t = F.lit(0).cast("long")
        for bit in range(order - 1, 0, -1):
            t = t.bitwiseXOR(F.when(item(a, n - 1).bitwiseAND(F.lit(1 << bit).cast("long")) != 0, F.lit((1 << bit) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.transform(a, lambda x: x.bitwiseXOR(t))

    state = bind(state, undo)

    def interleave(a: Column) -> Column:
        out = F.lit(0).cast("long")
        for bit in range(order):
            for i in range(n):
                out = out.bitwiseOR(F.shiftleft(F.shiftright(item(a, i), bit).bitwiseAND(F.lit(1).cast("long")), bit * n + n - 1 - i))
        return out

    return bind(state, interleave)


def cell_table(rows: DataFrame, column: str) -> DataFrame:
    """(value, cell) of at most VALUES values of a column, in order: the share of rows before it, in 2 ** ORDER parts."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.orderBy(F.col("n").desc(), "value").limit(VALUES)
    before = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy())
    return frequent.select("value", F.least(F.lit((1 << ORDER) - 1), F.floor(F.coalesce(before, F.lit(0)) * (1 << ORDER) / total)).cast("int").alias("cell"))


def order_rows(documents: DataFrame, text: str = "text", doc: str = "doc_id", dimensions: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, bytes, size, text_crc32, dim_0 .., curve, rank) of every row; rank is its place along the curve."""
    prepare(documents.sparkSession)
    there = [c for c in dimensions if c in documents.columns]
    own = picked(documents, doc_id=doc, text=text, **{f"dim_{i}": c for i, c in enumerate(there)})
    whole = F.coalesce(F.col("text"), F.lit(""))
    dims = [f"dim_{i}" for i in range(len(there))]
    rows = own.select(
        "doc_id",
        F.octet_length(whole).cast("long").alias("bytes"),
        F.crc32(whole).alias("text_crc32"),
        F.md5(whole).alias("group"),
        *[F.col(d).cast("string").alias(d) for d in dims],
    ).withColumn("step", F.floor(F.log2(F.col("bytes") + 1) * STEPS).cast("int"))
    # one row for each group of equal texts: partial sums before the shuffle, however large the group
    named = [F.col(d).alias(f"of_{d}") for d in dims]
    groups = rows.select("group", "doc_id", "step", *named).groupBy("group").agg(F.min(F.struct("doc_id", "step", *[f"of_{d}" for d in dims])).alias("m")).select("group", "m.*")
    axes = ["step", *[f"of_{d}" for d in dims]]
    cells = []
    for axis, column in zip(axes, ["step", *dims], strict=True):
        # a bounded table: VALUES rows at most. A value that is not in it takes the cell of its hash
        known = cell_table(rows, column).select(F.col("value").alias(axis), F.col("cell").alias(f"cell_{axis}"))
        groups = groups.join(F.broadcast(known), axis, "left")
        rare = F.when(F.col(axis).isNotNull(), F.pmod(F.xxhash64(axis), F.lit(1 << ORDER)).cast("int"))
        cells.append(F.coalesce(f"cell_{axis}", rare, F.lit(0)))
    curved = groups.select("group", hilbert_index(cells).alias("curve"))
    joined = rows.drop("step").join(curved, "group")
    return with_rank(joined, ["curve", "group", "doc_id"]).withColumn("size", F.col("bytes") + 8)


def manifest(placed: DataFrame) -> DataFrame:
    """One row for each shard: rows, and the smallest and largest bytes and value of each dimension."""
    dims = [c for c in placed.columns if c.startswith("dim_")]
    ends = [f(c).alias(f"{n}_{c}") for c in ("bytes", *dims) for n, f in (("least", F.min), ("most", F.max))]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)


def shard(documents: DataFrame, shards: int = SHARDS, **names) -> DataFrame:
    """Adds shard and slot to ``order_rows``: runs whose lengths differ by one at most, longer ones first."""
    ranked = order_rows(documents, **names)
    total = ranked.agg(F.count(F.lit(1)).alias("_total"))
    base, more = F.floor(F.col("_total") / F.lit(shards)), F.col("_total") % F.lit(shards)
    head = more * (base + 1)  # rows in the longer runs
    late = F.col("rank") - head
    number = F.when(late < 0, F.floor(F.col("rank") / (base + 1))).otherwise(more + F.floor(late / F.greatest(base, F.lit(1))))
    placed = ranked.join(F.broadcast(total)).withColumn("shard", number.cast("int"))
    return placed.withColumn("slot", F.col("rank") - F.when(late < 0, F.col("shard") * (base + 1)).otherwise(head + (F.col("shard") - more) * base)).drop("_total")


def op1_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    from .common import read

    placed = shard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
