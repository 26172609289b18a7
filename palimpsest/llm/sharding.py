"""Shards along a Hilbert curve over metadata. DataFrame functions only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

DIMENSIONS, BITS, SHARDS = ("lang", "source", "n_chars"), 5, 24


def _rotl(x: int, r: int, n: int) -> int:
    r %= n
    return ((x << r) | (x >> (n - r))) & ((1 << n) - 1)


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve of n dimensions as an automaton: for state * 2**n + orthant, the digit and the next state.

    A state is the entry corner and the direction of a cell; the orthants of a cell are visited in Gray code order.
    """
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    digit_of = {g: i for i, g in enumerate(gray)}

    def ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    def entry(w: int) -> int:
        return 0 if w == 0 else gray[2 * ((w - 1) // 2)]

    def direction(w: int) -> int:
        return 0 if w == 0 else (ones(w - 1) % n if w % 2 == 0 else ones(w) % n)

    digit, then = [], []
    for e in range(size):
        for d in range(n):
            for corner in range(size):
                w = digit_of[_rotl(corner ^ e, n - (d + 1) % n, n)]
                digit.append(w)
                then.append((e ^ _rotl(entry(w), d + 1, n)) * n + (d + direction(w) + 1) % n)
    return digit, then


def hilbert(cells: list[Column], bits: int) -> Column:
    """The index along the curve of the cell with these coordinates, each of `bits` bits."""
    n = len(cells)
    digit, then = (F.array(*map(F.lit, x)) for x in curve_tables(n))

    def step(acc: Column, i: Column) -> Column:
        orthant = sum((F.getbit(c, i).cast("int") * (1 << k) for k, c in enumerate(cells)), F.lit(0))
        at = acc["state"] * (1 << n) + orthant
        return F.struct((acc["h"] * (1 << n) + F.get(digit, at)).cast("long").alias("h"), F.get(then, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def _starts(rows: DataFrame, weight: str | None = None) -> tuple[DataFrame, int]:
    """(__part, __start) and the total: what comes before each partition of written rows with __at. One row for each
    partition is gathered."""
    part = F.shiftright("__at", 33).alias("__part")
    sizes = sorted((r["__part"], r["n"]) for r in rows.groupBy(part).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    # As Arrow: from Python rows, each executor would start Python workers of another kind, which stay for later stages.
    parts, starts = zip(*before, strict=True) if before else ((), ())
    return rows.sparkSession.createDataFrame(pa.table({"__part": pa.array(parts, pa.int64()), "__start": pa.array(starts, pa.int64())})), total


def cuts(docs: DataFrame, name: str, cells: int) -> list[tuple[object, int]]:
    """(value, cell): the values of a column at which a new cell begins, so that cells hold about equally many rows.

    Distinct values are counted and range-sorted; a value is in the cell in which the middle of its rows falls. A cell that
    one value overfills leaves others empty. `cells` rows are gathered at most; nulls don't count.
    """
    values = docs.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__value")).agg(F.count("*").alias("__c"))
    rows = cut(values.repartitionByRange("__value").sortWithinPartitions("__value").withColumn("__at", F.monotonically_increasing_id()), "values")
    starts, total = _starts(rows, "__c")
    placed = rows.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(starts), "__part")
    within = F.coalesce(F.sum("__c").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = F.expr(f"(2 * (__start + __within) + __c) * {cells} div (2 * {max(1, total)})")
    first = placed.withColumn("__within", within).groupBy(cell.cast("int").alias("__cell")).agg(F.min("__value").alias("__value"))
    return [(r["__value"], r["__cell"]) for r in first.orderBy("__cell").collect()]


def curve_keys(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """docs with __hilbert: each dimension is cut in at most 2**bits ranges of about equally many rows; a null is in the
    first range."""
    cells = []
    for name in dimensions:
        cell, last = F.lit(0), 0
        for value, k in cuts(docs, name, 1 << bits):
            cell, last = cell + F.when(F.col(name) >= F.lit(value), k - last).otherwise(0), k
        cells.append(F.coalesce(cell, F.lit(0)))
    names = [f"__c{k}" for k in range(len(cells))]
    return docs.withColumns(dict(zip(names, cells, strict=True))).withColumn("__hilbert", hilbert([F.col(x) for x in names], bits)).drop(*names)


def positions(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys, ordered by `order` and written, with __position: gapless from 0 over all rows.

    Rows are range-partitioned by the whole order, so equal curve indexes do not share a task; a row's place in its
    partition and the sizes of the partitions before give its position. Only one count for each partition is gathered, and
    sent back as a table of as many rows.
    """
    at = F.monotonically_increasing_id()
    rows = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "ordered")
    starts, total = _starts(rows)
    out = rows.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(starts), "__part")
    return out.withColumn("__position", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).withColumn("__total", F.lit(total).cast("long")).drop("__at", "__part", "__start")


def runs(df: DataFrame, shards: int) -> DataFrame:
    """shard and slot: `shards` runs of consecutive positions, whose lengths differ by one at most."""
    shard = F.expr(f"__position * {shards} div __total")
    first = F.expr(f"(__shard * __total + {shards - 1}) div {shards}")
    return df.withColumn("__shard", shard).withColumn("__slot", F.col("__position") - first)


def assign(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert for each row of docs.

    Rows are sorted along the curve, within a cell by text checksum and doc_id, and cut in runs: law `rows`. Equal texts of
    a cell are neighbours; across cells, or where a run ends between them, they part. Texts are not shuffled, whatever
    their length. Null text: no checksum, size 8. Null dimensions fall in the first range; ties in all keys are equal
    rows; null ids sort first. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    narrow = curve_keys(docs, dimensions, bits).select(F.col("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("__hilbert"))
    out = runs(positions(narrow, ["__hilbert", "text_crc32", "doc_id", "size"]), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__hilbert").alias("hilbert"))


def with_shards(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """docs and their shard and slot (named __shard and __slot if docs has such columns), in the order of the curve, decided
    as in assign. All rows stay: null texts and ids, repeated rows, texts of any length. An empty table gives none."""
    keyed = curve_keys(docs, dimensions, bits).withColumn("__crc", F.crc32(F.col("text").cast("string").cast("binary")))
    out = runs(positions(keyed, ["__hilbert", "__crc", "doc_id"]), shards)
    taken = {c.lower() for c in docs.columns}
    return out.select(*docs.columns, *[F.col(f"__{x}").cast(kind).alias(x if x not in taken else f"__{x}") for x, kind in (("shard", "int"), ("slot", "long"))])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
