"""What the training-data operators share: written tables that cut lineage, word hashing, bit filters, components."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship

WHITE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64
__all__ = ["SEGMENT", "U64", "Spans", "add_bits", "arrow", "ascii_lower", "components", "cut", "has_bits", "joined", "keyed", "log2_bits_for", "mix", "portions", "runs", "seen_bits", "signed", "table", "texts", "window_hashes"]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow, after the package has been sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, name: str) -> DataFrame:
    """df(name, text) with __key: tells rows apart by id and text, so that rows without an id, or with one of several texts,
    are told apart. Rows that agree in both have one key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.withColumn("__key", F.concat(F.coalesce(F.col(name).cast("long").cast("string"), F.lit("")), F.lit("-"), F.md5(text.cast("binary"))))


# ---------------------------------------------------------------- words and hashes, in NumPy

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, U64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class Spans:
    """Hashes of any spans of one buffer, from running sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        self.down = _powers(len(buf) + 1)[1]
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * _powers(len(buf) + 1)[0][: len(buf)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer in which each text is followed by a newline, and where each text begins (with the end at last)."""
    buf = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    return buf, np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs])))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element is False."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    return edge[0::2], edge[1::2]


def portions(blobs: list[bytes], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of about `most` bytes at most, so that work arrays stay small; a longer text has a slice of its own."""
    begin = held = 0
    for i, b in enumerate(blobs):
        if held and held + len(b) > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(b) + 1
    if begin < len(blobs):
        yield slice(begin, len(blobs))


def window_hashes(w: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of each window of k words within a text."""
    if len(w) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    s = np.zeros(len(w) - k + 1, U64)
    for i in range(k):
        s = s * U64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i]
    at = np.flatnonzero(doc[: len(w) - k + 1] == doc[k - 1 :])
    return mix(s[at]), at


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---------------------------------------------------------------- bit filters of a fixed size

SEGMENT = 1 << 18


def seen_bits(hashes: DataFrame, log2_bits: int, k: int = 2, twice: bool = False) -> np.ndarray:
    """A Bloom filter of 2**log2_bits bits over the longs in the only column of `hashes`.

    With twice, a second filter takes each bit that is set again, and is returned: whatever comes up twice has all its
    bits there. Each task sends its own bits, packed by segment; the segments are merged on the executors, and
    2**log2_bits / 8 bytes reach the driver whatever the input.
    """
    bits = 1 << log2_bits

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(bits // 8, np.uint8)
        again = np.zeros(bits // 8 if twice else 0, np.uint8)
        for b in batches:
            h = b.column(0).drop_null().to_numpy(zero_copy_only=False).view(U64)
            if len(h):
                _mark(once, again, h, bits, k, twice)
        for i in range(0, bits // 8, SEGMENT // 8):
            o, a = once[i : i + SEGMENT // 8], again[i : i + SEGMENT // 8]
            if o.any():
                yield pa.record_batch([pa.array([i]), pa.array([zlib.compress(o.tobytes(), 1)]), pa.array([zlib.compress(a.tobytes(), 1)])], names=["at", "once", "again"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for at, o, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o, a = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, a))
                if at not in held:
                    held[at] = [o.copy(), a.copy()]
                else:
                    if twice:
                        held[at][1] |= a | (held[at][0] & o)
                    held[at][0] |= o
        for at, (o, a) in held.items():
            yield pa.record_batch([pa.array([at]), pa.array([zlib.compress((a if twice else o).tobytes(), 1)])], names=["at", "bits"])

    parts = arrow(hashes, part, "at long, once binary, again binary")
    out = np.zeros(bits // 8, np.uint8)
    # One job for all segments: an iterator over partitions would run a job for each of them, one after another.
    for r in arrow(parts.repartition("at"), merge, "at long, bits binary").collect():
        piece = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        out[r["at"] : r["at"] + len(piece)] = piece
    return out


def _places(h: np.ndarray, bits: int, i: int) -> np.ndarray:
    return (mix(h + U64((i + 1) * 0xA0761D6478BD642F % (1 << 64))) & U64(bits - 1)).astype(np.int64)


def _mark(once: np.ndarray, again: np.ndarray, h: np.ndarray, bits: int, k: int, twice: bool) -> None:
    for i in range(k):
        p = np.sort(_places(h, bits, i))
        first = np.concatenate(([True], p[1:] != p[:-1]))
        if twice:
            old = (once[p >> 3] >> (p & 7).astype(np.uint8)) & 1
            np.bitwise_or.at(again, (q := p[(old == 1) | ~first]) >> 3, np.left_shift(1, q & 7).astype(np.uint8))
        p = p[first]
        np.bitwise_or.at(once, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def add_bits(filled: np.ndarray, h: np.ndarray, k: int = 2) -> None:
    _mark(filled, filled, h, len(filled) * 8, k, False)


def has_bits(filled: np.ndarray, h: np.ndarray, k: int = 2) -> np.ndarray:
    out = np.ones(len(h), bool)
    for i in range(k):
        p = _places(h, len(filled) * 8, i)
        out &= ((filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def log2_bits_for(n: int, per: int, low: int = 18, high: int = 28) -> int:
    """At least `per` bits for each of n values; beyond 2**high bits (32 MB) more values pass, and none is lost."""
    return min(high, max(low, int(n * per - 1).bit_length()))


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node it is connected to.

    Alternates large-star and small-star steps; each step is an aggregate and a join on tables of two columns, written
    to the shared folder. A node with very many neighbours is combined before the shuffle and split in the join.
    """
    a, b = F.col("a"), F.col("b")
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")

    def smallest(x: DataFrame) -> DataFrame:
        return cut(x.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")

    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.sum("down").alias("d"), F.max("up").alias("t")).where("d > 1 or d = 1 and t = 1")
        if loose.isEmpty():
            break
        both = e.union(e.select("v", "u"))
        large = both.where("v > u").join(smallest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        m = smallest(large)
        small = large.join(m, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", "m")).where("u <> v").distinct(), "small")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
