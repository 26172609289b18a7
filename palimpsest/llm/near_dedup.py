"""Near-duplicate removal by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Spans, _SPACE, arrow, components, cut, has_bits, joined, keyed, log2_bits_for, mix, portions, runs, seen_bits, signed, table, texts, window_hashes

#: Bands of coordinates: at similarity 0.8 a pair misses all bands once in 300,000 times, (1 - 0.8**5)**32.
BANDS, ROWS = 32, 5
EMPTY = U64(0xFFFFFFFFFFFFFFFF)
#: Texts of a pivot in one block, and the share of coordinates in which texts must agree to be compared in full.
BLOCK, AGREE = 200, 0.66


def shingles(blobs: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of a shorter text, its whole sequence as one."""
    buf, begin = joined([b.lower() for b in blobs])
    start, end = runs(~_SPACE[buf])
    doc = np.searchsorted(begin, start, side="right") - 1
    w = Spans(buf).hash(start, end)
    s, at = window_hashes(w, doc, k)
    cuts = np.searchsorted(doc[at], np.arange(len(blobs) + 1))
    words = np.searchsorted(doc, np.arange(len(blobs) + 1))
    out = []
    for i in range(len(blobs)):
        if cuts[i] < cuts[i + 1]:
            out.append(np.unique(s[cuts[i] : cuts[i + 1]]))
        else:
            few = w[words[i] : words[i + 1]]
            h = np.full(min(1, len(few)), len(few), U64)
            for x in few:
                h = mix(h) * U64(0xD6E8FEB86659FD93) + x
            out.append(h)
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of t coordinates, a row for each set.

    In round i < t each element goes to a bin by hash; in round t + i all go to bin i, so that after 2t rounds every
    bin of a set with elements is filled. A bin keeps its least value, and values of earlier rounds are less. Sets whose
    bins are all filled take no further part, which for sets of t log t elements is after about one round.
    """
    out = np.full((len(sets), t), EMPTY, U64)
    flat, x = out.reshape(-1), np.concatenate(sets) if sets else np.zeros(0, U64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(x):
                break
            h = mix(x ^ mix(np.array([i + 1], U64)))
            value = U64(i << 54) | (h >> U64(10))
            bins = (((mix(h) >> U64(32)) * U64(t)) >> U64(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(flat, row * t + bins, value)
            left = (out == EMPTY).any(axis=1)[row]
            x, row = x[left], row[left]
    return out


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, whatever the order of its elements."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(np.array([mix(s ^ U64(salt)).sum() + U64(len(s))], U64)).view(np.int64)[0]) for salt in (0x51ED270B, 0xC2B2AE3D27D4EB4F))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """The columns of docs(..., text) but the last, n (set size), hi and lo (128 bits that name the set), bands, sketch (a
    byte of each coordinate)."""
    names = docs.columns[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(len(names)))
            for p in portions(blobs):
                sets = shingles(blobs[p], k)
                sk = sketches(sets, BANDS * ROWS)
                bands = np.zeros((len(sets), BANDS), U64)
                for i in range(ROWS):
                    bands = mix(bands * U64(0xD6E8FEB86659FD93) + sk[:, i::ROWS] + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))
                keys = np.array([_set_key(s) for s in sets], np.int64).reshape(-1, 2)
                low = mix(sk).astype(np.uint8)
                yield pa.record_batch(
                    [
                        *(c[p.start : p.stop] for c in b.columns[:-1]),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.ascontiguousarray(keys[:, 0])),
                        pa.array(np.ascontiguousarray(keys[:, 1])),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32)), signed(bands.reshape(-1))),
                        pa.array([r.tobytes() for r in low], pa.binary()),
                    ],
                    names=[*names, "n", "hi", "lo", "bands", "sketch"],
                )

    return arrow(docs, run, "".join(f"{c} {t}, " for c, t in docs.dtypes[:-1]) + "n long, hi long, lo long, bands array<long>, sketch binary")


def _sets_of(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(node, elements) of wanted(hi, lo, node, rep), from rows of docs(doc_id, text) whose id is rep.

    A bit filter of fixed size keeps most other texts from being cut into shingles; what passes it by chance is dropped by
    a join on all 128 bits, which shuffles no more than the sets that were made.
    """
    hashed = F.xxhash64("doc_id")
    bits = docs.sparkSession.sparkContext.broadcast(seen_bits(wanted.select(F.xxhash64("rep")), log2_bits_for(max(1, wanted.count()), 12)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bits.value
        for b in batches:
            b = b.filter(pa.array(has_bits(filled, b.column(0).to_numpy(zero_copy_only=False).view(U64))))
            blobs = texts(b.column(1))
            for p in portions(blobs):
                sets = [s for s in shingles(blobs[p], k) if len(s)]
                keys = np.array([_set_key(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array([s.tobytes() for s in sets], pa.binary())], names=["hi", "lo", "elements"])

    made = arrow(docs.select(hashed, "text"), run, "hi long, lo long, elements binary")
    return made.join(wanted.select("hi", "lo", "node"), ["hi", "lo"]).groupBy("hi", "lo").agg(F.first("node").alias("node"), F.first("elements").alias("elements")).select("node", "elements")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) for which 100 * intersection >= percent * union, on the full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    j = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    return arrow(j.select("a", "b", "x", "y"), run, "a long, b long")


def _dealt(few: DataFrame) -> DataFrame:
    """few(b, node, root) with p, q and side: the pairs of blocks of a pivot b that a text takes part in, and its side.

    A component of BLOCK texts or more has blocks of its own, smaller ones share blocks. Blocks of one component never
    meet, so copies of a text, however many, meet only what is not linked to them yet.
    """
    sizes = cut(few.groupBy("b", "root").agg(F.count("*").alias("c")), "sizes")
    large = F.col("c") >= BLOCK
    pooled = sizes.where(~large).groupBy("b").agg(F.sum("c").alias("c")).select("b", F.lit(-1).cast("long").alias("owner"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    own = sizes.where(large).select("b", F.col("root").alias("owner"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    owners = cut(pooled.unionByName(own), "owners")
    block = F.struct("owner", "k").alias("block")
    blocks = owners.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("b", block)
    p, q = blocks.select("b", F.col("block").alias("p")), blocks.select("b", F.col("block").alias("q"))
    pairs = p.join(q, "b").where("p < q and (p.owner <> q.owner or p.owner = -1) or p = q and p.owner = -1")
    sides = pairs.select("b", F.col("p").alias("block"), "p", "q", F.lit(0).alias("side")).unionByName(pairs.where("p <> q").select("b", F.col("q").alias("block"), "p", "q", F.lit(1).alias("side")))
    members = few.join(sizes, ["b", "root"]).withColumn("owner", F.when(large, F.col("root")).otherwise(-1)).join(owners, ["b", "owner"])
    # The texts of a large component are dealt by their own hash, small components as a whole.
    at = F.pmod(F.when(F.col("owner") == -1, F.xxhash64("root")).otherwise(F.xxhash64("node")), F.col("blocks")).cast("int")
    return members.withColumn("k", at).select("b", "node", "root", block).join(sides, ["b", "block"]).drop("block")


def _unresolved(pairs: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of roots that links join, of what the pivots left apart.

    Two texts of a bucket both stand in a pair with its pivot, so the texts of each pivot that are not of one component yet
    are compared with each other, block by block with the full sets: no task holds all texts of a pivot, no pair becomes a
    row, only links do. Pairs whose sketches agree in less than AGREE of the coordinates are passed over; one of similarity
    0.8 does once in 100,000 times.
    """
    named = cut(pairs.join(labels, F.col("a") == F.col("node"), "left").select("b", F.col("a").alias("node"), F.coalesce("root", "a").alias("root")), "members")
    several = named.groupBy("b").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("b")
    dealt = _dealt(cut(named.join(several, "b", "left_semi"), "few"))
    held = dealt.join(classes.select("node", "sketch"), "node").join(sets, "node").select("b", "p", "q", "side", "root", "sketch", "elements")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        s = np.frombuffer(b"".join(x["sketch"]), np.uint8).reshape(len(x), -1)
        sets = [np.frombuffer(e, U64) for e in x["elements"]]
        n = np.array([len(e) for e in sets])
        root, side = x["root"].to_numpy(), x["side"].to_numpy()
        group = np.unique(root, return_inverse=True)[1]
        right = np.flatnonzero(side == side.max())
        out = []
        for u in np.flatnonzero(side == 0):
            v = right[(group[right] != group[u]) & (100 * np.minimum(n[right], n[u]) >= percent * np.maximum(n[right], n[u]))]
            for w in v[(s[v] == s[u]).mean(axis=1) >= AGREE] if len(v) else v:
                if group[w] != group[u]:
                    both = len(np.intersect1d(sets[u], sets[w], assume_unique=True))
                    if 100 * both >= percent * (n[u] + n[w] - both):
                        out.append((root[u], root[w]))
                        group[group == group[w]] = group[u]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return held.groupBy("b", "p", "q").applyInPandas(compare, "a long, b long")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The columns of docs(doc_id, ..., text) but the last, n (set size), root (a number of the component; null for an empty
    set) and least (the smallest doc_id of the component).

    Texts with equal shingle sets are one class from the start, so copies are never paired; classes are numbered when they
    are written. In each bucket of each band, all classes are compared with one of them; what is then still unlinked is
    compared in blocks. All links are confirmed on the full sets, with 64-bit hashes for shingles.
    """
    sig = cut(signatures(docs, k), "signatures")
    classes = sig.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = classes.select("node", F.explode("bands").alias("band"))
    buckets = cut(rows.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("band", "pivot"), "buckets")
    pairs = cut(rows.join(buckets, "band").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(classes.join(met, "node", "left_semi").select("hi", "lo", "node", "rep"), "wanted")
    sets = cut(_sets_of(docs.select("doc_id", "text"), k, wanted), "sets")
    # Links are written by components(), not here too: on a local file system, each file takes children of an executor's JVM.
    labels = components(_verified(pairs, sets, percent))
    above = components(_unresolved(pairs, labels, classes, sets, percent)).toDF("root", "above")
    named = classes.join(labels, "node", "left").select("hi", "lo", "rep", F.coalesce("root", "node").alias("root"))
    if not above.isEmpty():
        named = named.join(above, "root", "left").select("hi", "lo", "rep", F.coalesce("above", "root").alias("root"))
    named = cut(named, "named")
    least = cut(named.groupBy("root").agg(F.min("rep").alias("least")), "least")
    return sig.drop("bands", "sketch").join(named.join(least, "root").select("hi", "lo", "root", "least"), ["hi", "lo"], "left").drop("hi", "lo")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id among all that links reach), kept (doc_id = component_id).

    Null or wordless text: an empty set, linked with nothing, kept. Null doc_id: linked like any other; takes its
    component's id, and is kept only where no row of the component has an id. Rows of one id with several texts are
    texts of their own. Repeated rows give repeated results. Texts of any length are compared as wholes; ties don't arise,
    as the least id decides. Other columns are ignored; an empty table gives an empty result.
    """
    out = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), k, percent)
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: one row of each group stays, with its columns.

    It is the row of the least doc_id (of rows of one id, or without any, that of the least hash). Rows are told apart by
    id and text, so of one id with several texts, each text is judged on its own. Rows that agree in both are one. Empty
    texts, and those without words, are duplicates of nothing but themselves under one id.
    """
    own = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    group = F.coalesce(F.col("root").cast("string"), F.col("__key")).alias("group")
    rows = _grouped(own.select("doc_id", "__key", "text"), k, percent).groupBy(group, "__key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    rows = cut(rows, "rows")
    # A key stands in one group, so rows meet the first of their group by key: a group of any size is spread evenly.
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "__key")).alias("first")).select("first.__key", F.lit(True).alias("stays"))
    marks = cut(rows.join(first, "__key", "left").select("__key", F.col("stays").isNull().alias("gone"), "n").where("gone or n > 1"), "marks")
    left = keyed(docs, "doc_id").join(marks.where("gone").select("__key"), "__key", "left_anti")
    again = marks.where("not gone").select("__key")
    if not again.isEmpty():
        left = left.join(again, "__key", "left_anti").unionByName(left.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return left.select(docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
