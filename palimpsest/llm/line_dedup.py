"""Removal of lines that many documents share, by two Bloom filters and exact confirmation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, add_bits, arrow, cut, has_bits, log2_bits_for, portions, seen_bits, table, texts

MIN_CHARS, MIN_DOCS = 40, 5
_STRIP = b" \t\n\v\f\r"
_TAIL = re.compile(rb"[\x80-\xbf]+")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a line stripped and in lower case (A-Z); None for one of fewer than min_chars code points."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(_TAIL.sub(b"", key)) < min_chars and sum(b & 0xC0 != 0x80 for b in key) < min_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _keys(blob: bytes, min_chars: int) -> set[bytes]:
    return {k for x in set(blob.split(b"\n")) if (k := line_key(x, min_chars))}


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """64 bits of each document's distinct line keys, each hash twice at most for a batch of documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(0))
            for p in portions(blobs):
                got = np.sort(np.frombuffer(b"".join(k[:8] for t in blobs[p] for k in _keys(t, min_chars)), np.int64))
                third = np.concatenate((np.zeros(min(2, len(got)), bool), (got[2:] == got[:-2])))
                yield pa.record_batch([pa.array(got[~third])], names=["h"])

    return arrow(docs.select(F.col("text").cast("string")), run, "h long")


def _repeated(hashes: DataFrame, segments: int, log2_bits: int) -> DataFrame:
    """The hashes that come twice or more, and some that come once: each of `segments` tasks has a Bloom filter of its own
    for its part of the hashes, and lets a hash pass whose bits it has seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(1 << (log2_bits - 3), np.uint8)
        for b in batches:
            h = np.sort(b.column(0).to_numpy(zero_copy_only=False).view(U64))
            twice = np.concatenate(([False], h[1:] == h[:-1]))
            hit = h[has_bits(once, h) | twice]
            add_bits(once, h)
            yield pa.record_batch([pa.array(np.unique(hit).view(np.int64))], names=["h"])

    return arrow(hashes.repartition(segments, "h"), run, "h long").distinct()


def twice_seen(hashes: DataFrame, possible: int, high: int = 28) -> np.ndarray:
    """A Bloom filter that has all bits of each hash that comes twice or more, of 2**high bits at most.

    With room for six bits for each possible hash, two filters are filled where the texts are: what sets bits that are set
    goes to the second. Beyond that, hashes (8 bytes a line) are dealt to as many tasks as there are such filters, and the
    one that is returned takes those that come again.
    """
    if possible * 6 <= 1 << high:
        return seen_bits(hashes, log2_bits_for(possible, 6, high=high), twice=True)
    found = cut(_repeated(hashes, -(-possible * 6 // (1 << high)), high), "repeated")
    return seen_bits(found, log2_bits_for(found.count(), 6, high=high))


def _suspects(docs: DataFrame, filled: np.ndarray, min_chars: int) -> DataFrame:
    """(doc_id, hi, lo) of the keys whose bits have all been seen twice."""
    held = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(1))
            for p in portions(blobs):
                keys = [_keys(t, min_chars) for t in blobs[p]]
                both = np.frombuffer(b"".join(k for ks in keys for k in ks), np.int64).reshape(-1, 2)
                row = np.repeat(np.arange(p.start, p.stop), [len(ks) for ks in keys])
                hit = has_bits(held.value, np.ascontiguousarray(both[:, 0]).view(U64))
                both = both[hit]
                yield pa.record_batch([b.column(0).take(pa.array(row[hit])), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["doc_id", "hi", "lo"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")), run, "doc_id long, hi long, lo long")


def repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, high: int = 28) -> DataFrame:
    """(doc_id, keys): for each document the keys whose lines it loses, all but the largest doc_id that holds them.

    A first pass sets bits of each key in one Bloom filter, and in a second filter those that were set before. Only keys
    that pass the second are shuffled, once for each document, and counted exactly.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    filled = twice_seen(_hashes(docs, min_chars), size // max(1, min_chars) + 1, high)
    rows = cut(_suspects(docs, filled, min_chars).distinct(), "suspects")
    common = cut(rows.groupBy("hi", "lo").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).drop("n"), "common")
    gone = rows.join(common, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return gone.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))


def _affected(docs: DataFrame, filled: np.ndarray, wanted: bool) -> DataFrame:
    """The rows of docs(doc_id, text) whose id the filter has, or has not. Rows without an id count as being in it."""
    held = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            hit = has_bits(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64)) | ids.is_null().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit == wanted))

    return arrow(docs, run, "doc_id long, text string")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, high: int = 28) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text for each row of docs.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of min_chars code points or more
    that min_docs documents hold lose all their lines, except in the largest doc_id that holds them. Keys are compared
    by 128 bits of BLAKE2. Only texts whose ids a bit filter of the documents that lose lines lets pass are shuffled to
    meet these lines.

    Null or empty text: one empty line, kept. Null doc_ids are no document when documents are counted, and lose all
    lines of common keys. Repeated rows are one document and give repeated results, and the rows of one id with several
    texts are one document. Texts and lines of any length are read whole. Other columns are ignored; an empty table gives
    an empty result.
    """
    gone = cut(repeats(docs, min_chars, min_docs, high), "repeats").select(F.col("doc_id").alias("id"), "keys")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    filled = seen_bits(gone.select("id"), log2_bits_for(gone.count(), 12, high=high))
    # By a shuffle at every size: what is lost grows with the input, and is no table to send to all.
    j = _affected(d, filled, True).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "keys.hi", "keys.lo")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(1))
            for p in portions(blobs):
                part = b.slice(p.start, p.stop - p.start)
                lines, dropped, kept = [], [], []
                for t, hi, lo in zip(blobs[p], part.column(2), part.column(3), strict=True):
                    x = t.split(b"\n")
                    lines.append(len(x))
                    if hi.is_valid:
                        bad = {r.tobytes() for r in np.stack((hi.values.to_numpy(), lo.values.to_numpy()), axis=1)}
                        x = [y for y in x if line_key(y, min_chars) not in bad]
                    dropped.append(lines[-1] - len(x))
                    kept.append(b"\n".join(x))
                yield pa.record_batch([part.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = _affected(d, filled, False).select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("kept_text"))
    return arrow(j, run, "doc_id long, n_lines long, n_dropped long, kept_text string").unionByName(whole)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
