"""Line-first cleaning: rules on lines, then on what is left of the document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Spans, _SPACE, arrow, joined, mix, portions, runs, table, texts, window_hashes

BOILERPLATE = (
    b"all rights reserved", b"click here", b"cookie policy", b"cookies to", b"enable javascript", b"forgot your password",
    b"lorem ipsum", b"powered by", b"privacy policy", b"read more", b"share on", b"sign up", b"skip to content", b"subscribe to",
    b"terms of service", b"terms of use",
)


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _BAR, _BANG, _STOP = _lut(b"#*$%&|<>"), _lut(b"|>"), _lut(b"!"), _lut(bytes(range(128, 256)) + b".!?:;,\"')]")
_CAPITAL, _SMALL, _FIRST = _lut(bytes(range(65, 91))), _lut(bytes(range(97, 123))), ~_lut(bytes(range(128, 192)))


def _sums(mask: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[begin[1:]] - total[begin[:-1]]


def judge(blobs: list[bytes], *, min_words: int = 10, max_repeat: int = 20, max_lost: float = 0.5, min_fragment: int = 4) -> dict[str, np.ndarray]:
    """Counts and verdicts of each text, and of its lines."""
    buf, begin = joined(blobs)
    start, end = runs(~_SPACE[buf])
    n = len(blobs)
    doc = np.searchsorted(begin, start, side="right") - 1
    spans = Spans(buf)
    w = spans.hash(start, end)
    n_words = np.bincount(doc, minlength=n)
    out = {"n_words": n_words, "word_chars": _sums(_FIRST[buf] & ~_SPACE[buf], begin), "n_symbols": _sums(_SYMBOL[buf], begin)}

    # Words in a window of five that is found twice or more in its text.
    h, at = window_hashes(w, doc, 5)
    _, place, count = np.unique(mix(h ^ mix(doc[at].astype(U64))), return_inverse=True, return_counts=True)
    change = np.zeros(len(w) + 1, np.int64)
    again = at[count[place] > 1] if len(at) else at
    np.add.at(change, again, 1)
    np.add.at(change, again + 5, -1)
    covered = np.cumsum(change)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)

    # Lines: each ends with a newline of the buffer.
    line_end = np.flatnonzero(buf == 10)
    bounds = np.concatenate(([0], line_end + 1))
    line_doc = np.searchsorted(begin, bounds[:-1], side="right") - 1
    line = np.searchsorted(bounds, start, side="right") - 1
    words = np.bincount(line, minlength=len(line_end))
    live = words > 0
    key = mix(spans.hash(bounds[:-1], line_end) ^ mix(line_doc.astype(U64)))[live]
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_doc[live], minlength=n) - np.bincount(line_doc[live][first], minlength=n)

    symbols, bars, bangs, capitals, small = (_sums(x[buf], bounds) for x in (_SYMBOL, _BAR, _BANG, _CAPITAL, _SMALL))
    last = np.full(len(line_end), ord("."))
    tail = np.flatnonzero(np.diff(np.concatenate((line, [-1]))) != 0) if len(line) else line
    last[line[tail]] = buf[end[tail] - 1]
    navigation = (bars >= 2) & (4 * bars >= words) | ~_STOP[last] & (words < min_fragment)
    punctuation = (10 * symbols >= 3 * words) & (symbols >= 3) | (2 * bangs >= words) & (bangs >= 3) | (capitals >= 20) & (capitals > 3 * small)
    boilerplate = np.zeros(len(line_end), bool)
    for d, b in enumerate(blobs):
        if any(p in (low := b.lower()) for p in BOILERPLATE):
            i = np.searchsorted(line_doc, d)
            for k, x in enumerate(low.split(b"\n")):
                boilerplate[i + k] = any(p in x for p in BOILERPLATE) and words[i + k] < 40
    failed = live & (navigation | punctuation | boilerplate)
    lost = np.bincount(line_doc, weights=np.where(failed, words, 0), minlength=n)
    out["base_failed"] = (n_words < min_words) | (100 * out["n_repeat_words"] > max_repeat * n_words)
    out["kept"] = ~out["base_failed"] & (lost <= max_lost * n_words) & (n_words > lost)
    out["n_failed_lines"] = np.bincount(line_doc[failed], minlength=n)
    out["_failed"], out["_line_doc"] = failed, line_doc
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines")


def clean_lines(docs: DataFrame, with_text: bool = False, **limits: float) -> DataFrame:
    """doc_id, the counts of quality rules, base_failed, kept and, if asked for, cleaned (the text without failed lines).

    A line with words fails if it looks like navigation (bars or arrows between words, or fewer than min_fragment words
    without a mark at the end), if its punctuation is broken (symbols or exclamation marks on most words, all capitals),
    or if it is a short line with a boilerplate phrase. A document is kept if the base rules pass and the failed lines
    hold max_lost of its words at most.

    Null text: as an empty one, not kept. Null doc_id and repeated rows pass through. Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(1))
            for p in portions(blobs):
                j = judge(blobs[p], **limits)
                cols = [b.column(0)[p.start : p.stop], *(pa.array(j[c].astype(np.int64)) for c in COUNTS), pa.array(j["base_failed"]), pa.array(j["kept"])]
                if with_text:
                    out = blobs[p]
                    for d in np.unique(j["_line_doc"][j["_failed"]]):
                        i = np.searchsorted(j["_line_doc"], d)
                        out[d] = b"\n".join(x for k, x in enumerate(out[d].split(b"\n")) if not j["_failed"][i + k])
                    cols.append(pa.array(out, pa.binary()).cast(pa.string()))
                yield pa.record_batch(cols, names=["doc_id", *COUNTS, "base_failed", "kept", *["cleaned"] * with_text])

    schema = "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean" + ", cleaned string" * with_text
    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def keep_clean(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that clean_lines keeps, all columns, without their failed lines; n_chars, if there, is counted again."""
    names = docs.columns
    spot = names.index(next(c for c in names if c.lower() == "text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(spot))
            for p in portions(blobs):
                j, out = judge(blobs[p], **limits), blobs[p]
                for d in np.unique(j["_line_doc"][j["_failed"]]):
                    i = np.searchsorted(j["_line_doc"], d)
                    out[d] = b"\n".join(x for k, x in enumerate(out[d].split(b"\n")) if not j["_failed"][i + k])
                part = b.slice(p.start, p.stop - p.start)
                part = part.set_column(spot, part.schema.names[spot], pa.array(out, pa.binary()).cast(pa.string()))
                yield part.filter(pa.array(j["kept"]))

    kept = arrow(docs.withColumn(names[spot], F.col(names[spot]).cast("string")), run, docs.withColumn(names[spot], F.col(names[spot]).cast("string")).schema)
    return kept.withColumn("n_chars", F.length(names[spot]).cast("long")).select(names) if "n_chars" in names else kept


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("n_failed_lines")
