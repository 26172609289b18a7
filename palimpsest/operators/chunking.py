"""Content-defined chunking, partial re-chunking, pages, packs and runs."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Fixed values of the format: least, mean and largest chunk, and entries of a page.
SIZES, PAGE = (262_144, 1_048_576, 4_194_304), 4096
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "little") for i in range(256)], np.uint64)
_REACH = 64


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum over the last 64 bytes of table[byte] << age, modulo 2**64."""
    h = GEAR[data]
    shift = 1
    while shift < _REACH:
        h[shift:] = h[shift:] + (h[:-shift] << np.uint64(shift))
        shift *= 2
    return h


class Chunker:
    """Normalised chunking: a stricter mask before the mean size, a looser one after it.

    A cut depends on the bytes since the last one (the hash is of the last 64 bytes, fewer at the start of a chunk) and
    on the least, mean and largest size.
    """

    def __init__(self, least: int = SIZES[0], mean: int = SIZES[1], most: int = SIZES[2]):
        self.least, self.mean, self.most = least, mean, most
        bits = max(1, mean.bit_length() - 1)
        self.strict = np.uint64(((1 << (bits + 1)) - 1) << (64 - bits - 1))
        self.loose = np.uint64(((1 << max(1, bits - 1)) - 1) << (64 - max(1, bits - 1)))

    def next_cut(self, data: np.ndarray) -> int:
        """Length of the first chunk of data, which reaches to the end of the file or holds `most` bytes."""
        n = min(len(data), self.most)
        if n <= self.least:
            return n
        h = _gear(data[max(0, self.least - _REACH) : n])[self.least - max(0, self.least - _REACH) :]
        mean = min(self.mean, n) - self.least
        for part, mask, at in ((h[:mean], self.strict, self.least), (h[mean:], self.loose, self.least + mean)):
            hit = np.flatnonzero((part & mask) == 0)
            if len(hit):
                return at + int(hit[0]) + 1 if at + int(hit[0]) + 1 < n else n
        return n

    def _candidates(self, view: np.ndarray, step: int = 1 << 20) -> tuple[list[int], list[int]]:
        """Ends (of the byte that closes a chunk, plus one) where the strict mask holds, and where the loose one does.

        A hash is of the last 64 bytes, so the file is hashed once, in steps that overlap by as many.
        """
        strict, loose = [], []
        for at in range(0, len(view), step):
            lead = min(at, _REACH)
            h = _gear(view[at - lead : at + step])[lead:]
            hit = np.flatnonzero((h & self.loose) == 0)
            loose.append(hit + at + 1)
            strict.append(hit[(h[hit] & self.strict) == 0] + at + 1)
        return tuple(np.concatenate(x).tolist() if x else [] for x in (strict, loose))

    def lengths(self, data: bytes) -> list[int]:
        view, out, at = np.frombuffer(data, np.uint8), [], 0
        if self.least < _REACH:  # the hash at a cut then depends on where the chunk began
            while at < len(view):
                out.append(self.next_cut(view[at : at + self.most]))
                at += out[-1]
            return out
        strict, loose = self._candidates(view)
        while at < len(view):
            n = min(len(view) - at, self.most)
            mean = min(self.mean, n)
            i, j = bisect_right(strict, at + self.least), bisect_right(loose, at + mean)
            if n > self.least and i < len(strict) and strict[i] <= at + mean:
                n = strict[i] - at
            elif n > self.least and j < len(loose):
                n = min(n, loose[j] - at)
            out.append(n)
            at += n
        return out

    def rechunk(self, base: list[int], base_size: int, merged: bytes, regions: list[tuple[int, int]]) -> tuple[list[int], int]:
        """Chunk lengths of merged, and how many of its bytes were read, given those of the base that it was made from.

        regions are the changed ranges, sorted and apart. Cutting starts at the base chunk that holds the byte before a
        region, and stops at a cut that is a base boundary past it, while what follows is unchanged to the end.
        """
        starts = np.concatenate(([0], np.cumsum(base))).tolist()
        resized = len(merged) != base_size
        if resized:
            regions = merge_ranges([*regions, (max(0, min(base_size, len(merged)) - 1), max(base_size, len(merged)))])
        out: list[int] = []
        at = read = i = 0
        edges = set(starts[:-1])
        view = np.frombuffer(merged, np.uint8)
        while at < len(view):
            while i < len(regions) and regions[i][1] <= at:
                i += 1
            k = int(np.searchsorted(starts, at))
            if at in edges and (i == len(regions) or starts[k + 1] < regions[i][0]):
                out.append(base[k])  # its bytes, and the first after it, are as they were
                at += base[k]
                continue
            out.append(self.next_cut(view[at : at + self.most]))
            read += out[-1]
            at += out[-1]
        return out, read


def merge_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union; ranges that touch become one, empty ones go."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(r for r in ranges if r[0] < r[1]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def changed_regions(extents: Iterable[tuple[int, int]], base_visible: int, base_size: int, size: int) -> list[tuple[int, int]]:
    """Extents clipped to the file's size, and all from where the base is no longer visible."""
    clipped = [(s, min(e, size)) for s, e in extents]
    if base_visible < size or size != base_size:
        clipped.append((min(base_visible, size), size))
    return merge_ranges(clipped)


def _arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def chunk(files: DataFrame, least: int = SIZES[0], mean: int = SIZES[1], most: int = SIZES[2]) -> DataFrame:
    """(path, idx, offset, len, chunk_id, data) of files(path, data binary), one row for each chunk; nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Chunker(least, mean, most)
        for b in batches:
            out: list[tuple] = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                for i, n in enumerate(c.lengths(data or b"")):
                    piece = data[at : at + n]
                    out.append((path, i, at, n, hashlib.sha256(piece).hexdigest(), piece))
                    at += n
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["path", "idx", "offset", "len", "chunk_id", "data"])

    return _arrow(files.select("path", "data"), run, "path string, idx int, offset long, len long, chunk_id string, data binary")


def rechunk(edits: DataFrame, least: int, mean: int, most: int) -> DataFrame:
    """(path, equal, chunks, reread, size) for edits(path, base binary, at, patch binary): base with patch written at `at`,
    cut partly anew; equal says whether cutting all of it gives the same chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Chunker(least, mean, most)
        for b in batches:
            out = []
            for path, base, at, patch in zip(*(x.to_pylist() for x in b.columns), strict=True):
                merged = (base[:at].ljust(at, b"\0") + patch + base[at + len(patch) :])
                region = [(min(at, len(base)), at + len(patch))] if patch else []
                part, read = c.rechunk(c.lengths(base), len(base), merged, region)
                out.append((path, part == c.lengths(merged), len(part), read, len(merged)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["path", "equal", "chunks", "reread", "size"])

    return _arrow(edits.select("path", "base", "at", "patch"), run, "path string, equal boolean, chunks long, reread long, size long")


def reassemble(chunks: DataFrame, *more: Column) -> DataFrame:
    """(path, data, ...) of chunks(path, idx, data), joined in order, with more aggregates of the same chunks."""
    parts = F.array_sort(F.collect_list(F.struct("idx", F.hex("data").alias("h"))))
    return chunks.groupBy("path").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("data"), *more)


def paginate(pieces: DataFrame, size: int = PAGE) -> DataFrame:
    """pieces(path, idx, len) with page, offset, page_start and page_len: pages of `size` pieces, only the last one partial."""
    w = Window.partitionBy("path").orderBy("idx")
    p = pieces.withColumn("page", F.floor((F.row_number().over(w) - 1) / size)).withColumn("offset", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    page = Window.partitionBy("path", "page")
    return p.withColumn("page_start", F.min("offset").over(page)).withColumn("page_len", F.sum("len").over(page))


def _fold(df: DataFrame, key: str, order: list[str], cols: list[str], out: str, start: Callable, step: Callable) -> DataFrame:
    """df(cols) with the long column `out`, a fold over the rows of each key in order. Rows stream through a task in
    sorted order with the state of one key, so a key of any length needs no memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            got = []
            for row in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
                if row[0] != now:
                    now, state = row[0], start()
                value, state = step(state, row)
                got.append(value)
            yield pa.record_batch([*b.columns, pa.array(got, pa.int64())], names=[*b.schema.names, out])

    narrow = df.select(*cols, *[c for c in order if c not in cols])
    schema = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes) + f", {out} long"
    return _arrow(narrow.repartition(key).sortWithinPartitions(key, *order), run, schema)


def fill_packs(objects: DataFrame, target: int = 32 << 20) -> DataFrame:
    """objects(lane, seq, len) with pack: objects go to the open pack in order; once it holds target bytes a new one is
    begun, and the object that passes the target stays in the full one."""

    def step(state: tuple[int, int], row: tuple) -> tuple[int, tuple[int, int]]:
        pack, held = state
        held += row[2]
        return pack, (pack + 1, 0) if held >= target else (pack, held)

    return _fold(objects, "lane", ["seq"], ["lane", "seq", "len"], "pack", lambda: (0, 0), step)


def runs(places: DataFrame, max_span: int | None = None) -> DataFrame:
    """places(pack, offset, len) with run: what stands end to end in a pack is one run, of max_span bytes at most.

    Without a largest span these are islands of a window; with one, a fold in order.
    """
    if max_span is None:
        w = Window.partitionBy("pack").orderBy("offset", "len")
        new = F.coalesce((F.lag("offset").over(w) + F.lag("len").over(w) != F.col("offset")).cast("int"), F.lit(1))
        return places.withColumn("new", new).withColumn("run", (F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("new")

    def step(state: tuple[int, int, int], row: tuple) -> tuple[int, tuple[int, int, int]]:
        run, begin, end = state
        _, offset, length = row
        if run < 0 or offset != end or offset + length - begin > max_span:
            run, begin = run + 1, offset
        return run, (run, begin, offset + length)

    return _fold(places, "pack", ["offset", "len"], ["pack", "offset", "len"], "run", lambda: (-1, 0, 0), step)
