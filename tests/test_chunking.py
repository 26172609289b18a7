import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators.chunking import GEAR, Chunker, _gear, changed_regions, fill_packs, merge_ranges, runs


def data(seed, n):
    return np.random.default_rng(seed).integers(0, 256, n, np.uint8).tobytes()


def test_gear_is_the_rolling_hash():
    view, h = np.frombuffer(data(1, 300), np.uint8), 0
    for byte, got in zip(view, _gear(view), strict=True):
        h = ((h << 1) + int(GEAR[byte])) % (1 << 64)
        assert h == int(got)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(0, 50_000))
def test_chunks_cover_and_are_bounded(seed, n):
    c = Chunker(64, 256, 1024)
    lengths = c.lengths(data(seed, n))
    assert sum(lengths) == n
    assert all(64 <= x <= 1024 for x in lengths[:-1]) and all(0 < x <= 1024 for x in lengths)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 40_000), st.lists(st.one_of(st.tuples(st.integers(0, 40_000), st.integers(1, 3000)), st.integers(0, 40_000)), max_size=5))
def test_partial_is_full(seed, n, edits):
    c, base = Chunker(64, 256, 1024), data(seed, n)
    now, extents, visible = bytearray(base), [], n
    for k, e in enumerate(edits):
        if isinstance(e, tuple):
            at, length = e
            if at > len(now):
                now.extend(bytes(at - len(now)))
            now[at : at + length] = data(seed + k + 1, length)
            extents.append((at, at + length))
        else:
            if e < len(now):
                del now[e:]
            else:
                now.extend(bytes(e - len(now)))
            visible = min(visible, e)
            extents = [(s, min(x, e)) for s, x in extents if s < e]
    part, _ = c.rechunk(c.lengths(base), n, bytes(now), changed_regions(extents, visible, n, len(now)))
    assert part == c.lengths(bytes(now))


@pytest.mark.parametrize("short", [1, 2])
def test_truncation_at_the_end(short):
    c, base = Chunker(64, 256, 1024), data(5, 20_000)
    now = base[:-short]
    assert c.rechunk(c.lengths(base), len(base), now, changed_regions([], len(now), len(base), len(now)))[0] == c.lengths(now)


def test_small_edit_reads_little():
    c, base = Chunker(64, 256, 1024), data(3, 200_000)
    now = base[:100_000] + b"x" + base[100_001:]
    lengths, read = c.rechunk(c.lengths(base), len(base), now, [(100_000, 100_001)])
    assert lengths == c.lengths(now) and read < 10_000


def test_extents_merge_where_they_touch():
    e = [(10, 20), (30, 40)]
    assert merge_ranges([*e, (20, 25)]) == [(10, 25), (30, 40)]
    assert merge_ranges([*e, (20, 25), (5, 35)]) == [(5, 40)]
    assert merge_ranges([(5, 40), (0, 1)]) == [(0, 1), (5, 40)]


def test_packs_and_runs(spark):
    o = spark.createDataFrame([("l", i, x) for i, x in enumerate([5, 5, 30, 1, 40, 2])], "lane string, seq long, len long")
    assert [r.pack for r in fill_packs(o, 32).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2]
    p = spark.createDataFrame([("p", 0, 10), ("p", 10, 10), ("p", 20, 10), ("p", 31, 5)], "pack string, offset long, len long")
    assert [r.run for r in runs(p).orderBy("offset").collect()] == [0, 0, 0, 1]
    assert [r.run for r in runs(p, 20).orderBy("offset").collect()] == [0, 0, 1, 2]
    random.seed(0)


def test_candidates_of_a_file_give_the_cuts_of_one_chunk_after_another():
    rng = np.random.default_rng(5)
    for sizes in ((64, 256, 1024), (64, 64, 64), (100, 300, 500)):
        c = Chunker(*sizes)
        for n in (0, 1, 63, 64, 65, 500, 5000, (1 << 20) - 1, (1 << 20) + 700):
            view = rng.integers(0, 256 if n % 2 else 3, n, dtype=np.uint8)
            want, at = [], 0
            while at < n:
                want.append(c.next_cut(view[at : at + c.most]))
                at += want[-1]
            assert c.lengths(view.tobytes()) == want
