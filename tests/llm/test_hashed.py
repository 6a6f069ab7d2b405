"""Packed counts, the filter, and which signature settles a pair."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import hashed, jaccard


def _drawn(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


@pytest.mark.parametrize("bits", [0, 3])
def test_packed_counts_come_back(bits):
    keys = np.append(_drawn(500, 1), np.array([0, (1 << 64) - 1], np.uint64))
    key, count = hashed.added([keys, keys[:100], keys[:0]], [np.ones(len(keys), np.int64), np.full(100, 1 << 40), np.zeros(0, np.int64)])
    rows = hashed.packed(key, count, bits)
    parts = [hashed.opened(b) for b in rows.column("blob").to_pylist()]
    assert np.array_equal(np.concatenate([k for k, _ in parts]), key)
    assert np.array_equal(np.concatenate([c for _, c in parts]), count)
    assert all((hashed._ranges(k, bits) == r).all() for (k, _), r in zip(parts, rows.column("range").to_pylist(), strict=True))
    assert hashed.packed(key[:0], count[:0], bits).num_rows == 0


def test_a_key_is_frequent_in_a_shard_not_over_shards():
    a, b, c = np.array([5], np.uint64), np.array([6], np.uint64), np.array([7], np.uint64)
    one = np.ones(1, np.int64)
    table = pa.Table.from_batches([hashed.packed(k, n * one, 0, shard) for k, n, shard in (
        (a, 2, 0), (a, 1, 0), (b, 2, 0), (b, 2, 1), (c, 3, 2))])
    assert hashed.frequent(table, 3).tolist() == [5, 7]


@pytest.mark.parametrize("most", [64 << 20, 256])
def test_the_filter_misses_no_key(monkeypatch, most):
    monkeypatch.setattr(hashed, "FILTER_BYTES", most)
    inside, outside, bits = _drawn(5_000, 2), _drawn(20_000, 3), 2
    part = hashed._ranges(inside, bits)
    segments = [(r, hashed.segment(inside[part == r], bits)) for r in (0, 1, 2)]  # one range has nothing
    keep = hashed.Filter(segments, bits)
    assert keep.holds(inside[part < 3]).all() and not keep.holds(inside[part == 3]).any()
    if most > 256:
        assert keep.holds(outside).mean() < 0.02
    assert not hashed.Filter([], bits).holds(outside).any()


@pytest.mark.parametrize("codes", [3, 4096])
def test_a_pair_belongs_to_its_smallest_common_signature(monkeypatch, codes):
    monkeypatch.setattr(jaccard, "CODES", codes)
    rng = random.Random(6)
    before = [rng.sample(range(40), rng.randint(0, 6)) for _ in range(30)]
    found = jaccard._shared_earlier(before, slice(5, 17))
    want = [[bool(set(x) & set(y)) for y in before] for x in before[5:17]]
    off = ~np.eye(30, dtype=bool)[5:17]
    assert (found == np.array(want))[off].all()
    assert not jaccard._shared_earlier([[], []], slice(0, 2)).any()
