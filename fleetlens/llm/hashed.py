"""Counts of 64-bit hashes: packed by map tasks, added up by ranges, and sent on as a Bloom filter of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from fleetlens.llm.common import mixed

#: The largest filter, and its bits for each key below that size.
FILTER_BYTES, KEY_BITS = 64 << 20, 16
#: Bytes of keys and counts that a range's task is meant to add up at a time.
RANGE_BYTES = 8 << 20

BLOBS = "range long, shard long, blob binary"


def range_bits(n_bytes: int) -> int:
    """How many leading bits of a hash tell the ranges, for so many bytes of keys."""
    return max(0, (n_bytes // RANGE_BYTES).bit_length())


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(count[order], heads) if len(heads) else count[:0]


def packed(key: np.ndarray, count: np.ndarray, bits: int, shard: int = 0) -> pa.RecordBatch:
    """Rows (range, shard, blob) of sorted keys and their counts."""
    pack = zstandard.ZstdCompressor(level=1)
    part = _ranges(key, bits)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(key) else np.zeros(0, np.int64)
    steps = key.copy()
    steps[1:] -= key[:-1]
    steps[cuts] = key[cuts]
    blobs = [pack.compress(len(k).to_bytes(8, "little") + k.astype("<u8").tobytes() + c.astype("<i8").view(np.uint8).reshape(-1, 8)
                           .T.tobytes()) for k, c in zip(np.split(steps, cuts[1:]), np.split(count, cuts[1:]), strict=True)] if len(key) else []
    return pa.RecordBatch.from_pydict({"range": pa.array(part[cuts]), "shard": pa.array(np.full(len(cuts), shard, np.int64)),
                                       "blob": pa.array(blobs, pa.binary())})


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return (np.cumsum(np.frombuffer(raw, "<u8", n, 8)),
            np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n).reshape(8, n).T).view("<i8").ravel())


def frequent(table: pa.Table, support: int) -> np.ndarray:
    """What has a count of at least `support` in any shard of a range's blobs."""
    shards = table.column("shard").to_numpy()
    union = np.zeros(0, np.uint64)
    for shard in np.unique(shards).tolist():
        key, count = added(*zip(*(opened(table.column("blob")[i].as_py()) for i in np.flatnonzero(shards == shard).tolist()),
                                strict=True))
        union = np.union1d(union, key[count >= support])
    return union


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number that chooses the block, four bits of its 64) of each key."""
    drawn = mixed(keys + np.uint64(0x632BE59BD9B4E019))
    bits = np.zeros(len(keys), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << (drawn >> np.uint64(shift) & np.uint64(63))
    return drawn >> np.uint64(24), bits


def segment(keys: np.ndarray, bits: int) -> bytes:
    """A range's part of the filter: KEY_BITS bits a key, rounded up to a power of two of blocks, up to its share of the whole."""
    most, blocks = FILTER_BYTES >> bits, 1
    while blocks * 64 < len(keys) * KEY_BITS and blocks * 16 <= most:
        blocks *= 2
    out = np.zeros(blocks, np.uint64)
    at, marks = _bits(keys)
    np.bitwise_or.at(out, (at & np.uint64(blocks - 1)).astype(np.int64), marks)
    return out.tobytes()


class Filter:
    """A Bloom filter in blocks of 64 bits, put together from the ranges' segments: no key that went in is missed."""

    def __init__(self, segments: list[tuple[int, bytes]], bits: int):
        self.bits = bits
        sizes = np.zeros(1 << bits, np.int64)
        for number, raw in segments:
            sizes[number] = len(raw) // 8
        self.at = np.cumsum(sizes) - sizes
        self.mask = np.maximum(sizes - 1, 0)
        self.any = sizes > 0
        self.words = np.frombuffer(b"".join(raw for _, raw in sorted(segments)) or b"\0" * 8, np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        part = _ranges(keys, self.bits)
        at, marks = _bits(keys)
        place = self.at[part] + (at.astype(np.int64) & self.mask[part])
        return (self.words[np.minimum(place, len(self.words) - 1)] & marks == marks) & self.any[part]
