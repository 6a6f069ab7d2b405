"""Removal of repeated substrings by suffix arrays.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a
smaller id. Strings are judged on the input; those of one document never count against
it, and none crosses documents.

Of documents with equal texts only those of the smallest id are looked at: the others lose every
byte, if they have LENGTH of them, and can make no one else lose any.

Every window (LENGTH bytes) is sent to the shard of its anchor: the smallest hash among
the GRAM-byte strings inside it, so equal windows meet. Neighbouring windows with the
same anchor travel as one stretch of text. Before that, a map task keeps one of equal
stretches: those of documents with a larger id are repeats already, and go on as maximal runs of
their document, to the shard of its id. A task sends the stretches of PIECE bytes of text at a
time, as one blob for each shard. Windows of anchors
that a sample shows in many documents (HOT of them) are sent one by one, by their own
hash, so that no shard grows with one passage.

In a shard, stretches whose anchor occurs in one document only cannot hold a repeat.
The others are compared some anchors at a time: of equal ones again only those of the smallest
document go on, and of these the windows whose hash another document has too. What is left
is worked on in blocks of BLOCK_BYTES: a suffix array by Larsson-Sadakane
refinement (each round sorts only the groups that are still open, by the rank of the
suffix 8 and 16 bytes on, and last 18, which makes 50), common prefixes of neighbours by
Kasai's rule with all stretches in step, and so the distinct windows with their smallest
document. The blocks' sorted windows are merged by binary search, which gives every
window the smallest document of all that hold its anchor.

The ranges found are put together by document and cut out of the texts. They are
broadcast if they are at most SENT_BYTES, and joined by shuffle otherwise.

Null and empty texts are empty; texts shorter than LENGTH lose nothing; a missing id
counts as the smallest. Rows with one id and several texts are told apart, and
rows that repeat one id do not count against each other. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import (FEW_IDS, SpanHash, gathered, handed_back, map_pieces, mixed, pieces, shuffles_let_go,
                                  text_bytes, tidied, written)

LENGTH, GRAM = 50, 20
#: Text that a map task hashes and that it sends at a time; stretches that a suffix array takes and that are compared at a time.
STEP, PIECE, BLOCK_BYTES, SHARD_BYTES = 512 << 10, 4 << 20, 1 << 20, 4 << 20
#: Stretches that a shard is meant to hold, and shards up to which that holds; beyond them shards grow as well.
SHIPPED_BYTES, MANY_SHARDS = 8 << 20, 1024
#: Stretches whose text is gathered at a time.
STRETCHES = 1 << 14
#: Bytes of stretches for each byte of text, about.
SPREAD = 4
#: Documents looked at for hot anchors, and the share of them that makes an anchor hot.
HOT_SAMPLE, HOT = 20_000, 0.01
SENT_BYTES = 64 << 20
#: Excerpts that make the dictionary which blobs are packed with; it changes their size only.
PACKING_TEXTS, LEVEL = 100, 3

_HASH, _CHECK = SpanHash(19), SpanHash(23)
_WHOLE = 255  # the anchor is the window itself


def _dictionary(sample: bytes) -> zstandard.ZstdCompressionDict | None:
    """What blobs are packed with, so that small ones get small as well."""
    if not sample:
        return None
    made = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return made


# ---- map side: stretches


def _anchors(data: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For every window start, the position of its smallest GRAM-byte hash (of equal ones the last)."""
    raw = (prefix[GRAM:] - prefix[:-GRAM]) * _HASH.back_powers(len(data) - GRAM + 1)
    raw ^= raw >> np.uint64(29)
    raw *= np.uint64(0xBF58476D1CE4E5B9)
    last = np.uint64(0xFFFFFFFF)
    low = (raw >> np.uint64(32) << np.uint64(32)) | (last - np.arange(len(raw), dtype=np.uint64))
    span, wanted = 1, LENGTH - GRAM + 1
    while span * 2 <= wanted:
        low[:-span] = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wanted:
        low[: span - wanted] = np.minimum(low[: span - wanted], low[wanted - span:])
    return (last - (low & last)).astype(np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor position, anchor hash) of every stretch of a batch."""
    none = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    valid = np.maximum(lengths - LENGTH + 1, 0)
    if not valid.sum():
        return none, none, none, none, none.astype(np.uint64)
    anchor = _anchors(data, prefix)
    doc = np.repeat(np.arange(len(lengths)), valid)
    at = gathered(np.arange(len(data)), offsets[:-1], valid)
    anchor = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    place = anchor[first]
    return (doc[first], at[first], np.diff(np.append(first, len(at))), place,
            _HASH.spans(prefix, place, place + GRAM))


def _runs_by_document(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of the maximal runs that ranges cover; positions are of the piece, so documents keep apart."""
    if not len(doc):
        return doc, begin, end
    order = np.argsort(begin, kind="stable")
    doc, begin, end = doc[order], begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(doc), bool)
    new[1:] = (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], begin[heads], end[np.append(heads[1:], len(doc)) - 1]


def _spelled(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The text of stretches one after the other; none is longer than all windows of an anchor are."""
    longest = 2 * LENGTH - GRAM
    wide = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(longest, np.uint8)), longest)
    out = [np.zeros(0, np.uint8)]
    for i in range(0, len(at), STRETCHES):
        out.append(wide[at[i: i + STRETCHES]][np.arange(longest) < size[i: i + STRETCHES, None]])
    return np.concatenate(out)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second bytes and so on, which packs better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: str, count: int, at: int) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, count * wide, at).reshape(wide, count).T).view(kind).ravel()


def _stretched(piece: pa.RecordBatch, hot: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Of a piece: text, ids, variants, offsets; of its stretches, windows of hot anchors one by one: document, start,
    windows, anchor, key and two hashes."""
    data, offsets = text_bytes(piece.column(2))
    prefix = _HASH.prefix(data)
    doc, start, count, place, key = stretches(data, offsets, prefix)
    if not len(doc):
        return None
    anchor = place - start
    if len(hot) and (split := np.isin(key, hot)).any():
        one = count[split]
        inside = np.arange(int(one.sum())) - np.repeat(np.cumsum(one) - one, one)
        own = np.repeat(start[split], one) + inside
        single = _HASH.spans(prefix, own, own + LENGTH)
        doc = np.append(doc[~split], np.repeat(doc[split], one))
        start, count = np.append(start[~split], own), np.append(count[~split], np.ones(len(own), np.int64))
        anchor = np.append(anchor[~split], np.full(len(own), _WHOLE))
        key = np.append(key[~split], single)
    end = start + count + LENGTH - 1
    check = _CHECK.spans(_CHECK.prefix(data), start, end)
    return (data, piece.column(0).to_numpy(), piece.column(1).to_numpy(), offsets[:-1],
            doc, start, count.astype(np.uint8), anchor.astype(np.uint8), key, _HASH.spans(prefix, start, end), check)


def _again(ids: np.ndarray, same: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The stretches that by both hashes a document with a smaller id has as well."""
    order = np.argsort(same)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (same[order][1:] != same[order][:-1]) | (check[order][1:] != check[order][:-1])
    heads = np.flatnonzero(fresh)
    again = np.zeros(len(order), bool)
    if len(order):
        least = np.minimum.reduceat(ids[order], heads)
        again[order] = ids[order] > np.repeat(least, np.diff(np.append(heads, len(order))))
    return again


def _packed(parts: list[tuple[np.ndarray, ...]], shards: int, pack: zstandard.ZstdCompressor) -> pa.RecordBatch:
    """Rows (shard, blob): the stretches of some pieces, by the shard of their anchor."""
    data, ids, variants, offsets, doc, start, count, anchor, key, same, check = (list(x) for x in zip(*parts, strict=True))
    texts, docs = (np.cumsum([0, *map(len, x[:-1])]) for x in (data, ids))
    # Places count through the text of all pieces.
    offsets, start = (np.concatenate([x + n for x, n in zip(y, texts, strict=True)]) for y in (offsets, start))
    doc = np.concatenate([x + n for x, n in zip(doc, docs, strict=True)])
    data, ids, variants, count, anchor, key, same, check = map(np.concatenate, (data, ids, variants, count, anchor, key, same, check))
    size = count.astype(np.int64) + (LENGTH - 1)
    # Of equal stretches those of the smallest document go on; the others are repeats.
    again = _again(ids[doc], same, check)
    del same, check
    kind = np.uint16 if shards <= 1 << 16 else np.int64  # sorted by its digits
    gone = np.flatnonzero(again)
    run_doc, run_begin, run_end = _runs_by_document(doc[gone], start[gone], start[gone] + size[gone])
    run_shard = (mixed(ids[run_doc].view(np.uint64)) % np.uint64(shards)).astype(kind)
    kept = np.flatnonzero(~again)
    shard = ((key[kept] >> np.uint64(20)) % np.uint64(shards)).astype(kind)
    by = np.argsort(shard, kind="stable")
    kept, shard = kept[by], shard[by]
    by = np.argsort(run_shard, kind="stable")
    run_doc, run_begin, run_end, run_shard = run_doc[by], run_begin[by], run_end[by], run_shard[by]
    numbers = np.union1d(shard, run_shard)
    begin, end = (np.searchsorted(shard, numbers, side).tolist() for side in ("left", "right"))
    run_from, run_to = (np.searchsorted(run_shard, numbers, side).tolist() for side in ("left", "right"))
    of, size = doc[kept], size[kept]
    text_to = np.cumsum(size)
    text = _spelled(data, start[kept], size)
    fields = (ids[of], variants[of], start[kept] - offsets[of])
    counts, anchors = count[kept], anchor[kept]
    run_fields = (ids[run_doc], variants[run_doc], run_begin - offsets[run_doc], run_end - offsets[run_doc])
    blobs = []
    for a, b, c, d in zip(begin, end, run_from, run_to, strict=True):
        blobs.append(pack.compress(b"".join([
            np.array([b - a, d - c], "<i8").tobytes(),
            *(_planes(np.diff(x[a:b], prepend=x.dtype.type(0))) for x in fields), counts[a:b].tobytes(),
            *(_planes(x[c:d]) for x in run_fields), anchors[a:b].tobytes(),
            text[text_to[a] - size[a]: text_to[b - 1]].tobytes() if b > a else b""])))
    return pa.RecordBatch.from_pydict({"shard": pa.array(numbers.astype(np.int64)), "blob": pa.array(blobs, pa.binary())})


def _shipped(sent, shards: int):
    """Rows (shard, blob): the stretches of a task's texts, PIECE bytes of text at a time."""

    def run(batches):
        keys, sample = sent.value
        hot = np.array(sorted(keys), np.uint64)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(sample))
        parts, held = [], 0
        for batch in batches:
            for piece in pieces(batch, "text", STEP):
                if part := _stretched(piece, hot):
                    parts.append(part)
                    held += len(part[0])
                if held >= PIECE:
                    yield _packed(parts, shards, pack)
                    parts, held = [], 0
        if parts:
            yield _packed(parts, shards, pack)

    return run


# ---- shard side: suffix arrays


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as one number in byte order."""
    padded = np.append(text, np.zeros(8, np.uint8))
    return np.ndarray(len(text), ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_order(text: np.ndarray, starts: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Positions `starts` in the order of the LENGTH bytes that follow them (equal ones by position)."""
    n = len(text)
    words = _words(text) if words is None else words
    order = np.argsort(words)
    head = np.ones(n, bool)
    head[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.full(n + LENGTH, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    for step in (8, 16):
        alone = head.copy()
        alone[:-1] &= head[1:]
        slots = np.flatnonzero(~alone)  # groups that are still open
        if not len(slots):
            break
        at = order[slots]
        key = rank[at] * (n + 1) + rank[at + step] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        change = np.ones(len(at), bool)
        change[1:] = key[1:] != key[:-1]
        head[slots] = change
        rank[at] = slots[np.maximum.accumulate(np.where(change, np.arange(len(at)), 0))]
    key = rank[starts] * (n + 1) + rank[starts + LENGTH - 32] + 1
    room = len(starts).bit_length()
    if (n + 1) ** 2 >> (64 - room):
        return np.argsort(key, kind="stable")
    # Numbers that carry their position are sorted faster than positions are.
    both = np.sort(key.astype(np.uint64) << np.uint64(room) | np.arange(len(starts), dtype=np.uint64))
    return (both & np.uint64((1 << room) - 1)).astype(np.int64)


def common_prefixes(words: np.ndarray, starts: np.ndarray, order: np.ndarray, first: np.ndarray,
                    count: np.ndarray) -> np.ndarray:
    """For each window, how much it shares with the one before it in `order`, up to LENGTH.

    Kasai's rule along every stretch: a window shares at least one byte less than the
    window to its left did, where the left neighbour's predecessor moves along.
    """
    before = np.full(len(starts), -1, np.int64)
    before[order[1:]] = order[:-1]
    stays = np.zeros(len(starts), bool)  # the next window in the text is one of the same stretch
    stays[:-1] = True
    stays[first + count - 1] = False
    shared = np.zeros(len(starts), np.int64)
    for step in range(int(count.max(initial=0))):
        window = first[count > step] + step
        window = window[before[window] >= 0]
        other = before[window]
        known = np.zeros(len(window), np.int64)
        if step:
            left = shared[window - 1]
            beside = before[window - 1]
            moved = (beside >= 0) & stays[beside] & ((other == beside + 1) | (left < LENGTH))
            known = np.where(moved, np.maximum(left - 1, 0), 0)
        open_ = np.arange(len(window))
        while len(open_):
            a = words[starts[window[open_]] + known[open_]]
            b = words[starts[other[open_]] + known[open_]]
            differ = a ^ b
            same = sum((differ < np.uint64(1) << np.uint64(8 * j)).astype(np.int64) for j in range(8))
            known[open_] = np.minimum(known[open_] + same, LENGTH)
            open_ = open_[(same == 8) & (known[open_] < LENGTH)]
        shared[window] = known
    return shared


def _block(text: np.ndarray, first_at: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block of stretches: the class of every window, and each class's bytes and smallest document."""
    first = np.cumsum(count) - count
    starts = np.repeat(first_at - first, count) + np.arange(int(count.sum()))
    words = _words(np.append(text, np.zeros(LENGTH, np.uint8)))
    order = suffix_order(text, starts, words[: len(text)])
    shared = common_prefixes(words, starts, order, first, count)
    new = shared[order] < LENGTH
    new[0] = True
    heads = np.flatnonzero(new)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(np.repeat(doc, count)[order], heads)
    spelled = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts[order[heads]]]
    return own, np.ascontiguousarray(spelled).view(f"S{LENGTH}").ravel(), least


def _merged(runs_: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows with their smallest document, of two sorted runs at a time by binary search."""
    while len(runs_) > 1:
        paired = []
        for i in range(0, len(runs_) - 1, 2):
            (a, low_a), (b, low_b) = runs_[i], runs_[i + 1]
            at = np.searchsorted(a, b)
            hit = a[np.minimum(at, len(a) - 1)] == b
            low_a = low_a.copy()
            low_a[at[hit]] = np.minimum(low_a[at[hit]], low_b[hit])
            paired.append((np.insert(a, at[~hit], b[~hit]), np.insert(low_a, at[~hit], low_b[~hit])))
        runs_ = paired + runs_[len(paired) * 2:]
    return runs_[0]


def _read(blobs: list[bytes], sample: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(kept stretches, repeated runs) of a shard: ids, variants, starts, counts or ends; and anchors and text of the kept."""
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(sample))
    kept, gone = ([[] for _ in range(6)] for _ in range(2))
    for blob in blobs:
        raw = unpack.decompress(blob)
        n, runs_ = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16
        for j, kind in enumerate(("<i8", "<i4", "<i8")):
            kept[j].append(np.cumsum(_unplaned(raw, kind, n, at), dtype=kind))
            at += kept[j][-1].nbytes
        kept[3].append(np.frombuffer(raw, np.uint8, n, at))
        at += n
        for j, kind in enumerate(("<i8", "<i4", "<i8", "<i8")):
            gone[j].append(_unplaned(raw, kind, runs_, at))
            at += gone[j][-1].nbytes
        kept[4].append(np.frombuffer(raw, np.uint8, n, at))
        kept[5].append(np.frombuffer(raw, np.uint8, -1, at + n))
    return [np.concatenate(x) for x in kept], [np.concatenate(x) for x in gone[:4]]


_RANGES = "id long, variant int, begin long, end long"


def _narrowed(ids: np.ndarray, at: np.ndarray, count: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(stretch, first window, windows) of the stretches with windows that by hash are also in another document."""
    if not len(ids):
        return ids, ids, ids
    size = count + LENGTH - 1
    part = _spelled(text, at, size)
    first = np.cumsum(count) - count
    starts = np.repeat(np.cumsum(size) - size - first, count) + np.arange(int(count.sum()))
    hashed = _HASH.spans(_HASH.prefix(part), starts, starts + LENGTH)
    # Numbers that carry their position are sorted faster than positions are; the bits lost only let more through.
    low = np.uint64((1 << len(hashed).bit_length()) - 1)
    both = np.sort(hashed & ~low | np.arange(len(hashed), dtype=np.uint64))
    place, both = (both & low).astype(np.int64), both & ~low
    heads = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    stretch = np.repeat(np.arange(len(count)), count)
    owner = ids[stretch[place]]
    least, most = (f.reduceat(owner, heads) for f in (np.minimum, np.maximum))
    seen = np.zeros(len(hashed), bool)
    seen[place] = np.repeat(least != most, np.diff(np.append(heads, len(place))))
    window = np.flatnonzero(seen)
    own = stretch[window]
    turn = np.flatnonzero(own[1:] != own[:-1])
    begin, end = window[np.append(0, turn + 1)[: len(window)]], window[np.append(turn, len(window) - 1)[: len(window)]]
    return stretch[begin], begin - first[stretch[begin]], end - begin + 1


def _repeats(ids: np.ndarray, at: np.ndarray, count: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(stretch, first window, last window) of every run of windows that a document with a smaller id has, by suffix arrays."""
    size = count + LENGTH - 1
    cuts = np.searchsorted(np.cumsum(size), np.arange(BLOCK_BYTES, int(size.sum()) + 1, BLOCK_BYTES))
    blocks = [b for b in np.split(np.arange(len(ids)), cuts) if len(b)]
    made, found = [], [[], [], []]
    for block in blocks:
        part = _spelled(text, at[block], size[block])
        made.append(_block(part, np.cumsum(size[block]) - size[block], count[block], ids[block]))
    names, least = _merged([(spelled, low) for _, spelled, low in made])
    for block, (own, spelled, _) in zip(blocks, made, strict=True):
        lowest = least[np.searchsorted(names, spelled)][own]
        stretch = np.repeat(np.arange(len(block)), count[block])
        again = np.repeat(ids[block], count[block]) > lowest
        offset = np.arange(len(stretch)) - np.repeat(np.cumsum(count[block]) - count[block], count[block])
        # Neighbouring repeated windows are one range.
        head = again.copy()
        head[1:] &= ~again[:-1] | (stretch[1:] != stretch[:-1])
        tail = again.copy()
        tail[:-1] &= ~again[1:] | (stretch[1:] != stretch[:-1])
        a, b = np.flatnonzero(head), np.flatnonzero(tail)
        for x, y in zip(found, (block[stretch[a]], offset[a], offset[b]), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) for x in found)


def _shard(table: pa.Table, sample: bytes) -> pa.Table:
    """The repeated ranges that a shard finds."""
    (ids, variant, start, count, anchor, text), gone = _read(table.column("blob").to_pylist(), sample)
    count = count.astype(np.int64)
    size = count + LENGTH - 1
    at = np.cumsum(size) - size
    found = [[gone[0]], [gone[1]], [gone[2]], [gone[3]]]
    if len(ids):
        # An anchor in one document only: nothing to find. (By hash: others may only be looked at in vain.)
        spot = np.lib.stride_tricks.sliding_window_view(text, GRAM)[at + np.where(anchor == _WHOLE, 0, anchor)]
        spot = np.ascontiguousarray(np.pad(spot, ((0, 0), (0, -GRAM % 8)))).view("<u8")
        key = spot[:, 0]
        for j in range(1, spot.shape[1]):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + spot[:, j])
        order = np.argsort(key)
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        low, high = (f.reduceat(ids[order], heads) for f in (np.minimum, np.maximum))
        wide = np.diff(np.append(heads, len(order)))
        chosen = order[np.repeat(low != high, wide)]
        # Stretches of one anchor stay together, so that equal windows do.
        before = np.cumsum(size[chosen]) - size[chosen]
        group = np.repeat((np.cumsum(wide[low != high]) - wide[low != high]), wide[low != high])
        portion = before[group] // SHARD_BYTES
        for rows in np.split(chosen, np.flatnonzero(portion[1:] != portion[:-1]) + 1):
            part = _spelled(text, at[rows], size[rows])
            end = np.cumsum(size[rows])
            again = _again(ids[rows], *(f.spans(f.prefix(part), end - size[rows], end) for f in (_HASH, _CHECK)))
            gone = rows[again]
            for x, y in zip(found, (ids[gone], variant[gone], start[gone], start[gone] + size[gone]), strict=True):
                x.append(y)
            rows = rows[~again]
            stretch, skipped, windows = _narrowed(ids[rows], at[rows], count[rows], text)
            rows = rows[stretch]
            if len(rows):
                stretch, a, b = _repeats(ids[rows], at[rows] + skipped, windows, text)
                rows, from_ = rows[stretch], start[rows[stretch]] + skipped[stretch]
                for x, y in zip(found, (ids[rows], variant[rows], from_ + a, from_ + b + LENGTH), strict=True):
                    x.append(y)
    names = ("id", "variant", "begin", "end")
    kinds = (np.int64, np.int32, np.int64, np.int64)
    return pa.table({n: pa.array(np.concatenate(x).astype(k)) for n, x, k in zip(names, found, kinds, strict=True)})


# ---- the whole


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that ranges cover."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return begin[heads], end[np.append(heads[1:], len(begin)) - 1]


def _ranges(batches):
    for batch in batches:
        ends = []
        for begin, end in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = _union(np.array(begin, np.int64), np.array(end, np.int64))
            ends.append(np.stack([a, b], axis=1).ravel())
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "variant": batch.column(1),
                                          "ranges": pa.array(ends, pa.list_(pa.int64()))})


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, variant, text, doc_id): variant tells rows of one id with different texts apart."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.col(id_col).alias("doc_id"))
    repeated = rows.groupBy("id").count().filter("count > 1").select("id")
    if repeated.isEmpty():
        return rows.select("id", F.lit(0).alias("variant"), "text", "doc_id")
    tag = F.sha2(F.col("text"), 256)
    kinds = (rows.join(repeated, "id", "left_semi").select("id", tag.alias("tag")).distinct()
             .withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("tag"))))
    kinds = written(kinds, "variants")
    return (rows.withColumn("tag", tag).join(kinds, ["id", "tag"], "left")
            .select("id", F.coalesce(F.col("number"), F.lit(0)).cast("int").alias("variant"), "text", "doc_id"))


def _copies_marked(rows: DataFrame) -> DataFrame:
    """The rows with `copy`: whether a document with a smaller id has the same text."""
    tag = F.sha2(F.col("text"), 256)
    # Texts of several ids; of other texts nothing is joined.
    twice = (rows.filter("text <> ''").groupBy(tag.alias("tag")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
             .filter("first < last").select("tag", "first"))
    twice = written(twice, "copies")
    few = twice.count() <= FEW_IDS
    return (rows.withColumn("tag", tag).join(F.broadcast(twice) if few else twice, "tag", "left")
            .select("id", "variant", "text", "doc_id", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy")))


def _hot(rows: DataFrame, count: int) -> list[int]:
    """Anchors in at least a share HOT of the sampled documents; the sample only decides how work is dealt."""
    share = min(1.0, HOT_SAMPLE / max(count, 1))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", STEP):
                data, offsets = text_bytes(piece.column(0))
                doc, _, _, _, key = stretches(data, offsets, _HASH.prefix(data))
                both = np.unique(np.stack([doc, key.view(np.int64)], axis=1), axis=0)
                values, counts = np.unique(both[:, 1], return_counts=True) if len(both) else (both[:, 0], both[:, 0])
                yield pa.RecordBatch.from_pydict({"key": pa.array(values), "docs": pa.array(counts.astype(np.int64))})

    least = max(HOT * min(count, HOT_SAMPLE), 50)
    found = sample.select("text").mapInArrow(tidied(run), "key long, docs long").groupBy("key").agg(F.sum("docs").alias("docs"))
    return [r.key & (1 << 64) - 1 for r in found.filter(F.col("docs") >= least).select("key").collect()]


def _shards(total: int) -> int:
    """Shards for so many bytes of text. Every PIECE makes a blob for every shard, so their number grows with the root of a large input."""
    wanted = max(1, -(-int(total * SPREAD) // SHIPPED_BYTES))
    return min(wanted, int((wanted * MANY_SHARDS) ** 0.5))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, digest of what stays; with the kept text if asked."""
    spark = docs.sparkSession
    all_rows = _copies_marked(_numbered(docs, id_col, text_col))
    rows = all_rows.filter("NOT copy").select("id", "variant", "text", "doc_id")
    total, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = _shards(total or 0)
    excerpts = rows.filter("text <> ''").select(F.substring("text", 1, 600).alias("text"), F.xxhash64("id").alias("at"))
    sample = "\n".join(r.text for r in excerpts.orderBy("at", "text").limit(PACKING_TEXTS).collect()).encode()
    sent = spark.sparkContext.broadcast((set(_hot(rows, count)), sample))
    stretched = rows.select("id", "variant", "text").mapInArrow(tidied(_shipped(sent, shards)), "shard long, blob binary")

    def shard(table: pa.Table) -> pa.Table:
        out = _shard(table, sent.value[1])
        handed_back()
        return out

    found = stretched.groupBy("shard").applyInArrow(shard, _RANGES)
    ranges = written(found.groupBy("id", "variant").agg(F.collect_list("begin").alias("begin"), F.collect_list("end").alias("end"))
                     .mapInArrow(_ranges, "id long, variant int, ranges array<long>"), "ranges")
    room = ranges.agg(F.sum(F.size("ranges") * 8 + 24)).first()[0] or 0
    if room > SENT_BYTES:  # the texts are shuffled next, and the stretches have done their work
        shuffles_let_go(spark)
    size = F.octet_length("text").cast("long")
    whole = F.when(F.col("copy") & (size >= LENGTH), F.array(F.lit(0).cast("long"), size))
    joined = (all_rows.join(F.broadcast(ranges) if room <= SENT_BYTES else ranges, ["id", "variant"], "left")
              .select("doc_id", "text", F.coalesce(whole, "ranges").alias("ranges")))
    key = rows.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = text_bytes(batch.column(1))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i, cut in enumerate(batch.column(2).to_pylist()):
            own = data[offsets[i]: offsets[i + 1]]
            stays, at = [], 0
            for a, b in zip(cut[::2] if cut else [], cut[1::2] if cut else [], strict=True):
                stays.append(own[at:a].tobytes())
                at = b
            kept = b"".join([*stays, own[at:].tobytes()])
            for name, value in zip(out, (len(own), len(own) - len(kept), len(cut or ()) // 2,
                                         hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        made = {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)}
        if not with_text:
            del made["kept"]
        return {"doc_id": batch.column(0), **made}

    return map_pieces(joined.select("doc_id", "text", "ranges"), work,
                      f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                      + (", kept binary" if with_text else ""))
