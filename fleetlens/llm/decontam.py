"""Benchmark decontamination by multi-pattern search with shift tables.

The alphabet is words, so a pattern is a run of words of a benchmark item: every
run of `window` words, or the whole item if it has fewer. Patterns of one length
share a table. A block is two neighbouring words (one, for one-word patterns).
The shift table says how far a cursor that looks at the last block of a window may
move because no pattern has that block any further right; a block that no pattern
has lets it skip the whole window. Where the shift is zero, the hash of the
window's last two blocks selects a bucket of patterns, and direct comparison of
the words decides.

Documents are read once, each part of a document by a cursor of its own, and all
cursors of a batch move together. The patterns are sent to the executors in blocks
of at most BLOCK_BYTES of benchmark text, so a benchmark of any size goes through;
each further block is another pass of the same stage over the rows.

Null and empty texts have no words, and benchmark items without words are in no
document. Equal item ids count as one item; equal documents give equal rows; an
empty benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import PIECE_BYTES, SpanHash, lowered, mixed, pieces, runs, text_bytes, two_columns

WINDOW = 10
#: Benchmark text that is sent to the executors at a time.
BLOCK_BYTES = 8 << 20
#: Windows that one cursor goes through.
STRETCH = 512

SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

_HASH = SpanHash(7)
# Bytes of words: digits, lower-case letters, and all of every character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lowered bytes, starts, ends, hashes) of the words of a batch of texts."""
    data = lowered(data)
    starts, ends = runs(_WORD[data], offsets)
    return data, starts, ends, _HASH.spans(_HASH.prefix(data), starts, ends)


def _blocks(words: np.ndarray) -> np.ndarray:
    """A hash for each two neighbouring words."""
    return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


class _Table:
    """The patterns of one length: shifts by block, buckets by suffix."""

    def __init__(self, length: int, windows: np.ndarray, texts: list[bytes], items: list[set]):
        self.length, self.windows, self.texts = length, windows, texts
        self.items = items
        self.block = min(2, length)
        self.span = length - self.block + 1  # blocks in a window, and the longest shift
        grid = np.stack([self._of(row) for row in windows])
        keys, place = np.unique(grid, return_inverse=True)
        last = np.zeros(len(keys), np.int64)
        np.maximum.at(last, place.reshape(-1), np.tile(np.arange(self.span), len(windows)))
        self.keys, self.shift = keys, self.span - 1 - last
        self.suffix = self._suffix(grid[:, -1], grid[:, -2] if self.span > 1 else grid[:, -1])
        order = np.argsort(self.suffix, kind="stable")
        self.order, self.sorted = order, self.suffix[order]

    def _of(self, words: np.ndarray) -> np.ndarray:
        return _blocks(words) if self.block == 2 else words

    @staticmethod
    def _suffix(last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return mixed(last + before * np.uint64(3))

    def search(self, words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, pattern) pairs that may be occurrences; [first, stop) are the documents' words."""
        ahead = self._of(words)
        counts = np.maximum(stop - first - self.length + 1, 0)  # windows of each document
        parts = -(-counts // STRETCH)
        doc = np.repeat(np.arange(len(first)), parts)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        cursor = first[doc] + number * STRETCH
        limit = np.minimum(first[doc] + counts[doc], cursor + STRETCH)
        found, chosen = [], []
        while len(cursor):
            last = ahead[cursor + self.span - 1]
            at = np.searchsorted(self.keys, last)
            at[at == len(self.keys)] = 0
            shift = np.where(self.keys[at] == last, self.shift[at], self.span)
            stay = np.flatnonzero(shift == 0)
            if len(stay):
                begin = cursor[stay]
                before = ahead[begin + self.span - 2] if self.span > 1 else last[stay]
                suffix = self._suffix(last[stay], before)
                low = np.searchsorted(self.sorted, suffix, side="left")
                many = np.searchsorted(self.sorted, suffix, side="right") - low
                begin = np.repeat(begin, many)
                which = self.order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                for j in range(self.length):
                    same = words[begin + j] == self.windows[which, j]
                    begin, which = begin[same], which[same]
                found.append(begin)
                chosen.append(which)
            cursor = cursor + np.maximum(shift, 1)
            go = cursor < limit
            cursor, limit = cursor[go], limit[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(chosen)


class Patterns:
    """The tables for a block of benchmark items."""

    def __init__(self, items: list[tuple], window: int):
        by_length: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
            data, starts, ends, hashes = _words(raw, np.array([0, len(raw)]))
            if not len(starts):
                continue
            spelled = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            length = min(window, len(spelled))
            kept = by_length.setdefault(length, {})
            for i in range(len(spelled) - length + 1):
                kept.setdefault(b" ".join(spelled[i: i + length]), (hashes[i: i + length], set()))[1].add(str(item))
        self.tables = [_Table(length, np.stack([h for h, _ in kept.values()]), list(kept), [i for _, i in kept.values()])
                       for length, kept in by_length.items()]

    def hits(self, data, starts, ends, hashes, first, stop) -> Iterator[tuple[int, int, set]]:
        """(first word, words, items) of each occurrence."""
        for table in self.tables:
            begin, which = table.search(hashes, first, stop)
            for b, w in zip(begin.tolist(), which.tolist(), strict=True):
                words = [data[starts[b + j]: ends[b + j]].tobytes() for j in range(table.length)]
                if b" ".join(words) == table.texts[w]:
                    yield b, table.length, table.items[w]


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, one after the other."""
    rows = two_columns(benchmark, id_col, text_col).filter("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    for i in range(blocks):
        yield [tuple(r) for r in (rows if blocks == 1 else rows.filter(part == i)).collect()]


STATE = "n_words bigint, hits array<bigint>, items array<string>"


def flagged(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
            name: str = "overlap") -> DataFrame:
    """All rows and columns, and a struct `name`: n_words, hits (word ranges [start, end) that are inside
    occurrences, as one flat list) and items (those that occur, sorted as strings)."""
    sent = docs.sparkSession.sparkContext.broadcast
    rows = docs.withColumn(name, F.lit(None).cast(f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>"))
    for items in _item_blocks(benchmark, item_col, item_text_col, block_bytes):
        rows = rows.mapInArrow(_pass(sent((items, window)), rows.columns.index(text_col), len(rows.columns) - 1), rows.schema)
    return rows


def scanned(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            **options) -> DataFrame:
    """One row per document: how many words, how many inside occurrences, and the items that occur."""
    rows = flagged(two_columns(docs, id_col, text_col), benchmark, **options, name="overlap")
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "overlap.*").mapInArrow(_summary, f"doc_id {key}, {SCHEMA}")


def _pass(sent, place: int, state: int):
    """Search one block of patterns; its occurrences join those found before."""

    def run(batches):
        patterns = Patterns(*sent.value)
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[place], PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([
                    *piece.columns[:state], _searched(patterns, piece.column(place), piece.column(state))],
                    piece.schema.names)

    return run


def _searched(patterns: Patterns, texts: pa.Array, before: pa.Array) -> pa.Array:
    data, offsets = text_bytes(texts)
    data, starts, ends, hashes = _words(data, offsets)
    first, stop = np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])
    spans: dict[int, list[int]] = {}
    names: dict[int, set] = {}
    for begin, length, items in patterns.hits(data, starts, ends, hashes, first, stop):
        doc = int(np.searchsorted(stop, begin, side="right"))
        spans.setdefault(doc, []).extend((begin - int(first[doc]), begin - int(first[doc]) + length))
        names.setdefault(doc, set()).update(items)
    hits: list[list] = [[]] * len(texts)
    found: list[list] = [[]] * len(texts)
    for doc, old in enumerate(before.to_pylist()):
        own = ((old or {}).get("hits") or []) + spans.get(doc, [])
        if own:
            hits[doc] = _united(own)
            found[doc] = sorted({*((old or {}).get("items") or []), *names.get(doc, ())})
    return pa.StructArray.from_arrays(
        [pa.array((stop - first).astype(np.int64)), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
        ["n_words", "hits", "items"])


def _united(flat: list[int]) -> list[int]:
    """Disjoint ranges that cover the same words, as one flat list."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _summary(batches):
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        n_hit = [sum(h[1::2]) - sum(h[::2]) for h in column["hits"].to_pylist()]
        items = column["items"].to_pylist()
        yield pa.RecordBatch.from_pydict({
            "doc_id": column["doc_id"], "n_words": column["n_words"],
            "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(i) for i in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
            "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_())})
