"""Document fingerprints by winnowing.

Every k-gram of the UTF-8 bytes has a rolling hash. In each window of WINDOW
neighbouring hashes the smallest is chosen, of equal ones the rightmost, and kept with
its position; a text with fewer hashes has one window. Two texts that share a passage of
WINDOW + GRAM - 1 bytes therefore share a fingerprint inside it. A text shorter than a
k-gram has the hash of the whole text at position 0; null and empty texts have none.

A fingerprint is written as 8 hex digits of hash and 8 of byte position for each choice,
in order of position, separated by spaces. Two fingerprints are alike by the Jaccard
coefficient of their hashes; two empty ones are fully alike.

`followed` also needs the next document in id order. The id range is cut at quantiles
into parts that are sorted each in a task of its own and streamed; a copy of each
part's first document goes to the end of the part before it (the very first one to the
last part), so every document meets its successor without a global sort or a second copy
of the corpus. Documents without an id come first; equal ids go by text. The successor
of an only document is itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import PIECE_BYTES, SpanHash, pieces, two_columns

GRAM, WINDOW = 20, 128
#: Text that a part holds, and the most parts that the id range is cut into.
PART_BYTES, MAX_PARTS = 16 << 20, 4_096

_HASH = SpanHash(13)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text, (hash << 32 | position) of the chosen k-grams, by position."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum(lengths) - lengths
    grams = np.maximum(lengths - GRAM + 1, 0)
    prefix = _HASH.prefix(data)
    chosen: list[np.ndarray] = [None] * len(texts)
    if len(data) >= GRAM:
        raw = (prefix[GRAM:] - prefix[:-GRAM]) * _HASH.back_powers(len(data) - GRAM + 1)
        raw ^= raw >> np.uint64(29)
        raw *= np.uint64(0xBF58476D1CE4E5B9)
        # Smallest hash first, and of equal hashes the one furthest right.
        key = (raw >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(raw), dtype=np.uint64))
        low, span = key.copy(), 1
        while span * 2 <= WINDOW:
            low[:-span] = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < WINDOW:
            low[: span - WINDOW] = np.minimum(low[: span - WINDOW], low[WINDOW - span:])
    for i, (a, n) in enumerate(zip(first.tolist(), grams.tolist(), strict=True)):
        if n >= WINDOW:
            own = low[a: a + n - WINDOW + 1]
            own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            own = key[a: a + n].min()[None]
        elif lengths[i]:
            whole = int.from_bytes(hashlib.blake2b(texts[i], digest_size=4).digest(), "big")
            own = np.array([whole << 32 | 0xFFFFFFFF - a], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        place = np.uint64(0xFFFFFFFF) - (own & np.uint64(0xFFFFFFFF)) - np.uint64(a)
        chosen[i] = own >> np.uint64(32) << np.uint64(32) | place
    return chosen


def spelled(print_: np.ndarray) -> str:
    """A fingerprint as text."""
    if not len(print_):
        return ""
    digits = np.full((len(print_), 17), 32, np.uint8)
    for j in range(16):
        digits[:, j] = _HEX[(print_ >> np.uint64(60 - 4 * j) & np.uint64(15)).astype(np.int64)]
    return digits.tobytes()[:-1].decode()


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Jaccard coefficient of the hashes of two fingerprints."""
    one, two = np.unique(one >> np.uint64(32)), np.unique(two >> np.uint64(32))
    if not len(one) and not len(two):
        return 1.0
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / (len(one) + len(two) - both)


def fingerprinted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, hashes and positions of its fingerprint."""
    only = two_columns(docs, id_col, text_col)
    key = only.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                prints = fingerprints([(t or "").encode() for t in piece.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column(0),
                    "hashes": pa.array([(p >> np.uint64(32)).astype(np.int64) for p in prints], pa.list_(pa.int64())),
                    "positions": pa.array([(p & np.uint64(0xFFFFFFFF)).astype(np.int64) for p in prints],
                                          pa.list_(pa.int64()))})

    return only.mapInArrow(run, f"doc_id {key}, hashes array<long>, positions array<long>")


def _parts(docs: DataFrame, part_bytes: int) -> DataFrame:
    """Rows (part, copy, at, doc_id, text): each part of the id order, and a copy of what follows it."""
    rows = docs.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(MAX_PARTS, max(1, -(-total // part_bytes))))
    cuts = sorted({int(c) for c in rows.approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    part = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("at"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", part).withColumn("copy", F.lit(0))
    heads = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min("at")).collect())
    follows = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    copies = rows.filter(F.col("at").isin(list(follows))).withColumns({
        "copy": F.lit(1), "part": F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])[F.col("at")]}) \
        if follows else rows.limit(0)
    both = rows.unionByName(copies).select("part", "copy", "at", "doc_id", "text")
    return both.repartition(max(len(heads), 1), "part").sortWithinPartitions("part", "copy", "at", "text")


def followed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next one's are.

    The edited text has its last quarter of code points replaced by as many first
    ones (or all) of the next document.
    """
    only = two_columns(docs, id_col, text_col)
    key = only.schema["doc_id"].dataType.simpleString()

    def run(batches):
        kept: list[tuple] = []  # (part, copy, id, text) of rows whose successor is still to come
        size = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for part, copy, doc_id, text in zip(*columns, strict=True):
                if kept and kept[-1][0] != part:
                    yield from _results(kept)
                    kept, size = [], 0
                if copy and kept and kept[-1][1]:
                    continue  # only the first copy is the successor
                kept.append((part, copy, doc_id, text or ""))
                size += len(kept[-1][3])
                if size > PIECE_BYTES and len(kept) > 1:
                    yield from _results(kept)
                    kept, size = kept[-1:], len(kept[-1][3])
        if kept:
            yield from _results(kept)

    def _results(rows):
        if len(rows) < 2:
            return
        texts = [r[3] for r in rows]
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + after[:cut])
        raw = [e.encode() for e in edited]
        prints, others = fingerprints([t.encode() for t in texts]), fingerprints(raw)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([r[2] for r in rows[:-1]], batch_type),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in raw], pa.string()),
            "fingerprint": pa.array([spelled(p) for p in prints[:-1]], pa.string()),
            "edited_fingerprint": pa.array([spelled(p) for p in others], pa.string()),
            "near_edited": pa.array([likeness(p, e) for p, e in zip(prints, others, strict=False)], pa.float64()),
            "near_next": pa.array([likeness(p, q) for p, q in zip(prints, prints[1:], strict=False)], pa.float64())})

    batch_type = pa.int64() if key == "bigint" else pa.int32() if key == "int" else pa.string()
    return _parts(only, part_bytes).mapInArrow(run, f"doc_id {key}, n_chars long, edited_sha256 string, "
                                                    "fingerprint string, edited_fingerprint string, "
                                                    "near_edited double, near_next double")
