"""Phrase collocations by SON partitioning.

A text is split at punctuation and line ends into pieces, and those at blanks into words. A
phrase is a run of words of one piece; everything is counted for each language.

1. Mining. Documents are dealt by hash into SHARDS shards. A phrase with `least` occurrences in all
   has least / SHARDS of them in some shard, so each shard is mined completely, words and phrases
   of all lengths, at that lowered support. The local counts are worked out by key ranges: map tasks
   send sorted 64-bit phrase hashes with counts, packed, one blob for each shard and range; a
   range's task adds them up shard by shard and unites what is frequent in any. A phrase that
   occurs very often is one number in each blob.
2. The union goes to all tasks as a Bloom filter of at most hashed.FILTER_BYTES, whatever the corpus. What it
   lets through beyond the union costs work in the next step, and changes no result.
3. Counting. A second pass over the texts counts every phrase that passes, globally and exactly, by
   its spelling; those below `least` go. (Inside one map task, equal 64-bit hashes stand for equal
   spellings.) No frequent phrase can be missing, and words and parts of frequent phrases are as frequent.
4. Scoring. Each cut of a phrase joins the counts of its parts; the lowest score counts. Phrases held in
   a longer one with at least COVERED percent of their count go. Numbers are exact decimals.

Null and empty texts have no words. A null language is `und`. A repeated row counts again.
Ties are settled by the phrase's bytes. An empty table gives an empty result. Only the id, the text and the
language are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import hashed
from fleetlens.llm.common import SpanHash, gathered, lowered, mixed, owners, pieces, runs, text_bytes, written

LEAST, LONGEST, FIRST = 10, 3, 2000
COVERED = 50
SHARDS = 4
#: Text that is counted at a time, and distinct phrases that a map task holds before it sends them.
PIECE, HELD = 1 << 20, 1 << 19
#: Bytes of keys and counts for each byte of text, about.
SPREAD = 4

_HASH, _LANG_HASH = SpanHash(31), SpanHash(37)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _BREAK.copy()
_BLANK[[0x20, 0x09]] = True


def _runs_of_words(texts: pa.Array, langs: np.ndarray, longest: int):
    """(pool, starts, ends, [(first word, hash) of all phrases of 1, 2, ... words]); hashes differ by language."""
    data, offsets = text_bytes(texts)
    data = lowered(data)
    starts, ends = runs(~_BLANK[data], offsets)
    doc = owners(starts, offsets)
    word = _HASH.spans(_HASH.prefix(data), starts, ends)
    cut = np.cumsum(_BREAK[data], dtype=np.int64)[starts]
    on = (cut[1:] == cut[:-1]) & (doc[1:] == doc[:-1])  # the next word is of the same piece
    first = np.arange(len(starts))
    grown = mixed(word + langs[doc])
    made = [(first, grown)]
    for length in range(2, longest + 1):
        keep = np.zeros(len(first), bool)
        inside = first + length - 1 < len(starts)
        keep[inside] = on[first[inside] + length - 2]
        first = first[keep]
        grown = mixed(grown[keep] * np.uint64(0xD6E8FEB86659FD93) + word[first + length - 1])
        made.append((first, grown))
    return data, starts, ends, doc, made


def _lang_keys(langs: list[str]) -> dict[str, int]:
    """A number for each language, by its name only; words are hashed otherwise, so that sums of both differ."""
    out = {}
    for lang in set(langs):
        raw = np.frombuffer(lang.encode(), np.uint8)
        out[lang] = int(_LANG_HASH.spans(_LANG_HASH.prefix(raw), np.zeros(1, np.int64), np.full(1, len(raw)))[0])
    return out


# ---- mining


def _mined_locally(longest: int, bits: int):
    """Rows (range, shard, blob): the phrase hashes and counts of a map task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                names = piece.column(2).to_pylist()
                of = _lang_keys(names)
                langs = np.array([of[x] for x in names], np.uint64)
                *_, doc, made = _runs_of_words(piece.column(1), langs, longest)
                shard = piece.column(0).to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
                for number in np.unique(shard).tolist():
                    keys = np.concatenate([grown[shard[first] == number] for first, grown in made])
                    mine = held.setdefault(number, [])
                    mine.append(hashed.added([keys], [np.ones(len(keys), np.int64)]))
                    if sum(len(k) for k, _ in mine) > HELD:
                        mine[:] = [hashed.added(*zip(*mine, strict=True))]
                        if len(mine[0][0]) > HELD // 2:
                            yield hashed.packed(*mine.pop(), bits, number)
        for number, mine in held.items():
            if mine:
                yield hashed.packed(*hashed.added(*zip(*mine, strict=True)), bits, number)

    return run


# ---- counting


def _counted(sent, longest: int):
    """Rows (lang, phrase, n): occurrences of what passes the filter; a null phrase stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: hashed.Filter = sent.value
        held: list[tuple] = []
        total: dict[str, int] = {}

        def merged(parts: list[tuple]) -> tuple:
            key = np.concatenate([p[0] for p in parts])
            names, first, back = np.unique(key, return_index=True, return_inverse=True)
            count = np.bincount(back, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)
            take = pa.array(first)
            return (names, count, pa.concat_arrays([p[2] for p in parts]).take(take),
                    pa.concat_arrays([p[3] for p in parts]).take(take))

        def sent_on(part: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"lang": part[2], "phrase": part[3].cast(pa.string()), "n": pa.array(part[1])})

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                names = piece.column(2).to_pylist()
                of = _lang_keys(names)
                data, starts, ends, doc, made = _runs_of_words(
                    piece.column(1), np.array([of[x] for x in names], np.uint64), longest)
                for i, n in zip(*np.unique(doc, return_counts=True), strict=True):
                    total[names[i]] = total.get(names[i], 0) + int(n)
                pool = np.where(_BLANK[data], np.uint8(0x20), data)
                for words, (first, grown) in enumerate(made, 1):
                    passed = keep.holds(grown)
                    first, grown = first[passed], grown[passed]
                    if not len(first):
                        continue
                    key, at, count = np.unique(grown, return_index=True, return_counts=True)
                    held.append((key, count, pa.array([names[i] for i in doc[first[at]].tolist()], pa.string()),
                                 _spelled(pool, starts, ends, first[at], words)))
                if sum(len(p[0]) for p in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield sent_on(held.pop())
        if held:
            yield sent_on(merged(held))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()),
                                          "phrase": pa.nulls(len(total), pa.string()),
                                          "n": pa.array(list(total.values()), pa.int64())})

    return run


def _spelled(pool: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: int) -> pa.Array:
    """The phrases that start at the given words, joined by one space."""
    word = first[:, None] + np.arange(words)
    size = ends[word] - starts[word]
    size[:, :-1] += 1  # and the blank behind it
    text = gathered(pool, starts[word].ravel(), size.ravel())
    at = np.append(0, np.cumsum(size.sum(axis=1)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at.astype(np.int64)),
                                                                           pa.py_buffer(text)]).cast(pa.binary())


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, *, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang", shards: int = SHARDS) -> DataFrame:
    """(lang, phrase, n) of all words and phrases with at least so many occurrences; a null phrase has all words."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(id_col, text), F.lit(shards)).cast("long").alias("shard"), text.alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, support = hashed.range_bits(size * SPREAD), -(-least // shards)

    def segment(table: pa.Table) -> pa.Table:
        return pa.table({"range": table.column("range")[:1], "bits": pa.array(
            [hashed.segment(hashed.frequent(table, support), bits)], pa.binary())})

    mined = (rows.mapInArrow(_mined_locally(longest, bits), hashed.BLOBS)
             .groupBy("range").applyInArrow(segment, "range long, bits binary"))
    sent = spark.sparkContext.broadcast(hashed.Filter([(r.range, bytes(r.bits)) for r in mined.collect()], bits))
    counted = rows.mapInArrow(_counted(sent, longest), "lang string, phrase string, n long")
    return (counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
            .filter(F.col("phrase").isNull() | (F.col("n") >= least)))


# ---- scoring


def _whole(column: str):
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, **columns: str) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = written(phrase_counts(docs, least, longest, **columns), "phrases")
    known = counts.filter("phrase IS NOT NULL")
    words = F.split("phrase", " ", -1)
    phrases = known.withColumn("words", words).filter(F.size("words") > 1).withColumnRenamed("n", "a")

    def joined(begin, length):
        return F.array_join(F.slice("words", begin, length), " ")

    # Every cut of every phrase, with the counts of both parts.
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
        joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]))
    score = F.expr(f"({1_000_000}BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) "
                   "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))").cast("long")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.*"))
    # Phrases that a longer one covers.
    spans = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda begin: F.transform(
        F.sequence(F.lit(2), F.greatest(F.size("words") - begin + 1, F.lit(2))), lambda size: F.when(
            (begin + size - 1 <= F.size("words")) & (size < F.size("words")), F.array_join(F.slice("words", begin, size), " "))))
    covers = (phrases.filter(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.flatten(spans)).alias("phrase"))
              .filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    left = (scored.join(covers, ["lang", "phrase"], "left")
            .filter(f"longer IS NULL OR {100}BD * longer < {COVERED}BD * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    totals = counts.filter("phrase IS NULL").select("lang", "n")  # a row for each language
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
