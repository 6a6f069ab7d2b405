"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets counts of its words, symbols, repeated lines and repeated passages,
all by array functions inside its row, so texts are never shuffled. The rates made of
them (RATES) are not held against fixed cutoffs but against fences that each (language,
source) sets for itself:

* A sketch is a histogram of SUB / 2 buckets for every power of two of an integer rate: below
  SUB a bucket is one value, above it spans at most 1 / (SUB / 2) of it. Sketches merge by
  adding counts, in any order and grouping, so a repeated task or another partitioning gives
  the same thresholds. A sketch has at most SUB / 2 buckets for each bit of the rate, whatever
  the number of rows, and a hot source is counted in the map tasks before the one shuffle.
* Sources of a language merge to the language's sketch, languages to the corpus's. A group of
  fewer than MIN_ROWS rows takes the thresholds of the next wider one.
* The fence of a rate lies FENCE times the width of its middle half outside of that half, but no
  nearer than the rate's slack. Values beyond a fence fail. Documents that fail the two base rules
  are no part of any sketch.

The thresholds are joined to the documents' counts; they are broadcast behind a check
of their number.

A null text has no words. Texts without words fail the base rules. A null or empty language
or source is a group of its own ("" for both). Repeated rows count and are judged one by one.
An empty table gives an empty result. Windows of three words are compared by 64-bit hashes
within one text. Columns beyond id, text, language and source are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.sizing import small_side
from fleetlens.llm.common import written

#: Buckets of a sketch below which each is one value (a power of two).
SUB = 64
MIN_ROWS = 100
FENCE = 3
#: Base rules: fewest words, largest share of words in repeated windows (percent).
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Bits of a number that hold a window's place in its text: 268 million words.
PLACE_BITS = 28

_WORD, _SYMBOL = r"[^ \t-\r]+", r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rate:
    """An integer rate, and how far from the middle half its fences lie at least."""

    value: str
    slack: int
    low: bool = False
    high: bool = True


RATES = {
    "word_length": Rate("100 * word_chars div n_words", 100, low=True),
    "symbols": Rate("1000 * n_symbols div n_words", 20),
    "dup_lines": Rate("1000 * n_dup_lines div greatest(n_lines, 1)", 300),
    "repeats": Rate("1000 * n_repeat_words div n_words", 300),
}


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, also where the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in an array of words.

    Windows are sorted as single numbers of a part of their hash and their place; only those with an equal
    neighbour are then compared by the whole hash.
    """
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))

    def part(number: Column) -> Column:
        return F.shiftright(number, PLACE_BITS)

    def beside(marked: Column, of) -> Column:
        return F.filter(marked, lambda x, i: of(F.get(marked, i - 1)).eqNullSafe(of(x)) | of(F.get(marked, i + 1)).eqNullSafe(of(x)))

    def covered(hashes: Column, packed: Column) -> Column:
        whole = F.transform(beside(packed, part), lambda x: F.struct(
            F.get(hashes, x.bitwiseAND(place).cast("int")).alias("h"), x.bitwiseAND(place).cast("int").alias("i")))
        again = _let(F.sort_array(whole), lambda marked: beside(marked, lambda x: x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.aggregate(places, start, lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]

    def hashed(words: Column) -> Column:
        return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(
            w, F.get(words, i + 1), F.get(words, i + 2)))

    return _let(_let(words, hashed), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(
        F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long")))),
        lambda packed: covered(h, packed))))


def counted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """One row per document: its counts, language and source; no text."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select(
        "doc_id", "lang", "source", F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD)).alias("lines"),
        (F.size(F.split(text, _SYMBOL)) - 1).alias("n_symbols"))
    words, lines = F.col("words"), F.col("lines")
    return rows.select(
        "doc_id", "lang", "source", F.size(words).cast("long").alias("n_words"), F.size(lines).cast("long").alias("n_lines"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(words).cast("long").alias("n_repeat_words")).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _least(value: Column) -> Column:
    """The smallest value of the bucket that a value lies in."""
    shift = F.greatest(F.length(F.bin(value)) - (SUB.bit_length() - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): how many documents of a group have a rate in a bucket."""
    rates = [F.struct(F.lit(name).alias("rate"), _least(F.expr(rate.value)).alias("bucket")) for name, rate in RATES.items()]
    return (counts.filter(~F.col("base_failed")).select("lang", "source", F.inline(F.array(*rates)))
            .groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of wider groups: the sums of the narrower ones' counts."""
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, rows, q1, q3): the buckets that hold the lower and the upper quartile, by nearest rank."""
    group = Window.partitionBy(*keys, "rate")  # bounded: the buckets of one sketch
    ranked = (sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
              .withColumn("rows", F.sum("n").over(group)))
    return ranked.groupBy(*keys, "rate", "rows").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("bucket"))).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <rate>_low, <rate>_high) of every group; null where a group has no such fence.

    A rate has the same rows in every sketch of a group, so all its fences come from one level.
    """
    levels = [quartiles(sketch, ["lang", "source"]), quartiles(merged(sketch, ["lang"]), ["lang"]),
              quartiles(merged(sketch, []), [])]
    own, wide, all_ = (level.select(*[c for c in level.columns if c in ("lang", "source", "rate")],
                                    F.struct("rows", "q1", "q3").alias(name))
                       for level, name in zip(levels, ("own", "wide", "all"), strict=True))
    joined = own.join(small_side(wide), ["lang", "rate"]).join(small_side(all_), "rate")
    chosen = (F.when(F.col("own.rows") >= MIN_ROWS, F.col("own")).when(F.col("wide.rows") >= MIN_ROWS, F.col("wide"))
              .otherwise(F.col("all")))
    joined = joined.select("lang", "source", "rate", chosen.alias("q"))
    fences = []
    for name, rate in RATES.items():
        far = F.greatest(FENCE * (F.col("q.q3") - F.col("q.q1")), F.lit(rate.slack))
        mine = F.col("rate") == name
        if rate.low:
            fences.append(F.max(F.when(mine, F.col("q.q1") - far)).alias(f"{name}_low"))
        if rate.high:
            fences.append(F.max(F.when(mine, F.col("q.q3") + far)).alias(f"{name}_high"))
    return joined.groupBy("lang", "source").agg(*fences)


def verdicts(counts: DataFrame, fences: DataFrame) -> DataFrame:
    """The counts with `kept`: no base rule failed and every rate within its group's fences."""
    inside = F.lit(True)
    for name, rate in RATES.items():
        value = F.expr(rate.value)
        if rate.low:
            inside &= F.coalesce(value >= F.col(f"{name}_low"), F.lit(True))
        if rate.high:
            inside &= F.coalesce(value <= F.col(f"{name}_high"), F.lit(True))
    return (counts.join(small_side(fences), ["lang", "source"], "left")
            .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(inside)))


def judged(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, and the group's fences."""
    counts = written(counted(docs, **columns), "counts")
    fences = written(thresholds(sketches(counts)), "fences")
    return verdicts(counts, fences)
