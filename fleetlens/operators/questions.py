"""Routing of plain-English questions to an app and an intent."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.sizing import small_side
from fleetlens.session import checkpoint

#: Of a large dictionary: bits of the filter for each name, and at most; letters of a text that a probe carries at most.
FILTER_BITS, MOST_BITS, REACH = 16, 1 << 26, 64
#: Letters of a text that are split into pieces at a time.
CHUNK = 4096

# The default app dictionary, in matching order.
APPS = ["patient-onboarding", "ehr-api", "scheduler-svc", "billing-svc",
        "hl7-ingest", "postgres-db", "kafka", "generic-worker"]

# Phrases that ask for a blast radius.
BLAST_HINTS = ["goes down", "go down", "went down", "blast radius", "blast-radius",
               "downstream", "upstream", "what breaks", "what happens if",
               "depends on", "depend on", "fails", " fail", "outage", "impact"]


def _first_named(text: Column, apps: Sequence[str]) -> Column:
    # A chain of conditions rather than a lambda over an array or a join on
    # "contains": it stays in generated code and needs no second table.
    return F.coalesce(*[
        F.when(text.contains(app) | text.contains(app.replace("-", " ")), app) for app in apps], F.lit(None))


def _hinted(text: Column, hints: Sequence[str]) -> Column:
    return reduce(lambda found, hint: found | text.contains(hint), hints, F.lit(False))


def named_app(question: Column, apps: Sequence[str] = tuple(APPS)) -> Column:
    """First app of the list whose name, or name with spaces, occurs in the text."""
    return _first_named(F.lower(question), apps)


def is_blast(question: Column, hints: Sequence[str] = tuple(BLAST_HINTS)) -> Column:
    """Whether the text contains any of the hints."""
    return _hinted(F.lower(question), hints)


def route(questions: DataFrame, default_app: str | None, apps: Sequence[str] = tuple(APPS),
          hints: Sequence[str] = tuple(BLAST_HINTS)) -> DataFrame:
    """Adds ``app`` (the default where none is named) and ``intent``. Map-only.

    The text is lowered once, in a projection of its own, not once per phrase.
    """
    text = F.col("_text")
    return questions.withColumn("_text", F.lower("question")).withColumns({
        "app": F.coalesce(_first_named(text, apps), F.lit(default_app)),
        "intent": F.when(_hinted(text, hints), "blast").otherwise("rca")}).drop("_text")


def dictionary_index(dictionary: DataFrame) -> tuple[DataFrame, int]:
    """(gram, phrase, app, position) of every spelling of every app, by its first letters, and how many letters these are.

    ``dictionary``: app and position, where the smallest position wins. Empty names are in every text and are left out.
    """
    spellings = F.array_distinct(F.array(F.lower("app"), F.lower(F.replace("app", F.lit("-"), F.lit(" ")))))
    named = checkpoint(dictionary.filter("app <> ''").select("app", "position", F.explode(spellings).alias("phrase")))
    letters = named.agg(F.min(F.char_length("phrase"))).first()[0] or 1
    return named.select(F.substring("phrase", 1, letters).alias("gram"), "phrase", "app", "position"), letters


def _pieces(text: DataFrame, columns: Sequence[str], letters: int, reach: int) -> DataFrame:
    """(columns, _piece): from every place of ``_text`` on ``letters`` letters, and up to ``reach`` where there are more.

    Texts are split CHUNK letters at a time. No piece begins within a surrogate pair, where the regular expression also looks.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("_text"), F.lit(1)), F.lit(CHUNK))
    chunks = text.select(*dict.fromkeys([*columns, "_text"]), F.explode(starts).alias("_from")).select(
        *columns, F.substring("_text", F.col("_from"), F.lit(CHUNK + reach - 1)).alias("_chunk"))
    place = rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{letters - 1}}}.{{0,{reach - letters}}}))"
    return chunks.select(*columns, F.explode(F.array_distinct(F.regexp_extract_all(
        "_chunk", F.lit(place), F.lit(1)))).alias("_piece"))


def _found_by_shuffle(texts: DataFrame, index: DataFrame, letters: int, tag: Sequence[str]) -> DataFrame:
    """(tag, position, app) for a dictionary that is not broadcast.

    What goes to the names are pieces of the texts, and of these only the ones whose first letters are in a filter of bits,
    which is broadcast. Names that are longer than a piece are looked for in the text again.
    """
    rows, longest = index.agg(F.count("*"), F.max(F.char_length("phrase"))).first()
    reach = max(min(longest or 0, REACH), letters)
    slot = F.xxhash64("gram").bitwiseAND((1 << min(max(rows * FILTER_BITS, 1), MOST_BITS).bit_length()) - 1)
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")
    marks = index.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"))
    probes = _pieces(texts, tag, letters, reach).withColumn("gram", F.substring("_piece", 1, letters))
    passed = probes.join(F.broadcast(marks), word == F.col("_word")).filter(
        F.getbit("_bits", bit) == 1).select(*tag, "_piece", "gram")
    found = passed.join(index, "gram").filter(F.startswith("_piece", F.substring("phrase", 1, reach)))
    if (longest or 0) <= reach:
        return found.select(*tag, "position", "app")
    whole = F.char_length("phrase") <= reach
    rest = found.filter(~whole).select(*tag, "phrase", "position", "app").distinct().join(texts, tag)
    return found.filter(whole).select(*tag, "position", "app").unionAll(
        rest.filter(F.contains("_text", "phrase")).select(*tag, "position", "app"))


def route_by_index(questions: DataFrame, dictionary: DataFrame, keys: Sequence[str], default_app: str | None = None,
                   hints: Sequence[str] = tuple(BLAST_HINTS)) -> DataFrame:
    """``route`` for large dictionaries: ``app`` and ``intent`` of every question.

    An app can only be named where its first letters stand, so texts and names meet on these, and a text is searched for the
    few names that it has the beginning of. Every distinct text is searched once, under its two hashes. Few names are
    broadcast behind a count; others meet pieces of the texts by shuffle. ``keys`` tell questions apart.
    """
    index, letters = dictionary_index(dictionary)
    tag = ["_h1", "_h2"]
    tagged = questions.select(*keys, F.lower("question").alias("_text")).filter("_text IS NOT NULL").withColumns(
        {"_h1": F.xxhash64("_text"), "_h2": F.xxhash64(F.lit(1), "_text")})
    texts = tagged.groupBy(*tag).agg(F.first("_text").alias("_text"))
    few = small_side(index)
    if few is index:
        found = _found_by_shuffle(texts, index, letters, tag)
    else:
        probes = _pieces(texts, [*tag, "_text"], letters, letters).withColumnRenamed("_piece", "gram")
        found = probes.join(few, "gram").filter(F.contains("_text", "phrase"))
    named = found.groupBy(*tag).agg(F.min(F.struct("position", "app")).alias("_best"))
    named = tagged.select(*keys, *tag).join(named, tag).groupBy(*keys).agg(F.min("_best").alias("_best"))
    best = named.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_best")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return questions.join(best, reduce(lambda a, b: a & b, same), "left").select(
        *questions.columns, F.coalesce(F.col("_best.app"), F.lit(default_app)).alias("app"),
        F.when(_hinted(F.lower("question"), hints), "blast").otherwise("rca").alias("intent"))
