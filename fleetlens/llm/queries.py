"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (adaptive, alignment, bpe, collocations, decontam, jaccard, langid, pii, quality, sharding,
                           substrings, warc, winnow)
from fleetlens.llm.common import documents, held_out

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = langid.dictionaries(docs.filter(~held_out(F.col("doc_id"))))
    found = langid.identified(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score",
                        "language.margin", "language.rejected")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    folded = quality.trained(docs, labels.filter(~held_out(F.col("doc_id"))))
    return quality.scored(docs, folded).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.followed(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scanned(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records: every page as a full response, and a not-modified answer to a later or earlier recrawl.

    The recrawl's instant follows from URL and id, so some come before any response, and
    some find that another page has taken the URL since.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(html.cast("binary")), 1, 16), F.lit('"'))
    moved = ((F.length(F.coalesce(F.col("url"), F.lit(""))) * 7919 + F.col("page_id") * 104_729) % 2001 - 1000) * 2 + 1

    def record(kind, shift, headers, payload):
        ts = F.col("page_id") * 2 + shift
        headers = {"date": ts.cast("string"), **headers}
        return pages.select(
            (F.col("page_id") * 2 + int(kind == "revisit")).alias("record_id"), F.lit(kind).alias("type"), "url",
            ts.alias("ts"), F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), v)]).alias("headers"),
            payload.alias("payload"))

    content = F.struct(F.md5(html.cast("binary")).alias("md5"), F.octet_length(html).cast("long").alias("bytes"))
    full = record("response", F.lit(0), {
        "content-type": F.lit("text/html"), "content-length": F.octet_length(html).cast("string"), "etag": tag,
        "cache-control": F.lit("max-age=60"), "last-modified": F.col("page_id").cast("string")}, content)
    again = record("revisit", moved, {
        "content-length": F.lit("0"), "etag": F.concat(F.lit("W/"), tag), "cache-control": F.lit("max-age=3600"),
        "server": F.lit("recrawl")}, F.lit(None).cast(full.schema["payload"].dataType))
    return full.unionAll(again)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return warc.resolved(captures(documents(spark, sf_dir, "pages"))).select(
        F.col("record_id").alias("revisit_id"), "url_key", "ts", "state", "refers_to", "refers_ts",
        F.array_join(lines, "\n").alias("headers"), F.col("payload.md5").alias("payload_md5"),
        F.col("payload.bytes").alias("payload_bytes"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.found(docs, pii.trained(docs))
    return found.select("doc_id", *(f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), BYTE_LEVEL, PIECES)


def op13_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive.judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_winnowing": op5_winnowing,
    "op6_decontamination": op6_decontamination,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_sharding": op8_sharding,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_personal_data": op10_personal_data,
    "op11_collocations": op11_collocations,
    "op12_token_alignment": op12_token_alignment,
    "op13_adaptive_rules": op13_adaptive_rules,
}
