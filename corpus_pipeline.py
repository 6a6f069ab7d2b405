"""The corpus pipeline: language, near copies, benchmark passages, personal data, tokens.

Every stage takes all that the one before kept and is written as Parquet before the
next one reads it. All stages but the last return the columns of `documents`.

1. language: documents whose language is rejected go.
2. near_copies: of each group of near copies (five words, similarity 0.8), the
   document with the smallest id stays. Documents without an id stay, and texts without
   words. Where an id repeats, each of its texts is a document: of a group one row stays,
   of the smallest id and of that id's texts the one with the lowest hash.
3. benchmark: documents with a passage of a benchmark item go.
4. personal_data: every span is replaced by its kind; n_chars follows the text.
5. tokens: the ids of every text, their number, and digests of ids and decoded bytes.

Empty and null texts have no language and go in the first stage. An empty table gives
an empty result. Columns beyond those used stay as they are until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, decontam, jaccard, langid, pii
from fleetlens.llm.common import FEW_ROWS, batches_of, documents, free_name, without, written

#: Near copies: words of a shingle, and similarity in percent.
WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches_of(spark, FEW_ROWS)
    name = free_name(docs, "language")
    return langid.identified(docs, langid.dictionaries(docs), name=name).filter(~F.col(name)["rejected"]).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches_of(spark, FEW_ROWS)
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _near_copies_by_text(docs)
    found = jaccard.near_duplicates(docs, words=WORDS, percent=PERCENT)
    return without(docs, "doc_id", found.filter("component_id <> doc_id").select("doc_id").distinct())


def _near_copies_by_text(docs: DataFrame) -> DataFrame:
    """The same where ids repeat: texts are linked, and of each group one row with the smallest id stays."""
    key = free_name(docs, "text_key")
    # An own id for every text, so that one document id does not tie different texts.
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")))
    found = jaccard.near_duplicates(keyed, words=WORDS, percent=PERCENT, id_col=key)
    found = found.filter("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key), "component_id").distinct()
    named = keyed.filter("doc_id IS NOT NULL").groupBy("doc_id", key).agg(F.count("*").alias("copies"))
    named = written(named.join(found, key), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("first")).select("first.*")
    gone = named.join(first, ["doc_id", key], "left_anti").select("doc_id", key)
    repeated = named.filter("copies > 1").join(first, ["doc_id", key], "left_semi").select("doc_id", key)
    out = keyed.join(gone.unionAll(repeated), ["doc_id", key], "left_anti").select(*docs.columns)
    # Of equal texts under one id, the row whose columns have the lowest digest.
    row = F.struct(*docs.columns)
    one = (keyed.join(repeated, ["doc_id", key], "left_semi").groupBy("doc_id", key)
           .agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("row")).select("row.*"))
    return out.unionAll(one)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "overlap")
    rows = decontam.flagged(docs, documents(spark, sf_dir, "benchmark", FEW_ROWS), name=name)
    return rows.filter(F.size(F.col(name)["hits"]) == 0).drop(name)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches_of(spark, FEW_ROWS)
    name = free_name(docs, "pii")
    rows = pii.found(docs, pii.trained(docs), name=name, mask=True)
    text = F.col(name)["masked"]
    changed = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
                                if "n_chars" in docs.columns else {})
    return rows.withColumns(changed).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches_of(spark, FEW_ROWS)
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark),
          ("personal_data", personal_data), ("tokens", tokens)]

#: Compression, a trained tagger and merges by rank are beyond SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, rows=FEW_ROWS)
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), name)
    return rows
