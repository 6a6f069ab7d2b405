"""The pipeline's stages against brute force, and the registered queries against their SQL."""

import os
import random

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from fleetlens.llm import bpe, pii
from tests.llm.test_copies import _components, _family, _sets
from tests.llm.test_filters import _by_patterns, _overlap
from tools import check_oracles

SF_DIR = "/root/testdata/sf0.001"
LANGUAGES = {"xx": "alpha beta gamma delta epsilon zeta eta theta iota kappa".split(),
             "yy": "uno dos tres cuatro cinco seis siete ocho nueve diez".split()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lang = ["xx", "yy"][i % 2]
        rows.append((i, " ".join(rng.choices(LANGUAGES[lang], k=80)) + f" end{i}", lang))
    rows += [(60, rows[3][1], "yy"), (61, rows[4][1].replace("end4", "changed"), "xx"), (62, None, "xx"), (63, "", None),
             (64, "12 34 -- !!", "yy"), (None, "alpha beta gamma " * 20, "xx"), (65, rows[65 % 60][1], "yy"), (65, rows[5][1], "yy")]
    leak = "siete ocho leak passage of a benchmark item that is ten words long at least"
    rows += [(70, " ".join(rng.choices(LANGUAGES["yy"], k=60)) + " " + leak, "yy")]
    rows += [(80 + i, " ".join(rng.choices(LANGUAGES["xx"], k=50)) + f" jo.{i}@mail.example.org and +1 (415) 555-26{10 + i} "
              + " ".join(rng.choices(LANGUAGES["xx"], k=50)), "xx") for i in range(20)]
    rows += [(200 + i, t.replace("v", "alpha v"), "xx") for i, t in enumerate(_family(4, 12, 60, (0, 3)))]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(d, t, lang, "s", None if t is None else len(t), "extra") for d, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, gone string")
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(1, leak.upper()), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages_against_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 40)
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.language(spark, docs, folder)
    assert kept.columns == docs.columns
    first = [tuple(r) for r in kept.collect()]
    assert sorted((r[0], r[1]) for r in first if r[0] is not None) == sorted(
        (d, t) for d, t, _ in rows if d is not None and t and any(map(str.isalpha, t)))

    kept = pipeline.near_copies(spark, spark.createDataFrame(first, docs.schema), folder)
    assert kept.columns == docs.columns
    second = [tuple(r) for r in kept.collect()]
    named = {r[0]: r[1] for r in first if r[0] is not None}
    low = _components(_sets(named.items(), 5), 80)
    assert sorted(r[0] for r in second if r[0] is not None) == sorted({low[d] for d in named})
    assert sum(r[0] is None for r in second) == 1

    kept = pipeline.benchmark(spark, spark.createDataFrame(second, docs.schema), folder)
    assert kept.columns == docs.columns
    third = [tuple(r) for r in kept.collect()]
    hit = {(d, t) for d, t in [(r[0], r[1]) for r in second] if _overlap([(d, t)], items, 10)[0][5]}
    assert hit and {(r[0], r[1]) for r in third} == {(r[0], r[1]) for r in second} - hit

    kept = pipeline.personal_data(spark, spark.createDataFrame(third, docs.schema), folder)
    assert kept.columns == docs.columns
    fourth = [tuple(r) for r in kept.collect()]
    assert len(fourth) == len(third)
    before = {r[0]: r[1] for r in third}
    for doc, text, _, _, n_chars, _ in fourth:
        assert n_chars == len(text) and not _by_patterns(text)
        if not _by_patterns(before[doc]):
            assert text == before[doc]

    last = pipeline.tokens(spark, spark.createDataFrame(fourth, docs.schema), folder).collect()
    words = bpe.Vocabulary.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r[0]: r[1] for r in fourth}
    assert len(last) == len(fourth)
    assert all(b"".join(words.tokens[i] for i in r.ids).decode() == texts[r.doc_id] for r in last)

    # The whole run is the same.
    whole = {(r.doc_id, r.ids_sha256) for r in pipeline.run(spark, folder).collect()}
    assert whole == {(r.doc_id, r.ids_sha256) for r in last}


def test_repeated_ids_keep_their_own_texts(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(40)) for _ in range(8)]
    near = texts[1] + " changed"
    # Id 5 has a copy of id 1's text, two texts of its own, one of them twice, and a near copy of another.
    rows = [(1, texts[0], "a"), (5, texts[0], "a"), (5, texts[1], "b"), (5, texts[1], "a"), (5, near, "a"), (5, texts[2], "a"),
            (6, texts[2] + " more", "a"), (7, texts[3], "a"), (5, texts[4], "a"), (None, texts[0], "a"), (None, texts[0], "a")]
    rows += [(9, texts[5], "a"), (9, texts[6], "a"), (9, texts[7], "a"), (3, texts[7], "a")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        got = sorted([(r.doc_id, r.text, r.source) for r in pipeline.near_copies(spark, docs, "").collect()], key=str)
        own = [r for r in got if r[0] == 5 and r[1] in (texts[1], near)]
        assert len(own) == 1 and own[0][2] == "a"
        assert [r for r in got if r not in own] == sorted(
            [(1, texts[0], "a"), (5, texts[2], "a"), (5, texts[4], "a"), (7, texts[3], "a"), (9, texts[5], "a"), (9, texts[6], "a"),
             (3, texts[7], "a"), (None, texts[0], "a"), (None, texts[0], "a")], key=str)


def test_stages_of_an_empty_table(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and "pipeline" in entry.queries()
    assert [len(pipeline.STAGES), pipeline.ORACLE_SQL] == [5, None]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["op6_decontamination", "op7_warc_revisits", "op9_jaccard_join"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    status, _, _, detail = check_oracles.compare(spark, con, name, SF_DIR)
    assert status == "ok", detail
