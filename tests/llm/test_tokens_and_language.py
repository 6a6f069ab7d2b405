"""Byte-level BPE against the reference library, and language ID."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from fleetlens.llm import bpe, langid

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  \n", "'s 's's 'll''re I'd", "a  b\t\tc \r\n d", "5's x7 77 ½", "é ñ 中文 😀👍🏽 ́a", "nd" * 3000,
       "%" * 200 + "!!", " x\x1c\x85y ", "word " * 90_000]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(library):
    words = bpe.Vocabulary.of(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "'", "s", "'ll", "'re", "a", "b", "ll", "5", "é", "中", "!", " ", " ", "S", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + [t for t in ODD[1:-1]]
    ids, ends = words.encode(texts)
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == library.encode_ordinary(text), text
        assert words.decode(ids[begin:end])[0].tobytes() == text.encode()
        begin = end


def test_any_pattern_and_a_small_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 10)
    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN + "|zzz")
    assert not words.split.by_array
    for text in ODD[1:-1]:
        assert words.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_parts_of_long_texts_join():
    text = "ab cd  ef\n" * 1000
    assert "".join(bpe.parts(text, 100)) == text
    assert bpe.parts("x" * 500, 100) == ["x" * 500]


def test_encoded_rows(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "hello", "y"), (3, ODD[3], "x")],
                                 "doc_id long, text string, n_tokens string")
    rows = bpe.encoded(docs, RANKS, with_ids=True).collect()
    assert len(rows) == docs.count()
    texts = dict(enumerate(ODD)) | {None: "hello"}
    for row in rows:
        text = texts[row.doc_id] or ""
        want = library.encode_ordinary(text)
        assert (row.n_tokens, row.ids) == (len(want), want)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encoded(docs.limit(0), RANKS).count() == 0


WORDS = {"xx": "alpha beta gamma delta epsilon zeta eta theta".split(), "yy": "uno dos tres cuatro cinco seis siete ocho".split()}


def _texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=60)), lang) for i in range(n) for lang in [("xx", "yy")[i % 2]]]


def test_language_of_unseen_texts(spark):
    train = spark.createDataFrame(_texts(60, 1) + [(900, None, "xx"), (901, "text " * 60, None)],
                                  "doc_id long, text string, lang string")
    learned = langid.dictionaries(train)
    assert sorted(learned) == ["xx", "yy"]
    docs = spark.createDataFrame(
        _texts(40, 2) + [(100, None, "xx"), (101, "", "xx"), (102, "12 34 !!", None), (103, "UNO!! DOS!! TRES!! SEIS!! OCHO!!", "?")],
        "doc_id long, text string, language string")
    rows = langid.identified(docs, learned, name="found").collect()
    assert len(rows) == 44 and docs.columns + ["found"] == list(rows[0].asDict())
    for row in rows:
        if row.doc_id < 100:
            assert row.found.lang_pred == row.language and not row.found.rejected and 0.5 < row.found.score <= 1
        elif row.doc_id < 103:
            assert (row.found.lang_pred, row.found.score, row.found.rejected) == ("und", 0.0, True)
        else:
            assert row.found.lang_pred == "yy"


def test_language_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.dictionaries(none) == {}
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert langid.identified(docs, {}).first().language.lang_pred == "und"
    # Two languages alike: the margin is nothing, so the decision is rejected.
    row = langid.identified(docs, {"a": b"some text " * 50, "b": b"some text " * 50}).first().language
    assert (row.lang_pred, row.margin, row.rejected) == ("a", 0.0, True)
    assert langid.identified(docs.limit(0), {"a": b"x" * 100}).count() == 0
