"""Collocations, token alignment and adaptive rules against brute force."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest

from fleetlens.llm import adaptive, alignment, collocations, hashed
from fleetlens.llm.alignment import aligner

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- collocations


def _phrase_rows(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ünder", "A", "ß", "the", "THE"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", " ", ". ", "\n", ", ", "\r\n"])
                       for _ in range(rng.randint(0, 40)))
        if i % 4 == 0:
            text += " hot spot here and the hot spot. hot spot"
        out.append((i, rng.choice([None, "", text, text, text, text]), rng.choice([None, "und", "en", "en", "en", "de"]), "extra"))
    return out


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _collocations(rows, least=10, first=2000):
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", _lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    found = collections.defaultdict(list)
    frequent = {p: a for p, a in counts.items() if a >= least}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]],
                                     counts[lang, p[k:]]) for k in range(1, len(p)))
        if not any(other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                   and 100 * b >= 50 * a for (other, q), b in frequent.items()):
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -score)
                  for lang, rows_ in found.items() for i, (score, a, p, left, right) in enumerate(sorted(rows_)[:first]))


def _mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string").repartition(5)
    found = collocations.collocations(docs, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    rows = _phrase_rows(seed)
    want = _collocations(rows)
    assert len({r[0] for r in want}) > 1 and want == _mined(spark, rows)


def test_collocations_with_small_tasks_and_a_tight_filter(spark, monkeypatch):
    rows = _phrase_rows(3) + [(500 + i, "hot spot " * 50, "en", "x") for i in range(100)]
    for module, name, value in ((collocations, "PIECE", 500), (collocations, "HELD", 40), (hashed, "FILTER_BYTES", 64),
                                (hashed, "RANGE_BYTES", 2_000)):
        monkeypatch.setattr(module, name, value)
    assert _mined(spark, rows, first=7) == _collocations(rows, first=7)


def test_collocations_of_nothing(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, None, None, ""), (None, "", "en", ""), (3, " . ", "en", "")]) == []


def test_no_frequent_phrase_is_missed_by_mining(spark):
    # Ten occurrences, spread over the shards as thinly as they can be.
    rows = [(i, f"rare pair {i}", "en", "") for i in range(10)]
    assert [r[2] for r in _mined(spark, rows)] == ["rare pair"]


# ---- alignment


def _ranges(spelled):
    out, at = [], 0
    for raw in spelled:
        out.append((at, at + len(raw)))
        at += len(raw)
    return out


def _alignment(rows):
    both = aligner(A, B)
    per_row, docs = [], collections.Counter()
    for doc, text, *_ in rows:
        if not text:
            per_row.append((doc, None))
            continue
        a, b = both.a.encode([text])[0].tolist(), both.b.encode([text])[0].tolist()
        ra, rb = _ranges([both.a.spelled[i] for i in a]), _ranges([both.b.spelled[i] for i in b])
        if b"".join(both.a.spelled[i] for i in a) != b" " + text.encode() or b"".join(
                both.b.spelled[i] for i in b) != b" " + text.encode():
            per_row.append((doc, None))
            continue
        links = [(a[i], b[j]) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in ra} & {y[1] for y in rb})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(t) for t, x in zip(a, ra, strict=True) if low < x[1] <= cut) + "|"
                          + ",".join(str(t) for t, y in zip(b, rb, strict=True) if low < y[1] <= cut))
            low = cut
        docs.update(set(links))
        per_row.append((doc, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = collections.Counter()
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    out = []
    for doc, row in per_row:
        if row is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, digest = row
        out.append((doc, n_a, n_b, n_groups, len(links), sum(docs[x] == top[x[0]] for x in links), sum(docs[x] for x in links), digest))
    return sorted(out, key=repr)


ODD = [None, "", " ", "  two  spaces ", "a", "<|endoftext|> and <s> </s> <unk>", "ünï çødé ▁ under", "日本語 text", "\x00\x01 nul", "tab\tnew\nline\r\n",
       "🙂🙃", "é combined", "½ ﬁ ligature", "don't won't 1234567890", "A" * 300, "  sep 　"]


@pytest.mark.parametrize("sent", [alignment.SENT, 40, 0])
def test_alignment_equals_brute_force(spark, sent):
    rng = random.Random(5)
    words = ["the", "Les", "übrigens", "tokenizer", "xqzv", "1999", "…", "and,", "pneumonoultramicroscopic"]
    rows = [(i, x, 1, "clash") for i, x in enumerate(ODD)]
    rows += [(100 + i // 2, " ".join(rng.choices(words, k=rng.randint(1, 30))), 2, "clash") for i in range(30)]
    rows += [(None, "no id", 1, "x"), (7, "same", 1, "x"), (7, "same", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int, rest string").repartition(3)
    found = alignment.aligned(docs, A, B, sent=sent)
    assert sorted(map(tuple, found.collect()), key=repr) == _alignment(rows)


def test_alignment_of_long_text_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 50)
    rows = [(1, "long words repeat here " * 3_000), (2, "long words"), (3, "x" * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in alignment.aligned(docs, A, B).collect()}
    links = found[1].n_a + found[1].n_b - found[1].n_groups
    assert found[1].n_links == links > 10_000 and found[1].n_a == len(aligner(A, B).a.encode([rows[0][1]])[0])
    assert alignment.aligned(docs.limit(0), A, B).count() == 0


def test_texts_whose_bytes_change_have_no_tokens(spark):
    both = aligner(A, B)
    right, wrong = both.a.encode(["abc", "abd"])
    piece, = both.b.encode(["abc"])
    assert both.faithful("abc", right, piece) and not both.faithful("abc", wrong, piece)


def test_ranks_give_the_ids_of_the_library():
    both = aligner(A, B)
    letters = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x11000, 3), 0x1F600, 0x1D7D8, 0x20000]]
    texts = [x for x in ODD if x] + [f"a{c}b {c}{c}1{c} {c}\n {c}" for c in letters]
    assert both.a.ranked is not None
    assert [x.tolist() for x in both.a.encode(texts)] == [x.tolist() for x in both.a.library(texts)]


# ---- adaptive rules


def _rule_rows(n=900):
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "eiusmod"]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(30, 120)))
        if i % 9 == 0:
            text += "\nsame line here\n \nsame line here\n\n" * rng.randint(1, 4)
        if i % 11 == 0:
            text = text.replace(" ", " # ")
        source = "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else rng.choice([None, "", "tiny"])
        out.append((i // 2, rng.choice([text] * 9 + [None, "", " \t\n", "one two"]), rng.choice(["en", "en", "de", None]), source, 1))
    out.append((9_000, "w " * 4_000 + "end " * 3, "en", "hot", 1))
    out.append((9_001, " ".join(f"w{i}" for i in range(30_000)), "xx", "alone", 1))
    return out


def _counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines))


def _bucket(v):
    shift = max(v.bit_length() - 6, 0)
    return v >> shift << shift


def _verdicts(rows):
    counts = [_counts(r[1]) for r in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    rates = [(100 * c[1] // c[0], 1000 * c[2] // c[0], 1000 * c[3] // max(c[5], 1), 1000 * c[4] // c[0]) if c[0] else None for c in counts]
    groups = collections.defaultdict(list)
    for row, bad, rate in zip(rows, failed, rates, strict=True):
        if not bad:
            for key in ((row[2] or "", row[3] or ""), (row[2] or "",), ()):
                groups[key].append(tuple(map(_bucket, rate)))
    out = []
    for row, c, bad, rate in zip(rows, counts, failed, rates, strict=True):
        kept = not bad
        if kept:
            key = (row[2] or "", row[3] or "")
            group = next((groups[k] for k in (key, key[:1]) if len(groups[k]) >= 100), groups[()])
            for i, slack in enumerate((100, 20, 300, 300)):
                values = sorted(x[i] for x in group)
                n = len(values)
                q1, q3 = values[-(-n // 4) - 1], values[-(-3 * n // 4) - 1]
                far = max(3 * (q3 - q1), slack)
                kept &= rate[i] <= q3 + far and (i > 0 or rate[i] >= q1 - far)
        out.append((row[0], *c[:5], bad, kept))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_adaptive_rules_equal_brute_force(spark):
    rows = _rule_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    found = sorted(map(tuple, adaptive.judged(docs).select(*COLUMNS).collect()), key=repr)
    want = _verdicts(rows)
    assert found == want
    assert 0 < sum(r[-1] for r in want) < sum(not r[-2] for r in want)  # some pass the base rules and fail a fence


def test_sketches_merge_alike_in_any_partitioning(spark):
    docs = spark.createDataFrame(_rule_rows(300), "doc_id long, text string, lang string, source string, n_words int")
    counts = adaptive.counted(docs)
    one, many = (sorted(map(tuple, adaptive.sketches(counts.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_adaptive_rules_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert adaptive.judged(docs).count() == 0
    docs = spark.createDataFrame([(None, None, None, None)], docs.schema)
    row, = adaptive.judged(docs).collect()
    assert row.base_failed and not row.kept and row.n_words == 0


def test_adaptive_rules_stay_native(spark):
    docs = spark.createDataFrame(_rule_rows(20), "doc_id long, text string, lang string, source string, n_words int")
    plan = adaptive.counted(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
