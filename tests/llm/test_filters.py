"""Benchmark passages, personal data, quality and revisits against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from fleetlens.llm import decontam, pii, quality, warc
from fleetlens.llm.queries import captures

# ---- decontamination

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _benchmark_rows(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "É", "ñ1", "x", "y2", "ω"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(25, None), (26, " - "), (3, "alpha beta"), (27, items[0][1])]
    docs = []
    for i in range(60):
        text = " ".join(rng.choices(words + ["zz", "qq"], k=rng.randint(0, 60)))
        if i % 3 == 0:
            text += " ... " + rng.choice(items[:25])[1].upper() + "! " + rng.choice(items[:25])[1]
        docs.append((i, text))
    return docs + [(60, None), (61, ""), (62, "... !"), (60, "again alpha"), (None, items[4][1]),
                   (63, " ".join(rng.choices(words, k=3000)))], items


def _overlap(docs, items, window):
    patterns = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    docs, items = _benchmark_rows(1)
    rows = decontam.scanned(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, hits int"),
                            spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, rows), key=str) == _overlap(docs, items, 10)


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "some words here", 2)], "doc_id long, text string, overlap int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scanned(docs, none).first().n_hit == 0
    assert decontam.scanned(docs.limit(0), none).count() == 0
    flagged = decontam.flagged(docs, spark.createDataFrame([(1, "WORDS here")], "item_id long, text string"), name="found")
    assert flagged.columns == [*docs.columns, "found"] and list(flagged.first().found.hits) == [1, 3]


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _by_patterns(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10))
                                      for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = [*"ab.@-+0123 (%_é", "@a.b", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.zz"]
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert pii.base_spans(text) == _by_patterns(text), text


def test_base_spans_of_long_runs_take_no_long():
    for text in ("a" * 200_000, "@" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 60_000, "a@" * 100_000):
        pii.base_spans(text)


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    tagger = pii.Tagger({k: v.astype(np.float64) for k, v in pii.Tagger.fresh().w.items()})
    symbols, tags = rng.integers(0, 40, (3, 9)), rng.integers(0, 9, (3, 9))

    def loss():
        scores = tagger.scores(symbols).astype(np.float64)
        _, _, total = tagger._chains(scores)
        path = scores[:, 0][range(3), tags[:, 0]] + tagger.w["first"][tags[:, 0]]
        for i in range(1, 9):
            path = path + scores[range(3), i, tags[:, i]] + tagger.w["step"][tags[:, i - 1], tags[:, i]]
        return float((total[:, 0] - path).mean())

    found = tagger.gradients(symbols, tags)
    for name in ("out", "bias", "step", "first"):
        at = tuple(n // 2 for n in tagger.w[name].shape)
        was = tagger.w[name][at]
        tagger.w[name][at] = was + 1e-4
        up = loss()
        tagger.w[name][at] = was - 1e-4
        down = loss()
        tagger.w[name][at] = was
        assert abs((up - down) / 2e-4 - found[name][at]) < 1e-4


def _texts_with_data(seed, n):
    rng = random.Random(seed)
    words = "the of and to in is that it was for on are with they at be this from have or by".split()
    out = []
    for _ in range(n):
        data = rng.choice([f"jo.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.org",
                           f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}",
                           f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "4111 1111 1111 1111"])
        out.append(" ".join(rng.choices(words, k=40)) + " " + data + " " + " ".join(rng.choices(words, k=30)))
    return out


def test_tagger_adds_other_spellings(spark):
    train = spark.createDataFrame(list(enumerate(_texts_with_data(1, 300))), "doc_id long, text string")
    weights = pii.trained(train)
    found = 0
    clean = ["the of and to in 12 is that it was for on 3 of them", "chapter 4.0. and page 1999, then 42 more"]
    others = [f"the of call ({a}) 555-{b} and to in is that it was" for a, b in ((389, 5010), (415, 2671), (646, 9090))]
    texts = [*clean, *others, None, "", *_texts_with_data(2, 20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = pii.found(docs, weights, name="found", mask=True).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        base = _by_patterns(text or "")
        assert row.found.base_sha256 == hashlib.sha256(pii.spelled(base).encode()).hexdigest()
        spans = set(filter(None, row.found.spans.split(",")))
        assert set(filter(None, pii.spelled(base).split(","))) <= spans
        if text in clean:
            assert not spans and row.found.masked == text
        if text in others:
            found += len(spans)
        if text is None:
            assert row.found.masked is None
        for kind, a, b in base:
            assert text[a:b] not in row.found.masked and f"<{kind.upper()}>" in row.found.masked
    assert found >= 2
    assert pii.found(docs.limit(0), weights).count() == 0
    assert pii.trained(docs.limit(0)) is None
    assert pii.found(docs, None).filter("pii.spans <> ''").count() == 20


def test_masking_of_overlaps():
    assert pii.masked("abcdefgh", [("ip", 1, 4), ("card", 2, 6), ("email", 7, 8)]) == "a<IP>g<EMAIL>"


def test_windows_are_reconciled():
    tagger = pii.Tagger.fresh()
    text = "x" * 60 + " 1234567 " + "y" * 200
    spans = pii.tagged_spans(tagger, [text])[0]
    assert all(0 <= a < b <= len(text) for _, _, a, b in spans)


# ---- quality


def test_quality_of_unseen_texts(spark):
    rng = random.Random(4)
    good, bad = "the quick brown fox jumps over lazy dogs".split(), "%%% win $$$ !!! click click FREE ###".split()

    def rows(n, first):
        return [(first + i, " ".join(rng.choices(good if i % 2 else bad, k=50)), i % 2) for i in range(n)]

    train, test = rows(200, 0), rows(60, 1000)
    docs = spark.createDataFrame([(d, t, "s") for d, t, _ in train] + [(900, None, "s"), (901, "", "s")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in train] + [(900, None, 0), (None, 1, 0), (5000, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    folded = quality.trained(docs, labels)
    found = {r.doc_id: r for r in quality.scored(spark.createDataFrame(
        [(d, t) for d, t, _ in test] + [(1, None), (2, "")], "doc_id long, text string"), folded).collect()}
    assert all(found[d].predicted == q and (found[d].score > 0.5) == bool(q) for d, _, q in test)
    assert found[1].score == found[2].score and 0 < found[1].score < 1
    assert quality.scored(docs.limit(0), folded).count() == 0
    none = quality.trained(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}


def test_features_do_not_cross_documents():
    one, two = b"abc def", b"ghi jkl"
    joined = np.frombuffer(one + two, np.uint8)
    together = quality.features(joined, np.array([0, len(one), len(joined)]))
    for n, text in enumerate((one, two)):
        alone = quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert [b[d == n].tolist() for d, b in together] == [b.tolist() for _, b in alone]


# ---- revisits


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_ROWS", 5)
    rng = random.Random(5)
    urls = ["http://A.example.org/x?utm_source=f", "https://www.a.example.org:443/x/#top", "http://a.example.org/X", None,
            "http://b.example.org/?b=2&a=1&ref=q", "b.example.org?a=1&b=2"]
    keys = {urls[0]: "a.example.org/x", urls[1]: "a.example.org/x", urls[2]: "a.example.org/X", None: None,
            urls[4]: "b.example.org?a=1&b=2", urls[5]: "b.example.org?a=1&b=2"}
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "Revisit", "request"])
        headers = {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "content-length": str(i), "date": str(i)}
        if rng.random() < 0.2:
            headers = {"last-modified": rng.choice("mn"), "content-type": "text/html"}
        if rng.random() < 0.1:
            headers = {"server": "s"}
        rows.append((i, kind, rng.choice(urls), rng.choice([None, *range(80)]), headers, f"p{i}"))
    records = spark.createDataFrame([(*r, "clash") for r in rows],
                                    "record_id long, type string, url string, ts long, headers map<string,string>, "
                                    "payload string, refers_to string")
    got = {r.record_id: r for r in warc.resolved(records).collect()}
    assert len(got) == sum(r[1].lower() == "revisit" for r in rows)
    for i, kind, url, ts, headers, _ in rows:
        if kind.lower() != "revisit":
            continue
        row, key = got[i], keys[url]
        assert row.url_key == key
        before = [r for r in rows if r[1] == "response" and key is not None and keys[r[2]] == key
                  and ts is not None and r[3] is not None and r[3] < ts]
        if not before:
            assert row.state == "missing" and row.refers_to is None
            continue
        last = max(before, key=lambda r: (r[3], r[0]))
        plain = {k: v.removeprefix("W/") for k, v in headers.items()}
        stored = {k: v.removeprefix("W/") for k, v in last[4].items()}
        name = next((k for k in ("etag", "last-modified") if k in plain), None)
        state = "unvalidated" if name is None else "resolved" if plain[name] == stored.get(name) else "mismatch"
        assert row.state == state, (headers, last)
        if state == "resolved":
            update = {k: v for k, v in headers.items() if k in warc.PERMITTED}
            assert (row.refers_to, row.payload, row.headers) == (last[0], last[5], {**last[4], **update})
        else:
            assert row.refers_to is None and row.payload is None
    assert warc.resolved(records.limit(0)).count() == 0


def test_repeated_records_do_not_multiply(spark):
    url, tag = "http://a.example/", {"etag": '"1"'}
    rows = [(1, "response", url, 10, tag, "p")] * 4 + [(2, "revisit", url, 20, tag, None)] * 5
    rows += [(2, "revisit", "http://b.example/", 20, tag, None), (1, "response", url, 5, tag, "old"), (2, "revisit", url, 7, tag, None)]
    rows += [(9, "response", url, 30, tag, "x"), (9, "response", url, 30, tag, "y"), (3, "revisit", url, 40, tag, None)]
    records = spark.createDataFrame(rows, "record_id long, type string, url string, ts long, headers map<string,string>, payload string")
    got = sorted(((r.record_id, r.ts, r.state, r.refers_ts) for r in warc.resolved(records).collect()), key=str)
    assert got == sorted([(2, 20, "resolved", 10)] * 5 + [(2, 20, "missing", None), (2, 7, "resolved", 5), (3, 40, "resolved", 30)], key=str)


def test_captures_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.example/", "x")], "page_id long, url string, html string")
    rows = captures(pages).collect()
    assert len(rows) == 4 and {r.payload.bytes for r in rows if r.type == "response"} == {0, 1}
