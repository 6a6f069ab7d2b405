"""Repeated substrings, fingerprints, Jaccard links and shards against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import common, jaccard, sharding, substrings, winnow
from fleetlens.llm.common import components


def _rows(seed, n=60):
    """Texts with shared passages, near copies, repeats, and odd ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=40))
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            text = " ".join(rng.choices(words, k=rng.randint(1, 120)))
        elif kind == 1:
            text = rng.choice(out)[1]
        elif kind == 2:
            own = (rng.choice(out)[1] or "a b c").split()
            own[rng.randrange(len(own))] = "edited"
            text = " ".join(own)
        elif kind == 3:
            text = f"Intro{i} {passage} and {rng.randint(0, 9)} end"
        elif kind == 4:
            text = "Orre " * rng.randint(1, 60)
        else:
            text = rng.choice([None, "", "ab", "ñandú über " * rng.randint(1, 12), "x" * 49, "x" * 50, "A B C"])
        out.append((i * 3 % 61, text))
    return out


def _removed(rows):
    seen = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            seen.setdefault(raw[i:i + 50], doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen[raw[i:i + 50]] < doc:
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_substrings(spark, monkeypatch, hot):
    rows = _rows(1) + [(7, "another text under a used id, long enough to hold a window of fifty bytes, and more")] * 2
    if hot:  # every shared anchor counts as hot; small shards, so that they meet by window
        monkeypatch.setattr(substrings, "_hot", lambda rows, count: _all_anchors(rows))
        monkeypatch.setattr(substrings, "SHARD_BYTES", 2_000)
        monkeypatch.setattr(substrings, "BLOCK_BYTES", 700)
    docs = spark.createDataFrame([(a, t, 1) for a, t in rows], "doc_id long, text string, id int")
    got = substrings.deduplicated(docs, with_text=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == _removed(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def _all_anchors(rows):
    raw = [np.frombuffer(r.text.encode(), np.uint8) for r in rows.collect()]
    return list({int(k) for data in raw for k in substrings.stretches(
        data, np.array([0, len(data)]), substrings._HASH.prefix(data))[4].tolist()})


def test_repeated_substrings_edges(spark):
    docs = spark.createDataFrame([(None, "y" * 80), (1, "y" * 80), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in substrings.deduplicated(docs).collect()}
    assert rows[None].n_removed == 0 and rows[1].n_removed == 80 and rows[2].n_bytes == 0
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 900).astype(np.uint8)
    text[300:600] = text[:300]
    starts = np.arange(len(text) - 49)
    order = substrings.suffix_order(text, starts)
    spelled = [text[i:i + 50].tobytes() for i in starts]
    assert [spelled[i] for i in order] == sorted(spelled)
    words = substrings._words(np.append(text, np.zeros(50, np.uint8)))
    shared = substrings.common_prefixes(words, starts, order, np.array([0]), np.array([len(starts)]))
    for a, b in itertools.pairwise(order.tolist()):
        same = next((j for j in range(50) if spelled[a][j] != spelled[b][j]), 50)
        assert shared[b] == same


class _Sent:
    value = (set(), b"some words that many texts have")


def _texts_table(texts):
    return pa.table({"id": pa.array(range(len(texts)), pa.int64()), "variant": pa.array([0] * len(texts), pa.int32()), "text": texts})


def _shipped_blobs(texts, shards, rows):
    return [(n, blob) for batch in substrings._shipped(_Sent, shards)(_texts_table(texts).to_batches(rows))
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]


def test_blobs_do_not_grow_with_batches_times_shards():
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(400)) for _ in range(400)]
    assert len(_shipped_blobs(texts, 20, 40)) == 20
    large = 400 << 30
    assert substrings._shards(large) < substrings._shards(large // 100) * 11
    assert substrings._shards(0) == 1


def test_equal_stretches_go_through_a_suffix_array_once(monkeypatch):
    rng = random.Random(13)
    passage = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(300))
    texts = [f"{' '.join(f'v{rng.randrange(10 ** 6)}' for _ in range(30))} {passage}" for _ in range(20)]
    seen = []
    block = substrings._block
    monkeypatch.setattr(substrings, "_block", lambda text, first_at, count, doc: seen.append(int(count.sum())) or block(
        text, first_at, count, doc))
    blobs = [blob for _, blob in _shipped_blobs(texts, 1, 1)]
    blobs += [blob for i, t in enumerate(texts) for blob in _alone(i + 20, t)]  # as of tasks of their own
    found = substrings._shard(pa.table({"blob": pa.array(blobs, pa.binary())}), _Sent.value[1])
    removed = {i: (b, e) for i, b, e in _covered(found)}
    assert sum(seen) < len(passage) and len(removed) == 39
    for i, t in enumerate(texts[1:], 1):
        assert removed[i][0] <= t.index(passage) and removed[i][1] == len(t)


def _alone(number, text):
    table = _texts_table([text]).set_column(0, "id", pa.array([number], pa.int64()))
    return [blob for batch in substrings._shipped(_Sent, 1)(table.to_batches()) for blob in batch.column(1).to_pylist()]


def _covered(found):
    out = {}
    for row in sorted(found.to_pylist(), key=lambda r: (r["id"], r["begin"])):
        runs = out.setdefault(row["id"], [])
        if runs and row["begin"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], row["end"])
        else:
            runs.append([row["begin"], row["end"]])
    return [(i, *run) for i, runs in out.items() for run in runs]


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_ranges_in_small_steps(monkeypatch, hot):
    for name, size in (("STEP", 300), ("PIECE", 900), ("SHARD_BYTES", 500), ("BLOCK_BYTES", 300), ("STRETCHES", 5)):
        monkeypatch.setattr(substrings, name, size, raising=False)
    texts = [t or "" for _, t in _rows(3, 150)]
    if hot:
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        monkeypatch.setattr(_Sent, "value", ({int(k) for d in raw for k in substrings.stretches(
            d, np.array([0, len(d)]), substrings._HASH.prefix(d))[4].tolist()[::2]}, b""))
    by = {}
    for n, blob in _shipped_blobs(texts, 3, 7):
        by.setdefault(n, []).append(blob)
    found = pa.concat_tables([substrings._shard(pa.table({"blob": pa.array(b, pa.binary())}), _Sent.value[1]) for b in by.values()])
    seen, want = {}, []
    for i, t in enumerate(texts):
        raw, runs = t.encode(), []
        for at in range(len(raw) - 49):
            if seen.setdefault(raw[at:at + 50], i) < i:
                if runs and at <= runs[-1][2]:
                    runs[-1][2] = at + 50
                else:
                    runs.append([i, at, at + 50])
        want += map(tuple, runs)
    assert sorted(_covered(found)) == want


# ---- fingerprints


def _winnow(raw: bytes, hashes):
    chosen = []
    for i in range(max(len(hashes) - winnow.WINDOW + 1, 1 if hashes else 0)):
        window = hashes[i:i + winnow.WINDOW]
        low = min(window)
        at = i + max(j for j, h in enumerate(window) if h == low)
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return chosen


def test_winnowing_picks_minima_rightmost():
    rng = random.Random(5)
    texts = [b"", b"short", b"abc" * 200, *(bytes(rng.choices(b"ab cd", k=rng.randint(0, 900))) for _ in range(30))]
    for raw, found in zip(texts, winnow.fingerprints(texts), strict=True):
        grams = [raw[i:i + winnow.GRAM] for i in range(len(raw) - winnow.GRAM + 1)]
        # Hashes of single k-grams come from texts that are just that long.
        hashes = [int(f[0]) >> 32 for f in winnow.fingerprints(grams)]
        if grams:
            assert [int(x) & 0xFFFFFFFF for x in found] == _winnow(raw, hashes)
            assert [int(x) >> 32 for x in found] == [hashes[i] for i in _winnow(raw, hashes)]
        else:
            assert len(found) == (1 if raw else 0)


def test_winnowing_guarantee():
    rng = random.Random(6)
    shared = bytes(rng.choices(range(97, 123), k=winnow.WINDOW + winnow.GRAM - 1))
    one, two = (bytes(rng.choices(range(97, 123), k=400)) for _ in range(2))
    a, b = winnow.fingerprints([one + shared + two, two[:100] + shared + one[:33]])
    assert set((a >> np.uint64(32)).tolist()) & set((b >> np.uint64(32)).tolist())


@pytest.mark.parametrize("part_bytes", [1 << 20, 900])
def test_followed(spark, part_bytes):
    rows = [(d, t) for d, t in dict(_rows(2)).items()] + [(None, "no id here")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, part int")
    got = {r.doc_id: r for r in winnow.followed(docs, part_bytes=part_bytes).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, row = text or "", after or "", got[doc]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, nxt = winnow.fingerprints([text.encode(), edited.encode(), after.encode()])
        assert (row.fingerprint, row.edited_fingerprint) == (winnow.spelled(own), winnow.spelled(changed))
        assert row.near_edited == winnow.likeness(own, changed) and row.near_next == winnow.likeness(own, nxt)
    plain = {r.doc_id: r for r in winnow.fingerprinted(docs).collect()}
    assert all(len(plain[d].hashes) == len(plain[d].positions) == len(got[d].fingerprint.split()) for d, _ in rows)


def test_followed_edges(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert winnow.followed(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert winnow.followed(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "bbbb"), (5, "aaaa"), (6, "cccc")], "doc_id long, text string")
    assert sorted(r.edited_sha256 for r in winnow.followed(twice).collect()) == sorted(
        hashlib.sha256(x).hexdigest() for x in (b"aaab", b"bbbc", b"ccca"))


# ---- Jaccard


def _sets(rows, words):
    out = {}
    for doc, text in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        out[doc] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def _components(sets, percent):
    low = {d: d for d in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def _family(seed, n, size=90, edits=(0, 8)):
    """Near copies of one text, at, above and below the threshold from each other."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10_000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, words, percent):
    rows = list(dict(_rows(3)).items())
    rows += [(1000 + i, t) for i, t in enumerate(_family(1, 40) + _family(2, 25, 30, (0, 3)) + _family(3, 15, 8, (0, 2)))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs, words=words, percent=percent).collect()}
    sets = _sets(rows, words)
    want = _components(sets, percent)
    assert len(got) == len(rows)
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert len(set(want.values())) < len(rows)


def _resized(seed, n, size, edits=8):
    """Near copies by insertions and deletions: sets of sizes on both sides of the steps between sketch sizes."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10_000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own, grows = list(base), rng.random() < 0.5
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(own))
            own[at:at + (not grows)] = [f"e{rng.randrange(10_000)}"] if grows else []
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_rounds_end(spark, monkeypatch, seed):
    calls = []

    def counted(edges):
        calls.append(1)
        assert len(calls) <= 10, "rounds that find the same pairs again"
        return components(edges)

    monkeypatch.setattr(jaccard, "components", counted)
    monkeypatch.setattr(jaccard, "TRIES", 1 << 20)
    rows = list(enumerate(_resized(seed, 60, 106) + _resized(seed + 10, 40, 112, 14) + _resized(seed + 20, 30, 208, 20)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    sets = _sets(rows, 4)
    assert min(map(len, sets.values())) < 102 < max(map(len, sets.values()))
    assert got == _components(sets, 85)


def test_large_signatures_are_dealt_into_bounded_meetings(spark):
    parts = {1: [0] * 3000 + list(range(5000, 5030)), 2: [0] * 40 + [7] * 30, 3: [9] * 500, 4: list(range(300))}
    rows = [(sig, i, part) for sig, of in parts.items() for i, part in enumerate(of)]
    got = jaccard.dealt(spark.createDataFrame(rows, "sig long, node long, component long"), 100).collect()
    meets = {}
    for r in got:
        meets.setdefault(r.meet, []).append((r.node, r.side))
    assert max(map(len, meets.values())) <= 300  # of 3,030
    assert len(got) < 3000 + 30 * 32 + 70 + 300 * 4
    met = [tuple(sorted((x, y))) for m in meets.values() for (x, s), (y, t) in itertools.combinations(m, 2)
           if s == t == jaccard.WITHIN or s != t]
    want = [p for of in parts.values() for p in itertools.combinations(range(len(of)), 2) if of[p[0]] != of[p[1]]]
    assert set(want) <= set(met) and len(met) < 3030 * 3029 // 8


def test_jaccard_of_dealt_signatures(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "TRIES", 2)
    rows = list(enumerate(_family(21, 90, 60, (2, 9)) + _resized(22, 40, 106)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _components(_sets(rows, 4), 85)


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, " "), (8, None),
                                  (7, "")], "doc_id long, text string")
    rows = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, 2, None), (4, 2, 2), (2, 2, 2), (2, 2, 2), (9, 0, 9), (8, 0, 8), (7, 0, 7)], key=str)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        base = rng.integers(1, 1 << 62, n).astype(np.uint64)
        drop, add = (int(rng.integers(0, max(1, n // 8))) for _ in range(2))
        other = np.append(base[drop:], rng.integers(1, 1 << 62, add).astype(np.uint64))
        both = n - drop
        if not len(other) or 100 * both < 85 * (n + add) or (not drop and not add):
            continue
        doc = np.repeat([0, 1], [n, len(other)])
        of, sigs = jaccard.signatures(doc, np.append(base, other), np.array([n, len(other)]), 85)
        assert set(sigs[of == 0].tolist()) & set(sigs[of == 1].tolist())


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_IDS", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 299)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(30)}, 299: 299, 300: 299}


# ---- shards


def test_shards(spark):
    rows = _rows(9, 200) + [(5, "same"), (5, "same"), (None, "null id")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int")
    got = sharding.sharded(docs, 7).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    groups = {}
    for r in got:
        groups.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    total = [sum(r["size"] for r in got if r.shard == s) for s in range(7)]
    largest = max(sum(r["size"] for r in got if (r["size"], r.text_crc32) == g) for g in groups)
    assert max(total) - min(total) <= max(largest, 0.05 * sum(total) / 7)
    assert sharding.sharded(docs.limit(0), 7).count() == 0


def test_differencing():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1000) for _ in range(3000)]
    placed = sharding.differenced(sizes, 40)
    total = np.bincount(placed, sizes, minlength=40)
    assert total.max() - total.min() <= 5
    assert sharding.differenced([], 3) == [] and sharding.differenced([4], 3) == [sharding.differenced([9], 3)[0]]
    assert sorted(sharding.differenced([8, 7, 6, 5, 4], 1)) == [0] * 5
    # The textbook case: 8, 7, 6, 5, 4 in two parts.
    a = [s for s, p in zip([8, 7, 6, 5, 4], sharding.differenced([8, 7, 6, 5, 4], 2), strict=True) if p]
    assert abs(2 * sum(a) - 30) == 2
