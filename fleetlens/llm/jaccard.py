"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles (64-bit hashes). Two sets link when
100 * |intersection| >= percent * |union|; links make components.

Sizes fall into bands of ratio BAND. A set takes part in its own band and, where a
larger partner could lie in the next one, in that too, so every pair that may link
meets in the band of its larger set. There the two differ in at most
    k = 2 * (largest size of the band) * (100 - percent) / (100 + percent)
features. The feature domain is dealt into n1 > k / 2 partitions, so that some
partition holds at most one of the differences; each partition has two halves, and
the subsets of one half are enumerated: one of them holds no difference, and the two
sets share its signature. A half that is empty in both says nothing, so its signature
is only given by sets that may have no other in common with a partner, that is, whose
filled halves are no more than the differences a partner of theirs can have; SPARE
partitions beyond the necessary number make such sets rare. (A band with k = 0 needs no
signature: its sets link only when equal.)

Equal sets are one class, whose smallest document stands for it; a task emits the
signatures of a class once. The members of a signature are first compared with its
smallest class (the hub). What that leaves open - signatures whose members are still in
different components - is settled in rounds. A large signature is dealt into blocks; two
blocks meet in a task, except that the blocks of its largest component need not meet each other.
A pair belongs to the smallest signature that both have, so it is tried in one meeting only. The task looks at the parity sketches of a meeting's members and emits pairs that join
components, a few for each edge of a spanning forest, MORE times as many in each further round,
the most alike ones of those that may link and have not been tried there. They are
compared exactly and components are renewed; a meeting stays open as long as it emits pairs.
So no pair that shares a signature remains undecided. Rounds are few, as the number of tries
soon exceeds the pairs of a meeting; pairs that the sketches leave open and that do not link are
then all emitted, up to the square of the members if all of a family are just below the threshold.

A parity sketch has a bit for each of 2.5 buckets a feature, the parity of the bucket's
features. Two sketches differ in at most as many bits as the sets in features, so pairs
that differ in more bits than a link allows are settled exactly; a sketch folds to half
its size by xor of its halves.

Null and empty texts, and texts without words, have an empty set and link with
nothing. Fewer words than a shingle has: the whole sequence is the one shingle.
Repeated ids count as one document with each of its texts. A document without an id
links with nothing, and its component is null. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import hashed
from fleetlens.llm.common import (FEW_IDS, SpanHash, components, lowered, mixed, owners, pieces, runs, text_bytes, tidied,
                                  two_columns, written)

WORDS, PERCENT = 4, 85
BAND = 1.7
SPARE = 2
#: Bits of a parity sketch.
MIN_BITS, MAX_BITS = 256, 1 << 16
#: Members of a signature that make a block, about; two blocks meet in a task.
BLOCK = 1024
#: Rows of a meeting that are compared with the others at a time.
SLAB = 256
#: Pairs that the first round tries for two components of a meeting; each further round, MORE times as many.
TRIES, MORE = 32, 8
#: Text bytes that a task makes shingles of at a time; a longer document is one piece of its own.
PIECE_BYTES = 1 << 18
#: Signatures that a task counts at a time.
HELD = 1 << 18
#: Leading bits of a signature that are counted: equal ones by chance only let a few more through, and the rest need not be sent.
COUNTED = 40
#: Signatures that are compared at a time when it is looked up whether two members share one.
CODES = 1024
#: Meetings up to this size need no arrays.
FEW = 24
#: Sides of a meeting's rows: a pair that it has tried; a member that meets all others; members of two blocks.
TRIED, WITHIN, ONE, TWO = -1, 0, 1, 2

_HASH = SpanHash(11)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a batch, by document and hash."""
    data = lowered(data)
    starts, ends = runs(~_SPACE[data], offsets)
    hashes = _HASH.spans(_HASH.prefix(data), starts, ends)
    doc = owners(starts, offsets)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    place = np.arange(len(doc)) - first[doc]
    length = np.minimum(count, words)[doc]  # words of this document's shingles
    head = place + length <= count[doc]
    begin = np.flatnonzero(head)
    grown = mixed(hashes[begin])
    for j in range(1, words):
        more = np.flatnonzero(length[begin] > j)
        grown[more] = mixed(grown[more] * np.uint64(0xD6E8FEB86659FD93) + hashes[begin[more] + j])
    owner = doc[begin]
    order = np.argsort(grown)
    order = order[np.argsort(owner[order].astype(np.uint16) if n_docs < 65_536 else owner[order], kind="stable")]
    owner, grown = owner[order], grown[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (grown[1:] != grown[:-1])
    return owner[keep], grown[keep]


def _bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest, largest, k) sizes of the larger set of a pair, up to a size."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND))
        out.append((low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


def signatures(doc: np.ndarray, features: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) pairs; `sizes` by document."""
    docs_out, sigs_out = [], []
    for number, (low, high, k) in enumerate(_bands(percent, int(sizes.max(initial=0)) * 100 // percent + 1)):
        if k == 0:
            continue
        member = (sizes <= high) & (sizes * 100 >= percent * low)  # itself, or a larger partner, in the band
        member &= sizes > 0
        if not member.any():
            continue
        index = np.cumsum(member) - 1
        inside = member[doc]
        own, feature = index[doc[inside]], features[inside]
        halves = 2 * (k // 2 + 1 + SPARE)
        dealt = mixed(feature + np.uint64(0x51ED270B * (number + 1)))
        cell = (dealt >> np.uint64(32)) * np.uint64(halves) >> np.uint64(32)
        grid = np.zeros(int(member.sum()) * halves, np.uint64)
        np.add.at(grid, own * halves + cell.astype(np.int64), mixed(dealt + np.uint64(0xA0761D6478BD642F)))
        grid = grid.reshape(-1, halves)
        filled = grid != 0
        size = sizes[member]
        partner = np.minimum(high, size * 100 // percent)
        apart = (size + partner) * (100 - percent) // (100 + percent)
        given = filled | (filled.sum(axis=1) <= apart)[:, None]
        tag = mixed(np.arange(halves, dtype=np.uint64) + np.uint64(number << 40))
        row, column = np.nonzero(given)
        docs_out.append(np.flatnonzero(member)[row])
        sigs_out.append(mixed(grid[row, column] + tag[column]))
    if not docs_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs_out), np.concatenate(sigs_out)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _featured(words: int, percent: int):
    def run(batches):
        seen: set[tuple[int, int]] = set()  # the classes of this task
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                n = piece.num_rows
                data, offsets = text_bytes(piece.column(1))
                doc, features = shingles(data, offsets, words)
                sizes = np.bincount(doc, minlength=n)
                one = _sums(mixed(features + np.uint64(1)), sizes)
                two = _sums(mixed(features + np.uint64(2)), sizes)
                fresh = np.zeros(n, bool)
                named = piece.column(0).is_valid().to_pylist()
                for i, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    if sizes[i] and named[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                inside = fresh[doc]
                bits = np.where(fresh, _bits(sizes), 0)
                base = np.cumsum(bits) - bits
                owner = doc[inside]
                bucket = base[owner] + (features[inside] & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
                sketch = np.packbits(np.bincount(bucket, minlength=int(bits.sum())) & 1, bitorder="little").tobytes()
                of, sigs = signatures(doc[inside], features[inside], np.where(fresh, sizes, 0), percent)
                order = np.argsort(of, kind="stable")
                each = np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column(0), "n": pa.array(sizes.astype(np.int64)),
                    "one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64)),
                    "sketch": pa.array([sketch[a // 8: (a + w) // 8] if w else None
                                        for a, w in zip(base.tolist(), bits.tolist(), strict=True)], pa.binary()),
                    "sigs": pa.ListArray.from_arrays(pa.array(each), pa.array(sigs[order].view(np.int64)))})

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, offsets = text_bytes(piece.column(1))
                doc, features = shingles(data, offsets, words)
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=piece.num_rows)))
                yield pa.RecordBatch.from_pydict({
                    "node": piece.column(2),
                    "features": pa.array([features[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())], pa.binary())})

    return run


def _bits(sizes: np.ndarray) -> np.ndarray:
    """How many bits the sketches of sets of these sizes have: a power of two."""
    power = np.ceil(np.log2(np.maximum(sizes, 1) * 2.5)).astype(np.int64)
    return np.clip(1 << power, MIN_BITS, MAX_BITS)


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all folded to the size of the smallest."""
    least = min(map(len, sketches))
    out = np.zeros((len(sketches), least // 8), np.uint64)
    for i, raw in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, "<u8").reshape(-1, least // 8), axis=0)
    return out


def _may_link(bits: np.ndarray, n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and differing bits allow a link."""
    return ((100 * np.minimum(n, other) >= percent * np.maximum(n, other))
            & (bits * (100 + percent) <= (n + other) * (100 - percent)))


def _maybe(percent: int):
    """Keep pairs that may link."""

    def run(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            n_a, n_b = col["n_a"].to_numpy(), col["n_b"].to_numpy()
            bits = np.array([int(np.bitwise_count(np.bitwise_xor(*_folded([x, y]))).sum()) for x, y in zip(
                col["sketch_a"].to_pylist(), col["sketch_b"].to_pylist(), strict=True)], np.int64)
            keep = pa.array(_may_link(bits, n_a, n_b, percent))
            yield pa.RecordBatch.from_pydict({c: col[c].filter(keep) for c in ("a", "b")})

    return run


def _forest(percent: int, tries: int):
    """Pairs of each meeting's members that may link and join its components; rows come sorted by meeting.

    Without tries, one pair of every meeting that has any, whichever signature settles it."""

    def run(batches):
        waiting = []  # rows of the last meeting so far, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            meet = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(meet)) + 1
            if waiting and waiting[-1].column(0)[0].as_py() != meet[0]:
                yield from _joining(pa.Table.from_batches(waiting), percent, tries)
                waiting = []
            if len(cuts):
                yield from _joining(pa.Table.from_batches([*waiting, batch.slice(0, int(cuts[-1]))]), percent, tries)
                batch, waiting = batch.slice(int(cuts[-1])), []
            waiting.append(batch)
        if waiting:
            yield from _joining(pa.Table.from_batches(waiting), percent, tries)

    return run


def _joining(table: pa.Table, percent: int, tries: int):
    table = table.combine_chunks()
    meet, side = table.column("meet").to_numpy(), table.column("side").to_numpy()
    cuts = np.flatnonzero(np.diff(meet)) + 1
    node, part = table.column("node").to_numpy(), table.column("component").to_numpy()
    n, sketches, earlier = table.column("n").to_numpy(), table.column("sketch"), table.column("before")
    few: list[tuple[int, int, int]] = []
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(meet)]):
        member, pair = a + np.flatnonzero(side[a:b] >= 0), a + np.flatnonzero(side[a:b] < 0)
        if len(member) < 2:
            continue
        sketch = sketches.take(pa.array(member)).to_pylist()
        before = earlier.take(pa.array(member)).to_pylist()
        row = node[member], part[member], side[member], n[member], sketch
        if len(member) <= FEW:
            tested = set(zip(node[pair].tolist(), part[pair].tolist(), strict=True))
            few += [(int(meet[a]), x, y) for x, y in _spanning_few(
                *(r.tolist() for r in row[:4]), sketch, before, tested, percent, tries)]
            continue
        for ones, twos in _spanning(*row, before, node[pair], part[pair], percent, tries):
            yield pa.RecordBatch.from_pydict({"meet": pa.array(np.full(len(ones), meet[a])), "a": pa.array(ones),
                                              "b": pa.array(twos)})
    if few:
        meets, ones, twos = (np.array(x, np.int64) for x in zip(*few, strict=True))
        yield pa.RecordBatch.from_pydict({"meet": pa.array(meets), "a": pa.array(ones), "b": pa.array(twos)})


def _shared_earlier(before: list[list[int]], rows: slice) -> np.ndarray:
    """Whether two members, one of `rows`, have an earlier signature in common: that one settles their pair."""
    names, code = np.unique(np.array(list(itertools.chain.from_iterable(before)), np.int64), return_inverse=True)
    owner = np.repeat(np.arange(len(before)), [len(x) for x in before])
    twice = np.bincount(code, minlength=len(names)) > 1  # others are nobody's in common
    owner, code = owner[twice[code]], (np.cumsum(twice) - 1)[code[twice[code]]]
    number = len(range(*rows.indices(len(before))))
    out = np.zeros((number, len(before)), bool)
    for first in range(0, int(twice.sum()), CODES):
        grid = np.zeros((len(before), CODES), np.float32)
        here = (code >= first) & (code < first + CODES)
        grid[owner[here], code[here] - first] = 1
        out |= grid[rows] @ grid.T > 0
    return out


def _spanning(node, part, side, n, sketches, before, tested_a, tested_b, percent: int, tries: int):
    """Pairs, a < b, that may link, are settled here, and make one component of as many members as they can."""
    order = np.argsort(node)
    node, part, side, n = node[order], part[order], side[order], n[order]
    before = [before[i] for i in order.tolist()]
    sketch = _folded([sketches[i] for i in order.tolist()])
    label = np.unique(part, return_inverse=True)[1]
    names, named = np.unique(node, return_inverse=True)  # a repeated id is several rows
    at_a, at_b = np.searchsorted(names, tested_a), np.searchsorted(names, tested_b)
    for begin in range(0, len(node), SLAB):
        rows = slice(begin, begin + SLAB)
        bits = np.zeros((len(node[rows]), len(node)), np.int64)
        for word in range(sketch.shape[1]):
            bits += np.bitwise_count(sketch[rows, word][:, None] ^ sketch[None, :, word])
        may = _may_link(bits, n[rows][:, None], n[None, :], percent) & (label[rows][:, None] != label[None, :])
        may &= (side[None, :] == WITHIN) | (side[rows][:, None] != side[None, :])
        if may.any():
            may &= ~_shared_earlier(before, rows)
        first, last = named[rows][0], named[rows][-1]
        here = (at_a >= first) & (at_a <= last)
        tried = np.zeros((last - first + 1, len(names)), bool)
        tried[at_a[here] - first, at_b[here]] = True
        may &= ~tried[named[rows] - first][:, named]
        one, two = np.nonzero(np.triu(may, begin + 1))  # each pair once
        if not tries and len(one):
            yield node[one[:1] + begin], node[two[:1]]
            return
        near = np.argsort(bits[one, two], kind="stable")  # the most alike first
        one, two = one[near] + begin, two[near]
        ones, twos = [], []
        while len(one):
            x, y = label[one[0]], label[two[0]]
            between = np.flatnonzero(((label[one] == x) & (label[two] == y)) | ((label[one] == y) & (label[two] == x)))[:tries]
            ones.append(node[one[between]])
            twos.append(node[two[between]])
            label[label == y] = x
            open_ = label[one] != label[two]
            one, two = one[open_], two[open_]
        if ones:
            yield np.concatenate(ones), np.concatenate(twos)


def _spanning_few(node, part, side, n, sketches, before, tested, percent: int, tries: int) -> list[tuple[int, int]]:
    """The same for a small meeting, without arrays."""
    order = sorted(range(len(node)), key=node.__getitem__)
    least = min(map(len, sketches))
    bits = []
    for i in order:
        raw, size = int.from_bytes(sketches[i], "little"), len(sketches[i]) * 8
        while size > least * 8:
            size //= 2
            raw = raw >> size ^ raw & (1 << size) - 1
        bits.append(raw)
    label, earlier = [part[i] for i in order], [set(before[i]) for i in order]
    pairs = []
    for x, i in enumerate(order):
        for y in range(x + 1, len(order)):
            j = order[y]
            differ = (bits[x] ^ bits[y]).bit_count()
            if (label[x] != label[y] and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j])
                    and (side[i] == WITHIN or side[i] != side[j])
                    and differ * (100 + percent) <= (n[i] + n[j]) * (100 - percent) and (node[i], node[j]) not in tested
                    and earlier[x].isdisjoint(earlier[y])):
                pairs.append((differ, x, y))
    pairs.sort()
    out = []
    if not tries:
        return [(node[order[x]], node[order[y]]) for _, x, y in pairs[:1]]
    while pairs:
        kept, gone = label[pairs[0][1]], label[pairs[0][2]]
        between = [(x, y) for _, x, y in pairs if {label[x], label[y]} == {kept, gone}]
        out += [(node[order[x]], node[order[y]]) for x, y in between[:tries]]
        label = [kept if old == gone else old for old in label]
        pairs = [p for p in pairs if label[p[1]] != label[p[2]]]
    return out


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            keep = []
            for x, y in zip(col["features_a"].to_pylist(), col["features_b"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_pydict({c: col[c].filter(keep) for c in ("a", "b")})

    return run


def dealt(members: DataFrame, block: int) -> DataFrame:
    """(meet, sig, node, side): the members (sig, node, component) of each signature that has several components, dealt into
    meetings of one or two blocks. Any two members of different components have one meeting, in which
    both are WITHIN or one is ONE and the other TWO.

    A signature of up to `block` members is one meeting. In a larger one, its largest component is dealt into blocks,
    and the rest into others: blocks of the rest meet all blocks, but those of the largest component not each other.
    """
    counts = members.groupBy("sig", "component").agg(F.count("*").alias("n"))
    counts = (counts.groupBy("sig").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"),
                                        F.count("*").alias("parts")).filter("parts > 1"))
    whole = F.col("n") <= block
    counts = counts.select(
        "sig", F.when(~whole, F.col("most.component")).alias("main"),
        F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("most.n")) / block)).cast("int").alias("rest"),
        F.when(whole, 0).otherwise(F.ceil(F.col("most.n") / block)).cast("int").alias("blocks"))
    rows = members.join(counts, "sig")
    at = F.xxhash64("node")
    in_main = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    rows = rows.select("sig", "node", "rest", "blocks", in_main.alias("in_main"), F.when(
        in_main, F.col("rest") + F.pmod(at, F.greatest("blocks", F.lit(1)))).otherwise(F.pmod(at, "rest")).cast("int").alias("block"))
    others = F.when(F.col("in_main"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("rest") + F.col("blocks") - 1))
    rows = rows.select("sig", "node", "block", F.explode(others).alias("other"))
    return rows.select(
        F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other")).alias("meet"), "sig", "node",
        F.when(F.col("block") == F.col("other"), WITHIN).when(F.col("block") < F.col("other"), ONE).otherwise(TWO).alias("side"))


def _repeated(table: DataFrame) -> hashed.Filter:
    """A filter of the signatures that occur in more than one row: counted by packed blobs, as most occur in one."""
    rows = table.select("sigs")
    total = rows.agg(F.sum(F.size("sigs"))).first()[0] or 0
    bits = min(hashed.range_bits(total * 8), COUNTED)

    def packed(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy().view(np.uint64))
            size += len(held[-1])
            if size > HELD:
                yield _counts(held, bits)
                held, size = [], 0
        yield _counts(held, bits)

    def segment(found: pa.Table) -> pa.Table:
        return pa.table({"range": found.column("range")[:1],
                         "bits": pa.array([hashed.segment(hashed.frequent(found, 2), bits)], pa.binary())})

    segments = rows.mapInArrow(tidied(packed), hashed.BLOBS).groupBy("range").applyInArrow(segment, "range long, bits binary")
    return hashed.Filter([(r.range, bytes(r.bits)) for r in segments.collect()], bits)


def _leading(sigs: np.ndarray) -> np.ndarray:
    return sigs & ~np.uint64((1 << 64 - COUNTED) - 1)


def _counts(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    keys = _leading(np.concatenate([np.zeros(0, np.uint64), *held]))
    return hashed.packed(*hashed.added([keys], [np.ones(len(keys), np.int64)]), bits)


def _filtered(keep: hashed.Filter):
    """(sig, one) of the signatures that pass."""

    def run(batches):
        for batch in batches:
            sigs = batch.column(1)
            values = sigs.flatten().to_numpy()
            passed = keep.holds(_leading(values.view(np.uint64)))
            one = np.repeat(batch.column(0).to_numpy(), sigs.value_lengths().to_numpy())
            yield pa.RecordBatch.from_pydict({"sig": pa.array(values[passed]), "one": pa.array(one[passed])})

    return run


class _Join:
    """The candidate pairs of one run, and which of them link."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        self.table = written(docs.mapInArrow(
            tidied(_featured(words, percent)),
            "doc_id long, n long, one long, two long, sketch binary, sigs array<long>"), "partenum")
        in_class = F.expr("n > 0 AND doc_id IS NOT NULL")
        self.classes = written(self.table.filter(in_class).groupBy("one", "two", "n").agg(F.min("doc_id").alias("node")), "classes")
        # Signatures that tasks gave more than once; the filter may let others through, which the next step drops.
        rows = self.table.select("one", "sigs").mapInArrow(tidied(_filtered(_repeated(self.table))), "sig long, one long").distinct()
        rows = written(rows, "repeated")
        sets = rows.groupBy("sig").agg(
            F.min("one").alias("hub"), F.count("*").alias("members"),
            *[F.bit_xor(F.xxhash64("one", F.lit(i))).alias(f"x{i}") for i in (1, 2)]).filter("members > 1")
        # Signatures with the same members say the same: one of them stays.
        kept = sets.groupBy("members", "x1", "x2", "hub").agg(F.min("sig").alias("sig"))
        # What shares a signature with another class: the only rows that matter from here on.
        self.shared = written(rows.join(kept.select("sig", "hub"), "sig"), "shared")
        ones = written(self.shared.select("one").distinct(), "ones")
        few = ones.count() <= FEW_IDS
        mine = self.table.filter(in_class).select("one", "two", "n", "sketch")
        sketches = (mine.filter("sketch IS NOT NULL").join(F.broadcast(ones) if few else ones, "one", "left_semi")
                    .groupBy("one", "two", "n").agg(F.min("sketch").alias("sketch")))
        #: Classes with a partner in sight, and their sketches.
        self.known = written(self.classes.join(sketches, ["one", "two", "n"]), "known")

    def candidates(self) -> DataFrame:
        """Each class with the hubs of its signatures, as pairs of representatives."""
        keys = self.shared.filter("one <> hub").select(F.col("hub").alias("x"), F.col("one").alias("y")).distinct()
        node = self.known.select("one", "node")
        return (keys.join(node.toDF("x", "p"), "x").join(node.toDF("y", "q"), "y")
                .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).filter("a <> b").distinct())

    def _of(self, nodes: DataFrame) -> DataFrame:
        """The classes of the given representatives, picked without a shuffle of all where these are few."""
        nodes = written(nodes.select("node").distinct(), "nodes")
        few = nodes.count() <= FEW_IDS
        return written(self.known.join(F.broadcast(nodes) if few else nodes, "node", "left_semi"), "own")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Those of some written pairs that link."""
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
        side = self._of(ends).select("node", "n", "sketch")
        likely = (pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
                  .filter(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)"))
        likely = written(likely.mapInArrow(tidied(_maybe(self.percent)), "a long, b long"), "likely")
        nodes = written(likely.select(F.col("a").alias("node")).unionAll(likely.select(F.col("b").alias("node"))).distinct(),
                        "nodes")
        few = nodes.count() <= FEW_IDS
        texts = self.docs.withColumn("node", F.col("doc_id"))
        texts = texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("doc_id", "text", "node")
        sets = written(texts.mapInArrow(tidied(_sets(self.words)), "node long, features binary"), "sets")
        return (likely.join(sets.toDF("a", "features_a"), "a").join(sets.toDF("b", "features_b"), "b")
                .mapInArrow(tidied(_linked(self.percent)), "a long, b long"))

    def components(self) -> DataFrame:
        """(node, component) of all representatives that link with another."""
        links = written(self.compared(written(self.candidates(), "tested")), "links")
        tested = None
        part = self._sent(components(links))
        # Hubs have been compared with all others of their signatures.
        alive = self.shared.filter("one <> hub").join(self.known.select("one", "node"), "one").select("sig", "node")
        alive = written(dealt(alive.join(part, "node", "left").select(
            "sig", "node", F.coalesce("component", "node").alias("component")), BLOCK), "dealt")
        # Which signature settles a pair: the smallest that both have. So each pair is tried once. (Not those of an id
        # with several texts, which do not have the same signatures.)
        single = self.known.groupBy("node").count().filter("count = 1").select("node")
        lists = written(alive.select("sig", "node").distinct().groupBy("node").agg(F.collect_list("sig").alias("sigs"))
                        .join(single, "node"), "lists")
        tries = TRIES
        while True:
            placed = alive.join(part, "node", "left").select("meet", "sig", "node", "side", F.coalesce("component", "node").alias("component"))
            spread = placed.groupBy("meet").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            still = written(placed.join(spread.filter("low <> high").select("meet"), "meet"), "still")
            if tested is None:  # most meetings have no pair that may link; lists of signatures are for the others
                none = F.array().cast("array<long>").alias("before")
                rows = (still.join(self._of(still).select("node", "n", "sketch"), "node")
                        .select("meet", "node", "component", "side", "n", "sketch", none))
                open_ = written(rows.repartition("meet").sortWithinPartitions("meet")
                                .mapInArrow(tidied(_forest(self.percent, 0)), "meet long, a long, b long"), "open")
                still = written(still.join(open_.select("meet").distinct(), "meet", "left_semi"), "still")
            before = F.filter(F.coalesce("sigs", F.array().cast("array<long>")), lambda x: x < F.col("sig")).alias("before")
            rows = (still.join(self._of(still).select("node", "n", "sketch"), "node").join(lists, "node", "left")
                    .select("meet", "node", "component", "side", "n", "sketch", before))
            if tested is not None:
                rows = rows.unionAll(tested.select("meet", F.col("a").alias("node"), F.col("b").alias("component"), F.lit(TRIED),
                                                   F.lit(0).cast("long"), F.lit(None).cast("binary"),
                                                   F.lit(None).cast("array<long>")))
            found = written(rows.repartition("meet").sortWithinPartitions("meet")
                            .mapInArrow(tidied(_forest(self.percent, tries)), "meet long, a long, b long"), "forest")
            if found.isEmpty():
                return part
            links = written(links.unionAll(self.compared(written(found.select("a", "b").distinct(), "tried"))), "links")
            tries *= MORE
            part = self._sent(components(links))
            tested = self._apart(found if tested is None else tested.unionAll(found), part)
            tested = written(tested.join(found.select("meet").distinct(), "meet", "left_semi"), "tested")
            alive = written(still.select("meet", "sig", "node", "side").join(found.select("meet").distinct(), "meet", "left_semi"), "alive")

    @staticmethod
    def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
        """Those of some tried pairs that no component holds; the others cannot be tried again."""
        for end in ("a", "b"):
            pairs = pairs.join(part.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}")), end, "left")
        return pairs.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("meet", "a", "b")

    @staticmethod
    def _sent(part: DataFrame) -> DataFrame:
        return F.broadcast(part) if part.count() <= FEW_IDS else part


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    docs = two_columns(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    join = _Join(docs, words, percent)
    part = join.components()
    named = (join.classes.join(part, "node", "left")
             .select("one", "two", "n", F.coalesce("component", "node").alias("component")))
    rows = join.table.select("doc_id", "n", "one", "two")
    in_class = F.expr("n > 0 AND doc_id IS NOT NULL")
    found = (rows.filter(in_class).join(named, ["one", "two", "n"])
             .select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")))
    return found.unionAll(rows.filter(~in_class).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
