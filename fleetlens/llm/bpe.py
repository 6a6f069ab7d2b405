"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the fixed pattern; each piece is merged on its own.
The merges of a piece are found with a segment tree over its byte positions: a
leaf holds the rank of the pair that starts there (none: infinity), an inner
node the smaller child, so that the root is the leftmost minimum. A merge
changes the pair at its own position, at its live left neighbour and at the
position that it swallowed: three point updates of logarithmic cost.

Equal pieces of a batch are merged once (two 64-bit hashes tell them apart), and the
trees of pieces of like length are worked on together as the rows of a matrix; a
piece above LONGEST bytes has a tree of its own. A task keeps at most CACHED
pieces between batches.

Null and empty texts have no tokens; a null id stays null; repeated rows give
repeated results; an empty table gives none. A text longer than PIECE_BYTES is worked
on in parts, cut where a piece is sure to start, so that memory does not grow with it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlens.llm.common import PIECE_BYTES, SpanHash, gathered, map_pieces, text_bytes, two_columns

#: Pieces up to so many bytes share a matrix of trees.
LONGEST = 64
#: Pieces whose ids a task keeps.
CACHED = 500_000

# The only pattern that has an array form below; any other goes through the regex module.
ARRAY_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = np.int64(1) << 62


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Pairs:
    """Which token two neighbours make: an open-addressing table of all pairs."""

    def __init__(self, tokens: list[bytes]):
        rank = {token: i for i, token in enumerate(tokens) if token}
        found = [(rank[token[:cut]], rank[token[cut:]], i) for token, i in rank.items()
                 for cut in range(1, len(token)) if token[:cut] in rank and token[cut:] in rank]
        left, right, made = (np.array(x, np.uint64) for x in zip(*found, strict=True)) if found else \
            (np.zeros(0, np.uint64),) * 3
        self.bits = max(4, int(len(made) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, _NONE, np.int64)
        keys = (left << np.uint64(32) | right).astype(np.int64)
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[rest[free]]  # of several for one slot, one gets it
            won = self.keys[at] == keys[rest]
            self.made[at[won]] = made[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at = self._home(keys)
        out = np.full(len(keys), _NONE, np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            seen = self.keys[at]
            hit = seen == keys[rest]
            out[rest[hit]] = self.made[at[hit]]
            go = ~hit & (seen != -1)
            rest, at = rest[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


def _merge_rows(ids: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Merge all rows of a matrix of symbol ids; -1 where a position is no longer live."""
    rows, width = ids.shape
    shift = width.bit_length() - 1
    live = np.arange(rows)
    right = np.broadcast_to(np.arange(1, width + 1), (rows, width)).copy()
    right[np.arange(width)[None, :] >= lengths[:, None] - 1] = width
    left = np.broadcast_to(np.arange(-1, width - 1), (rows, width)).copy()
    tree = np.full((rows, 2 * width), _NONE, np.int64)
    r, c = np.nonzero(right < width)
    rank = pairs(ids[r, c], ids[r, c + 1])
    tree[r, width + c] = np.where(rank < _NONE, (rank << shift) | c, _NONE)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

    def put(rows_, leaves, values):
        node = leaves + width
        tree[rows_, node] = values
        for _ in range(shift):
            up = node >> 1
            values = np.minimum(values, tree[rows_, node ^ 1])
            tree[rows_, up] = values
            node = up

    while len(live):
        best = tree[live, 1]
        go = best < _NONE
        live, best = live[go], best[go]
        if not len(live):
            break
        at, made = best & (width - 1), best >> shift
        gone = right[live, at]
        after = right[live, gone]
        before = left[live, at]
        ids[live, at] = made
        ids[live, gone] = -1
        right[live, at] = after
        has = after < width
        left[live[has], after[has]] = at[has]
        fresh = np.full(len(live), _NONE, np.int64)
        rank = pairs(made[has], ids[live[has], after[has]])
        fresh[has] = np.where(rank < _NONE, (rank << shift) | at[has], _NONE)
        put(live, gone, np.full(len(live), _NONE, np.int64))
        put(live, at, fresh)
        has = before >= 0
        if has.any():
            rank = pairs(ids[live[has], before[has]], made[has])
            put(live[has], before[has], np.where(rank < _NONE, (rank << shift) | before[has], _NONE))
    return ids


def _merge_long(symbols: list[int], pair: dict[int, int]) -> list[int]:
    """The same merges for one long piece, on plain lists."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    none = (1 << 62, 0)
    right, left = [*range(1, n), -1], list(range(-1, n - 1))
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = pair.get(symbols[i] << 32 | symbols[i + 1])
        if rank is not None:
            tree[width + i] = (rank, i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i, value):
        node = i + width
        tree[node] = value
        while node > 1:
            value = min(value, tree[node ^ 1])
            node >>= 1
            tree[node] = value

    while tree[1] is not none and tree[1][0] < none[0]:
        made, at = tree[1]
        gone = right[at]
        after, before = right[gone], left[at]
        symbols[at], symbols[gone], right[at] = made, -1, after
        put(gone, none)
        rank = None
        if after >= 0:
            left[after] = at
            rank = pair.get(made << 32 | symbols[after])
        put(at, none if rank is None else (rank, at))
        if before >= 0:
            rank = pair.get(symbols[before] << 32 | made)
            put(before, none if rank is None else (rank, before))
    return [s for s in symbols if s >= 0]


class Splitter:
    """Where the pieces of texts start.

    In the array form, runs of letters, numbers, white space and other characters
    are found first. A single space before a run belongs to that run; other white
    space before a run is cut off before its last character; a lone apostrophe
    takes the letters of a contraction with it.
    """

    LETTER, NUMBER, SPACE, OTHER = range(4)

    def __init__(self, pattern: str):
        self.regex = regex.compile(pattern)
        self.by_array = pattern == ARRAY_PATTERN
        if self.by_array:
            self.kinds = np.full(0x110000, self.OTHER, np.uint8)
            chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            for kind, found in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.SPACE, r"\s+")):
                for m in regex.finditer(found, chars):
                    self.kinds[[ord(c) for c in m[0]]] = kind

    def starts(self, text: str, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Start positions over the concatenated texts; `firsts` are the texts' own starts."""
        if not self.by_array:
            ends = [*firsts[1:].tolist(), len(text)]
            return np.array([m.start() for a, b in zip(firsts.tolist(), ends, strict=True)
                             for m in self.regex.finditer(text, a, b)], np.int64)
        n = len(points)
        kind = self.kinds[points]
        edge = np.ones(n, bool)
        edge[1:] = kind[1:] != kind[:-1]
        first = np.zeros(n, bool)
        first[firsts[firsts < n]] = True
        edge |= first
        begin = np.flatnonzero(edge)
        of, end = kind[begin], np.append(begin[1:], n)
        inside = np.append(~first[begin[1:]], False)  # the next run is in the same text
        blank = of == self.SPACE
        after_space = np.zeros(len(begin), bool)
        after_space[1:] = inside[:-1] & (points[begin[1:] - 1] == 32)
        flag = np.zeros(n + 3, bool)
        flag[begin[blank | ~after_space]] = True
        flag[end[blank & inside] - 1] = True
        lone = np.flatnonzero((of == self.OTHER) & (end - begin == 1) & (points[begin] == 39) & ~after_space & inside)
        lone = lone[of[np.minimum(lone + 1, len(of) - 1)] == self.LETTER]
        at, room = begin[lone] + 1, end[np.minimum(lone + 1, len(end) - 1)] - begin[lone] - 1
        one = points[at]
        two = points[np.minimum(at + 1, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (room > 1) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v"))))
                             | ((one == ord("l")) & (two == ord("l"))))
        flag[at[short | long]] = False
        flag[at[short] + 1] = True
        flag[at[long] + 2] = True
        return np.flatnonzero(flag[:n])


class Vocabulary:
    """Ranks, the splitter, and the pieces met so far; one per Python worker."""

    _kept: dict[tuple[str, str], Vocabulary] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Vocabulary:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    @classmethod
    def forget_all(cls) -> None:
        """At the end of a task: its worker goes on to others, also of other stages."""
        for words in cls._kept.values():
            words.forget()

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.rank = {token: i for i, token in enumerate(self.tokens) if token}
        self.split = Splitter(pattern)
        self.pairs = Pairs(self.tokens)
        full = self.pairs.keys >= 0
        self.pair = dict(zip(self.pairs.keys[full].tolist(), self.pairs.made[full].tolist(), strict=True))
        self.byte = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the rank file has no token for some byte")
        self.bytes_of = _pooled(self.tokens)
        self.digits_of = _pooled([b"%d " % i for i in range(len(self.tokens))])
        # A piece that is a token as a whole is that token; few or none come out otherwise by merging.
        full = [token for token in self.tokens if token]
        pool, at, count = self._merged_tokens(full)
        odd = [t for t, a, n in zip(full, at.tolist(), count.tolist(), strict=True) if n > 1 or pool[a] != self.rank[t]]
        self.whole = {token: self.rank[token] for token in odd}
        self.whole_lengths = sorted({len(token) for token in odd})
        self.forget()

    def _merged_tokens(self, tokens: list[bytes]) -> tuple[np.ndarray, ...]:
        self.whole = {}
        raw, starts, lengths = _pooled(tokens)
        return self.merged(raw, starts, lengths)

    def forget(self) -> None:
        self.hashes = [SpanHash(seed) for seed in (1, 2)]
        self.slot: dict[int, int] = {}
        self.check = np.zeros(0, np.uint64)
        self.ids = np.zeros(0, np.uint32)
        self.at = self.length = np.zeros(0, np.int64)

    def merged(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Merge spans of bytes: a pool of ids, and where each span's ids are and how many."""
        at, count = np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)
        pool, filled = [], 0
        rest = np.arange(len(starts))
        for width in (2, 4, 8, 16, 32, LONGEST):
            fits = lengths[rest] <= width
            rows, rest = rest[fits], rest[~fits]
            for begin in range(0, len(rows), 8192):
                some = rows[begin: begin + 8192]
                size = lengths[some]
                ids = np.full((len(some), width), -1, np.int64)
                ids[np.arange(width)[None, :] < size[:, None]] = self.byte[gathered(raw, starts[some], size)]
                live = (ids := _merge_rows(ids, size, self.pairs)) >= 0
                pool.append(ids[live].astype(np.uint32))
                count[some] = live.sum(axis=1)
                at[some] = np.cumsum(count[some]) - count[some] + filled
                filled += len(pool[-1])
        for i in rest.tolist():
            symbols = self.byte[raw[starts[i]: starts[i] + lengths[i]]].tolist()
            pool.append(np.array(_merge_long(symbols, self.pair), np.uint32))
            at[i], count[i] = filled, len(pool[-1])
            filled += len(pool[-1])
        pool = np.concatenate(pool) if pool else np.zeros(0, np.uint32)
        if self.whole:
            for i in np.flatnonzero(np.isin(lengths, self.whole_lengths)).tolist():
                rank = self.whole.get(raw[starts[i]: starts[i] + lengths[i]].tobytes())
                if rank is not None:
                    pool[at[i]], count[i] = rank, 1
        return pool, at, count

    def _keep(self, made: tuple[np.ndarray, ...], check: np.ndarray) -> np.ndarray:
        """Append merged pieces to those kept; their places."""
        pool, at, count = made
        slots = np.arange(len(at)) + len(self.check)
        self.at = np.append(self.at, at + len(self.ids))
        self.length = np.append(self.length, count)
        self.ids = np.append(self.ids, pool)
        self.check = np.append(self.check, check)
        return slots

    def _slots(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """For each piece, the place of its ids among those kept."""
        wide = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
        low, high = wide[starts], wide[ends]
        one, two = (h.spans(h.prefix(raw), low, high) for h in self.hashes)
        keys, at, which = np.unique(one, return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > CACHED:
            self.forget()
        slots = np.array(list(map(self.slot.get, keys.tolist(), itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = at[new]
            slots[new] = self._keep(self.merged(raw, low[first], high[first] - low[first]), two[first])
            self.slot.update(zip(keys[new].tolist(), slots[new].tolist(), strict=True))
        of = slots[which]
        other = np.flatnonzero(self.check[of] != two)  # the same first hash by chance: merged on their own
        if len(other):
            of[other] = self._keep(self.merged(raw, low[other], high[other] - low[other]), two[other])
        return of

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        text = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lasts = np.cumsum(sizes)
        starts = self.split.starts(text, points, (lasts - sizes)[sizes > 0])
        ends = np.append(starts[1:], len(points))
        of = self._slots(points, starts, ends, np.frombuffer(text.encode("utf-8"), np.uint8))
        ids = gathered(self.ids, self.at[of], self.length[of])
        count = np.append(0, np.cumsum(self.length[of]))
        return ids, count[np.searchsorted(starts, lasts)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and how many each has."""
        pool, at, length = self.bytes_of
        return gathered(pool, at[ids], length[ids]), length[ids]

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids as decimal numbers, each followed by a space, and how long each is."""
        pool, at, length = self.digits_of
        return gathered(pool, at[ids], length[ids]), length[ids]


def _pooled(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


# A piece starts at a single space between two other characters, whatever stands around.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def parts(text: str, size: int = PIECE_BYTES // 4) -> list[str]:
    """Cut a long text where a piece is sure to start."""
    cuts = [0]
    while len(text) - cuts[-1] > size:
        found = _SAFE.search(text, cuts[-1] + size)
        if not found:
            break
        cuts.append(found.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def encoded(docs: DataFrame, ranks: str, pattern: str = ARRAY_PATTERN, *, id_col: str = "doc_id",
            text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of the decimal ids and of the decoded bytes.

    `ranks` is a rank file that every executor can read. With `with_ids` the ids
    themselves follow, as an array of integers.
    """

    def work(batch: pa.RecordBatch) -> dict:
        words = Vocabulary.of(ranks, pattern)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        if len(texts) == 1:
            rows = [_digest(words, parts(texts[0]), with_ids)]
        else:
            rows = _digests(words, texts, with_ids)
        columns = list(zip(*rows, strict=True))
        out = {"doc_id": batch.column(0), "n_tokens": pa.array(columns[0], pa.int64()),
               "ids_sha256": pa.array(columns[1], pa.string()),
               "decoded_sha256": pa.array(columns[2], pa.string())}
        return out | ({"ids": pa.array(columns[3], pa.list_(pa.int32()))} if with_ids else {})

    only = two_columns(docs, id_col, text_col)
    schema = SCHEMA.replace("doc_id long", f"doc_id {only.schema['doc_id'].dataType.simpleString()}")
    return map_pieces(only, work, schema + (", ids array<int>" if with_ids else ""), after=Vocabulary.forget_all)


def _digests(words: Vocabulary, texts: list[str], with_ids: bool) -> list[tuple]:
    ids, ends = words.encode(texts)
    spelled, wide = words.decimals(ids)
    plain, long = words.decode(ids)
    spelled_at, plain_at = np.append(0, np.cumsum(wide)), np.append(0, np.cumsum(long))
    out = []
    for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
        numbers = spelled[spelled_at[a]: max(spelled_at[b] - 1, spelled_at[a])]
        out.append((b - a, hashlib.sha256(numbers).hexdigest(),
                    hashlib.sha256(plain[plain_at[a]:plain_at[b]]).hexdigest(), ids[a:b].astype(np.int32) if with_ids else None))
    return out


def _digest(words: Vocabulary, texts: list[str], with_ids: bool) -> tuple:
    """The same for one long document that comes in parts."""
    numbers, decoded, count, kept = hashlib.sha256(), hashlib.sha256(), 0, []
    for text in texts:
        ids, _ = words.encode([text])
        spelled = words.decimals(ids)[0].tobytes()[:-1]
        numbers.update(b" " + spelled if count and len(ids) else spelled)
        decoded.update(words.decode(ids)[0])
        count += len(ids)
        if with_ids:
            kept.append(ids.astype(np.int32))
    return count, numbers.hexdigest(), decoded.hexdigest(), np.concatenate(kept) if with_ids else None
