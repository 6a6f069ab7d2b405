"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers encode the same text: a space and the document. Cumulative byte ends of
each side go into a dictionary from end to index; the sorted common keys slice both id
lists into groups, and every group is expanded to its links, the pairs of tokens whose
byte ranges overlap. (Inside a slice no end is common, so each end of either side but
the last begins one more link.)

Pairs of ids are counted by how many documents hold them linked. Map tasks add up their
pairs before the shuffle, so a pair that all documents hold is one row a task. Distinct
pairs are bounded by the vocabularies, not by the corpus, but that bound is large; so the SENT
most frequent ones are sent to all tasks, and the pairs of documents that are not among them are
joined by shuffle. Those are the rare ones, so no key of that join is hot.

Texts are encoded once: a row's distinct pairs and how often each occurs stay with it,
packed, until the counts are known.

Texts that are null or empty, or whose joined token bytes on either side differ from space and
text, have no tokens: all numbers are zero and the digest is the empty text. A text is encoded
as a whole, whatever its length. Repeated rows count as documents of their own. An empty
table gives an empty result. Only the id and the text are looked at.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import gathered, pieces, two_columns, written

#: Text bytes that are encoded at a time.
PIECE = 1 << 18
#: Distinct pairs that a map task gathers before it emits them.
HELD = 1 << 20
#: Pairs whose counts are sent to all tasks: 13 bytes each.
SENT = 2_000_000

_SHIFT = 20  # bits of an id of the second tokenizer


# ---- the two tokenizers


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library.

    Where its merges come in the order of their ids, as is usual, they are ranks: then tiktoken's encoder gives the
    same ids in a quarter of the time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.model.get_vocab()
        special = {x.content for x in self.model.get_added_tokens_decoder().values()}
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.spelled[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks = {self.spelled[i]: i for token, i in vocabulary.items() if token not in special}
        self.ranked = None
        if [vocabulary.get(m) for m in merged] == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged):
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.model.encode_batch([" " + x for x in texts], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranked is None:
            return self.library(texts)
        return [np.array(self.ranked.encode_ordinary(" " + x), np.int64) for x in texts]


class Pieces:
    """A piece model of the sentencepiece library, which puts a space before the text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.spelled = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.spelled.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


class _Side:
    """Ids as bytes and as digits with each of the separators that may follow them."""

    def __init__(self, spelled: list[bytes], separators: bytes):
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.bytes_at = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)
        digits = [b"%d%c" % (i, s) for i in range(len(spelled)) for s in separators]
        self.digit_length = np.array([len(x) for x in digits], np.int64)
        self.digits_at = np.cumsum(self.digit_length) - self.digit_length
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return gathered(self.pool, self.bytes_at[ids], self.length[ids]).tobytes()


class Aligner:
    """Groups and links of texts under two tokenizers."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.left, self.right = _Side(a.spelled, b",|"), _Side(b.spelled, b",;")
        self.digits = np.concatenate([self.left.digits, self.right.digits])

    def faithful(self, text: str, ids_a: np.ndarray, ids_b: np.ndarray) -> bool:
        """Whether the tokens of both sides spell a space and the text."""
        want = b" " + text.encode()
        return self.left.joined(ids_a) == want and self.right.joined(ids_b) == want

    def aligned(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> list[tuple]:
        """(groups, digest, distinct pairs, occurrences of each) of encoded texts that are faithful.

        The texts are worked on as one: each ends with a common end, so no group crosses two of them.
        """
        if not ids_a:
            return []
        upto_a, upto_b = (np.cumsum([len(x) for x in ids]) for ids in (ids_a, ids_b))
        ids_a, ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(self.left.length[ids_a]), np.cumsum(self.right.length[ids_b])
        index_a = dict(zip(ends_a.tolist(), range(1, len(ids_a) + 1), strict=True))
        index_b = dict(zip(ends_b.tolist(), range(1, len(ids_b) + 1), strict=True))
        common = sorted(index_a.keys() & index_b.keys())
        cut_a = np.fromiter(map(index_a.__getitem__, common), np.int64, len(common))
        cut_b = np.fromiter(map(index_b.__getitem__, common), np.int64, len(common))
        groups = np.searchsorted(cut_a, upto_a, side="right")
        spelled, until = self._spelled(ids_a, ids_b, cut_a, cut_b, upto_a, upto_b)
        # Every end of either side closes one link; a common end closes one for both.
        ends = np.concatenate([ends_a, ends_b])
        ends.sort(kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        link = ids_a[of_a] << _SHIFT | ids_b[of_b]
        out, begin, low, first = [], 0, 0, 0
        last_link = np.searchsorted(of_a, upto_a)
        for high, stop, until_link in zip(groups.tolist(), until.tolist(), last_link.tolist(), strict=True):
            own = np.sort(link[begin:until_link])
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out.append((high - low, hashlib.sha256(spelled[first:stop - 1]).hexdigest(), own[head],
                        np.diff(np.append(head, len(own)))))
            begin, low, first = until_link, high, stop
        return out

    def _spelled(self, ids_a, ids_b, cut_a, cut_b, upto_a, upto_b) -> tuple[bytes, np.ndarray]:
        """The groups as text, `a1,a2|b1;a3|b2,b3;`, and where each document's part of it ends."""
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[cut_a - 1] = last_b[cut_b - 1] = 1
        # The place of each token: its own side's tokens before it, and the other side's of earlier (b: and this) groups.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        at_a = np.arange(len(ids_a)) + np.append(0, cut_b)[group_a]
        at_b = np.arange(len(ids_b)) + cut_a[group_b]
        start, size = (np.empty(len(ids_a) + len(ids_b), np.int64) for _ in range(2))
        row_a, row_b = ids_a * 2 + last_a, ids_b * 2 + last_b
        start[at_a], size[at_a] = self.left.digits_at[row_a], self.left.digit_length[row_a]
        start[at_b], size[at_b] = self.right.digits_at[row_b] + len(self.left.digits), self.right.digit_length[row_b]
        return gathered(self.digits, start, size).tobytes(), np.cumsum(size)[upto_a + upto_b - 1]


_READY: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, made once in a process."""
    if (path_a, path_b) not in _READY:
        _READY[path_a, path_b] = Aligner(ByteLevel(path_a), Pieces(path_b))
    return _READY[path_a, path_b]


# ---- tasks


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _opened(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _encoded(path_a: str, path_b: str):
    """Rows of documents with their numbers, digest and packed pairs."""

    def run(batches):
        both = aligner(path_a, path_b)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                texts = piece.column(1).to_pylist()
                some = [i for i, x in enumerate(texts) if x]
                given = [texts[i] for i in some]
                ids = list(zip(both.a.encode(given), both.b.encode(given), strict=True))
                good = [j for j, (a, b) in enumerate(ids) if both.faithful(given[j], a, b)]
                made = both.aligned([ids[j][0] for j in good], [ids[j][1] for j in good])
                rows = {some[j]: (found, *map(len, ids[j])) for j, found in zip(good, made, strict=True)}
                out = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often")}
                for i in range(piece.num_rows):
                    found, n_a, n_b = rows.get(i, (None, 0, 0))
                    if found is None:
                        values = (0, 0, 0, 0, "", None, None)
                    else:
                        groups, digest, pairs, often = found
                        steps = np.diff(pairs, prepend=0)  # small numbers pack better
                        values = (n_a, n_b, groups, int(often.sum()), digest, _packed(steps.astype("<u8")), _packed(often.astype("<u4")))
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column(0)} | {
                    n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    return run


def _summed(batches):
    """(pair, docs): the pairs of a task's documents, added up."""
    keys, sums, fresh, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        both = np.concatenate([keys, *fresh])
        names, back = np.unique(both, return_inverse=True)
        counts = np.bincount(back, np.concatenate([sums, np.ones(len(both) - len(keys), np.int64)]), len(names))
        return names, counts.astype(np.int64)

    def rows():
        return pa.RecordBatch.from_pydict({"pair": pa.array(keys), "docs": pa.array(sums)})

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            if raw is None:
                continue
            fresh.append(np.cumsum(_opened(raw, "<u8")).astype(np.int64))
            held += len(fresh[-1])
            if held >= HELD:
                (keys, sums), fresh, held = merged(), [], 0
                if len(keys) >= HELD:
                    yield rows()
                    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if fresh:
        keys, sums = merged()
    yield rows()


def _judged(sent, some_missing: bool):
    """The rows' best links and sums, as far as the sent pairs tell; what they do not, as a list."""

    def run(batches):
        names, counts, best = sent.value
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            n_best, count_sum, rest = [], [], []
            for raw, often in zip(col["pairs"].to_pylist(), col["often"].to_pylist(), strict=True):
                missing = []
                if raw is None or not len(names):
                    n_best.append(0)
                    count_sum.append(0)
                    if raw is not None and some_missing:
                        pairs = np.cumsum(_opened(raw, "<u8")).astype(np.int64)
                        missing = list(zip(pairs.tolist(), _opened(often, "<u4").tolist(), strict=True))
                else:
                    pairs, times = np.cumsum(_opened(raw, "<u8")).astype(np.int64), _opened(often, "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(names, pairs), len(names) - 1)
                    known = names[at] == pairs
                    n_best.append(int(times[known & best[at]].sum()))
                    count_sum.append(int((times * counts[at])[known].sum()))
                    if some_missing and not known.all():
                        missing = list(zip(pairs[~known].tolist(), times[~known].tolist(), strict=True))
                rest.append([{"pair": p, "often": t} for p, t in missing])
            made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
            if some_missing:
                made["rest"] = pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("often", pa.int64())])))
            yield pa.RecordBatch.from_pydict({c: col[c] for c in col if c not in ("pairs", "often")} | made)

    return run


_NUMBERS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def encoded(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its groups' digest, numbers, and packed pairs."""
    rows = two_columns(docs, id_col, text_col)
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(path_a, path_b), f"doc_id {key}, {_NUMBERS}, pairs binary, often binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents a pair is linked, and whether no pair of its first id has more."""
    pairs = rows.select("pairs").mapInArrow(_summed, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    pairs = written(pairs, "pairs")
    most = pairs.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("docs").alias("most"))  # a row for each id
    return pairs.join(F.broadcast(most), F.shiftright("pair", _SHIFT) == F.col("a")).select(
        "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text",
            sent: int = SENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    rows = written(encoded(docs, path_a, path_b, id_col=id_col, text_col=text_col), "aligned")
    counts = written(pair_counts(rows), "pair-counts")
    total = counts.count()
    # The least count of the sent pairs: all pairs above it go, those of that count stay behind if they are too many.
    least = 0
    if total > sent:
        sizes = counts.groupBy("docs").agg(F.count("*").alias("n")).orderBy(F.desc("docs"))
        room = sent
        for row in sizes.toLocalIterator():
            room -= row.n
            if room < 0:
                least = row.docs
                break
    found = counts.filter(F.col("docs") > least).orderBy("pair").toArrow()
    names, docs_, best = (found.column(c).to_numpy() for c in ("pair", "docs", "best"))
    some_missing = total > len(names)
    table = spark.sparkContext.broadcast((names, docs_, best))
    key = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_judged(table, some_missing), f"doc_id {key}, {_NUMBERS}, n_best long, count_sum long"
                          + (", rest array<struct<pair: long, often: long>>" if some_missing else ""))
    if some_missing:
        out = _with_rare(out, counts.filter(F.col("docs") <= least))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _with_rare(out: DataFrame, rare: DataFrame) -> DataFrame:
    """The rows with what their pairs beyond the sent ones add, by shuffle."""
    out = written(out.withColumn("row", F.expr("uuid()")), "judged")
    links = out.select("row", F.inline("rest"))
    more = (links.join(rare, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
                 F.sum(F.col("often") * F.col("docs")).alias("more_sum")))
    return out.drop("rest").join(more, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
