"""Quality classifier: averaged embeddings of hashed words and character n-grams.

A document's features are its words, its pairs of neighbouring words and the n-grams
of its bytes (sizes GRAMS), all lower-cased in ASCII and hashed into BUCKETS rows of an
embedding table. The rows are averaged, a linear layer and a softmax over two classes
follow, and all of it is learned by stochastic gradient descent in numpy.

Scoring is linear up to the softmax, so the table is folded with the layer into one
number for each bucket, and a document's score is the sigmoid of their mean. Every
whole text of every row is scored, and nothing but the text is read.

The fit uses a bounded sample: at most SAMPLE labelled rows with a text of at most
SAMPLE_BYTES bytes, those with the lowest hash of the id.

A null or empty text has no features and gets the score of the bias alone. Without a
labelled row every score is 0.5. Several labels for one id count each; a null label does
not count. Equal texts get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import SpanHash, lowered, map_pieces, owners, runs, text_bytes, two_columns

SAMPLE, SAMPLE_BYTES = 5_000, 20_000
BUCKETS_LOG2 = 18
GRAMS = (2, 4)
DIMENSIONS, EPOCHS, RATE = 8, 6, 0.35
#: Score from which a document is predicted good.
GOOD = 0.7

_HASH = SpanHash(17)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) arrays, one for each kind of feature, documents in order."""
    data = lowered(data)
    shift = np.uint64(64 - BUCKETS_LOG2)
    starts, ends = runs(~_SPACE[data], offsets)
    words = _HASH.spans(_HASH.prefix(data), starts, ends)
    doc = owners(starts, offsets)
    out = [(doc, words >> shift)]
    if len(words) > 1:
        pair = doc[1:] == doc[:-1]
        both = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        out.append((doc[1:][pair], (both * np.uint64(0xD6E8FEB86659FD93) >> shift)[pair]))
    wide = data.astype(np.uint64)
    lengths = np.diff(offsets)
    for n in GRAMS:
        if len(data) < n:
            continue
        packed = wide[: len(wide) - n + 1].copy()
        for j in range(1, n):
            packed = packed << np.uint64(8) | wide[j: len(wide) - n + 1 + j]
        bucket = (packed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> shift
        inside = np.ones(len(bucket), bool)  # n-grams that cross into the next document
        for j in range(1, n):
            at = offsets[1:-1] - j
            inside[at[(at >= 0) & (at < len(inside))]] = False
        out.append((np.repeat(np.arange(len(lengths)), lengths)[: len(bucket)][inside], bucket[inside]))
    return out


def fit(texts: list[str], labels: list[int], seed: int = 3) -> np.ndarray:
    """The folded table: one number for each bucket, and the bias at the end."""
    size = 1 << BUCKETS_LOG2
    if not texts:
        return np.zeros(size + 1, np.float32)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    examples = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [b for _, b in features(raw, np.array([0, len(raw)]))] if len(raw) else []
        examples.append(np.unique(np.concatenate(found).astype(np.int64), return_counts=True) if found else None)
    steps = EPOCHS * len(examples)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)).tolist():
            rate = RATE * (1 - step / steps)
            step += 1
            if examples[i] is None:
                mean = np.zeros(DIMENSIONS, np.float32)
            else:
                rows, counts = examples[i]
                share = (counts / counts.sum()).astype(np.float32)
                mean = share @ table[rows]
            logits = mean @ layer + bias
            grad = np.exp(logits - logits.max())
            grad /= grad.sum()
            grad[labels[i]] -= 1
            back = layer @ grad
            layer -= rate * np.outer(mean, grad)
            bias -= rate * grad
            if examples[i] is not None:
                table[rows] -= rate * len(rows) ** 0.5 * share[:, None] * back[None, :]
    side = layer[:, 1] - layer[:, 0]
    return np.append(table @ side, bias[1] - bias[0]).astype(np.float32)


def trained(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality") -> np.ndarray:
    """The folded table, learned from a bounded sample of labelled rows."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "label").limit(SAMPLE)
    rows = two_columns(docs, id_col, text_col).filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    sample = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label").collect()
    sample.sort(key=lambda r: (str(r.doc_id), r.label, r.text or ""))
    return fit([r.text or "" for r in sample], [r.label for r in sample])


def scored(docs: DataFrame, folded: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    only = two_columns(docs, id_col, text_col)
    key = only.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(folded)

    def work(batch: pa.RecordBatch) -> dict:
        weights, bias = sent.value[:-1], float(sent.value[-1])
        data, offsets = text_bytes(batch.column(1))
        total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for doc, bucket in features(data, offsets):
            total += np.bincount(doc, weights[bucket.astype(np.int64)], minlength=batch.num_rows)
            count += np.bincount(doc, minlength=batch.num_rows)
        score = 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))
        return {"doc_id": batch.column(0), "score": pa.array(score), "predicted": pa.array((score >= GOOD).astype(np.int32))}

    return map_pieces(only, work, f"doc_id {key}, score double, predicted int")
