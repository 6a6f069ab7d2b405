"""What several operators share: Arrow batches as byte arrays, span hashes, ragged gathers, components.

Everything here runs inside Spark tasks on bounded pieces of a batch, or is a
plain DataFrame function. Texts are handled as UTF-8 bytes; a null text counts
as empty unless an operator says otherwise.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fleetlens.session import checkpoint, scratch_dir

#: Text bytes that a task works on at a time; a longer document is one piece of its own.
PIECE_BYTES = 1 << 20
#: Positions that a ragged gather works out at a time.
GATHERED = 1 << 20
#: Rows of an Arrow batch between the JVM and Python; in the pipeline, whose stages share the executors.
BATCH_ROWS, FEW_ROWS = 2_000, 500
#: Ids that are sent to every executor; more are joined by shuffle.
FEW_IDS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def batches_of(spark: SparkSession, rows: int) -> None:
    """Keep Arrow batches small, in what the session runs from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents", rows: int = BATCH_ROWS) -> DataFrame:
    """A given table, with Arrow batches kept small."""
    batches_of(spark, rows)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles_let_go(spark: SparkSession) -> None:
    """Have the shuffle files of queries that are over deleted now; else that waits for the driver to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names: other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


# ---- texts of a batch as bytes


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    at = at.astype(np.int64) if len(at) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most so many text bytes, one row at least."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def handed_back() -> None:
    """Give freed memory that the allocators hold back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], after: Callable[[], None] = lambda: None):
    """The same work on a task's batches; at its end the worker, which goes on to other tasks, hands back what this one has freed."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        after()
        handed_back()

    return all_of


def map_pieces(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str,
               column: str = "text", limit: int = PIECE_BYTES, after: Callable[[], None] = lambda: None) -> DataFrame:
    """Run `work` on bounded runs of rows; it returns the columns of the result. `after` is called when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, limit):
                yield pa.RecordBatch.from_pydict(work(piece))

    return df.mapInArrow(tidied(run, after), schema)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the rows do not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def annotated(df: DataFrame, text_col: str, work: Callable[[pa.Array], dict], fields: str, name: str,
              limit: int = PIECE_BYTES) -> DataFrame:
    """All rows and columns as they are, and a struct column `name` that `work` makes of the texts."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col, limit):
                made = work(piece.column(place))
                extra = pa.StructArray.from_arrays(list(made.values()), list(made))
                yield pa.RecordBatch.from_arrays([*piece.columns, extra], [*piece.schema.names, name])

    schema = StructType([*df.schema.fields, StructField(name, StructType.fromDDL(fields))])
    return df.mapInArrow(tidied(run), schema)


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among the given distinct ids; those are broadcast only if they are few."""
    ids = written(ids.select(ids.columns[0]).toDF("gone"), "gone")
    few = ids.count() <= FEW_IDS
    gone = ids.withColumnRenamed("gone", name := free_name(df, "gone"))
    return df.join(F.broadcast(gone) if few else gone, df[id_col] == gone[name], "left_anti")


# ---- spans and their hashes


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class SpanHash:
    """64-bit hashes of any spans of an array of small symbols, from one prefix sum."""

    def __init__(self, seed: int = 1, symbols: int = 256):
        self.made_from = (seed, symbols)
        self.base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1) | 5) & 0xFFFFFFFFFFFFFFFF)
        self.back = np.uint64(_inverse(int(self.base)))
        self.table = mixed(np.arange(1, symbols + 1, dtype=np.uint64) + np.uint64(seed << 32))
        self._powers = self._backs = np.ones(1, np.uint64)

    def __reduce__(self):
        return SpanHash, self.made_from  # without the powers

    def back_powers(self, n: int) -> np.ndarray:
        """The first n powers of the inverse of the base."""
        self._grow(n)
        return self._backs[:n]

    def _grow(self, n: int) -> None:
        if len(self._powers) <= n:
            n = max(n + 1, 1 << 16)
            for name, base in (("_powers", self.base), ("_backs", self.back)):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols))
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(self.table[symbols] * self._powers[: len(symbols)], out=sums[1:])
        return sums

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (prefix[ends] - prefix[starts]) * self.back_powers(len(prefix))[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * _BASE)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document that each position lies in (empty documents own none)."""
    return np.searchsorted(offsets, starts, side="right") - 1


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate spans of a pool."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, pool.dtype)
    begin = 0
    while begin < len(lengths):  # so many positions at a time
        done = int(ends[begin - 1]) if begin else 0
        end = max(int(np.searchsorted(ends, done + GATHERED, side="right")), begin + 1)
        size = lengths[begin:end]
        shift = starts[begin:end] - (ends[begin:end] - size - done)
        out[done: int(ends[end - 1])] = pool[np.repeat(shift, size) + np.arange(int(ends[end - 1]) - done)]
        begin = end
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


# ---- connected components


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of one task, by union-find with the smaller node on top."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while top.setdefault(root, root) != root:
            root = top[root]
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
    nodes = list(top)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()),
                                      "component": pa.array([find(x) for x in nodes], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) can reach.

    Up to FEW_IDS edges are a few megabytes and go through one task. More are worked
    on by alternating large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the smallest it knows. Each step is two
    aggregations of the edges with map-side minima, so a node with very many edges is no
    single task. Steps end on checkpoints; no edge reaches the driver.
    """
    found = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges")
    if found.count() <= FEW_IDS:
        return written(found.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
    return _starred(found)


def _starred(edges: DataFrame) -> DataFrame:
    """Components of any number of edges (u, v), u > v."""
    links = checkpoint(edges.distinct())
    seen = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpoint(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .filter("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        links = checkpoint(large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .unionAll(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
