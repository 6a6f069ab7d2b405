"""What Python workers, which go on from task to task and stage to stage, hold at a time and keep."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

import corpus_pipeline as pipeline
from fleetlens.llm import bpe, common, hashed, jaccard


def _texts(n, words):
    rng = random.Random(8)
    return [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(words)) for _ in range(n)]


def test_near_copies_hold_little_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": _texts(1000, 400)})
    tracemalloc.start()
    rows = sum(b.num_rows for b in jaccard._featured(5, 80)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1000
    assert peak < 20 << 20


def test_a_task_is_tidied_at_its_end():
    seen = []
    run = common.tidied(lambda batches: (b for b in batches), lambda: seen.append("after"))
    assert [(b, len(seen)) for b in run([1, 2])] == [(1, 0), (2, 0)] and seen == ["after"]


def test_workers_keep_no_pieces(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(40, 30))), "doc_id long, text string").repartition(8)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert len(bpe.encoded(docs, path, public_tokenizers.PATTERN).collect()) == 40

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(v.slot) for v in bpe.Vocabulary._kept.values())], pa.int64())})

    assert not any(r.n for r in spark.range(0, 8, 1, 8).mapInArrow(kept, "n long").collect())


def test_stages_keep_batches_small(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    docs.selectExpr("doc_id AS item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for stage in (pipeline.near_copies, pipeline.benchmark, pipeline.tokens):
            spark.conf.set(name, "10000")  # a stage may be the first of its session
            stage(spark, docs, str(tmp_path))
            assert spark.conf.get(name) == str(common.FEW_ROWS)
    finally:
        spark.conf.set(name, before)


def test_counted_signatures_are_sent_in_few_bytes():
    sigs = np.random.default_rng(2).integers(0, 1 << 64, 1 << 17, dtype=np.uint64)
    sent = jaccard._counts([sigs, sigs[:1000]], 3)
    assert sum(len(b) for b in sent.column("blob").to_pylist()) < 4.5 * len(sigs)
    table = pa.Table.from_batches([sent])
    found = [hashed.segment(hashed.frequent(table.slice(i, 1), 2), 3) for i in range(8)]
    keep = hashed.Filter(list(enumerate(found)), 3)
    rows = pa.RecordBatch.from_pydict({"one": pa.array([1, 2], pa.int64()), "sigs": pa.array(
        [sigs[:1000].view(np.int64).tolist(), sigs[1000:].view(np.int64).tolist()], pa.list_(pa.int64()))})
    passed = next(iter(jaccard._filtered(keep)([rows])))
    assert passed.column("sig").to_pylist()[:1000] == sigs[:1000].view(np.int64).tolist()  # none is missed
    assert passed.num_rows < 1000 + 0.05 * len(sigs)
