"""What the Python steps hold at once: bounded by constants, with unchanged results."""

import tracemalloc

import numpy as np
import pyarrow as pa

from newsprep.functions import vectors
from newsprep.operators.pruning import ROWS, Impacts
from newsprep.operators.search import _chunks
from newsprep.streaming import news, news_stream


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_batch_of_vectors_is_held_once():
    rng, dim = np.random.default_rng(1), 384
    rows = [None if i % 1000 == 3 else rng.integers(0, dim, i % 40).tolist() for i in range(10_000)]
    count, buckets = vectors._counter(dim).func, pa.array(rows, pa.list_(pa.int32()))
    assert len(count(buckets.slice(0, 0))) == 0
    found, held = peak(lambda: count(buckets))
    assert held < 10_000 * dim * 4 + (6 << 20)
    wanted = [np.bincount(r or [], minlength=dim).tolist() for r in rows]
    assert found.type == pa.list_(pa.float32()) and found.to_pylist() == wanted


def test_impacts_hold_few_unit_vectors():
    counts = np.random.default_rng(2).poisson(0.1, (20_000, 384)).astype(np.float32)
    counts[7] = 0
    blocks, held = peak(lambda: Impacts(counts))
    assert held < 48 << 20
    assert sorted(np.concatenate(blocks.members)) == list(range(20_000)) and max(map(len, blocks.members)) == ROWS
    length = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1))[:, None]
    unit = np.divide(counts, length, out=np.zeros(counts.shape), where=length != 0)
    order = np.lexsort((-unit.max(axis=1), unit.argmax(axis=1)))
    assert all((np.sort(order[i * ROWS:(i + 1) * ROWS]) == m).all() for i, m in enumerate(blocks.members))
    assert np.allclose(blocks.most, [unit[m].max(axis=0) for m in blocks.members])
    empty = Impacts(np.zeros((0, 0)))
    assert empty.members == [] and empty.most.shape == (0, 0)


def test_a_chunk_of_points_is_copied_once():
    rng, dim = np.random.default_rng(3), 384
    ids, made = rng.permutation(10_000), rng.random((10_000, dim)).astype(np.float32)
    made[5], made[6, 0] = np.nan, np.inf
    made[7] = 0

    def batch(low, high):
        offsets = np.arange(0, (high - low + 1) * dim, dim, dtype=np.int32)
        vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[low:high].ravel()))
        return pa.RecordBatch.from_arrays([pa.array([f"i{i:05d}" for i in ids[low:high]], pa.string()), vectors], names=["chunk_id", "vector"])

    batches = [batch(0, 4000), batch(4000, 4000), batch(4000, 10_000)]
    list(_chunks(iter(batches[1:2])))
    (found, vectors), held = peak(lambda: next(_chunks(iter(batches))))
    assert held < 26 << 20  # 15 MB of vectors, their ids and slices
    order = [i for i in np.argsort(ids) if i not in (5, 6)]
    assert found.tolist() == [f"i{i:05d}" for i in ids[order]] and (vectors == made[order]).all()
    sliced = list(_chunks(iter([batches[0].slice(10, 3)])))
    assert sliced[0][0].tolist() == sorted(f"i{i:05d}" for i in ids[10:13])


def test_a_stream_sends_small_batches_to_python(spark, tmp_path, monkeypatch):
    seen, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(news, "ingest_frames", lambda frames, *a: seen.append(frames.sparkSession.conf.get(key)) or {})
    before = spark.conf.get(key)
    spark.createDataFrame([("[]",)], "value string").write.text(f"{tmp_path}/in")
    news_stream(spark, f"{tmp_path}/in", f"{tmp_path}/c", f"{tmp_path}/state", "r", dim=4, trigger={"availableNow": True}).awaitTermination()
    assert seen == [str(news.ARROW_ROWS)] and spark.conf.get(key) == before
