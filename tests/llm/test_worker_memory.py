"""What a Python worker holds beside the executor's heap is bounded by slices, not by the batches that it gets."""

import tracemalloc

import pyarrow as pa
from shelfmark.llm import common, substring_dedup


def _peak(run, batch):
    """MB of Python's and numpy's memory at most, and the rows that come out."""
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_chunks_of_a_batch_are_not_all_python_objects():
    # One segment in each row: 40 chunks that follow each other here and in their owner.
    chunk = lambda k: {"place": k * 100 << 16, "length": 100, "most": (127 << 23) | (20 << 15) | (127 << 8) | 255, "digest": k, "owner": 1, "owner_place": (k * 100 + 7) << 16}
    kind = pa.list_(pa.struct([("place", pa.int64()), ("length", pa.int32()), ("most", pa.int32()), ("digest", pa.int64()), ("owner", pa.int64()), ("owner_place", pa.int64())]))
    n = 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(2, n + 2)), pa.array(range(n)), pa.array([[chunk(k) for k in range(40)]] * n, kind)], ["doc", "row_key", "chunks"])
    peak, rows = _peak(substring_dedup._runs(20), batch)
    assert rows == n
    assert peak < 8


def test_chunks_are_cut_in_small_slices():
    texts = [f"{k} " + " ".join(str((k * 7919 + j * 104729) % 9973) for j in range(400)) for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], ["doc", "row_key", "text"])
    peak, rows = _peak(substring_dedup._chunks, batch)
    assert rows > 1000
    assert peak < 60


def test_worker_gives_back_what_it_freed_when_a_task_ends(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1))
    run = common.lean(lambda batches: (b for b in batches))
    out = run(iter([1, 2]))
    assert next(out) == 1 and not told
    assert list(out) == [2] and told == [1]
    next(out := run(iter([1, 2])))
    out.close()  # a task that ends early
    assert told == [1, 1]
    monkeypatch.undo()
    common.give_back()
