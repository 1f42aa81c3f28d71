import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from retailloom.llm import common, lz_dedup, suffix_dedup, windows


def once(rows):
    return sorted({r for r in rows if r[0] is not None})


@pytest.mark.parametrize("crowd", [windows.CROWD, 1], ids=["together", "dealt singly"])
@pytest.mark.parametrize("operator", [suffix_dedup, lz_dedup])
def test_like_brute_force(corpus, awkward, operator, crowd, monkeypatch):
    monkeypatch.setattr(windows, "CROWD", crowd)
    got = operator.digest(corpus(awkward)).collect()
    assert len(got) == len([r for r in awkward if r[0] is not None])
    assert sorted({tuple(r) for r in got}) == operator.brute_force(once(awkward))


@pytest.mark.parametrize("operator", [suffix_dedup, lz_dedup])
def test_empty_table(corpus, operator):
    assert operator.digest(corpus([])).count() == 0


def test_suffix_array_orders_every_suffix():
    for seed in range(60):
        rng = random.Random(seed)
        parts = [bytes(rng.choices(b"ab\x00", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        raw = b"\xff".join(parts) + b"\xff"
        order = suffix_dedup.suffix_array(np.frombuffer(raw, np.uint8), 8)
        assert sorted(order) == list(range(len(raw)))
        heads = [raw[i : raw.index(b"\xff", i) + 1][:8] for i in order if raw[i] != 255]
        assert heads == sorted(heads)


def test_a_task_holds_few_arrays_at_a_time():
    """Two workers and the JVM share an executor's memory."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 4000, np.uint8).tobytes().decode() for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    common.powers(1)  # kept by every worker
    tracemalloc.start()
    try:
        found = 0
        for _, data, bounds in common.blocks(iter([batch])):
            values, limits, _ = suffix_dedup._bytes_of(data, bounds)
            found += len(windows.segments(values, limits, suffix_dedup.SPAN, suffix_dedup.GRAM)[0])
        assert found
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
