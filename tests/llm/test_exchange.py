"""Coding of keys and facts, and blocks that ask buckets."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laglake.llm import exchange as X


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=50), st.sampled_from([0, 12, 28]))
def test_keys_come_back(values, drop):
    keys = np.unique(np.array(values, np.uint64) >> np.uint64(drop)) << np.uint64(drop)
    assert (X.received(X.sent(keys, drop)) << np.uint64(drop)).tolist() == keys.tolist()


@pytest.mark.parametrize("kind", ["u1", "<u4", "<u8", [("a", "<u4"), ("b", "u1")]])
def test_facts_come_back(kind):
    for n in (0, 1, 7):
        raw = np.random.default_rng(n).integers(0, 256, n * np.dtype(kind).itemsize).astype(np.uint8)
        facts = raw.view(np.dtype(kind))
        assert X.values_of(X.planes(facts), kind).tolist() == facts.tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=40), st.integers(1, 9))
def test_slices_cover_the_keys_in_order(values, buckets):
    keys = np.unique(np.array(values, np.uint64))
    parts = X.slices(keys, buckets)
    assert len(parts) == buckets and np.concatenate([keys[s] for s in parts]).tolist() == keys.tolist()
    for i, s in enumerate(parts):
        assert all(int(k) * buckets >> 64 == i or int(k) in {(j << 64) // buckets for j in range(buckets)} for k in keys[s])


def test_answers_reach_the_block_that_asked(spark):
    rng = np.random.default_rng(3)
    own = {b: np.unique(rng.integers(0, 50, 30).astype(np.uint64) << np.uint64(56)) for b in range(6)}
    rows = [r for b, k in own.items() for r in X.asks(b, 0, k, np.ones(len(k), "<u4"), 4)]
    ask = spark.createDataFrame(rows, X.ASK)
    count = lambda which, facts, blocks: np.bincount(which, weights=facts).astype("<u4")[which]
    got = X.answered(ask, count, "<u4").toArrow()
    every = np.concatenate(list(own.values()))
    for b, k in own.items():
        mine = got.filter([x == b for x in got["block"].to_pylist()])
        assert X.replies(mine, "<u4")[0].tolist() == [int((every == x).sum()) for x in k]
