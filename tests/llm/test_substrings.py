import hashlib
import random

import pytest

from strandloom.llm import substrings as S

from .helpers import clashing, corpus, empty, table, words


def brute(rows):
    first = {}
    split = [(r[0], words(r[1])) for r in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in S.removal_digests(df).collect()), key=str)


@pytest.mark.parametrize("rows_in_memory", [20_000, 3])
def test_against_all_windows(spark, monkeypatch, rows_in_memory):
    """Also with partitions so small that most prefixes are split to whole windows."""
    monkeypatch.setattr(S, "PARTITION_ROWS", rows_in_memory)
    rows = [r for r in corpus(1) if r[1] is None or len(r[1]) < 100_000]
    assert got(clashing(table(spark, rows))) == brute(rows)


def test_long_text_and_repeats_within(spark):
    rng = random.Random(5)
    w = [f"w{rng.randrange(900)}" for _ in range(30_000)]
    rows = [(5, " ".join(w), None, None, None), (6, " ".join(w[:200] * 3), None, None, None), (4, " ".join(w[1000:1060]), None, None, None), (7, "z " * 500, None, None, None), (8, "z " * 400, None, None, None)]
    assert got(table(spark, rows)) == brute(rows)


def test_batches_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(S, "SORT_ROWS", 5)
    rows = [r for r in corpus(2) if r[1] is None or len(r[1]) < 100_000]
    assert got(table(spark, rows)) == brute(rows)


def test_empty_null_and_equal_ids(spark):
    assert S.remove_repeats(empty(spark)).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, None, None, None), (3, text, None, None, None), (3, text, None, None, None), (9, text, None, None, None), (10, None, None, None, None)]
    removed = sorted((r.doc_id or 0, r.n_removed) for r in S.remove_repeats(table(spark, rows)).collect())
    assert removed == [(0, 0), (3, 0), (3, 0), (9, 80), (10, 0)]


def test_anchors_are_shared():
    import numpy as np

    g = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    at = set(S.anchor_positions(g).tolist())
    for i in range(len(g) - S.LEFT):
        win = g[i : i + S.LEFT + 1]
        assert i + int(np.argmin(win)) in at
    assert len(at) < len(g) / 8
