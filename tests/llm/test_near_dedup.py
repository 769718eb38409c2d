import numpy as np
import pytest

from strandloom.llm import near_dedup as N
from strandloom.llm.components import connected_components
from strandloom.llm.textops import chunks, shingle_sets

from .helpers import clashing, corpus, empty, table, words


def brute(rows, percent):
    sets = {}
    for r in rows:
        w = words(r[1], fold=True)
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_components_against_all_pairs(spark, percent):
    rows = corpus()
    got = N.near_duplicate_components(clashing(table(spark, rows)), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, percent)
    assert len(got) == len(rows)


def test_chain_of_links_that_no_star_holds(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(8):  # each next text drops ten words at the end: far ones are not alike
        rows.append((100 - i, " ".join(base[: 200 - 8 * i]), None, None, None))
    got = {r.doc_id: r.component_id for r in N.near_duplicate_components(table(spark, rows)).collect()}
    assert got == {k: v[1] for k, v in brute(rows, 80).items()} and len(set(got.values())) == 1


def test_large_group_of_copies(spark):
    rows = [(i, "a b c d e f g " + ("h" if i % 2 else "i"), None, None, None) for i in range(400)]
    got = N.near_duplicate_components(table(spark, rows)).collect()
    assert {r.component_id for r in got} == {0, 1} and sum(r.kept for r in got) == 2


def test_null_ids_repeats_and_empty(spark):
    assert N.near_duplicate_components(empty(spark)).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (2, None, None, None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicate_components(table(spark, rows)).collect())
    assert got == [(0, 2, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**63, 600, dtype=np.uint64)])
    sig = N.circulant_signature(np.concatenate([a, b]), np.array([0, len(a)]), 400)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 2400 / 3600) < 0.1


def test_shingles_of_odd_texts():
    import pyarrow as pa

    col = pa.array(["", "one", " A\tb c\nD e", "a b c d e", "é   x", None])
    (_, _, data, offs), = chunks(col)
    sets = shingle_sets(data, offs)
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 0] and sets[2].tolist() == sets[3].tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40, 2)] + [(i + 1, i + 2) for i in range(0, 20, 2)] + [(7, 7), (None, 3), (5, 4)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 21)) and got[23] == 22 and 22 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
