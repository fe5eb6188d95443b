import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import near_dedup as nd
from logloom.llm.components import components


def brute(rows, threshold, k):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= round(100 * threshold) * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, threshold, k, **more):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, cls string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(d, threshold=threshold, k=k, **more).collect()}
    assert got == brute(rows, threshold, k)


def test_documents_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows, 0.85, 3)


@pytest.mark.parametrize(("block", "large", "rounds"), [(8, 16, 6), (8, 4, 0), (512, 2048, 6)])
def test_a_dense_group_and_odd_rows(spark, monkeypatch, block, large, rounds):
    monkeypatch.setattr(nd, "BLOCK", block)
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "A b"), (4, "a  B"), (5, "a b c"), (6, "one"), (7, "One")]
    for i in range(10, 70):
        t = list(base)
        for _ in range(r.randint(0, 8)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    check(spark, rows, 0.8, 3, large=large, max_rounds=rounds)


@pytest.mark.parametrize("large", [4, 2048])
def test_copies_that_all_miss_the_threshold_or_just_reach_it(spark, monkeypatch, large):
    monkeypatch.setattr(nd, "BLOCK", 16)
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        t = list(base)
        for j in r.sample(range(200), 5):
            t[j] = f"x{r.randrange(40)}"  # few words to choose from, so edits are shared
        rows.append((i, " ".join(t)))
    check(spark, rows, 0.85, 3, large=large, max_rounds=0)
    hashes = [np.sort(np.array(r.sample(range(60), r.randint(1, 40)), np.uint64)) for _ in range(60)]
    for x in hashes:
        for y in hashes:
            n = len(set(x.tolist()) & set(y.tolist()))
            assert nd.reaches(x, y, 30) == (n > 0 and 100 * n >= 30 * (len(x) + len(y) - n))


def test_differences_tell_links():
    """Differences from a reference: the sum rule and the prefix filter against all pairs."""
    import pyarrow as pa

    r = random.Random(3)
    p = set(range(100))
    sets = [np.array(sorted((p - set(r.sample(range(100), r.randint(0, 12)))) | set(r.sample(range(100, 160), r.randint(0, 12)))), np.uint64) for _ in range(80)]
    ref = np.array(sorted(p), np.uint64).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 80), pa.array(range(80)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([ref] * 80, pa.binary())], ["bucket", "node", "set", "ref"])
    (out,) = nd._differences(85)(iter([batch]))
    g, diff = out.column("g").to_pylist(), [set(d) for d in out.column("diff").to_pylist()]
    for a in range(80):
        for b in range(a):
            assert nd.reaches(sets[a], sets[b], 85) == (2 * 185 * len(diff[a] & diff[b]) >= g[a] + g[b])


def test_repeated_rows_null_ids_and_empty_table(spark):
    d = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in nd.near_duplicates(d).collect()]
    assert sorted(got, key=str) == sorted([(4, 2), (4, 2), (None, 2), (2, 2)], key=str)
    assert nd.near_duplicates(d.limit(0)).count() == 0


def test_bands_and_bounds():
    assert (1 - 0.85**nd.BAND_ROWS) ** nd.n_bands(0.85) <= nd.MISS
    need = nd._enough(0.8, nd.PRUNE)
    assert list(need) == sorted(need) and need[-1] < 0.8 * nd.VERIFY


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_components(spark, edges):
    d = spark.createDataFrame(edges, "u long, v long")
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in components(d).collect()} == want
