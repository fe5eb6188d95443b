from collections import defaultdict

import numpy as np
import pytest

from logloom.llm import repeats
from logloom.llm.repeats import remove_repeats


def brute(rows, length, keep_first):
    """rows: (doc_id, bytes) in order -> per row the bytes that remain, removed count and spans."""
    where = defaultdict(list)
    for r, (_, body) in enumerate(rows):
        for i in range(len(body) - length + 1):
            where[body[i : i + length]].append((r, i))
    gone = [bytearray(len(b)) for _, b in rows]
    for at in where.values():
        for r, i in at[1:] if keep_first else at * (len(at) > 1):
            gone[r][i : i + length] = b"\x01" * length
    out = []
    for (_, body), g in zip(rows, gone, strict=True):
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((bytes(c for c, x in zip(body, g, strict=True) if not x), sum(g), spans))
    return out


def check(spark, rows, length, keep_first, hot=20_000):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in remove_repeats(df, length=length, keep_first=keep_first, aligned=False, hot=hot).collect()}
    want = brute([(i, (t or "").encode()) for i, t in rows], length, keep_first)
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}


@pytest.mark.parametrize("keep_first", [True, False])
def test_against_brute_force_on_documents(spark, sf, keep_first):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").orderBy("doc_id").collect()]
    check(spark, rows, 100, keep_first)


@pytest.mark.parametrize("hot", [1, 20_000])
@pytest.mark.parametrize("keep_first", [True, False])
def test_overlaps_periods_and_odd_rows(spark, keep_first, hot):
    a, b, c = "".join(chr(97 + i * i % 23) for i in range(90)), "ü" * 70, "-".join(map(str, range(60)))
    rows = [(0, a + c), (1, c + a), (2, b + a[:50] + b), (3, None), (4, ""), (5, "ab" * 100), (6, c[10:80] + a[20:] + "ab" * 40), (7, a + c), (8, "short"), (9, c[:70] + "!" + c[5:90])]
    check(spark, rows, 40, keep_first, hot)


@pytest.mark.parametrize("hot", [1, 20_000])
@pytest.mark.parametrize("keep_first", [True, False])
def test_every_shared_key_dealt_over_several_tasks(spark, monkeypatch, keep_first, hot):
    monkeypatch.setattr(repeats, "SHARE", 10**9)
    line = "".join(chr(97 + i * i % 23) for i in range(45)) + "|"
    rows = [(i, line * (i % 4 + 1) + str(i) * 30) for i in range(40)] + [(50, line * 60), (51, None)]
    check(spark, rows, 40, keep_first, hot)


def test_empty_table_and_whole_characters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty, length=40).count() == 0
    rows = [(0, "é" * 50), (1, "x" + "é" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in remove_repeats(df, length=39, aligned=True).collect():
        bytes(r.kept).decode()


def test_repeated_rows_and_null_ids(spark):
    t = "-".join(map(str, range(40)))
    df = spark.createDataFrame([(None, t), (1, t), (1, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(df, length=40).collect())
    assert got == [(-1, len(t)), (1, 0), (1, 0)]
    assert all(r.n_removed == len(t) for r in remove_repeats(df, length=40, keep_first=False).collect())


@pytest.mark.parametrize("length", [5, 16, 21])
def test_suffix_array_lcp_and_longest_previous_factors(length):
    r = np.random.default_rng(length)
    body = bytes(r.choice([97, 98], 60).astype(np.uint8)) + b"abcabcabcabcabcabcabcabcabc" * 3 + bytes(r.choice([0, 255], 40).astype(np.uint8))
    body += body[20:90]
    cut = [body[i : i + length] for i in range(len(body) - length + 1)]
    data, start, digest, _, place = repeats.windows([body], length)
    order, lcp = repeats.suffix_order(data, start, digest, length)
    assert order.tolist() == sorted(range(len(cut)), key=lambda i: (cut[i], i))

    def common(a, b):
        return next((i for i in range(length) if a[i] != b[i]), length)

    assert lcp.tolist() == [0] + [common(cut[a], cut[b]) for a, b in zip(order, order[1:])]
    lpf = [max((common(cut[i], cut[j]) for j in range(i)), default=0) for i in range(len(cut))]
    assert repeats.longest_previous(order, lcp, length).tolist() == [x == length for x in lpf]
    for keep_first in (True, False):
        want = [cut[i] in cut[:i] or not keep_first and cut.count(cut[i]) > 1 for i in range(len(cut))]
        assert repeats.repeated(data, start, digest, length, keep_first).tolist() == want


def test_one_very_long_text(spark):
    long = " ".join(map(str, range(200_000)))
    df = spark.createDataFrame([(1, long + "!" + long[5000:9000]), (2, long[700_000:700_900])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(df, length=400).collect()}
    assert got == {1: (4000, 1), 2: (900, 1)}
