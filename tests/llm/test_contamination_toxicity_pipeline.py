import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import decontaminate, near_dedup, toxicity
from logloom.llm import queries as q


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else set()


def contained(docs, items):
    out = set()
    for i, t in docs:
        for j, item in items:
            k = min(5, len((item or "").split()))
            s = shingles(item, k) if k else set()
            if s and len(s & shingles(t, k)) / len(s) >= 0.8:
                out.add((i, j))
    return out


def test_containment_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(3000)}"
    items = [(j, " ".join(word() for _ in range(n))) for j, n in enumerate([1, 3, 5, 6, 14, 20, 40, 60, 200])] + [(90, None), (91, ""), (92, " ")]
    docs = [(100, None), (101, ""), (102, "w1"), (103, " ".join(word() for _ in range(20_000)))]
    for d in range(40):
        t = [word() for _ in range(r.randint(0, 3000))]
        item = r.choice(items[:9])[1].split()
        for _ in range(r.randint(0, max(1, len(item) // 25))):
            item[r.randrange(len(item))] = "changed"
        at = r.randint(0, len(t))
        docs.append((d, " ".join(t[:at] + [w.upper() for w in item] + t[at:])))
    docs += docs[:3] + docs[4:6]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = contained(docs, items)
    got = decontaminate.find_contamination(d, b)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and got.count() == len(want) and len(want) > 20
    bad = {i for i, _ in want}
    assert sorted(x.doc_id for x in decontaminate.drop_contaminated(d, b).collect()) == sorted(i for i, _ in docs if i not in bad)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_contamination(d, b).collect()} == want
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0 == decontaminate.find_contamination(d, b.limit(0)).count()


def test_gradients():
    net = toxicity.Network({b"a": 1, b"b": 2})
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    r = np.random.default_rng(0)
    table = r.standard_normal((5, 6 * toxicity.HIDDEN))
    ids, mask, y = r.integers(0, 5, (3, 7)), np.ones((3, 7)), np.array([1.0, 0.0, 1.0])
    mask[1, 4:] = 0

    def loss(t):
        x = net.logits(t, ids, mask)
        return np.mean(np.log1p(np.exp(-np.where(y > 0, x, -x))))

    grad, dt = net.gradients(table, ids, mask, y)
    for name in ("uf", "ub", "att", "out", "bias"):
        flat = net.p[name].ravel()
        for i in r.integers(0, flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss(table)
            flat[i] = old - 1e-3
            down = loss(table)
            flat[i] = old
            assert abs((up - down) / 2e-3 - grad[name].ravel()[i]) < 2e-3, name
    for i, j in zip(r.integers(0, 5, 6), r.integers(0, table.shape[1], 6), strict=True):
        t = table.copy()
        t[i, j] += 1e-3
        up = loss(t)
        t[i, j] -= 2e-3
        assert abs((up - loss(t)) / 2e-3 - dt[i, j]) < 2e-3


def test_learns_and_scores_every_window(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "mi", "tu"]) for _ in range(3))
    texts, labels = [], []
    for i in range(700):
        t = [word() for _ in range(r.randint(5, 120))]
        if i % 5 == 0:
            for _ in range(3):
                t.insert(r.randint(0, len(t)), r.choice(["zgrub", "zgrax", "zgrol"]))
        texts.append(" ".join(t))
        labels.append(int(i % 5 == 0))
    net = toxicity.train(texts[:500], labels[:500])
    late = " ".join([word() for _ in range(3000)] + ["zgrub", "zgrol", "zgrax"])
    docs = [(i, t, 0.5) for i, t in enumerate(texts[500:])] + [(900, None, 0.1), (901, "", 0.1), (902, late, 0.1), (902, late, 0.1)]
    got = [(x.doc_id, x.score) for x in toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string, score double"), net).collect()]
    score = dict(got)
    right = sum((score[i] >= 0.5) == bool(y) for i, y in enumerate(labels[500:]))
    assert len(got) == len(docs) and right >= 190 and score[902] > 0.5 and 0 <= score[900] == score[901] < 0.5


def test_fit_reads_one_text_for_each_chosen_label(spark, monkeypatch):
    ids = [i for i, in spark.range(100).where(toxicity.fold(F.col("id")) != 0).collect()][:6]
    docs = [(ids[0], f"copy {n:02}") for n in range(40)][::-1] + [(i, f"text {i}") for i in ids[1:5]] + [(ids[5], None)]
    labels = [(i, int(i % 2)) for i in ids] + [(ids[1], int(ids[1] % 2))]
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: (texts, labels))
    texts, y = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), sample=7)
    want = sorted([(ids[0], "copy 00"), (ids[1], f"text {ids[1]}"), *((i, f"text {i}") for i in ids[1:5]), (ids[5], "")])
    assert list(zip(texts, y, strict=True)) == [(t, i % 2) for i, t in want]


def test_rows_that_share_an_id_go_only_as_near_duplicates(spark, sf):
    r = random.Random(7)
    a, b, c = (" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (1, b + " end"), (2, c), (3, c), (2, a + " end"), (4, None), (4, ""), (None, c)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    kept = sorted((x.doc_id or 0, x.text or "") for x in got)
    assert [i for i, _ in kept] == [0, 1, 1, 2, 4]
    assert {t.removesuffix(" end") for i, t in kept if i == 1} == {a, b} and (2, c) in kept and (0, c) in kept


def test_pipeline_by_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "repeats", "decontamination", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = {x.doc_id: x.text for x in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        after = {x.doc_id: x.text for x in kept.collect()}
        assert set(after) <= set(before) and kept.columns == docs.columns
        if name == "near_dedup":
            comp = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(before.items()), "doc_id long, text string"), threshold=0.8, k=5).collect()}
            assert set(after) == set(comp.values())
        if name == "repeats":
            seen, length = set(), corpus_pipeline.PASSAGE_BYTES
            for i in sorted(before):
                body = before[i].encode()
                grams = [body[j : j + length] for j in range(len(body) - length + 1)]
                gone = bytearray(len(body))
                for j, g in enumerate(grams):
                    if g in seen:
                        gone[j : j + length] = b"\x01" * length
                    seen.add(g)
                n = len(body) - sum(gone)
                assert n <= len(after[i].encode()) <= n + 6 * (1 + sum(gone[j] != gone[j - 1] for j in range(1, len(gone))))
        if name == "decontamination":
            items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {i for i, _ in contained(before.items(), items)}
    out = corpus_pipeline.STAGES[4][1](spark, kept, sf).collect()
    import hashlib

    assert {x.doc_id: x.decoded_sha256 for x in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()}
    assert all(x.n_tokens == len(x.ids) for x in out)


def test_all_queries_are_registered():
    import __spark_entry__

    have = __spark_entry__.queries()
    assert "pipeline" in have and sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 11))


def test_stages_keep_clashing_columns_nulls_and_empty_tables(spark, sf):
    schema = "doc_id long, text string, n_chars long, score double, kept string, n_removed string, _node int, _text string"
    long = " ".join(map(str, range(2000)))
    rows = [(1, long, 1, 9.0, "k", "r", 3, "t"), (1, long, 1, 9.0, "k", "r", 3, "t"), (2, None, None, None, None, None, None, None), (None, "", 0, 9.0, "k", "r", 3, "t"), (5, long + " end", 1, 8.0, "q", "s", 4, "u")]
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = spark.createDataFrame(rows, schema)
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        got = {(r.doc_id, r.score, r.kept, r.n_removed, r._node, r._text) for r in out.collect()}
        want = {(r[0], *r[3:]) for r in rows}
        assert got == (want - {(5, 8.0, "q", "s", 4, "u")} if name == "near_dedup" else want)
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    net = toxicity.train([], [])
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert all(r.score < 1e-6 for r in toxicity.score_toxicity(docs, net).collect())
