import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import log, state
from logloom.schema import checked_log


def df(spark, rows):
    return spark.createDataFrame([(i + 1, op, k, bytearray(v.encode()) if v is not None else None) for i, (op, k, v) in enumerate(rows)], "seq long, op string, key string, value binary")


def put(k, v):
    return "PUT", k, v


def delete(k):
    return "DELETE", k, None


def live(d):
    return {r.key: bytes(r.value).decode() for r in state.live_state(d).collect()}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([put("a", "1"), put("b", "2"), put("c", "3"), delete("b")], {"a": "1", "c": "3"}),
        ([put("a", "1"), put("a", "2"), delete("a"), put("a", "3")], {"a": "3"}),
        ([put("a", "1"), delete("a")], {}),
        ([put("", "x")], {"": "x"}),
        ([put("k", "")], {"k": ""}),
        ([delete("never")], {}),
        ([], {}),
    ],
)
def test_newest_write_wins(spark, rows, want):
    d = df(spark, rows)
    assert live(d) == want
    assert {r.key for r in state.live_keys(d).collect()} == set(want)


def test_arrival_order_does_not_matter(spark):
    r = random.Random(3)
    rows = [(i + 1, *(put(f"k{r.randint(0, 9)}", str(i)) if r.random() < 0.7 else delete(f"k{r.randint(0, 9)}"))) for i in range(300)]
    model = {}
    for _, op, k, v in rows:
        model[k] = v if op == "PUT" else None
    for _ in range(2):
        r.shuffle(rows)
        d = spark.createDataFrame([(s, o, k, bytearray(v.encode()) if v is not None else None) for s, o, k, v in rows], "seq long, op string, key string, value binary")
        assert live(d) == {k: v for k, v in model.items() if v is not None}
        assert {r.key for r in state.deleted_keys(d).collect()} == {k for k, v in model.items() if v is None}


def test_previous_values_outcomes_and_history(spark):
    d = df(spark, [put("a", "1"), put("a", "2"), delete("a"), delete("a"), put("a", "3")])
    assert [r.previous and bytes(r.previous).decode() for r in state.previous_value(d).orderBy("seq").collect()] == [None, "1", "2", None, None]
    assert [r.outcome for r in state.outcomes(d).orderBy("seq").collect()] == ["OK", "OK (previous value replaced)", "OK (removed)", "OK (not found)", "OK"]
    assert [r.valid_to for r in state.history(d).orderBy("seq").collect()] == [2, 3, 4, 5, None]


def test_lookups_tell_absent_from_empty(spark):
    d = df(spark, [put("a", ""), put("b", "x"), delete("b")])
    got = {r.key: r.value for r in state.multi_get(d, ["a", "b", "c"]).collect()}
    assert got == {"a": bytearray(), "b": None, "c": None}
    assert state.get(d, "b").count() == 0


def test_nulls_are_refused(spark):
    for row in [(1, "PUT", "k", None), (1, "PUT", None, bytearray(b"x"))]:
        d = spark.createDataFrame([row], "seq long, op string, key string, value binary")
        with pytest.raises(Exception, match="null key or value"):
            checked_log(d).collect()


def test_numbers_and_truncation(spark):
    d = df(spark, [put("a", "1"), put("b", "2"), put("c", "3")])
    assert log.next_sequence(d).first().next_seq == 4
    assert log.next_sequence(d, watermark=9).first().next_seq == 10
    assert log.next_sequence(d.limit(0)).first().next_seq == 1
    assert log.next_sequence(d, at_least=50).first().next_seq == 50
    assert [r.seq for r in log.truncate(d, 2).collect()] == [3]
    writes = spark.createDataFrame([(7, "PUT", "z", bytearray(b"1")), (8, "DELETE", "a", None)], "at long, op string, key string, value binary")
    assert sorted(r.seq for r in log.append(d, writes, 4, "at").collect()) == [1, 2, 3, 4, 5]


def test_valid_prefix(spark):
    rows = [("f", i, i + 1, i != 3) for i in range(6)] + [("g", 0, 5, True), ("g", 1, 4, True), ("g", 2, 9, True)] + [("h", 0, 1, False)]
    d = spark.createDataFrame(rows, "file string, ordinal long, seq long, intact boolean")
    got = {(r.file, r.ordinal) for r in log.valid_prefix(d, ["file"]).collect()}
    assert got == {("f", 0), ("f", 1), ("f", 2), ("g", 0)}
    assert log.valid_prefix(d.where(F.lit(False)), ["file"]).count() == 0
