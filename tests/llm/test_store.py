"""Work tables go when a result is written; few rows are told from many."""

import os
import uuid

import pyarrow as pa
import pytest

from quern.llm import memory, store


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(store, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    return tmp_path


def test_finished_leaves_the_result_alone(spark, shared):
    def make():
        rows = store.written(spark.range(5), "numbers")
        assert len(os.listdir(shared)) == 1
        return store.written(rows.where("id > 1"), "some").where("id > 2")

    out = store.finished(spark, "work", make)
    assert sorted(r.id for r in out.collect()) == [3, 4] and len(os.listdir(shared)) == 1
    store.drop_folder(out)
    assert os.listdir(shared) == []


def test_failed_work_leaves_nothing(spark, shared):
    def make():
        store.written(spark.range(5), "numbers")
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.finished(spark, "work", make)
    assert os.listdir(shared) == []
    assert store.written(spark.range(2), "after").count() == 2  # no longer inside the deleted folder


def test_few_rows_are_sent_to_all(spark):
    rows = spark.range(10)
    assert "broadcast" in store.if_small(rows, 10)._jdf.queryExecution().logical().toString().lower()
    assert store.if_small(rows, 9) is rows


def test_batches_pass_unchanged(monkeypatch):
    given = [pa.RecordBatch.from_pydict({"t": ["x" * n]}) for n in (10, 100)]
    monkeypatch.setattr(memory, "LARGE", 50)
    seen = []
    monkeypatch.setattr(memory, "release", lambda: seen.append(1))
    assert [b.num_rows for b in memory.lean(lambda batches: batches)(iter(given))] == [1, 1]
    assert len(seen) == 2
