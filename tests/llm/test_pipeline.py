"""The pipeline's stages, one after the other, on the smallest tables."""

import os
import uuid
from collections import Counter

import corpus_pipeline
from quern.llm import secrets, store
from tests.llm.cases import ODD, clashing
from tests.llm.test_near_dedup import brute
from tests.llm.test_scans import base_spans, contained
from tests.llm.test_tokens import check_pieces


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    (_, quality), (_, near), (_, bench), (_, secret), (_, pack) = corpus_pipeline.STAGES
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}

    good = quality(spark, docs, sf).cache()
    assert good.columns == docs.columns
    gone = {i for i, _ in rows(docs)} - {i for i, _ in rows(good)}
    assert sum(labels.get(i) == 1 for i in gone) <= 2

    one = near(spark, good, sf).cache()
    before = rows(good)
    assert sorted(i for i, _ in rows(one)) == sorted(i for i, _, c in brute(before, 5) if i == c)

    clean = bench(spark, one, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in contained(rows(one), items)}
    assert {i for i, _ in rows(clean)} == {i for i, _ in rows(one)} - bad

    safe = secret(spark, clean, sf).cache()
    words = secrets.automaton()
    assert dict(rows(safe)) == {i: secrets.redacted(t, secrets.spans(t, words)) for i, t in rows(clean)}
    assert not any(base_spans(t) for _, t in rows(safe))

    check_pieces(pack(spark, safe, sf).collect(), rows(safe))


def test_run_leaves_its_result_alone(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(corpus_pipeline.BATCHES)
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(os.listdir(tmp_path)) == 1 and spark.conf.get(corpus_pipeline.BATCHES) == before


def test_empty_labels_reject_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark, [(1, "one two"), (2, None), (None, "three")])
    assert corpus_pipeline.good_quality(spark, docs, str(tmp_path)).count() == 3


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeats, clashing names and empty tables: each stage keeps columns and what is clean."""
    for rows in (ODD, []):
        docs = clashing(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "packing":
                check_pieces(out.collect(), rows)
                continue
            assert out.columns == docs.columns
            ids = Counter(r[0] for r in out.collect())
            if name == "near duplicates":
                assert set(ids) == {i for i, _ in rows} - {5, 9}
            elif name == "secret scan":
                assert ids == Counter(i for i, _ in rows)
            else:
                assert not ids - Counter(i for i, _ in rows)
