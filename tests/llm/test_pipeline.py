"""The corpus pipeline, stage by stage, and its end."""

from __future__ import annotations

import itertools
from collections import Counter

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    sizes = [held.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        before = Counter(r.doc_id for r in held.collect())
        assert not Counter(r.doc_id for r in rows) - before, name
        held = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    texts = [r.text for r in held.collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    assert len(packed) == len(texts)


def test_run_ends_in_batches(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    for _, batch in itertools.groupby(sorted(rows, key=lambda r: r.batch), lambda r: r.batch):
        assert len({r.bucket for r in batch}) == 1


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard join", "secret scans", "packing"]
