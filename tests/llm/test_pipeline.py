import math
from collections import Counter

import corpus_pipeline
from ebbtide.llm import queries

from .conftest import FOLDER


def test_stages(spark, documents, odd, nothing):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER).cache()
        assert after.columns == corpus_pipeline.COLUMNS
        before_ids, ids = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, after))
        assert ids <= before_ids
        if name == "language ID":
            assert len(ids) >= 0.99 * len(before_ids)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    pieces = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert pieces == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    tokens, sequences = sum(r["length"] for r in packed), len({r["sequence_id"] for r in packed})
    assert sequences <= math.ceil(tokens / 4096) * 1.05 + 1


def test_stages_take_odd_and_empty_tables(spark, odd, nothing):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, FOLDER).collect()
        assert stage(spark, nothing, FOLDER).count() == 0


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
