"""The pipeline: each stage against what its operator says, and the whole from end to end."""

import corpus_pipeline
from bookloom.llm import decontamination, near_dedup, quality
from bookloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, labels, items = docs.columns, table(spark, SF, "labels"), table(spark, SF, "benchmark")
    judge = quality.Judge(docs, labels)
    kept = {r.key for r in judge.judged(judge.rows).where("keep").collect()}
    first = corpus_pipeline.keep_quality(spark, docs, SF)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == kept
    second = corpus_pipeline.drop_near_duplicates(spark, first, SF)
    own = {r.doc_id for r in near_dedup.near_duplicates(first, 5, 0.8).where("kept").collect()}
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(own)
    third = corpus_pipeline.drop_contaminated(spark, second, SF)
    clean = {r.doc_id for r in decontamination.contaminated(second, items).where("NOT n_hit > 0").collect()}
    assert third.columns == columns and {r.doc_id for r in third.collect()} == clean
    fourth = corpus_pipeline.mix_sources(spark, third, SF)
    assert fourth.columns == columns and {r.doc_id for r in fourth.collect()} <= clean


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_output"]


def test_odd_rows_pass_all_stages(spark, edges, frame):
    docs = edges
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
        assert docs.columns == edges.columns
    keys = [r.doc_id for r in docs.collect()]
    assert not {1, 2, 3} & set(keys) and {4, None} <= set(keys) and not {5, 6} & set(keys)
    assert len([k for k in keys if k is not None]) == len({k for k in keys if k is not None})
    for _, stage in corpus_pipeline.STAGES[2:]:
        docs = stage(spark, docs, SF)
    ends = [(r.start, r.start + r.n_tokens) for r in docs.orderBy("start").collect()]
    assert ends and ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    empty = frame([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
