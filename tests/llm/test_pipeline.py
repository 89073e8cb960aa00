"""The stages against brute force, and the whole on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
from tidemark.llm import common, language, linerules, pii
from tidemark.llm.queries import fold
from tests_llm_brute import components  # noqa: I001


def test_stages(spark, docs, rows):
    out, sf = docs, "unused"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language identification", "quality rules", "near duplicates", "pseudonyms", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r.text for r in out.collect()}
        if name == "language identification":
            rejected = {r.doc_id for r in language.identify(out, language.fit(out.where(fold(3) != 1))).collect() if r.rejected}
            want = set(before) - rejected
        elif name == "quality rules":
            want = {r.doc_id for r in linerules.judge(out).collect() if r.kept}
        elif name == "near duplicates":
            want = {d for d, c in components(before).items() if d == c}
        else:
            want = set(before)
        out = stage(spark, out, sf)
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) == want, name
        p = pii.Pseudonyms(pii.DEVELOPMENT_KEY)
        assert after == {d: p.replace(before[d])[0] if name == "pseudonyms" else before[d] for d in want}
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_stages_on_an_empty_table(spark, none):
    out = none
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "unused")
        assert out.isEmpty()


def test_stages_send_whole_texts_in_small_batches(spark, none):
    assert all(stage.__wrapped__ for _, stage in corpus_pipeline.STAGES)
    for own, want in (("10000", common.TEXT_ROWS), ("0", common.TEXT_ROWS), ("700", 700)):
        spark.conf.set(common.ARROW_ROWS, own)
        corpus_pipeline.STAGES[-1][1](spark, none, "unused")
        sizes = spark.range(0, 4100, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) == want
    spark.conf.unset(common.ARROW_ROWS)
