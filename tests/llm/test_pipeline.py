import re

import corpus_pipeline
from lumenflow.llm import mixing
from lumenflow.llm.common import scratch_tables
from tests.llm.test_near_dedup import classes


def test_stages_take_effect_in_order(spark, docs, texts):
    """Each stage against a plain version of it, on its own input."""
    columns, at = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in at.collect()] if name != "packing" else at.count()
        at = spark.createDataFrame(stage(spark, at, "/root/testdata/sf0.01").toArrow())
        after = [r.asDict() for r in at.collect()]
        seen.append(name)
        if name != "packing":
            assert at.columns == columns
        if name == "language ID":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) >= 0.99 * len(before)
        elif name == "line dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] != texts[r["doc_id"]])
            assert all(re.search(r"\S", r["text"]) for r in after)
        elif name == "MinHash near-dedup":
            assert {r["doc_id"] for r in after} == set(classes({r["doc_id"]: r["text"] for r in before}).values())
        elif name == "mixing":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(spark.createDataFrame(before, docs.schema)).collect()}
            assert len(after) == sum(want.values())
        else:
            assert sum(r["start"] == 0 for r in after) == before
    assert seen == ["language ID", "line dedup", "MinHash near-dedup", "mixing", "packing"]


def test_awkward_documents_keep_their_own_columns(spark, awkward, nothing, tmp_path):
    """Columns named like what operators add are handed on with their values, to the last stage."""
    before = {}
    for r in awkward.collect():
        before.setdefault((r["doc_id"], r["text"]), set()).add(tuple(r.asDict().items()))
    at = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, str(tmp_path)).toArrow(), awkward.schema)
        assert at.columns == awkward.columns
        for r in at.collect():
            own = {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")}
            assert any(own.items() <= dict(x).items() for (i, _), rows in before.items() if i == r["doc_id"] for x in rows), name
        assert at.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in packed) == at.count()
    for k, df in enumerate((awkward, nothing)):
        df.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / str(k))).collect()
        assert sum(r["start"] == 0 for r in got) == (at.count() if k == 0 else 0)


def test_what_stages_leave_behind_is_deleted(spark):
    before = set(scratch_tables())
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert len(set(scratch_tables()) - before) == 1
