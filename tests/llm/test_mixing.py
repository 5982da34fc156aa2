import math

from pyspark.sql import functions as F

from lumenflow.llm import mixing


def fill(sizes):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_taken(spark, docs, texts):
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].split()) and r["taken"] == r["size"] * r["copies"] and r["copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = fill(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert math.isclose(own[0]["target"], want[s], rel_tol=1e-9) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) < 0.15 * want[s]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert dict(mixed.groupBy("doc_id").count().collect()) == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    assert sorted(map(tuple, mixing.mix_plan(docs).collect())) == sorted(map(tuple, rows))


def test_awkward_rows(awkward, nothing):
    rows = mixing.mix_plan(awkward).collect()
    assert len(rows) == awkward.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    none = awkward.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix_plan(none).agg(F.sum("taken")).first()[0] == 0
