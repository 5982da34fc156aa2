"""Flows: both dialects, order, errors, fused chains; streams; sources."""

import numpy as np
import pytest

from lumenflow.plans import flow
from lumenflow.spec import FlowError, load
from tests.test_operators import frames, square

load()


def spec_of(*nodes, connections=()):
    return {"id": "f", "nodes": list(nodes), "connections": list(connections)}


def node(i, t, inputs=None, **params):
    return {"id": i, "type_id": t, "params": params, "inputs": {p: {"source_node": s, "source_port": "image"} for p, s in (inputs or {}).items()}}


def test_order_is_deterministic_and_cycles_are_errors():
    f = flow.parse(spec_of(node("c", "ImageNot", {"image": "a"}), node("b", "ImageNot", {"image": "a"}), node("a", "ImageNot"), node("d", "ImageAdd", {"image_a": "b", "image_b": "c"})))
    assert f.order() == ["a", "b", "c", "d"]
    with pytest.raises(FlowError, match="cyclic"):
        flow.parse(spec_of(node("a", "ImageNot", {"image": "b"}), node("b", "ImageNot", {"image": "a"}))).order()
    with pytest.raises(FlowError, match="unknown operator"):
        flow.parse(spec_of({"id": "a", "type_id": "Blur"}))


def test_chain_is_one_pass(spark):
    f = flow.parse({"nodes": [{"id": "a", "type": "SimpleThreshold"}, {"id": "b", "type": "ImageNot"}, {"id": "c", "type": "ImageNot"}], "connections": [{"fromNode": "a", "fromPort": 0, "toNode": "b", "toPort": 0}, {"fromNode": "b", "toNode": "c", "toPort": "image"}, {"fromNode": "gone", "toNode": "c", "toPort": 0}]})
    out = flow.run(f, {"image": frames(spark, square())})
    plan = out["c"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert (np.frombuffer(out["c"].first()["data"], np.uint8).reshape(300, 300) == np.where(square() > 128, 255, 0)).all()


def test_shared_and_disabled_nodes(spark):
    nodes = [node("a", "ImageNot"), node("b", "ImageAdd", {"image_a": "a", "image_b": "a"}), node("x", "ImageNot", {"image": "a"}) | {"enabled": False}, node("y", "ImageNot", {"image": "x"})]
    out = flow.run(flow.parse(spec_of(*nodes)), {"image": frames(spark, square())})
    assert set(out) == {"a", "b"}
    assert set(np.frombuffer(out["b"].first()["data"], np.uint8)) == {55, 205}


def test_missing_input(spark):
    with pytest.raises(FlowError, match="required"):
        flow.run(flow.parse(spec_of(node("a", "ImageNot"))))


def test_stream_equals_batch(spark, tmp_path):
    from lumenflow.streaming.sync import sync_windows

    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id / 10) as ts, id % 3 as camera_id from range(100)").write.parquet(str(tmp_path / "in"))
    batch = sync_windows(spark.read.parquet(str(tmp_path / "in"))).orderBy("start").collect()
    stream = sync_windows(spark.readStream.schema("ts timestamp, camera_id long").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("synced").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("synced").orderBy("start").collect() == batch and len(batch) == 10


def test_point_cloud_file(spark, tmp_path):
    from lumenflow.sources.readers import point_cloud

    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nend_header\n1 2 3\n-1.5 0 2e1 9\n")
    assert [tuple(r)[2:] for r in point_cloud(spark, str(tmp_path / "a.ply")).orderBy("point_id").collect()] == [(1, 2, 3), (-1.5, 0, 20)]
