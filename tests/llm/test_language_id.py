import zlib

import numpy as np

from lumenflow.llm import language_id as L
from lumenflow.llm.queries import op1_language_id


def test_held_out_accuracy(spark, docs):
    got = op1_language_id(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(lang) and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.held_out.items())
    held = got[got.held_out]
    assert np.mean([lang[i] == p for i, p in held.lang_pred.items()]) > 0.98
    again = op1_language_id(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    assert (again.loc[got.index].lang_pred == got.lang_pred).all()


def test_table_of_rows_equals_plain_average():
    rng = np.random.default_rng(0)
    model = L.Model(["a", "b"], rng.normal(size=(1 << L.BITS, 2)).astype(np.float32), np.array([0.1, -0.1], np.float32))
    texts = ["hello there world", "", "é", "ab", "x" * 40_000 + "é"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    for t, got in zip(texts, model.logits(raw, offsets), strict=True):
        key, part, n = L.bag(t.encode())
        assert np.allclose(got, model.bias + (part @ model.table[key] if n else 0), atol=1e-4)


def test_awkward_rows(spark, awkward, nothing):
    model = L.train_language_id(awkward)
    got = L.identify(awkward, model)
    assert got.count() == awkward.count()
    rows = got.collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in rows if not (r["text"] or "").strip() or r["text"] == "1 2 3")
    assert L.train_language_id(nothing) is None
    assert L.identify(nothing, None).count() == 0
    assert {r["lang_pred"] for r in L.identify(awkward, None).collect()} == {"und"}
