from collections import Counter

import numpy as np
import pytest

from lumenflow.llm import lm_score as M
from lumenflow.llm.common import word_hashes


def hashes(text):
    return word_hashes(np.frombuffer(text.encode(), np.uint8))[1]


@pytest.fixture(scope="module")
def few(docs):
    return docs.filter("doc_id < 250").cache()


@pytest.fixture(scope="module")
def model(few):
    voc = M.vocabulary(M.corpus_counts(few), 3000)
    return voc, M.train(few, voc, unit=40_000)


def plain_log_probabilities(net, voc, key):
    """Word by word, without tables of batches."""
    known, out = M.find(voc.words, key), []
    for t in range(len(key)):
        h = net["b"].astype(float)
        for k, o in enumerate((-2, -1, 1, 2)):
            x = voc.input[known[t + o]] if 0 <= t + o < len(key) else 0
            h = h + net["E"][x] * net["c"][k]
        h = np.tanh(h)
        z, g = h @ net["A"] + net["a"], voc.klass[known[t]]
        p = z[g] - np.log(np.exp(z).sum())
        if voc.rank[known[t]] < voc.own:
            s, e = voc.ends[g], voc.ends[g + 1]
            y = net["B"][s:e] @ h + net["d"][s:e]
            p += y[voc.rank[known[t]] - s] - np.log(np.exp(y).sum())
        out.append(p + voc.inside[known[t]])
    return np.array(out)


def test_scores_equal_word_by_word_sums(few, model):
    """Every text against sums over its words and spans, with words outside the head."""
    voc, net = model
    texts = {r["doc_id"]: r["text"] or "" for r in few.collect()}
    assert voc.tail is not None
    counts = Counter(w for t in texts.values() for w in hashes(t).tolist())
    head = set(voc.words.tolist())
    beyond = sum(n + 0.5 for h, n in counts.items() if h not in head)
    every, sides, both = {}, Counter(), Counter()
    for i, t in texts.items():
        key = hashes(t)
        each = plain_log_probabilities(net, voc, key)
        rare = M.find(voc.words, key) == len(voc.words)
        each[rare] += [np.log((counts[h] + 0.5) / beyond) for h in key[rare].tolist()]
        cuts = [0, *[k + 1 for k in range(len(key)) if k + 1 == len(key) or M._mix(key[k : k + 1])[0] % np.uint64(M.SPAN) == 0]]
        padded = [None, None, *key.tolist(), None, None]
        found = [((tuple(padded[a : a + 2]), tuple(padded[b + 2 : b + 4])), tuple(key[a:b].tolist()), each[a:b].sum()) for a, b in zip(cuts, cuts[1:], strict=False)]
        every[i] = len(key), found
        sides.update(c for c, _, _ in found)
        both.update((c, s) for c, s, _ in found)
    got = {r["doc_id"]: r for r in M.score(few, net, voc).collect()}
    assert len(got) == len(texts)
    for i, (n, found) in every.items():
        want = sum((np.logaddexp(np.log(both[c, s] - 1), p) if both[c, s] > 1 else p) - np.log(sides[c]) for c, s, p in found)
        assert got[i]["n_words"] == n and abs(got[i]["log_prob"] - want) < 2e-3 * max(1, n / 10)
        assert (got[i]["log_prob_per_word"] is None) == (n == 0)


def test_probabilities_of_all_words_add_up(model):
    voc, net = model
    h = np.tanh(np.random.default_rng(3).normal(size=(1, M.DIMS)))
    z = h @ net["A"] + net["a"]
    p = (np.exp(z) / np.exp(z).sum())[0]
    total = 0.0
    for g in range(voc.classes - 1):
        inner = voc.klass[:-1] == g
        total += p[g] * (1.0 if g < len(voc.ends) - 1 else np.exp(voc.inside[:-1][inner].astype(float)).sum())
    assert abs(total + p[-1] - 1) < 1e-4
    assert sorted(voc.rank[:-1][voc.rank[:-1] < voc.own]) == list(range(voc.own))


def test_the_result_does_not_depend_on_partitions(docs, model):
    voc, net = model
    few = docs.filter("doc_id < 300")
    one, many = (M.train(few.repartition(n), voc, unit=20_000) for n in (1, 8))
    assert all(np.array_equal(one[k], many[k]) for k in one)
    got = [{r["doc_id"]: r["log_prob"] for r in M.pseudo_likelihood(few.repartition(n)).collect()} for n in (1, 8)]
    assert all(abs(got[0][i] - got[1][i]) < 1e-3 + 1e-6 * abs(got[0][i]) for i in got[0])


def test_counts_cover_every_word_and_training_helps(docs, texts, model):
    counts = M.corpus_counts(docs)
    want = Counter(h for t in texts.values() for h in hashes(t).tolist())
    assert counts.sum() == sum(want.values())
    assert {r["h"] % (1 << 64): r["n"] for r in counts.table.collect()} == want
    voc, net = model
    key = np.concatenate([hashes(t) for t in texts.values()])
    lengths = np.array([len(hashes(t)) for t in texts.values()])
    before, after = (M.log_probabilities(x, voc, key, lengths)[0].mean() for x in (M.initial(voc), net))
    assert after > before + 0.02


def test_documents_that_stand_twice_score_apart(docs, texts):
    got = {r["doc_id"]: r["log_prob_per_word"] for r in M.pseudo_likelihood(docs).collect() if r["n_words"] > 0}
    times = Counter(texts.values())
    once, twice = ([got[i] for i in got if (times[texts[i]] > 1) == two] for two in (False, True))
    assert np.median(twice) > np.quantile(once, 0.9)


def test_awkward_rows(spark, awkward, nothing):
    rows = M.pseudo_likelihood(awkward).collect()
    assert len(rows) == awkward.count()
    assert all((r["n_words"] == 0) == (r["log_prob_per_word"] is None) for r in rows)
    by_text = {}
    for r, text in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_words"])), sorted(((a["doc_id"] is None, a["doc_id"], len((a["text"] or "").split()), a["text"]) for a in awkward.collect()), key=lambda x: x[:3]), strict=True):
        by_text.setdefault(text[3], set()).add((r["n_words"], round(r["log_prob"], 4)))
    assert all(len(x) == 1 for x in by_text.values())
    assert M.pseudo_likelihood(nothing).count() == 0
    assert M.pseudo_likelihood(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).count() == 2
