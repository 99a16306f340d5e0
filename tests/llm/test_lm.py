import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vesper.llm import lm

from .conftest import ODD, spaced


def check(rows, docs):
    train = [spaced(t) + [None] for i, t in docs if not (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)]
    count = Counter(w for ws in train for w in ws)
    total, kinds = sum(count.values()), len(count)
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        ws = spaced(text[r.doc_id]) + [None]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_base_scores(documents, monkeypatch):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    whole = sorted(lm.report(documents).collect())
    check(whole, docs)
    # few words are sent to the workers: the others join
    monkeypatch.setattr(lm, "FREQUENT", 500)
    few = sorted(lm.report(documents).collect())
    check(few, docs)
    # all words have a class of their own
    monkeypatch.setattr(lm, "OWN_COUNT", 1)
    check(sorted(lm.report(documents).collect()), docs)
    for rows in (whole, few):
        out = [r for r in rows if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_forward_and_expected_counts_against_all_paths(monkeypatch):
    import itertools


    rng = np.random.default_rng(1)
    states, kinds = 2, 3
    share = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = lm.Hidden(share(rng.random(states), 0), share(rng.random((states, states)), 1), share(rng.random((kinds, states)), 0))
    texts = [[0, 1, 2, 1], [2], [1, 1, 0, 2, 2, 0, 1, 0, 0, 1], [], [0, 0, 1], [2, 1, 0, 0, 1, 2, 2]]
    of = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    logs = lm.forward(model, np.concatenate([np.array(t, np.int64) for t in texts]), of)
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((kinds, states))
    for text, got in zip(texts, logs, strict=True):
        paths = {}
        for path in itertools.product(range(states), repeat=len(text)):
            p = 1.0
            for t, (s, w) in enumerate(zip(path, text, strict=True)):
                p *= (model.start[s] if t == 0 else model.move[path[t - 1], s]) * model.emit[w, s]
            paths[path] = p
        total = sum(paths.values())
        assert got == pytest.approx(math.log10(total))
        for path, p in paths.items():
            for t, (s, w) in enumerate(zip(path, text, strict=True)):
                emits[w, s] += p / total
                if t == 0:
                    starts[s] += p / total
                else:
                    moves[path[t - 1], s] += p / total
    # whole texts, and texts of several segments: counts are the same
    for segment, long, most in ((64, 1 << 16, 1 << 21), (3, 1, 6), (3, 5, 9)):
        monkeypatch.setattr(lm, "SEGMENT", segment)
        monkeypatch.setattr(lm, "LONG", long)
        monkeypatch.setattr(lm, "TOKENS", most)
        counts = lm.blank(states, kinds)
        assert lm.expect(model, np.concatenate([np.array(t, np.int64) for t in texts]), of, counts) == pytest.approx(logs.sum())
        assert counts[0] == pytest.approx(starts) and counts[1] == pytest.approx(moves) and counts[2] == pytest.approx(emits)


def test_likelihood_grows_with_each_round():
    rng = np.random.default_rng(2)
    classes = np.concatenate([rng.integers(0, 20, 500), rng.integers(20, 40, 500)])
    of = np.array([0, 500, 1000])
    prior = np.full(4000, 1 / 4000)
    model = lm.begin([(classes[:500], np.array([0, 500])), (classes[500:], np.array([0, 500]))], prior, 2, 0)
    last = -math.inf
    for _ in range(4):
        counts = lm.blank(2, 4000)
        now = lm.expect(model, classes, of, counts)
        assert now >= last - 0.5
        last, model = now, lm.maximise(counts, prior)


def test_odd_rows(odd, none):
    rows = lm.report(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lm.report(none).collect() == []
