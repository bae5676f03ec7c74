"""The language model: gradients, carried state, counts and held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordflow.llm import gru, lm
from recordflow.llm.common import crc_class


def test_gradients_against_differences():
    sizes = gru.Sizes(10, 4, hidden=5, width=4)
    rnd = np.random.default_rng(0)
    weights = gru.start(sizes, rnd.integers(1, 50, 14).astype(float))
    weights = {k: v.astype(np.float64) + rnd.standard_normal(v.shape) * .3 for k, v in weights.items()}
    symbols, target = rnd.integers(0, 14, (6, 3)), rnd.integers(0, 14, (6, 3))
    live = rnd.random((6, 3)) < .8
    h = rnd.standard_normal((3, 5)) * .1

    def loss():
        hs = gru.states(weights, symbols, np.ones(symbols.shape), h)
        lp = gru.log_probs(weights, hs.reshape(-1, 5), target.ravel(), sizes)
        return -(lp * live.ravel()).sum() / live.sum()

    g, _, total = gru.gradients(weights, symbols, target, live, h, sizes)
    assert total / live.sum() == pytest.approx(loss(), rel=1e-3)
    for k, v in weights.items():
        for _ in range(6):
            at = tuple(rnd.integers(0, n) for n in v.shape)
            was, v[at] = v[at], v[at] + 1e-2
            up = loss()
            v[at] = was - 1e-2
            down, v[at] = loss(), was
            assert g[k][at] == pytest.approx((up - down) / 2e-2, abs=2e-3), k


def test_probabilities_add_up_to_one():
    sizes = gru.Sizes(10, 4, hidden=5, width=4)
    w = gru.start(sizes, np.arange(1.0, 15.0))
    h = np.random.default_rng(1).standard_normal((1, 5)).astype(np.float32)
    every = gru.log_probs(w, np.repeat(h, 14, 0), np.arange(14), sizes)
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)


def _model(texts):
    c = Counter(w for t in texts for w in lm.words(t))
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    total, distinct = np.zeros(lm.TAILS, np.int64), np.zeros(lm.TAILS, np.int64)
    for w, n in top[lm.HEADS - 1:]:
        total[lm.tail_class(w)] += n
        distinct[lm.tail_class(w)] += 1
    v = lm.Vocabulary(sum(c.values()) + len(texts), len(c) + 1, len(texts), [w for w, _ in top],
                      np.array([n for _, n in top]), total, distinct)
    return lm.Model(v, gru.flat(gru.start(v.sizes, v.symbol_counts, seed=3)) * np.float32(1.5))


def test_state_is_carried_across_windows_and_lanes(monkeypatch):
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randint(0, 30)}" for _ in range(rnd.choice([0, 1, 5, 90])))
             for _ in range(40)]
    model = _model(texts)
    symbols = [model.vocabulary.encode(lm.words(t))[1] for t in texts]
    together = lm.sequence_logs(model, symbols)
    monkeypatch.setattr(lm, "WINDOW", 7)
    monkeypatch.setattr(lm, "LANES", 3)
    assert lm.sequence_logs(model, symbols) == pytest.approx(together, rel=1e-4)
    alone = [lm.sequence_logs(model, [s])[0] for s in symbols]
    assert alone == pytest.approx(together, rel=1e-4)


def _rows(n=400):
    rnd = random.Random(3)
    kinds = [[f"{k}{rnd.randint(0, 999)}" for _ in range(300)] for k in "abc"]
    rows = [(i, " ".join(rnd.choice(rnd.choice(kinds[i % 3:i % 3 + 1]))
                         for _ in range(rnd.randint(5, 80)))) for i in range(n)]
    return rows + [(10000, None), (10001, ""), (None, "a1 new"), (10002, "NEW é É a1"), (10002, "new É é a1"),
                   (10003, "x" * 500 + " " + "y " * 20000)]


def test_counts_base_and_held_out_gain(make_docs):
    rows = _rows(3000)
    docs = make_docs(rows, score="old", n_tokens="x").coalesce(1)
    out = lm.held_out(crc_class("doc_id", 5))
    is_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, n, ends = Counter(), 0, 0
    for i, t in rows:
        if not is_out(i):
            c.update(lm.words(t or ""))
            ends += 1
    n = sum(c.values()) + ends
    model, counts = lm.fit(docs.where(~out))
    assert (model.vocabulary.total, model.vocabulary.distinct) == (n, len(c) + 1)
    got = lm.score(docs, model, counts).collect()
    assert len(got) == len(rows)

    def expected(t):
        x = [c[w] for w in lm.words(t or "")] + [ends]
        return len(x), sum(k > 0 for k in x), sum(math.log10((k + .5) / (n + .5 * (len(c) + 2))) for k in x)

    want = sorted((repr(i), *expected(t)) for i, t in rows)
    mine = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in got)
    for a, b in zip(mine, want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    held = [r for r in got if is_out(r.doc_id) and r.doc_id < 1000 and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_are_joined(make_docs, monkeypatch):
    """With next to no words in the model's table the counts come from the join, unchanged."""
    rows = _rows(60)
    docs = make_docs(rows)
    model, counts = lm.fit(docs)
    full = {(r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(docs, model, counts).collect()}
    monkeypatch.setattr(lm, "KNOWN", 20)
    small, counts = lm.fit(docs)
    assert len(small.vocabulary.words) <= 20
    assert {(r.n_tokens, r.n_known, round(r.base_score, 6))
            for r in lm.score(docs, small, counts).collect()} == full


def test_empty_training_and_empty_table(make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    model, counts = lm.fit(docs.where(F.lit(False)))
    got = lm.score(docs, model, counts).collect()
    assert [r.base_score for r in got] == pytest.approx([0.0, 0.0], abs=1e-12) and all(math.isfinite(r.score) for r in got)
    assert [r.n_known for r in got] == [0, 0]
    assert lm.score(docs.limit(0), model, counts).count() == 0


def test_windows_go_through_whole_texts():
    rnd = random.Random(6)
    texts = [np.array([rnd.randint(1, 9) for _ in range(rnd.choice([0, 1, 3, 40]))], np.int64)
             for _ in range(50)]
    lanes, steps = 4, 5
    got, before, count = [[] for _ in range(lanes)], [0] * lanes, 0
    for inputs, target, live, keep, on in lm.windows(iter(texts), lanes, steps):
        assert inputs.shape == (steps, len(on))
        for col, lane in enumerate(on):
            for s in range(steps):
                if not live[s, col]:
                    continue
                assert inputs[s, col] == (before[lane] if keep[s, col] else 0)
                if not keep[s, col]:
                    got[lane].append([])
                got[lane][-1].append(int(target[s, col]))
                before[lane], count = target[s, col], count + 1
    assert count == sum(len(t) + 1 for t in texts)
    assert sorted(x for lane in got for x in lane) == sorted([*t.tolist(), 0] for t in texts)


def test_score_of_a_plain_walk():
    """The score of a text, step by step with plain loops, from the weights alone."""
    model = _model(["a b c a", "b b d"])
    v, w = model.vocabulary, gru.shaped(model.vector, model.vocabulary.sizes)
    n, sizes = v.sizes.hidden, v.sizes
    sig = lambda x: 1 / (1 + np.exp(-x))
    for text in ("a b", "d c c a b b", ""):
        h, total, last = np.zeros(n), 0.0, 0
        for target in [*v.encode(lm.words(text))[1].tolist(), 0]:
            x, u = w["inputs"][last] + w["state_bias"], h @ w["state"]
            r, z = sig(x[:n] + u[:n]), sig(x[n:2 * n] + u[n:2 * n])
            new = np.tanh(x[2 * n:] + r * u[2 * n:])
            h = z * h + (1 - z) * new
            scores = np.exp(h @ w["class_weight"] + w["class_bias"])
            head = target < sizes.heads
            c = target // sizes.width if head else target - sizes.heads + sizes.head_classes
            total += math.log10(scores[c] / scores.sum())
            if head:
                at = slice(c * sizes.width, min((c + 1) * sizes.width, sizes.heads))
                words = np.exp(h @ w["word_weight"][:, at] + w["word_bias"][at])
                total += math.log10(words[target - at.start] / words.sum())
            last = target
        assert lm.sequence_logs(model, [v.encode(lm.words(text))[1]])[0] == pytest.approx(total, rel=1e-4)
