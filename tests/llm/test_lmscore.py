import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cinegraph.llm import lmscore as m


def toks(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None]


@pytest.mark.parametrize("lookup", [150_000, 20])
def test_base_scores_equal_brute_force(spark, monkeypatch, lookup):
    monkeypatch.setattr(m, "LOOKUP", lookup)
    rng = np.random.default_rng(2)
    texts = [None, "", " \n", "One one ONE É é", "x " * 4000] + [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 80)) % 500) for _ in range(200)]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "no id here", "c", 1), (7, texts[7], "c", 1)]
    got = m.score(spark.createDataFrame(rows, "doc_id long, text string, rare string, key int")).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter()
    for i, t, _, _ in rows:
        if not held(i):
            c.update(toks(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    text = {i: t for i, t, _, _ in rows}
    for r in got:
        w = toks(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0


def net(counts, k, hashed):
    shape = m.Shape(k, hashed)
    by_place = np.full(shape.pad, -1.0)
    by_place[shape.place(np.arange(k + hashed))] = counts
    return shape, by_place, m.Model.start(by_place, shape)


def test_probabilities_sum_to_one_and_training_learns():
    shape, counts, start = net(np.array([50.0, 30, 20, 10, 40, 25, 5]), 4, 3)
    rng = np.random.default_rng(1)
    rank = [0]
    for _ in range(6000):  # the next class mostly follows from the last
        rank.append((rank[-1] + 1) % 7 if rng.random() < 0.8 else int(rng.integers(0, 7)))
    x, at = m.stream(shape.place(np.array(rank)), np.array([len(rank)]), shape.pad)
    before = m.Model(start, shape).log_prob(x)[at - m.LEAD].mean()
    t = m.Trainer(start, counts, shape)
    for _ in range(6):
        t.run(x)
    assert t.m.log_prob(x)[at - m.LEAD].mean() > before + 0.5
    text = x[: m.LEAD + 40].copy()
    total = 0.0
    for k in range(7):
        text[-1] = shape.place(np.array([k]))[0]
        total += np.exp(t.m.log_prob(text)[-1])
    assert abs(total - 1) < 1e-4


def test_gradient_is_that_of_the_contrastive_loss():
    """Moving along the gradient changes the noise-contrastive loss as a numeric derivative says."""
    shape, counts, start = net(np.array([5.0, 3, 2, 1, 4, 2, 5]), 4, 3)
    rng = np.random.default_rng(6)
    start = (start + rng.normal(0, 0.3, len(start))).astype(np.float32)
    x = shape.place(rng.integers(0, 7, (3, m.LEAD + 9)))
    x[0, : m.LEAD] = shape.pad
    x[1, m.LEAD + 4 :] = shape.pad

    def loss(p):
        t = m.Trainer(p, counts, shape)
        one, two, far = t.m.contexts(x)
        v = (one * t.m.s[0] + two * t.m.s[1] + far * t.m.s[2]).reshape(-1, m.DIM).astype(float)
        y = x[:, m.LEAD :].ravel()
        v, y = v[y < shape.pad], y[y < shape.pad]
        order = np.argsort(y, kind="stable")
        v, y = v[order], y[order]
        g = y // shape.width
        soft = lambda z: np.log1p(np.exp(z))
        out = soft(-((v * t.m.u[g]).sum(1) + t.m.a[g] - t.shift[g])).sum()
        noise = np.minimum(np.searchsorted(t.cum, t.rng.random(m.NOISE)), shape.groups - 1)
        out += soft(v @ t.m.u[noise].T + t.m.a[noise] - t.shift[noise]).sum()
        out += soft(-((v * t.m.t[y]).sum(1) + t.m.b[y] - t.shift_in[y])).sum()
        there = np.unique(g)
        drawn = (t.rng.random((len(there), m.NOISE, 1)) > t.cum_in[there, None, :-1]).sum(axis=2)
        for k, noise in zip(there, drawn, strict=True):
            noise = k * shape.width + noise
            out += soft(v[g == k] @ t.m.t[noise].T + t.m.b[noise] - t.shift_in[noise]).sum()
        return out

    t = m.Trainer(start, counts, shape)
    t.step(x)
    grad = t.grad.p.astype(float)
    for _ in range(5):
        way = rng.normal(0, 1, len(start))
        eps = 1e-2
        slope = (loss((start + eps * way).astype(np.float32)) - loss((start - eps * way).astype(np.float32))) / (2 * eps)
        assert math.isclose(slope, float(grad @ way), rel_tol=0.02, abs_tol=0.05)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert m.score(df.limit(0)).count() == 0


def test_hashed_counts_follow_the_vocabulary(spark):
    vocab = spark.createDataFrame([(h, abs(h) % 13, h % 7 + 1) for h in range(-50, 50)], "h long, x int, c long")
    h, c = m._frequent(vocab, 150)
    n, v = m._hashed_counts(vocab, h[:3], 10)
    assert len(n) == 10 and v.sum() == 97 and n.sum() == c.sum() - c[:3].sum()


def test_beats_the_counts_and_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, many = ({r.doc_id: r for r in m.score(docs.repartition(n)).collect()} for n in (1, 16))
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.2
    assert all(math.isclose(r.score, many[i].score, rel_tol=1e-5) for i, r in one.items())


def test_shards_are_averaged_alike_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_TOKENS", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r.doc_id: r.score for r in m.score(docs.repartition(n)).collect()} for n in (1, 7))
    assert all(math.isclose(x, many[i], rel_tol=1e-4) for i, x in one.items())
