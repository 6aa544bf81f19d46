import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cinegraph.llm import suffixdup


def covered(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = True
        out.append(mark)
    return out


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh"])
def test_expansion_equals_brute_force(letters):
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([1, 2, 3, 5, 8, 20, 33])
        base = bytes(rng.choice(letters) for _ in range(60))
        pieces = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(60)
            pieces.append(base[a : rng.randint(a, 60)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 10))))
        count = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] for p in pieces]
        assert [x.tolist() for x in suffixdup.repeated(pieces, length)] == want


def corpus(rng):
    text = lambda n: "".join(rng.choice("abcdefghij éß\n") for _ in range(n))
    passage, copy = text(60), text(300)
    docs = [None, "", "short", "aaaa" * 200, copy, copy, copy[:150] + "x" + copy[151:], "ab" * 90, text(45) + passage + passage + text(3)]
    docs += [text(rng.randint(0, 80)) + passage[rng.randint(0, 5) : rng.randint(50, 60)] + text(rng.randint(0, 80)) for _ in range(60)]
    return docs


@pytest.mark.parametrize("most", [2000, 5])
def test_documents_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffixdup, "MOST_PIECES", most)
    docs = corpus(random.Random(8))
    rows = [(i if i else None, t, 0, "k") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_spans int, key string").repartition(5)
    got = {r.doc_id: r for r in suffixdup.remove(df, length=40, gram=12).collect()}
    raw = [(t or "").encode() for t in docs]
    for i, (t, mark) in enumerate(zip(raw, covered(raw, 40), strict=True)):
        r = got[i if i else None]
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], mark.astype(int)])) == 1))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), int(mark.sum()), runs)
        assert bytes(r.kept) == np.frombuffer(t, np.uint8)[~mark].tobytes()


def test_runs_are_few_pieces():
    for unit in (b"a", b"-= ", b"the same sentence of words. "):
        raw = (unit * (1 << 20))[: 1 << 20]
        off = np.array([0, len(raw)])
        assert len(suffixdup.anchors(np.frombuffer(raw, np.uint8), off, 200, 64)[0]) < 10


def test_periodic_texts_and_shared_ids_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "MOST_WINDOWS", 64)
    rng = random.Random(4)
    texts = ["ab" * 100, "ab" * 60 + "c" * 300, "xyz" * 70, "q" * 90, "".join(rng.choice("abcd") for _ in range(300)), "k" * 39, "same id " * 30, "x" + "-= " * 80, "-= " * 80]
    rows = [(i % 3 or None, t, "h") for i, t in enumerate(texts)] + [(1, "abcd" * 3, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    raw = sorted(t.encode() for _, t, _ in rows)
    want = dict(zip(raw, (int(m.sum()) for m in covered(raw, 40)), strict=True))
    got = suffixdup.remove(df, length=40, gram=12).collect()
    assert {r.text.encode(): r.n_removed for r in got} == want and len(got) == len(rows)
    left = suffixdup.remove(df, length=40, gram=12, as_text=True).collect()
    assert all(len(r.kept.encode()) == r.n_bytes - r.n_removed for r in left)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 10 + "y" * 300), (1, "x" * 10 + "y" * 300), (2, "z" * 199)], "doc_id long, text string")
    got = sorted(map(tuple, suffixdup.digests(df).collect()))
    gone = hashlib.sha256(b"").hexdigest()
    assert got == [(1, 310, 310, 1, gone)] * 2 + [(2, 199, 0, 0, hashlib.sha256(b"z" * 199).hexdigest())]
    assert suffixdup.digests(df.limit(0)).count() == 0
