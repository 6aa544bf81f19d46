import numpy as np

from cinegraph.llm import weaklabel as w

SF = "/root/testdata/sf0.01"


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.3
    accuracy, cast = [0.95, 0.8, 0.7, 0.9], [0.9, 0.6, 1.0, 0.5]
    patterns = {}
    for t in truth:
        v = tuple(0 if rng.random() > c else (w.BAD if (rng.random() < a) == t else w.GOOD) for a, c in zip(accuracy, cast, strict=True))
        patterns[v] = patterns.get(v, 0) + 1
    post, probs = w.estimate(patterns)
    for k, a in enumerate(accuracy):
        assert abs(probs[1, k, w.BAD] - a) < 0.03 and abs(probs[0, k, w.GOOD] - a) < 0.03
    assert all(0 <= p <= 1 for p in post.values())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "you stupid idiot", 0.3), (4, "x " * 5000, 0.4)], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = w.verdicts(docs, labels).collect()
    assert {"weak_junk", "weak_toxic"} < set(w.classify(docs, labels, weak=True).columns)
    assert len(got) == 5 and all(r.kept for r in got if r.doc_id in (1, 2))
    assert w.verdicts(docs.limit(0), labels.limit(0)).count() == 0


def test_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = w.verdicts(docs, learn).join(held, "doc_id").collect()
    share = lambda rows: sum(r.kept for r in rows) / len(rows)
    assert share([r for r in got if r.quality == 1 and r.toxic == 0]) >= 0.96
    assert share([r for r in got if r.toxic == 1]) <= 0.05
    assert share([r for r in got if r.quality == 0]) <= 0.05


def test_words_are_trimmed_however_deep():
    text = (b"." * 5000 + b"word" + b"!" * 3000 + b" a ... (b) ''")
    data = np.frombuffer(text, np.uint8)
    row, words, _, _ = w._trimmed(data, np.array([0, len(text)]))
    plain = np.frombuffer(b"word a b", np.uint8)
    assert words.tolist() == w._trimmed(plain, np.array([0, 8]))[1].tolist()


def test_a_single_bad_vote_is_not_outvoted():
    data = np.frombuffer(b"the the the the the the the the the of of of of of of of of", np.uint8)
    junk, toxic = w.votes(w.read(data, np.array([0, len(data)])), [w.insult_hashes()] + [np.zeros(0, np.uint64)] * 3)
    assert w.BAD in junk[0] and w.GOOD not in junk[0] and (toxic[0] == w.GOOD).all()
