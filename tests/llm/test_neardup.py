import random
import re

import pytest

from cinegraph.llm import neardup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_rows_without_an_own_id(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(None, a), (5, a), (None, b), (None, b), (7, b + " twelve thirteen"), (7, "other text here now"), (None, ""), (None, None), (9, "x y z"), (9, "x y z")]
    df = spark.createDataFrame([(i, t, "flag", "r") for i, t in rows], "doc_id long, text string, flag string, row string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df).collect()))
    assert got == sorted([(0, 3, 5, False), (5, 3, 5, True), (0, 2, 0, True), (0, 2, 0, False), (7, 4, 7, True), (7, 1, 7, True), (0, 0, 0, True), (0, 0, 0, True), (9, 1, 9, True), (9, 1, 9, True)])
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert left == sorted([(5, a), (0, b), (7, b + " twelve thirteen"), (7, "other text here now"), (0, ""), (0, ""), (9, "x y z")])


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(30)
    docs = [None, "", "  \n", "one", "One", "two words", "two  WORDS", "x " * 3000, "É é ß", "é É ß"]
    base = text(120)
    for _ in range(150):  # a large group of near copies, some too far
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = word()
        docs.append(" ".join(t))
    for _ in range(80):  # a common passage
        docs.append(" ".join(text(rng.randint(5, 60)) + passage + text(rng.randint(0, 20))))
    for n in (4, 5, 6, 8, 12, 30):
        for _ in range(6):
            t = text(n)
            docs += [" ".join(t), " ".join([*t, word()]), "\t".join(t), " ".join(t[1:])]
    return [*enumerate(docs, 100), (None, "no id")]


@pytest.mark.parametrize("block", [16 << 20, 20_000])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block)
    rng = random.Random(3)
    docs = corpus(rng)
    rng.shuffle(docs)
    rows = [(i, t, "c", 1) for i, t in [*docs, docs[7]]]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, cluster string, rep int")).collect()
    want = brute(docs)
    assert len(got) == len(rows)
    got = [r for r in got if r.doc_id is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table_and_kept(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e F", "s"), (3, None, "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [1, 3]
    assert neardup.keep_one(df).columns == df.columns
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_no_link_of_the_documents_is_lost(spark):
    """Against all pairs that share a shingle."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    common = Counter((i, j) for own in lists.values() for i in own for j in own if i < j)
    label = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    links = [(i, j) for (i, j), n in common.items() if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    assert len(links) > 50 and all(label[i] == label[j] for i, j in links)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert label == {i: find(i) for i in sets}


def test_a_common_passage_makes_no_large_cluster(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, base = text(60), text(80)
    docs = [(i, f"{text(20)} {passage} {text(10)}") for i in range(200)]
    docs += [(200 + i, f"{docs[i][1]} more") for i in range(20)] + [(300 + i, f"{base} {i} {passage}") for i in range(10)]
    shipped = []
    links = neardup._links

    def seen(docs, clusters, *args):
        shipped.extend(r.n for r in clusters.groupBy("cluster").agg({"n": "sum"}).toDF("cluster", "n").collect())
        return links(docs, clusters, *args)

    monkeypatch.setattr(neardup, "BLOCK_BYTES", 8192)
    monkeypatch.setattr(neardup, "_links", seen)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert max(shipped) * 8 < 3 * 8192  # was one cluster of all 230
