import duckdb
import numpy as np
import pytest

import corpus_pipeline as p
from cinegraph.llm import bpe, quality
from cinegraph.llm import decontaminate as d
from tests.llm.test_decontaminate import distance
from tests.llm.test_suffixdup import covered

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(p.STAGES)


def words(a, n):
    return " ".join(f"w{i * 7919 % 100_003}" for i in range(a, a + n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_stages_on_small_documents(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    passage = words(3000, 60)
    rows = [
        (1, words(0, 120)),
        (2, words(0, 119)),  # a near copy
        (3, "short text"),
        (4, "same words again " * 60),
        (5, words(200, 100) + " " + passage + " " + words(400, 100)),
        (6, words(600, 100) + " " + passage + " é " + words(800, 100)),
        (7, words(1000, 100) + " " + item),
        (8, None),
        (None, words(1300, 100)),
        (None, words(1300, 100)),
    ]
    docs = out = table(spark, rows)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns, name
    got = [(r.doc_id, r) for r in p.STAGES[-1][1](spark, out, SF).collect()]
    assert sorted(i or 0 for i, _ in got) == [0, 1, 5, 6]
    assert all(r.round_trip and r.n_tokens > 0 for _, r in got)
    five = dict(got)[5]
    assert passage not in five.text and words(200, 90) in five.text and five.n_chars == len(five.text)


def shingles(text, k=5):
    w = (text or "").split()
    return frozenset(tuple(x.lower() for x in w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage, over the documents of the smallest table."""
    out = [(None, spark.read.parquet(f"{SF}/documents.parquet").toPandas())]
    for name, stage in p.STAGES:
        rows = out[-1][1][["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)
        df = spark.createDataFrame([tuple(None if x is None else x for x in r) for r in rows], SCHEMA)
        out.append((name, stage(spark, df, SF).toPandas()))
    return {name: (before, after) for (_, before), (name, after) in zip(out, out[1:])}


def test_quality_equals_its_sql(stages):
    documents, after = stages["quality_rules"]
    want = duckdb.sql(quality.VERDICTS_SQL).fetchdf()
    assert len(documents) and set(after.doc_id) == set(want[want.kept].doc_id) and len(after) < len(documents)


def test_near_duplicates_equal_all_pairs(stages):
    before, after = stages["near_duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in before.itertuples()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert sorted(after.doc_id) == sorted({find(i) for i in ids}) and len(after) < len(before)


def test_suffix_dedup_equals_counted_windows(stages):
    before, after = stages["suffix_dedup"]
    raw = [t.encode() for t in before.text]
    want = {i: np.frombuffer(t, np.uint8)[~m].tobytes().decode("utf-8", "ignore") for i, t, m in zip(before.doc_id, raw, covered(raw, 200))}
    assert dict(zip(after.doc_id, after.text)) == want
    assert all(after.n_chars == after.text.str.len())


def test_decontamination_equals_distances(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(before.doc_id) - set(after.doc_id)
    texts = dict(zip(before.doc_id, before.text))
    for i in gone:  # each held an item
        assert any(d.may_hold(d.lower(x), d.lower(texts[i]), int(d.ERROR_RATE * len(x))) and d.best_end(d.lower(x), d.lower(texts[i]))[0] <= int(d.ERROR_RATE * len(x)) for x in items)
    for i, t in list(texts.items())[:60]:
        if i not in gone and len(t) < 1500:
            assert all(distance(d.lower(x), d.lower(t)) > int(d.ERROR_RATE * len(x)) for x in items[:6])


def test_tokens_equal_the_library(stages):
    tokenizers = pytest.importorskip("tokenizers")
    _, after = stages["bpe"]
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    for r in after.itertuples():
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(r.text or "", add_special_tokens=False).ids
    assert after.round_trip.all()


@pytest.mark.parametrize("name", list(STAGE))
def test_edge_cases_of_each_stage(spark, name):
    """Empty tables, nulls in every column, empty and long texts, repeated rows, and clashing columns."""
    empty = table(spark, [])
    assert STAGE[name](spark, empty, SF).count() == 0
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (2, long, "en", None, None), (3, words(0, 80), "en", "s", 1), (3, words(0, 80), "en", "s", 1)]
    df = spark.createDataFrame([(*r, "x", 7, True) for r in rows], SCHEMA + ", key string, flag int, kept boolean")
    out = STAGE[name](spark, df, SF)
    got = out.collect()
    assert [c for c in out.columns if c in df.columns] == df.columns
    assert {r.key for r in got} == {"x"} and {r.flag for r in got} == {7}
    n = {"quality_rules": 3, "near_duplicates": 4, "suffix_dedup": 5, "decontamination": 5, "bpe": 5}[name]
    assert len(got) == n and any(r.text == long for r in got)


def test_run(spark):
    out = p.run(spark, SF)
    assert 0 < out.count() < 200
