import random

from cinegraph.llm import decontaminate as d


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abcxyz ") + s[i:], s[:i] + rng.choice("abcxyz") + s[i + 1 :]])
    return s


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))


def test_matches_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(word(rng) for _ in range(12))) for i in range(6)] + [(90, None), (91, ""), (92, "short"), (93, "Äß" * 20)]
    docs = [(0, None), (1, ""), (2, "x" * 50_000), (3, "Wow ÄSS " + "äß" * 20)]
    for k in range(60):
        body = " ".join(word(rng) for _ in range(30))
        t = items[k % 6][1]
        n = int(d.ERROR_RATE * len(t)) + rng.choice([-3, 0, 1, 4])
        docs.append((10 + k, body + " " + edited(rng, t, n).upper() + " " + body[:40]))
    rows = [(i, t, "h", 3) for i, t in docs] * 2
    got = d.leaks(spark.createDataFrame(rows, "doc_id long, text string, hits string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, t in docs:
        for j, item in items:
            if t and item and len(item) >= d.MIN_CHARS and len(t) < 10_000:
                best = distance(d.lower(item), d.lower(t))
                if best <= int(d.ERROR_RATE * len(item)):
                    want[i, j] = best
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(got) == 2 * len(want) and len(want) > 20
    for r in got:
        part = d.lower(dict(docs)[r.doc_id])[r.start : r.end]
        assert distance(part, d.lower(dict(items)[r.item_id])) <= r.distance + 2


def test_blocks_and_empty_tables(spark):
    items = spark.createDataFrame([(i, f"item number {i} with some more words") for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see item number 7 with some more words"), (2, "clean text of a page")], "doc_id long, text string")
    one = d.match(docs, items).select("doc_id", "hits.item_id").collect()
    many = d.match(docs, items, block_bytes=100).collect()
    assert {(r.doc_id, tuple(sorted(r.item_id))) for r in one} == {(r.doc_id, tuple(sorted(h.item_id for h in r.hits))) for r in many}
    assert [r.doc_id for r in d.clean(docs, items).collect()] == [2]
    assert d.leaks(docs.limit(0), items).count() == 0 and d.leaks(docs, items.limit(0)).count() == 0


def test_short_items_and_items_without_id(spark):
    items = spark.createDataFrame([(1, "2 + 2 = 4"), (2, "短い問題です"), (None, "the name of this river in the far north is Ob"), (3, "   "), (4, "cat")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "so 2 + 2 = 4."), (2, "so 2 + 2 = 41"), (3, "これは短い問題ですか"), (4, "well, the name of this river in the far nort is Ob!"), (5, "concatenate"), (6, "a Cat"), (7, None)], "doc_id long, text string"
    )
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()} == {(1, 1), (3, 2), (4, None), (6, 4)}
    assert sorted(r.doc_id for r in d.clean(docs.withColumn("_doc_id", docs.doc_id), items).collect()) == [2, 5, 7]
