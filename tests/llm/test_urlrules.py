import random
import time
from itertools import combinations

import pytest

from cinegraph.llm import urlrules as u

URLS = {
    1: ("http://WWW.Example.COM/en/7x?q#f", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
    2: ("https://a.com/en/1", "a.com", "/en/1", "com/en/", "block"),
    3: ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    4: ("http://x.net/de/81", "x.net", "/de/81", "net/de/", "allow"),
    5: ("http://org/es/", "org", "/es/", "org/es/", "block"),
    6: ("http://xorg/es/", "xorg", "/es/", None, "allow"),
    7: (None, "", "", None, "allow"),
    8: ("mailto:x", "", "", None, "allow"),
    9: ("://h?a://b/en/", "h", "", None, "allow"),
    10: ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    11: ("", "", "", None, "allow"),
    12: ("http://É.COM/EN/1", "É.com", "/EN/1", None, "allow"),
}


def test_listed_rules(spark):
    pages = spark.createDataFrame([(k, v[0], "x", "y") for k, v in URLS.items()] * 2, "page_id long, url string, rule string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = u.verdicts(pages, labels).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], r
    assert u.verdicts(pages.limit(0), labels).count() == 0


def brute(urls, bad, least, confidence):
    sets = {i: u.tokens(x) for i, x in urls}
    stands = {}
    for i, own in sets.items():
        for t in own:
            stands.setdefault(t, set()).add(i)
    first = {}
    for t in sorted(stands):
        first.setdefault(frozenset(stands[t]), t)
    used = set(first.values())
    count, both = {}, {}
    for i, own in sets.items():
        for n in (1, 2, 3):
            for c in combinations([t for t in own if t in used], n):
                count[c] = count.get(c, 0) + 1
                both[c] = both.get(c, 0) + (i in bad)
    rules = {c: (both[c] / count[c], both[c]) for c in count if both[c] >= least and both[c] / count[c] >= confidence}
    parts = lambda c: [p for n in (1, 2) for p in combinations(c, n) if len(p) < len(c)]
    return {(c, round(v[0], 9), v[1]) for c, v in rules.items() if not any(p in rules and rules[p][0] >= v[0] for p in parts(c))}


def test_mined_rules_equal_brute_force(spark):
    urls = [(i, f"http://{'casino' if i % 5 == 0 else 'news'}.shop{i % 3}.info/{'win' if i % 2 else 'read'}/{i}.html") for i in range(300)]
    labels = [(i, 0 if "casino" in x and "win" in x else 1, None if i % 7 else int(i % 70 == 0)) for i, x in urls] + [(5000, 0, 0), (None, 0, 1), (3, None, None)]
    pages, known = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mining = u.Mining(min_support=0.02, min_confidence=0.9)
    rules = u.mine(pages, known, mining)
    want = brute(urls, {i for i, q, t in labels if q == 0 or t == 1}, 8, 0.9)
    assert {(r[0], round(r[1], 9), r[2]) for r in rules} == want and want
    got = {r.page_id: r for r in u.verdicts(pages, known, mining).collect()}
    for i, x in urls:
        assert (got[i].verdict == "block") == any(set(r[0]) <= set(u.tokens(x)) for r in want)


@pytest.mark.parametrize("share", [1.0, 0.85])
def test_mining_of_long_urls_is_bounded_and_equals_brute_force(spark, share):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(30)]
    urls, bad = [], set()
    for i in range(80):
        own = [k for k in keys if rng.random() < share]
        urls.append((i, f"http://x.org/{'a' if i % 2 else 'b'}/{i}?{'&'.join(f'{k}=1' for k in own)}"))
        if i % 2 and ("k3" in own) == (share < 1 or i % 3 > 0):
            bad.add(i)
    pages = spark.createDataFrame(urls, "page_id long, url string")
    known = spark.createDataFrame([(i, 0 if i in bad else 1, 0) for i, _ in urls], "doc_id long, quality int, toxic int")
    began = time.time()
    rules = u.mine(pages, known, u.Mining(min_confidence=0.6))
    assert time.time() - began < 60
    assert {(r[0], round(r[1], 9), r[2]) for r in rules} == brute(urls, bad, 8, 0.6) and rules
