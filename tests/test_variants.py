import difflib
import itertools
import random

from cinegraph.operators import resolution as R


def test_variants_equal_all_pairs(spark):
    rng = random.Random(5)
    names = {"abcdefghij", "abcXefXhij", "abcde", "abxde", "aaaa bbbb", "aaaa bb", "名前の長い人物", "名前の短い人物だ", "", "x"}
    for _ in range(40):
        n = "".join(rng.choice("abcd ") for _ in range(rng.randint(3, 14)))
        names |= {n, "".join(rng.choice("abcdz") if rng.random() < 0.15 else x for x in n), n[1:] + "q"}
    want = set()
    for a, b in itertools.combinations(sorted(names), 2):
        apart = sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else abs(len(a) - len(b))
        ratio = round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
        if ratio >= 0.8 and apart >= 2:
            want.add((a, b, ratio))
    got = R.variants(spark.createDataFrame([(n,) for n in names] + [(None,), ("abcde",)], "n string"), "n", 0.8).collect()
    assert ("abcXefXhij", "abcdefghij", 0.8) in want
    assert len(got) == len(want) and {tuple(r) for r in got} == want
