import re
from collections import Counter

import pytest

from cinegraph.llm import quality


def brute(text, rules=quality.RULES):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    cover = {}
    for n in [quality.BASE_N, *rules.grams]:
        c = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
        cover[n] = {j for i in range(len(ws) - n + 1) if c[tuple(ws[i : i + n])] > 1 for j in range(i, i + n)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(map(len, ws))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(ws) < rules.min_words or 100 * len(cover[3]) > rules.max_repeat_words * len(ws)
    good = all(100 * sum(len(ws[j]) for j in cover[n]) <= m * chars for n, m in rules.grams.items())
    good = good and 100 * len(dup) <= rules.max_dup_lines * len(lines) and 100 * sum(map(len, dup)) <= rules.max_dup_line_chars * sum(map(len, lines))
    good = good and 100 * symbols <= rules.max_symbols * len(ws)
    return (len(ws), chars, symbols, len(dup), len(cover[3]), failed, not failed and good)


CASES = [
    None,
    "",
    " \n\t\n ",
    "one",
    "a b c a b c a b c " * 30,
    "\n".join(["same line here"] * 60),
    " ".join(f"w{i}" for i in range(400)) + "\n" + " ".join(f"w{i}" for i in range(60)),
    "é ü ß " * 5 + " ".join(f"wörd{i}" for i in range(90)),
    " ".join(f"x{i} #" for i in range(100)),
    "\r\n".join(f"line {i % 7} ok" for i in range(40)),
    "long " + "z" * 100_000 + " " + " ".join(str(i) for i in range(3000)) + "\n\nend",
]


def test_counts_match_brute_force(spark):
    rows = [(i, x, 7, True) for i, x in enumerate(CASES)] * 2
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute(CASES[r.doc_id]), r.doc_id


def test_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert quality.verdicts(df).collect()[0].n_words == 2
    assert quality.verdicts(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_clean_labelled_documents_stay(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("quality = 1")
    got = quality.verdicts(docs).join(labels, "doc_id").where("n_words >= 50")
    assert got.where("not kept").count() == 0
