import hashlib

import numpy as np
import pytest

from cinegraph.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None,
    "",
    " ",
    "a<|endoftext|> b",
    "x " * 3000 + "  y\n\n z",
    "日本語" * 5000,
    " ".join(["don't we'll <|endoftext|>foo  bar\t"] * 800),
    "a" * 30000,
    (" " * 40 + "q") * 500,
    "Zwei Straßen, trois écoles; ¿qué año? 12 345 6.7\r\n" * 400,
]


def test_round_trip_is_exact(spark):
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    rows = [(i, x, "y") for i, x in enumerate(TEXTS)] * 2
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode_alone(spark):
    df = spark.createDataFrame([(1, "Zwei Straßen"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df)).collect()} == {1: "Zwei Straßen", 2: ""}


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_are_found_and_shared():
    rng = np.random.default_rng(1)
    one = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(4000)).encode()
    cuts = bpe.find_cuts(np.frombuffer(one + one, np.uint8), np.array([0, len(one), 2 * len(one)]))
    assert len(cuts[0]) > 5 and cuts[0] == cuts[1]


SCRIPTS = {
    "cyrillic": "абвгдежз иклм ноп рстуф ",
    "greek": "αβγδ εζηθ ικ λμνξ ο ",
    "arabic": "ابت ثجحخ دذر زسش ",
    "chinese": "的一是不了人。我在有，他这为之大来以个中上们！",
    "japanese": "あいう漢字です。かき、くけこ？",
    "mixed": "a é 1 ! 日。\u00a0 \u3000 'll 's \u2009x  y\t z <|endoftext|> ・。ー。々。",
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_every_script_has_safe_places(script):
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    c = bpe.codec(bpe.default_vocabulary())
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list(SCRIPTS[script]), 6000))
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    want = t.encode(text, add_special_tokens=False).ids
    places = bpe.safe_places(data).tolist()
    assert len(places) > 100
    parts = [raw[a:b] for a, b in zip([0, *places], [*places, len(raw)], strict=True)]
    assert [i for p in parts for i in c.plain(p).tolist()] == want  # a token starts at every safe place
    cuts = bpe.find_cuts(data, np.array([0, len(raw)]), mask=63)
    assert len(cuts[0]) > 20 and c.encode(raw, cuts[0]).tolist() == want


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, copy = text(3000), text(2000)
    texts = [text(300) + " " + passage + " " + text(300) for _ in range(8)] + [copy] * 4 + [text(1500), None, "", passage, "日本語。" * 3000, "x"]
    df = spark.createDataFrame([(i, x, "z", 3) for i, x in enumerate(texts)] + [(0, texts[0], "z", 3)], "doc_id long, text string, ids string, k int").repartition(4)
    got = bpe.encode_once(df.drop("ids").withColumn("flag", df.k), decoded="back").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.back == (texts[r.doc_id] or "") and (r.k, r.flag) == (3, 3)
    data = np.frombuffer(passage.encode(), np.uint8)
    assert len(bpe.find_cuts(data, np.array([0, len(data)]))[0]) > 5
    assert bpe.encode_once(df.drop("ids").limit(0)).count() == 0
