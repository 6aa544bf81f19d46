"""Edge cases of operators on small rows."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegraph.functions import text as X
from cinegraph.operators import communities, evidence, folds, intervals, resolution, retrieval, search, segments, similarity, store, tasks
from cinegraph.operators.components import components
from cinegraph.streaming import sessions


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_shingles_and_jaccard(spark):
    s = lambda x: X.shingles3(F.lit(x))
    assert [one(spark, s(x)) for x in ("", "a", "ab", "abc", "abcd")] == [[], ["a"], [], ["abc"], ["abc", "bcd"]]
    assert one(spark, X.jaccard(s("ab"), s("cd"))) == 1.0
    assert one(spark, X.jaccard(s(""), s("abc"))) == 0.0
    assert one(spark, X.jaccard(s("abcd"), s("abc"))) == 0.5


def test_entropy_and_normal_forms(spark):
    assert one(spark, X.entropy(F.lit("aaaaaa"))) == 0.0
    assert abs(one(spark, X.entropy(F.lit("ab cd"))) - 2.0) < 1e-9
    assert one(spark, X.normalize_exact(F.lit("  A　B \n c "))) == "a b c"
    assert one(spark, X.normalize_exact(F.lit(None).cast("string"))) == ""
    assert one(spark, X.normalize_fuzzy(F.lit("Don't—stop 中文!"))) == "don't stop 中文"
    assert one(spark, X.mmss(F.lit(6_000_000))) == "100:00"


def test_ocr(spark):
    keep = {"OEIAFMOOC": False, "AI": True, "hello world": True, "中文字幕": True, "abc": False, "": False, "bcdfghj": False}
    for t, k in keep.items():
        assert one(spark, X.ocr_keep(F.lit(t), ["AI", "GPU"])) is k, t


def test_rrf(spark):
    lists = [spark.createDataFrame(x, "k string, rank int") for x in ([("a", 0), ("b", 1), ("c", 2)], [("b", 0), ("d", 1)])]
    got = {r.k: r.score for r in retrieval.rrf(lists, "k").collect()}
    assert got == pytest.approx({"b": 1 / 61 + 1 / 60, "a": 1 / 60, "d": 1 / 61, "c": 1 / 62})


def test_folds(spark):
    df = spark.createDataFrame([(1, 0, 20000), (1, 1, 10000), (1, 2, 3000), (2, 0, 99999)], "k int, o int, size int")
    assert sorted(map(tuple, folds.budget_pack(df, "k", "o", "size", 24000).collect())) == [(1, 0), (1, 2), (2, 0)]
    assert [r.chunk for r in folds.chunk_pack(df, "k", "o", "size", 24000).where("k = 1").orderBy("o").collect()] == [0, 1, 1]
    h = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 3), (1, 3, 7)], "k int, o int, h long")
    assert [r.o for r in folds.dedup_chain(h, "k", "o", "h", 2).orderBy("o").collect()] == [0, 3]


def test_plan():
    assert segments.plan(29_999, []) == [(0, 29_999, False, False, 0, 29_999)]
    assert [p[:2] for p in segments.plan(90_000, [])] == [(0, 60_000), (60_000, 90_000)]
    cuts = [p[:2] for p in segments.plan(300_000, list(range(5000, 300_000, 5000)))]
    assert cuts[0] == (0, 60_000) and all(30_000 <= b - a <= 90_000 for a, b in cuts)
    assert segments.plan(200_000, [100_000])[0][3] is True  # a hard cut
    assert [p[:4] for p in segments.plan(100_000, [85_000])] == [(0, 50_000, False, True), (50_000, 100_000, True, False)]
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 900_000)
        out = segments.plan(n, [rng.randrange(n + 1) for _ in range(rng.randint(0, 30))])
        assert out[0][0] == 0 and out[-1][1] == n and all(x[1] == y[0] for x, y in zip(out, out[1:]))
        assert all(b - a <= 90_000 and (b - a >= 30_000 or n < 30_000) for a, b, *_ in out)


def test_intervals(spark):
    s = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 1000, 130_000)], "m int, segment_index int, start_ms long, end_ms long")
    p = spark.createDataFrame([(1, 10, 999), (1, 11, 1000), (1, 12, 129_999), (1, 13, 500_000)], "m int, p long, ts long")
    assert {r.p: r.segment_index for r in intervals.owner(p, s, "m", "p").collect()} == {10: 0, 11: 1, 12: 1, 13: 1}
    rows = spark.createDataFrame([(1, "a", 1500), (2, "b", 0)], "m int, r string, at long")
    near = spark.createDataFrame([(1, 7, 1000), (1, 5, 2000)], "m int, p long, ts long")
    assert [(r.r, r.p) for r in intervals.nearest(rows, near, "m", "r", "p").collect()] == [("a", 5)]


def test_components_of_customers_and_suppliers(spark):
    from cinegraph import queries

    d = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    root = {r[0]: r[0] for r in read("customer").select("c_custkey").collect()} | {-r[0] - 1: -r[0] - 1 for r in read("supplier").select("s_suppkey").collect()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in read("orders").join(read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", -F.col("l_suppkey") - 1).distinct().collect():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = queries.queries()["connected_components"](spark, d).collect()
    assert {r.node: r.component for r in got} == {i: find(i) for i in root}


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(e.limit(0)).count() == 0


def test_chains(spark):
    rows = [("a", "b"), ("b", "g"), ("g", None), ("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r.id: r.target for r in resolution.close_chains(spark.createDataFrame(rows, "id string, target string")).collect()}
    assert got == {"a": "g", "b": "g", "g": "g", "x": "x", "y": "y", "z": "gone"}


def test_judge_falls_back(spark):
    df = spark.createDataFrame([(1, i, f"n{i}", ["c"], [0.95]) for i in range(23)], "batch int, pos int, name string, candidates array<string>, scores array<double>")

    def broken(batch):
        if len(batch) == 20:
            raise RuntimeError
        return [{"id": 0, "candidate": 0}, {"id": 0, "candidate": -1}, {"id": 1, "candidate": 5}, {"id": 7, "candidate": 0}]

    assert {r.action for r in resolution.judge(df).collect()} == {"merge"}
    assert [r.name for r in resolution.judge(df, broken).collect() if r.action == "merge"] == ["n20"]


def test_clusters_equal_a_plain_fold(spark):
    rng = random.Random(2)
    words = ["red", "blue", "gear", "bolt", "old", "cold", "ring"]
    rows = [("a" if rng.random() < 0.5 else "b", i, " ".join(rng.sample(words, rng.randint(1, 3))), rng.randint(1, 9), rng.randint(0, 4)) for i in range(60)]

    def grams(x):
        return {x} if len(x) == 1 else set() if len(x) == 2 else {x[i : i + 3] for i in range(len(x) - 2)}

    want = []
    for key in "ab":
        clusters = []
        for _, i, x, w, k in [r for r in rows if r[0] == key]:
            for c in clusters:
                a, b = grams(c["d"][0]), grams(x)
                if len(a & b) / len(a | b) >= 0.8:
                    c["d"].append(x)
                    c["s"] = max(c["s"], w)
                    c["k"].add(k)
                    break
            else:
                clusters.append({"d": [x], "s": w, "k": {k}})
        want += [(key, c["d"], c["s"], len(c["d"]), sorted(c["k"])) for c in clusters]
    got = resolution.cluster_relations(spark.createDataFrame(rows, "src string, pos int, description string, strength int, segment_index int"), ["src"]).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_and_contained_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(3, 12))).strip() for _ in range(80)} - {""})
    df = spark.createDataFrame([(i % 2, n) for i, n in enumerate(names)], "k int, name string").withColumn("flat", F.col("name")).withColumn("s", X.shingles3(F.col("name")))
    own = {n: (i % 2, {n[j : j + 3] for j in range(len(n) - 2)}) for i, n in enumerate(names)}
    pairs = [(a, b) for a in names for b in names if a < b and own[a][0] == own[b][0]]
    for at in (0.3, 0.5, 0.9):
        want = {(a, b) for a, b in pairs if own[a][1] and own[b][1] and len(own[a][1] & own[b][1]) >= at * len(own[a][1] | own[b][1])}
        assert {(r.a, r.b) for r in similarity.near_pairs(df.where(F.size("s") > 0), ["k"], at).collect()} == want
    held = {(a, b) for a, b in pairs if len(a) >= 3 and len(b) >= 3 and (a in b or b in a)}
    assert {(r.a, r.b) for r in similarity.contained_pairs(df, ["k"]).collect()} == held


def test_cascade(spark):
    rows = [("g", 0, "Red Gear", [1.0, 0.0]), ("g", 1, "red  gear", [1.0, 0.0]), ("g", 2, "red gears", [0.0, 1.0]), ("g", 3, "crimson cog", [0.9, 0.1]), ("g", 4, "ab", None), ("g", 5, "ab", None), ("g", 6, "some other name", [-1.0, 0.0]), ("h", 0, "red gear", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "group_id string, pos long, name string, vector array<double>")
    got = {(r.group_id, r.pos): (r.target, r.via) for r in resolution.cascade(df, "group_id", lambda n, names: 0).collect()}
    assert got == {("g", 0): ("red gear", "create"), ("g", 1): ("red gear", "exact"), ("g", 2): ("red gear", "similar"), ("g", 3): ("red gear", "judged"), ("g", 4): ("ab", "create"), ("g", 5): ("ab", "exact"), ("g", 6): ("some other name", "create"), ("h", 0): ("red gear", "create")}


def test_description_gate(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [("a", 0, "first text", w, v), ("a", 1, "text", w, v), ("a", 2, "like the stored", v, v), ("a", 3, "x" * 900, w, v), ("b", 0, None, w, None), ("b", 1, "b", v, None)]
    df = spark.createDataFrame(rows, "k string, o int, t string, v array<double>, s array<double>")
    got = {r.k: (r.description, r.added) for r in resolution.description_gate(df, "k", "o", "t", "v", "s").collect()}
    assert got["a"] == ("first text\n" + "x" * 389, 2) and got["b"] == ("b", 1)


def test_communities_of_cliques(spark):
    near = [{} for _ in range(12)]
    for block in (range(4), range(4, 8), range(8, 12)):
        for a in block:
            for b in block:
                if a != b:
                    near[a][b] = 2.0
    near[3][4] = near[4][3] = near[7][8] = near[8][7] = 1.0
    assert communities.leiden(near) == [0] * 4 + [1] * 4 + [2] * 4
    names = [chr(97 + i) for i in range(12)]
    nodes = spark.createDataFrame([("g", n) for n in [*names, "zz"]], "group_id string, name string")
    edges = spark.createDataFrame([("g", names[a], names[b], int(w)) for a in range(12) for b, w in near[a].items() if a < b], "group_id string, src string, dst string, strength int")
    top = [r for r in communities.hierarchy(nodes, edges).collect() if r.level == 0]
    assert len(top) == 13 and len({r.community for r in top}) == 4


def test_leiden_beats_single_nodes_and_keeps_communities_connected():
    rng = random.Random(9)
    n = 60
    near = [{} for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if rng.random() < (0.4 if a % 4 == b % 4 else 0.03):
                near[a][b] = near[b][a] = 1.0
    own = communities.leiden([dict(x) for x in near])
    total = sum(sum(x.values()) for x in near)
    q = sum(w for v, x in enumerate(near) for u, w in x.items() if own[u] == own[v]) / total
    q -= sum((sum(sum(near[v].values()) for v in range(n) if own[v] == c) / total) ** 2 for c in set(own))
    assert q > 0.4 and communities._connected(near, own) == [min(v for v in range(n) if own[v] == own[u]) for u in range(n)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, created int")
    new = spark.createDataFrame([(2, None, 2), (3, "c", 2)], "id int, v string, created int")
    up = lambda o: store.upsert(o, new, ["id"], ("created",))
    assert sorted(map(tuple, up(old).collect())) == [(1, "a", 1), (2, None, 1), (3, "c", 2)]
    assert sorted(map(tuple, up(up(old)).collect())) == sorted(map(tuple, up(old).collect()))


def test_states(spark):
    rng = random.Random(1)
    actions = list(tasks.TRANSITIONS)
    rows = [(k, i, rng.choice(actions) if i else "create") for k in range(30) for i in range(60)]
    got = {r.user_id: tuple(r)[1:7] for r in tasks.run_states(spark.createDataFrame(rows, "user_id long, o int, action string"), "user_id", ["o"], "action").collect()}
    for k in range(30):
        now = (None, 0, 0, 0, 0, 0)
        for _, _, action in rows[k * 60 : k * 60 + 60]:
            now = tasks.step(now, action)
        assert got[k] == now
    run = lambda *xs: functools.reduce(tasks.step, xs, (None, 0, 0, 0, 0, 0))
    assert run("create", "analyze", "create") == ("ANALYZING", 1, 0, 0, 0, 1)
    assert run("create", "analyze_retry", "analyze_retry", "analyze_retry") == ("QUEUED", 3, 2, 0, 0, 1)
    assert run("create", "analyze", "analyzed", "commit", "committed", "cancel")[0] == "SUCCESS"
    assert run("create", "analyze_error", "manual_analyze", "analyze_retry") == ("QUEUED", 2, 1, 0, 0, 0)


def test_locks(spark):
    rows = [(1, 1, [3, 1, 3]), (1, 2, [2]), (1, 3, [1, 4]), (1, 4, [4]), (2, 5, [1])]
    got = {r.r: (r["keys"], r.granted) for r in tasks.locks(spark.createDataFrame(rows, "b int, r int, k array<int>"), "b", "r", "k").collect()}
    assert got == {1: ("1,3", True), 2: ("2", True), 3: ("1,4", False), 4: ("4", True), 5: ("1", True)}


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from cinegraph.plans import shared

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared.shared_dir(fake)


def test_late_rows_are_dropped(spark, tmp_path):
    for n, ts in enumerate(["2024-01-01 00:00:00", "2024-01-01 05:00:00", "2024-01-01 06:00:00", "2024-01-01 00:30:00", "2024-01-01 09:00:00"]):
        spark.createDataFrame([(n, ts, "view", 1.0)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema("event_id int, ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = sessions.drain(sessions.tumbling(source, "1 hour")).collect()
    assert [(str(r.start), r.n) for r in sorted(out, key=lambda r: r.start)][0] == ("2024-01-01 00:00:00", 1)


def test_pictures():
    from cinegraph.operators import images

    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (8, 9)).astype(np.uint8)
    bits = "".join("1" if px[r, k] > px[r, k + 1] else "0" for r in range(8) for k in range(8))
    want = int(bits, 2) - (1 << 64 if bits[0] == "1" else 0)
    assert images.dhash(b"P5\n9 8\n255\n" + px.tobytes()) == want
    big = np.repeat(np.repeat(px, 5, axis=0), 3, axis=1)
    assert images.dhash(b"P5 # a comment\n27 40 255\n" + big.tobytes()) == want
    colour = np.repeat(px[:, :, None], 3, axis=2)
    assert images.dhash(b"P6 9 8 255\n" + colour.tobytes()) == want
    for bad in (None, b"", b"P5", b"P5 9 8 255\n" + px.tobytes()[:-1], b"P7 1 1 255\nx", b"P5 0 0 255\n", b"P5 a b 255\n"):
        assert images.dhash(bad) is None
    odd = images.shrink(np.arange(35.0).reshape(5, 7), 2, 3)
    assert odd.shape == (2, 3) and abs(odd.mean() - 17) < 1e-9


def test_rerank_and_points(spark):
    rows = spark.createDataFrame([("a", "red bolt", 0), ("b", "red gear", 1), ("c", None, 2)], "k string, x string, rank int")
    order = lambda df: [r.k for r in df.orderBy("rank").collect()]
    assert order(search.rerank(rows, "x", 2)) == ["a", "b"]
    assert order(search.rerank(rows, "x", 2, search.overlap(["red", "gear"]))) == ["b", "a"]
    assert order(search.rerank(rows, "x", 3, lambda texts: [1.0])) == ["a", "b", "c"]  # too few scores
    assert search.rerank(rows.limit(0), "x", 3, search.overlap(["red"])).count() == 0
    com = spark.createDataFrame([(f"c{i}", ["x"], i) for i in range(7)], "community string, findings array<string>, rank int")
    calls = lambda rows: "[]" if len(rows) == 5 else '[{"community": 1, "points": [{"text": "t", "score": 80}, {"text": "u", "score": 40}]}, 3, {"community": 0, "points": 4}]'
    assert [tuple(r) for r in search.map_reduce(com, calls).select("community", "text", "score").collect()] == [("c6", "t", 80)]
    assert search.map_reduce(com, lambda rows: "no json").count() == 0


def test_assigned_communities(spark):
    names = [("g", n) for n in "abcdef"]
    e = spark.createDataFrame(names, "group_id string, name string")
    given = spark.createDataFrame([("g", "a", 1), ("g", "b", 1)], "group_id string, name string, community int")
    edges = spark.createDataFrame([("g", "a", "c"), ("g", "b", "c"), ("g", "c", "d"), ("g", "a", "d")], "group_id string, src string, dst string")
    vectors = spark.createDataFrame([("g", "e", [1.0, 0.0]), ("g", "f", [-1.0, 0.0])], "group_id string, name string, vector array<double>")
    centres = spark.createDataFrame([("g", 1, [1.0, 0.1])], "group_id string, community int, centre array<double>")
    got = {r.name: (r.community, r.via) for r in communities.assign(e, given, edges, vectors, centres).collect()}
    assert got == {"a": (1, "given"), "b": (1, "given"), "c": (1, "vote1"), "d": (1, "vote2"), "e": (1, "judged"), "f": (-1, "single")}


def test_claims_and_sections(spark):
    seg = spark.createDataFrame([(1, 0, 60_000, "We say: Hello, World!", ["SCREEN one"]), (1, 60_000, 120_000, "other", [])], "media_id int, start_ms long, end_ms long, transcript string, ocr_texts array<string>")
    ev = spark.createDataFrame(
        [("a", 1, 59_999, "asr", "claim A", "hello world"), ("b", 1, 60_000, "ASR", "claim A", "hello"), ("c", 1, 5, "OCR", "claim B", "screen ONE"), ("d", 1, 5, "ASR+OCR", "x", "World! screen"), ("e", 1, 5, "NOTE", "x", "hello"), ("f", 1, 5, "ASR", "x", " ?! ")],
        "evidence_id string, media_id int, ts long, source string, claim string, content string",
    )
    judged = evidence.supported(ev, seg)
    assert {r.evidence_id for r in judged.where("supported").collect()} == {"a", "c", "d"}
    claims = spark.createDataFrame([(1, "Claim a."), (1, "claim c"), (1, "--")], "media_id int, claim string")
    assert {r.claim: r.supported for r in evidence.supports_claims(claims, judged).collect()} == {"Claim a.": True, "claim c": False, "--": False}
    assert tuple(evidence.critique(claims, judged).first()) == (1, 3, 2, "5,60000", False)
    row = spark.createDataFrame([("REVIEW", ["omissions"])], "mode string, have array<string>").select(evidence.missing_sections(F.col("mode"), F.col("have")).alias("m")).first()
    assert row.m == ["fallacies", "exaggerations", "doubtful"]


def test_clusters_fold_many_equal_descriptions(spark):
    # 4,000 rows of 40 descriptions: one fold of 40, not one of 4,000
    rows = [("a", i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 40 % 26]}{i % 40} gear of {i % 40 * 7919} plates", i % 9, i % 5) for i in range(4000)]
    got = resolution.cluster_relations(spark.createDataFrame(rows, "src string, pos int, description string, strength int, segment_index int"), ["src"]).collect()
    assert sum(r.n for r in got) == 4000 and all(r.descriptions[0] in r.descriptions for r in got)
    calls = []
    shingles, resolution._shingles = resolution._shingles, lambda x: calls.append(x) or shingles(x)
    try:
        placed = resolution._leaders([r[2] for r in rows], 0.8)
    finally:
        resolution._shingles = shingles
    assert len(calls) == 40 and len(set(placed)) == len(got)
    assert resolution._leaders(["", "ab", "cd", "x", "", "xyz"], 0.8) == [0, 0, 0, 1, 0, 2]


def test_judge_starts_no_python_group_for_a_batch_key(spark):
    rows = [(k, i, f"{k}/{i}", ["c"], [0.95]) for k in range(300) for i in range(k % 45)] + [(None, 0, "none", ["c"], [0.95])]
    sizes = spark.createDataFrame(rows, "batch int, pos int, name string, candidates array<string>, scores array<double>")

    def model(batch):
        assert len({r["batch"] for r in batch}) == 1 and [r["pos"] for r in batch] == list(range(batch[0]["pos"], batch[0]["pos"] + len(batch))) and batch[0]["pos"] % 20 == 0
        return [{"id": i, "candidate": 0} for i in range(len(batch))]

    out = resolution.judge(sizes, model)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert sorted((r.name, r.action) for r in out.collect()) == sorted((r[2], "merge") for r in rows)


def test_items_of_few_and_of_many_names_merge_alike(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    names = [f" {word()} {word()} " if rng.random() < 0.6 else word().upper() for _ in range(60)]
    names += [n + rng.choice(["s", "", "x y"]) for n in names] + ["aabbccdd", "aabbccd", "", "ab", "中文字幕组合", "中文字幕组"]
    rows = [(i % 6, n, "t", "d", i) for i, n in enumerate(names)] + [(7, n, "t", "d", i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "media_id int, name string, type string, description string, segment_index int")
    found = []
    for few in (200, 0, 25):
        monkeypatch.setattr(resolution, "FEW", few)
        groups, border = resolution.merge_mentions(df)
        found.append((sorted(map(tuple, groups.collect())), sorted((m, a, b, round(j, 9)) for m, a, b, j in border.collect())))
        if few:
            assert groups.select("media_id").distinct().count() == 7
    assert found[0] == found[1] == found[2] and found[0][1]


def test_items_are_dealt_once(spark):
    rel = spark.createDataFrame([(1, "A b", "c d", 1), (2, "x", "nobody", 2)], "media_id int, src string, dst string, n int").repartition("media_id")
    groups = spark.createDataFrame([(1, "a b", "a b"), (1, "c d", "a b"), (2, "x", "x")], "media_id int, name string, `group` string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, lost = resolution.map_relations(rel, groups)
        out = kept.groupBy("media_id", "s", "t").count()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in out.collect()] == [(1, "a b", "a b", 1)] and [tuple(r) for r in lost.collect()] == [(2, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3  # the relations once, the groups for either end


def test_relations_are_merged_in_one_deal_by_item(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    names = [f" {word()} {word()} " if rng.random() < 0.6 else word().upper() for _ in range(60)]
    names += [n + rng.choice(["s", "", "x y"]) for n in names] + ["aabbccdd", "aabbccd", "", "ab", "中文字幕组合", "中文字幕组", "x" * 3 + "abcdefghijklmnopqrstuvwxyz", "xxxx-abcdefghijklmnopqrstuvwxyz"]
    mentions = [(i % 6, n) for i, n in enumerate(names)] + [(7, n) for n in names]
    texts = ["near one brand", "near one brands", "Near  one-brand", "", "far from all", None]
    relations = [(rng.choice([0, 1, 2, 3, 4, 5, 7, 7, 8]), rng.choice(names[:30]), rng.choice([*names[:30], "nobody"]), rng.choice(texts), rng.choice([None, 1, 5, 9]), rng.choice([None, 0, 1, 2, 10])) for _ in range(1500)]
    m = spark.createDataFrame([(k, n, "t", "d", 0) for k, n in mentions], "media_id long, name string, type string, description string, segment_index int")
    r = spark.createDataFrame(relations, "media_id long, src string, dst string, description string, strength int, segment_index int")
    kept, _ = resolution.map_relations(r, resolution.merge_mentions(m)[0])
    pos = F.struct("segment_index", "src", "dst", "description").alias("pos")
    want = resolution.cluster_relations(kept.select("media_id", F.col("s").alias("src"), F.col("t").alias("dst"), pos, "description", "strength", "segment_index"), ["media_id", "src", "dst"])
    cells = lambda df: sorted(repr(tuple(x)) for x in df.select("media_id", "src", "dst", "descriptions", "strength", "n", "sources").collect())
    want = cells(want)
    both = m.select("media_id", "name").unionByName(r, allowMissingColumns=True)
    both = both.unionByName(spark.createDataFrame([(7, None, None, "ab", "x", 1, 1), (7, None, "ab", None, "x", 1, 1), (None, "ab", "ab", "ab", "x", 1, 1)], both.schema))
    assert len(want) > 200
    for few, batch in ((200, 10_000), (0, 7), (25, 3)):  # items of many names go through lists; batches end within items
        monkeypatch.setattr(resolution, "FEW", few)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert cells(resolution.premerge(both)) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    odd = ["İstanbul  KK", "ΣΑΣ x", "it's\ta-b", "　中 文 ", " ' ", "", "é9\x1cz", None]
    assert [resolution._fuzzy(x) for x in odd] == [x[0] for x in spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").orderBy("i").select(X.normalize_fuzzy(F.col("x"))).collect()]


def test_relation_premerge_writes_nothing_and_deals_mentions_once(spark, monkeypatch):
    from cinegraph import queries as library

    monkeypatch.setattr(resolution, "scratch", lambda *a: pytest.fail("a table is written between"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = library.queries()["relation_premerge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3  # lines and parts to be joined, mentions by item
