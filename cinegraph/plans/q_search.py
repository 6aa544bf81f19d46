"""Search over segments, media, entities and communities, and the evidence that long media are cut down to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegraph.operators import search as H
from cinegraph.operators.folds import budget_pack as pack
from cinegraph.operators.intervals import points_in_intervals
from cinegraph.operators.traversal import k_hop
from cinegraph.plans.catalog import entity, evidence, media, mention, moment, query, relation, segment, vec
from cinegraph.plans.shared import scratch

c = F.col
WORDS, NAMES = ["the", "and", "thing"], ["red", "gear"]
SPOKEN, SEEN = ["the", "de ", "la"], ["the", "le"]

# SQL pieces: vectors by arithmetic on keys, scores against vector 0, BM25 and fusion
_EV = "(ascii(name) * 31 + length(name) * 7 + ascii(right(name, 1)) * 13 + {0}) % 500"
_SC = "q0 AS (SELECT v AS q FROM vec WHERE vec_id = 0), sc AS (SELECT vec_id, list_cosine_similarity(v, q) AS raw, (1 + list_cosine_similarity(v, q)) / 2 AS s FROM vec, q0)"
_COMM = "100 + community * 7 + ascii(right(group_id, 1))"


def _top(name: str, source: str, key: str, k: int) -> str:
    return f"{name} AS (SELECT {key} AS key, row_number() OVER (ORDER BY score DESC, {key}) - 1 AS rank FROM {source} QUALIFY rank < {k})"


def _bm(name: str, source: str, key: str, text: str, terms: list[str]) -> str:
    n = name
    return f"""{n}w AS (SELECT {key}, regexp_extract_all(lower({text}), '([a-z0-9]+)', 1) AS w FROM {source}), {n}n AS (SELECT count(*) AS n, avg(len(w)) AS av FROM {n}w),
{n}h AS (SELECT {key}, len, term, count(*) AS tf FROM (SELECT {key}, len(w) AS len, unnest(w) AS term FROM {n}w) WHERE list_contains({terms}, term) GROUP BY ALL), {n}f AS (SELECT term, count(*) AS df FROM {n}h GROUP BY term),
{n} AS (SELECT {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS score FROM {n}h JOIN {n}f USING (term), {n}n GROUP BY {key})"""


def _fuse(name: str, lists: list[str], k: int) -> str:
    u = " UNION ALL ".join(f"SELECT {i} AS l, key, rank FROM {x}" for i, x in enumerate(lists))
    return f"{name}r AS (SELECT key, sum(1 / (rank + 60)) AS score, min(l * 1000 + rank) AS f FROM ({u}) GROUP BY key), {name} AS (SELECT key, row_number() OVER (ORDER BY score DESC, f) - 1 AS rank FROM {name}r QUALIFY rank < {k})"


def _overlap(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{t}')::INT" for t in terms) + f") / {len(terms)}"


def _rerank(name: str, source: str, text: str, terms: list[str], k: int) -> str:
    return f"{name} AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY {_overlap(text, terms)} DESC, rank) - 1 AS rank FROM {source} QUALIFY row_number() OVER (ORDER BY {_overlap(text, terms)} DESC, rank) <= {k})"


def _q(spark: SparkSession, d: str) -> DataFrame:
    return vec(spark, d).where("vec_id = 0").select(c("v").alias("q"))


def _with(spark: SparkSession, d: str, rows: DataFrame, at: F.Column, name: str = "vector") -> DataFrame:
    """Adds the vector whose id is `at`."""
    v = vec(spark, d).select(c("vec_id").alias("_at"), c("v").alias(name))
    return rows.withColumn("_at", at.cast("long")).join(F.broadcast(v), "_at", "left").drop("_at")  # 500 rows


def _name_at(off: int) -> F.Column:
    return (F.ascii("name") * 31 + F.length("name") * 7 + F.ascii(F.right("name", F.lit(1))) * 13 + off) % 500


_SEGMENTS = f"g AS (SELECT m.*, sc.s AS score FROM segment m JOIN sc ON sc.vec_id = (media_id * 8 + segment_index) % 500 WHERE group_id = 'user_1' AND sc.s >= 0.4), {_bm('bm', 'segment', 'segment_id', 'transcript', WORDS)}, b AS (SELECT bm.* FROM bm JOIN segment USING (segment_id) WHERE group_id = 'user_1')"


@query(f"[vec segment] WITH {_SC}, {_SEGMENTS}, {_top('la', 'g', 'segment_id', 10)}, {_top('lb', 'b', 'segment_id', 10)}, {_fuse('fu', ['la', 'lb'], 10)}, cand AS (SELECT segment_id, media_id, start_ms, left(transcript, 300) AS x, fu.rank FROM fu JOIN segment ON segment_id = key), {_rerank('best', 'cand', 'x', WORDS, 5)} SELECT segment_id, media_id, start_ms, left(x, 100) AS excerpt, rank FROM best")
def segment_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and full text of a tenant's segments, fused, reranked by the words of the question, with citations."""
    s = segment(spark, d)
    own = _with(spark, d, s.where("group_id = 'user_1'"), (c("media_id") * 8 + c("segment_index")) % 500)
    lists = [H.vector_list(own, "segment_id", "vector", _q(spark, d), H.SEGMENT_AT, 10), H.text_list(s, "segment_id", "transcript", WORDS, 10, "group_id = 'user_1'")]
    cand = s.join(H.fuse(lists, "segment_id", 10), "segment_id").select("segment_id", "media_id", "start_ms", F.left("transcript", F.lit(300)).alias("x"), "rank")
    return H.rerank(cand, "x", 5, H.overlap(WORDS)).select("segment_id", "media_id", "start_ms", F.left("x", F.lit(100)).alias("excerpt"), c("rank").cast("long").alias("rank"))


@query(f"[vec segment] WITH {_SC}, {_SEGMENTS}, {_top('la', 'g', 'segment_id', 10)}, {_top('lb', 'b', 'segment_id', 10)}, {_fuse('fu', ['la', 'lb'], 10)} SELECT 'fused' AS way, key AS segment_id, rank FROM fu WHERE rank < 5 UNION ALL SELECT 'failed', key, rank FROM fu WHERE rank < 5")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    """Without a model, and with one that fails, the fused order stays."""
    s = segment(spark, d)
    own = _with(spark, d, s.where("group_id = 'user_1'"), (c("media_id") * 8 + c("segment_index")) % 500)
    lists = [H.vector_list(own, "segment_id", "vector", _q(spark, d), H.SEGMENT_AT, 10), H.text_list(s, "segment_id", "transcript", WORDS, 10, "group_id = 'user_1'")]
    cand = s.join(H.fuse(lists, "segment_id", 10), "segment_id").select("segment_id", "transcript", "rank")

    def broken(texts: list[str]) -> list[float]:
        raise RuntimeError("no model")

    out = [H.rerank(cand, "transcript", 5, m).select(F.lit(way).alias("way"), "segment_id", c("rank").cast("long").alias("rank")) for way, m in (("fused", None), ("failed", broken))]
    return out[0].unionByName(out[1])


@query(f"[vec media] WITH {_SC} SELECT media_id, title, round(duration_ms / 60000.0, 1) AS minutes, round(s, 3) AS score FROM media JOIN sc ON sc.vec_id = media_id % 500 WHERE group_id = 'user_1' AND s >= 0.4 ORDER BY s DESC, media_id LIMIT 5")
def media_search(spark: SparkSession, d: str) -> DataFrame:
    """The coarse first step: media of a tenant whose summary vector is like the question."""
    m = media(spark, d).where("group_id = 'user_1'")
    best = H.vector_list(_with(spark, d, m, c("media_id") % 500), "media_id", "vector", _q(spark, d), H.MEDIA_AT, 5)
    return m.join(F.broadcast(best), "media_id").select("media_id", "title", F.round(c("duration_ms") / 60000, 1).alias("minutes"), F.round("score", 3).alias("score"))


@query(f"[vec entity] WITH {_SC} SELECT id, round(s, 6) AS score FROM entity JOIN sc ON sc.vec_id = {_EV.format(0)} WHERE group_id = 'user_1' AND s >= 0.5 ORDER BY s DESC, id LIMIT 10")
def entity_search_debug(spark: SparkSession, d: str) -> DataFrame:
    """Name vectors of a tenant's entities; no limit to a media item."""
    e = _with(spark, d, entity(spark, d).where("group_id = 'user_1'"), _name_at(0))
    return H.vector_list(e, "id", "vector", _q(spark, d), H.NAME_AT, 10).select("id", F.round("score", 6).alias("score"))


_ENTS = f"""e AS (SELECT *, name || ' ' || description AS x FROM entity WHERE group_id = 'user_1'), na AS (SELECT e.name, s AS score FROM e JOIN sc ON sc.vec_id = {_EV.format(0)} WHERE s >= 0.5), de AS (SELECT e.name, s AS score FROM e JOIN sc ON sc.vec_id = {_EV.format(17)} WHERE s >= 0.6), {_bm('bm', 'e', 'name', 'x', NAMES)},
{_top('la', 'na', 'name', 10)}, {_top('lb', 'de', 'name', 10)}, {_top('lc', 'bm', 'name', 10)}, {_fuse('seed', ['la', 'lb', 'lc'], 3)},
lk AS (SELECT src AS x, dst AS y FROM relation WHERE group_id = 'user_1' UNION SELECT dst, src FROM relation WHERE group_id = 'user_1'), hop1 AS (SELECT DISTINCT y AS name FROM lk JOIN seed ON x = key WHERE y NOT IN (SELECT key FROM seed)), hop2 AS (SELECT DISTINCT y AS name FROM lk JOIN hop1 ON x = hop1.name WHERE y NOT IN (SELECT key FROM seed) AND y NOT IN (SELECT name FROM hop1)),
bfs AS (SELECT name, 1.0 AS score FROM hop1 UNION ALL SELECT name, 0.5 FROM hop2), {_top('ld', 'bfs', 'name', 10)}, {_fuse('fu', ['la', 'lb', 'lc', 'ld'], 10)}, cand AS (SELECT name, name || ' (' || type || '): ' || description AS x, fu.rank FROM fu JOIN e ON name = key), {_rerank('ent', 'cand', 'x', NAMES, 5)}"""
_RELS = f"""rl AS (SELECT src || '|' || dst AS key, src || ' -> ' || dst AS x, src, dst, strength, n FROM relation WHERE group_id = 'user_1'), rv AS (SELECT rl.key, s AS score FROM rl JOIN sc ON sc.vec_id = (ascii(src) * 17 + ascii(dst) * 29 + length(src)) % 500 WHERE s >= 0.5), {_bm('rb', 'rl', 'key', 'x', NAMES)},
{_top('ra', 'rv', 'key', 10)}, {_top('rc', 'rb', 'key', 10)}, {_fuse('rf', ['ra', 'rc'], 10)}, rcand AS (SELECT rl.key, x, rf.rank FROM rf JOIN rl ON rl.key = rf.key), {_rerank('rel', 'rcand', 'x', NAMES, 5)}"""


@query(f"""[vec entity relation] WITH {_SC}, {_ENTS}, {_RELS},
edge AS (SELECT ent.rank, ent.name, rl.x, row_number() OVER (PARTITION BY ent.name ORDER BY strength DESC, n DESC, rl.key) AS r FROM ent JOIN rl ON rl.src = ent.name OR rl.dst = ent.name)
SELECT 'entity' AS kind, rank, x AS text FROM ent UNION ALL SELECT 'edge', rank * 10 + r, x FROM edge WHERE r <= 3 UNION ALL SELECT 'relation', rank, x FROM rel UNION ALL
SELECT 'citation', 0, 'media_' || media_id || '_segment_' || segment_index FROM (SELECT DISTINCT media_id, segment_index FROM mention WHERE group_id = 'user_1' AND name IN (SELECT name FROM ent))""")
def local_search(spark: SparkSession, d: str) -> DataFrame:
    """Entities by three lists and the graph around their best, relations by two lists, as contexts with citations."""
    e = scratch(entity(spark, d).where("group_id = 'user_1'").withColumn("x", F.concat_ws(" ", "name", "description")), "search-entities")
    q = _q(spark, d)
    lists = [
        H.vector_list(_with(spark, d, e, _name_at(0)), "name", "vector", q, H.NAME_AT, 10),
        H.vector_list(_with(spark, d, e, _name_at(17)), "name", "vector", q, H.DESCRIPTION_AT, 10),
        H.text_list(e, "name", "x", NAMES, 10),
    ]
    r = scratch(relation(spark, d).where("group_id = 'user_1'"), "search-relations")  # read by every list below
    near = k_hop(r, scratch(H.fuse(lists, "name", 3).select("name"), "search-seeds", 3), 2).withColumn("score", 1 / F.greatest("distance", F.lit(1)))
    lists.append(H.ranked(H.top(near, 10, "score", "name"), [F.desc("score"), "name"]))
    cand = e.join(H.fuse(lists, "name", 10), "name").select("name", F.concat("name", F.lit(" ("), "type", F.lit("): "), "description").alias("x"), "rank")
    best = H.rerank(cand, "x", 5, H.overlap(NAMES)).select("name", "x", c("rank").cast("long").alias("rank"))

    rl = r.select(F.concat_ws("|", "src", "dst").alias("key"), F.concat_ws(" -> ", "src", "dst").alias("x"), "src", "dst", "strength", "n")
    at = (F.ascii("src") * 17 + F.ascii("dst") * 29 + F.length("src")) % 500
    lists = [H.vector_list(_with(spark, d, rl, at), "key", "vector", q, H.RELATION_AT, 10), H.text_list(rl, "key", "x", NAMES, 10)]
    direct = H.rerank(rl.join(H.fuse(lists, "key", 10), "key").select("key", "x", "rank"), "x", 5, H.overlap(NAMES))

    ends = rl.select(c("src").alias("name"), "key", c("x").alias("edge"), "strength", "n").unionByName(rl.select(c("dst").alias("name"), "key", c("x").alias("edge"), "strength", "n"))
    w = Window.partitionBy("name").orderBy(F.desc("strength"), F.desc("n"), "key")
    edges = ends.join(F.broadcast(best.select("name", "rank")), "name").withColumn("r", F.row_number().over(w)).where("r <= 3")
    cited = mention(spark, d).where("group_id = 'user_1'").join(F.broadcast(best.select("name")), "name", "left_semi").select("media_id", "segment_index").distinct()
    row = lambda df, kind, rank, text: df.select(F.lit(kind).alias("kind"), rank.cast("long").alias("rank"), text.alias("text"))
    segment_id = F.concat(F.lit("media_"), "media_id", F.lit("_segment_"), "segment_index")
    return row(best, "entity", c("rank"), c("x")).unionByName(row(edges, "edge", c("rank") * 10 + c("r"), c("edge"))).unionByName(row(direct, "relation", c("rank"), c("x"))).unionByName(row(cited, "citation", F.lit(0), segment_id))


_MEMBERS = "mb AS (SELECT group_id, ascii(name) % 5 AS community, name, source_count FROM entity), cm AS (SELECT group_id, community, string_agg(name, ' ' ORDER BY source_count DESC, name) AS x, count(*) AS members FROM mb GROUP BY ALL)"


def _communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Members, and communities with a summary of their members' names, the most mentioned first."""
    m = entity(spark, d).select("group_id", (F.ascii("name") % 5).alias("community"), "name", "source_count")
    own = F.array_sort(F.collect_list(F.struct((-c("source_count")).alias("k"), "name")))
    return m, m.groupBy("group_id", "community").agg(F.array_join(F.transform(own, lambda s: s["name"]), " ").alias("x"), F.transform(own, lambda s: s["name"]).alias("findings"), F.count("*").alias("members"))


def points_of(terms: list[str], rows: list[dict]) -> str:
    """A mapper without a model: findings that hold a term, by the share of terms; it also answers some nonsense."""
    out: list = [{"community": 99, "points": [{"text": "nobody", "score": 100}]}, {"community": "x"}]
    for i, r in enumerate(rows):
        points = [{"text": f, "score": 100 * sum(t in f for t in terms) // len(terms)} for f in r["findings"]]
        out.append({"community": i, "points": [*points, {"text": "no score", "score": "high"}, {"text": " ", "score": 100}]})
    return json.dumps(out)


_POINTS = "pt AS (SELECT {0}, name AS text, (100 * (contains(name, 'red')::INT + contains(name, 'gear')::INT)) // 2 AS score, row_number() OVER (PARTITION BY {0} ORDER BY source_count DESC, name) AS place FROM mb)"


@query(f"[entity] WITH {_MEMBERS}, k AS (SELECT group_id, community, row_number() OVER (ORDER BY group_id, community) - 1 AS rank FROM cm), {_POINTS.format('group_id, community')} SELECT group_id || '/' || community AS community, text, score::INT AS score FROM pt JOIN k USING (group_id, community) WHERE score >= 50 ORDER BY score DESC, rank, place LIMIT 15")
def map_reduce_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of all communities' answers, five communities a call; what is malformed is left out."""
    _, cm = _communities(spark, d)
    rows = cm.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("group_id", "community")) - 1)  # communities of the tenants that are asked about
    rows = rows.select(F.concat_ws("/", "group_id", "community").alias("community"), "findings", "rank")
    return H.map_reduce(rows, lambda batch: points_of(NAMES, batch)).select("community", "text", "score")


@query(f"""[vec entity mentioned] WITH {_SC}, {_MEMBERS}, own AS (SELECT * FROM cm WHERE group_id = 'user_1'), cv AS (SELECT community, s AS score FROM own JOIN sc ON sc.vec_id = {_COMM} WHERE s >= 0.3), {_bm('bm', 'own', 'community', 'x', NAMES)},
{_top('la', 'cv', 'community', 10)}, {_top('lb', 'bm', 'community', 10)}, {_fuse('fu', ['la', 'lb'], 10)}, cand AS (SELECT community, x, fu.rank FROM fu JOIN own ON community = key), {_rerank('best', 'cand', 'x', NAMES, 5)},
pt AS (SELECT community, name AS text, (100 * (contains(name, 'red')::INT + contains(name, 'gear')::INT)) // 2 AS score, row_number() OVER (PARTITION BY community ORDER BY source_count DESC, name) AS place FROM mb WHERE group_id = 'user_1'),
po AS (SELECT pt.community, text, score FROM pt JOIN best USING (community) WHERE score >= 50 ORDER BY score DESC, rank, place LIMIT 15), gave AS (SELECT DISTINCT community FROM po)
SELECT 'point' AS kind, community, text, score::BIGINT AS n FROM po UNION ALL SELECT 'core', community, text, place FROM pt JOIN gave USING (community) WHERE place <= 5 UNION ALL
SELECT 'provenance', community, '', count(DISTINCT (media_id, segment_index)) FROM mentioned JOIN mb ON entity_id = 'entity_' || mb.group_id || '_' || mb.name JOIN gave USING (community) WHERE mentioned.group_id = 'user_1' GROUP BY community""")
def global_search(spark: SparkSession, d: str) -> DataFrame:
    """Communities by two lists, their points by a mapper, the core members and the number of source segments."""
    members, cm = _communities(spark, d)
    members, own = members.where("group_id = 'user_1'"), cm.where("group_id = 'user_1'")
    at = 100 + c("community") * 7 + F.ascii(F.right("group_id", F.lit(1)))
    lists = [H.vector_list(_with(spark, d, own, at), "community", "vector", _q(spark, d), H.COMMUNITY_AT, 10), H.text_list(own, "community", "x", NAMES, 10)]
    cand = own.join(H.fuse(lists, "community", 10), "community").select("community", "x", "findings", "rank")
    points = H.map_reduce(H.rerank(cand, "x", 5, H.overlap(NAMES)).select("community", "findings", "rank"), lambda batch: points_of(NAMES, batch))
    gave = points.select("community").distinct()
    w = Window.partitionBy("community").orderBy(F.desc("source_count"), "name")
    core = members.join(F.broadcast(gave), "community", "left_semi").withColumn("n", F.row_number().over(w)).where("n <= 5")
    cited = mention(spark, d).where("group_id = 'user_1'").withColumn("community", F.ascii("name") % 5).join(F.broadcast(gave), "community", "left_semi").groupBy("community").agg(F.countDistinct("media_id", "segment_index").alias("n"))
    row = lambda df, kind, text, n: df.select(F.lit(kind).alias("kind"), "community", text.alias("text"), n.cast("long").alias("n"))
    return row(points, "point", c("text"), c("score")).unionByName(row(core, "core", c("name"), c("n"))).unionByName(row(cited, "provenance", F.lit(""), c("n")))


# --- evidence of long media: chunks of five minutes, their segments, and a budget of characters ---

_CHUNKS = "ch AS (SELECT media_id, start_ms // 300000 AS chunk, string_agg(transcript, ' ' ORDER BY segment_index) AS spoken, coalesce(string_agg(nullif(array_to_string(ocr_texts, ' '), ''), ' ' ORDER BY segment_index), '') AS seen FROM moment GROUP BY ALL), cs AS (SELECT ch.*, raw, row_number() OVER (PARTITION BY media_id ORDER BY raw DESC, chunk) AS r FROM ch JOIN sc ON sc.vec_id = (media_id * 3 + chunk) % 500)"


def _terms(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{t}')::INT" for t in terms) + f") / {len(terms)}"


_RANKED = f"""{_CHUNKS}, ck AS (SELECT media_id, chunk, 0.6 * raw + 0.25 * {_terms('spoken', SPOKEN)} + 0.15 * {_terms('seen', SEEN)} AS score FROM cs QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY score DESC, chunk) <= 3),
rk AS (SELECT m.media_id, m.segment_index, m.start_ms, length(transcript) + coalesce(list_sum(list_transform(ocr_texts, lambda x: length(x))), 0) AS size, round(0.55 * ck.score + 0.25 * {_terms('transcript', SPOKEN)} + 0.2 * {_terms("array_to_string(ocr_texts, ' ')", SEEN)}, 9) AS score FROM moment m JOIN ck ON ck.media_id = m.media_id AND ck.chunk = m.start_ms // 300000),
ps AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, start_ms) AS pos FROM rk)"""


def _chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Segments with their chunk and size, and chunks with their texts and vector."""
    m = moment(spark, d).withColumn("chunk", F.floor(c("start_ms") / 300_000)).withColumn("screen", F.array_join("ocr_texts", " "))
    size = F.length("transcript") + F.aggregate("ocr_texts", F.lit(0), lambda a, x: a + F.length(x))
    m = m.withColumn("size", size)
    line = F.array_sort(F.collect_list(F.struct("segment_index", "transcript", "screen")))
    ch = m.groupBy("media_id", "chunk").agg(line.alias("l")).select(
        "media_id", "chunk", F.array_join(F.transform("l", lambda x: x["transcript"]), " ").alias("spoken"), F.array_join(F.filter(F.transform("l", lambda x: x["screen"]), lambda x: x != ""), " ").alias("seen")
    )
    return m, _with(spark, d, ch, (c("media_id") * 3 + c("chunk")) % 500)


@query(f"[vec moment] WITH {_SC}, {_CHUNKS} SELECT media_id, chunk, round(raw, 6) AS score, r <= 1 AS from_store FROM cs")
def vector_store_search(spark: SparkSession, d: str) -> DataFrame:
    """Scores of an item's chunks: the store's answer for its best, the plain cosine for the rest."""
    _, ch = _chunks(spark, d)
    q = _q(spark, d)
    return H.chunk_scores(ch, q, H.store_search(ch, q, 1), SPOKEN, SEEN).select("media_id", "chunk", F.round("semantic", 6).alias("score"), "from_store")


def _rank(spark: SparkSession, d: str) -> DataFrame:
    m, ch = _chunks(spark, d)
    q = _q(spark, d)
    return H.rank_segments(m, H.chunk_scores(ch, q, H.store_search(ch, q, 6), SPOKEN, SEEN), SPOKEN, SEEN)


@query(f"[vec moment] WITH {_SC}, {_RANKED} SELECT media_id, segment_index, round(score, 6) AS score FROM ps WHERE pos <= 8")
def evidence_rank(spark: SparkSession, d: str) -> DataFrame:
    """The eight best segments of an item's three best chunks."""
    return _rank(spark, d).where("pos <= 8").select("media_id", "segment_index", F.round("score", 6).alias("score"))


_PICK = """cand AS (SELECT m.media_id, m.segment_index, row_number() OVER (PARTITION BY m.media_id ORDER BY m.start_ms) AS pos, length(transcript) + coalesce(list_sum(list_transform(ocr_texts, lambda x: length(x))), 0) AS size FROM moment m JOIN lg USING (media_id) WHERE last <= 300000 UNION ALL SELECT ps.media_id, segment_index, pos, size FROM ps JOIN lg USING (media_id) WHERE last > 300000)"""
_PACKED = "{1}(media_id, pos, segment_index, taken, used) AS (SELECT media_id, pos, segment_index, true, size FROM {0} WHERE pos = 1 UNION ALL SELECT n.media_id, n.pos, n.segment_index, p.used + n.size <= {2}, p.used + CASE WHEN p.used + n.size <= {2} THEN n.size ELSE 0 END FROM {1} p JOIN {0} n ON n.media_id = p.media_id AND n.pos = p.pos + 1)"
_SELECT = f"{_SC}, {_RANKED}, lg AS (SELECT media_id, max(end_ms) AS last FROM moment GROUP BY media_id), {_PICK}, {_PACKED.format('cand', 'pk', 800)}"


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """media_id, segment_index of what fits the budget: all segments of short media in order, else the ranked ones."""
    m = moment(spark, d)
    size = F.length("transcript") + F.aggregate("ocr_texts", F.lit(0), lambda a, x: a + F.length(x))
    last = m.groupBy("media_id").agg(F.max("end_ms").alias("last"))
    short = m.withColumn("size", size).join(last.where("last <= 300000"), "media_id", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms")))
    long = _rank(spark, d).join(last.where("last > 300000"), "media_id", "left_semi")
    cand = short.select("media_id", "segment_index", "pos", "size").unionByName(long.select("media_id", "segment_index", "pos", "size"))
    return cand.join(pack(cand, "media_id", "pos", "size", 800).select("media_id", "pos"), ["media_id", "pos"], "left_semi").select("media_id", "segment_index")


@query(f"[vec moment] WITH RECURSIVE {_SELECT} SELECT media_id, segment_index FROM pk WHERE taken")
def select_relevant(spark: SparkSession, d: str) -> DataFrame:
    return _relevant(spark, d)


_BAD = "bad AS (SELECT e.media_id, e.ts FROM evidence e WHERE (e.media_id + length(e.claim)) % 3 = 0)"


@query(f"[vec moment evidence] WITH RECURSIVE {_SELECT}, {_BAD}, al AS (SELECT m.media_id, m.segment_index, 1 AS pri FROM moment m WHERE EXISTS (SELECT 1 FROM bad WHERE bad.media_id = m.media_id AND ts >= greatest(0, m.start_ms - 60000) AND ts < m.end_ms + 60000) UNION ALL SELECT media_id, segment_index, 2 FROM pk WHERE taken UNION ALL SELECT media_id, segment_index, 3 FROM moment WHERE segment_index = 0), fi AS (SELECT media_id, segment_index, min(pri) AS pri FROM al GROUP BY ALL), c2 AS (SELECT fi.media_id, fi.segment_index, row_number() OVER (PARTITION BY fi.media_id ORDER BY pri, start_ms) AS pos, length(transcript) + coalesce(list_sum(list_transform(ocr_texts, lambda x: length(x))), 0) AS size FROM fi JOIN moment m ON m.media_id = fi.media_id AND m.segment_index = fi.segment_index), {_PACKED.format('c2', 'p2', 1200)} SELECT media_id, segment_index FROM p2 WHERE taken")
def refine_for_critique(spark: SparkSession, d: str) -> DataFrame:
    """Segments near the times that a critique names, then those of a new search, then those selected before, as far as the budget goes."""
    m = moment(spark, d)
    size = F.length("transcript") + F.aggregate("ocr_texts", F.lit(0), lambda a, x: a + F.length(x))
    bad = evidence(spark, d).where((c("media_id") + F.length("claim")) % 3 == 0).select("media_id", "ts")
    margin = F.greatest(F.lit(60_000), c("end_ms") - c("start_ms"))
    wide = m.select("media_id", "segment_index", F.greatest(F.lit(0), c("start_ms") - margin).alias("start_ms"), (c("end_ms") + margin).alias("end_ms"))
    near = points_in_intervals(bad, wide, "media_id").select("media_id", "segment_index").distinct().withColumn("pri", F.lit(1))
    every = near.unionByName(_relevant(spark, d).withColumn("pri", F.lit(2))).unionByName(m.where("segment_index = 0").select("media_id", "segment_index").withColumn("pri", F.lit(3)))
    first = every.groupBy("media_id", "segment_index").agg(F.min("pri").alias("pri"))
    rows = first.join(m.withColumn("size", size).select("media_id", "segment_index", "start_ms", "size"), ["media_id", "segment_index"])
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("media_id").orderBy("pri", "start_ms")))
    return rows.join(pack(rows, "media_id", "pos", "size", 1200).select("media_id", "pos"), ["media_id", "pos"], "left_semi").select("media_id", "segment_index")
