"""URL filters by association rules (operator 10).

Listed rules decide first: a rule fits its host and all subdomains where the path starts with the rule's path,
and the longest fitting rule wins. All other urls are judged by mined rules: Spark's FP-growth finds token
combinations of labelled urls, those that imply the bad label with enough confidence and support stay, rules
implied by a shorter rule at least as sure are pruned, and an inverted index from each rule's rarest token
matches them.

Mining is bounded. Only tokens that stand in enough bad urls take part; of tokens that always stand together the first
stands for all. FP-growth would still list every subset of what long urls share, while a rule has max_tokens tokens at
most: where urls hold more than WIDE tokens, the tokens are dealt to buckets, and each url goes once for every choice
of max_tokens buckets, with tokens marked by the choice. Every short combination lies in some choice with its full
counts, and none has many more than WIDE tokens. The rules number at most (combinations of up to max_tokens
tokens in a url, on average) / (least support), whatever the input, so they may be collected and sent to the workers.

Edge cases: a null url, or one without "://", has an empty host and path, no rule and the verdict allow unless
a mined rule of no tokens could exist (it can't); a label without a page, and a page without a label, only stay
out of the mining; null labels count as unlabelled; without bad labels nothing is mined; repeated rows stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.llm.common import scratch, tune

#: The listed rules (verdict, host, path).
LISTED = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"
#: Tokens of a url that FP-growth takes at once.
WIDE = 12


@dataclass(frozen=True)
class Mining:
    min_support: float = 0.002
    min_confidence: float = 0.7
    #: Rules with fewer labelled urls behind them are noise at any input size.
    min_rows: int = 8
    #: At most 3: rules are pruned by their single tokens and pairs.
    max_tokens: int = 3


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]] = LISTED) -> Column:
    """struct(size, rule, verdict) of the longest fitting rule, or null. The rules are an index by host."""
    by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for verdict, h, p in rules:
        by_host[h].append((p, verdict))
    found = []
    for h, own in by_host.items():
        fits = (host == h) | F.endswith(host, F.lit(f".{h}"))
        for p, verdict in own:
            found.append(F.when(fits & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*found)))


def tokens(url: str | None) -> list[str]:
    """Distinct tokens: scheme, host labels, the top domains, path words, query keys and the fragment's presence."""
    if not url or "://" not in url:
        return []
    scheme, rest = url.split("://", 1)
    m = re.match(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", rest)
    host, path, query, fragment = m[1].lower(), m[2], m[3] or "", m[4]
    labels = [x for x in host.split(".") if x]
    out = [f"s={scheme.lower()}", *(f"h={x}" for x in labels)]
    out += [f"p={x.lower()}" for x in re.split(r"[/._-]+", path) if x and not x.isdigit()]
    out += [f"q={x.partition('=')[0].lower()}" for x in query.split("&") if x]
    return sorted({*out, *(["f="] if fragment is not None else [])})


def with_tokens(pages: DataFrame, column: str = "url_tokens") -> DataFrame:
    kept = pages.drop(column)
    at = kept.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([tokens(u) for u in b.column(at).to_pylist()], pa.list_(pa.string()))], names=[*b.schema.names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.ArrayType(T.StringType()))]))


def mine(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> list[tuple[tuple[str, ...], float, int]]:
    """(tokens, confidence, rows) of the rules for bad urls. A page's label is that of the document whose id ends its path."""
    doc = F.regexp_extract(F.col("path"), r"(\d{1,18})(?:\.\w+)?/?\z", 1)
    _, path = host_path(F.col("url"))
    numbered = pages.select("url").withColumn("path", path).withColumn("label_id", F.when(doc != "", doc.cast("long"))).where("label_id is not null")
    known = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    rows = with_tokens(numbered.join(known, "label_id").select("url", "bad")).select(F.monotonically_increasing_id().alias("row"), "bad", "url_tokens")
    rows = scratch(rows, "url-labelled")
    n, bad = rows.agg(F.count("*"), F.sum("bad")).first()
    if not bad:
        return []
    least = int(min(n, max(np.ceil(mining.min_support * n), mining.min_rows)))
    each = rows.select("row", "bad", F.explode("url_tokens").alias("token"))
    stands = each.groupBy("token").agg(F.sum("bad").alias("b"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(7))).alias("y"))
    used = stands.where(F.col("b") >= least).groupBy("b", "c", "x", "y").agg(F.min("token").alias("token")).select("token")
    used = scratch(used.withColumn("place", F.xxhash64("token")), "url-tokens")  # at most tokens in a url / support rows
    per_row = scratch(each.join(F.broadcast(used), "token").groupBy("row", "bad").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("own")), "url-items")
    wide = per_row.agg(F.max(F.size("own"))).first()[0] or 0
    if not wide:
        return []
    k = mining.max_tokens
    buckets = max(k, -(-k * wide // WIDE)) if wide > WIDE else k
    if wide > WIDE:  # neighbours in the order of all tokens go to different buckets
        ranked = {r.token: i % buckets for i, r in enumerate(used.orderBy("place", "token").collect())}
        choices = [list(c) for c in combinations(range(buckets), k)]
    else:
        ranked, choices = None, [[0]]
    return _prune(_rules(per_row, ranked, choices, least, mining))


def _rules(per_row: DataFrame, bucket: dict[str, int] | None, choices: list[list[int]], least: int, mining: Mining) -> DataFrame:
    """antecedent, confidence, rows of all rules for BAD with up to max_tokens tokens."""
    from pyspark.ml.fpm import FPGrowth

    spark = per_row.sparkSession
    label = F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    if bucket is None:
        items = per_row.select(F.concat(F.col("own.token"), label).alias("items"))
    else:
        dealt = spark.createDataFrame(sorted(bucket.items()), "token string, bucket int")
        chosen = spark.createDataFrame([(i, b) for i, c in enumerate(choices) for b in c], "choice int, bucket int")
        chosen = dealt.join(F.broadcast(chosen), "bucket").groupBy("token").agg(F.collect_list("choice").alias("in"))
        flat = per_row.select("row", "bad", F.explode("own.token").alias("token")).join(F.broadcast(chosen), "token")
        flat = flat.select("row", "bad", "token", F.explode("in").alias("choice"))
        mark = F.concat(F.col("choice").cast("string"), F.lit("\x00"))
        own = flat.groupBy("row", "bad", "choice").agg(F.collect_list(F.concat(mark, "token")).alias("own"))
        items = own.select(F.concat("own", F.transform(label, lambda x: F.concat(mark, x))).alias("items"))
    items = scratch(items, "url-transactions")
    total = items.count()
    model = FPGrowth(itemsCol="items", minSupport=max(least - 0.5, 0.5) / total, minConfidence=mining.min_confidence).fit(items)
    rules = model.associationRules.where((F.size("antecedent") <= mining.max_tokens) & F.element_at("consequent", 1).endswith(BAD))
    plain = F.transform("antecedent", lambda x: F.element_at(F.split(x, "\x00"), -1)) if bucket is not None else F.col("antecedent")
    rules = rules.select(F.sort_array(plain).alias("antecedent"), "confidence", F.round(F.col("support") * total).cast("long").alias("rows"))
    return rules.dropDuplicates(["antecedent"])


def _prune(rules: DataFrame) -> list[tuple[tuple[str, ...], float, int]]:
    """Leaves out a rule if some of its tokens already make a rule that is as sure."""
    rules = scratch(rules, "url-rules")
    parts = rules.select("antecedent", "confidence", F.explode(F.expr("flatten(array(transform(antecedent, x -> array(x)), flatten(transform(antecedent, (x, i) -> transform(slice(antecedent, i + 2, size(antecedent)), y -> array(x, y))))))")).alias("part"))
    parts = parts.where(F.size("part") < F.size("antecedent"))
    short = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    implied = parts.join(short, "part").where(F.col("sure") >= F.col("confidence")).select("antecedent")
    found = rules.join(implied, "antecedent", "left_anti").collect()
    return sorted((tuple(r.antecedent), r.confidence, r.rows) for r in found)


def matches(pages: DataFrame, rules: list[tuple[tuple[str, ...], float, int]], column: str = "mined_rule") -> DataFrame:
    """Adds the surest mined rule that fits each url (its tokens joined by a blank), or null."""
    count: dict[str, int] = defaultdict(int)
    for items, _, _ in rules:
        for t in items:
            count[t] += 1
    index: dict[str, list[tuple[float, str, frozenset]]] = defaultdict(list)
    for items, conf, _ in rules:
        index[min(items, key=lambda t: (count[t], t))].append((-conf, " ".join(items), frozenset(items)))
    index = {t: sorted(own) for t, own in index.items()}
    kept = pages.drop(column)
    at = kept.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u in b.column(at).to_pylist():
                own = set(tokens(u)) if index else set()
                out.append(min((x[:2] for t in own if t in index for x in index[t] if x[2] <= own), default=(0, None))[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.StringType())]))


def verdicts(pages: DataFrame, labels: DataFrame, mining: Mining = Mining(), rules: list[tuple[str, str, str]] = LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every page."""
    tune(pages.sparkSession)
    found = matches(pages.select("page_id", "url"), mine(pages, labels, mining))
    host, path = host_path(F.col("url"))
    out = found.withColumn("host", host).withColumn("path", path)
    out = out.withColumn("own", listed(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), method).alias("verdict"), F.when(F.col("own").isNull(), F.col("mined_rule")).alias("mined_rule"))
