"""HTML extraction by a maximum-scoring subsequence (operator 3).

A page is a sequence of words and tags. A word scores by the element around it, a tag costs by its name; both
weights come from labelled pages, which are those that mark their article themselves: the log odds of standing
inside it, counted over all of them. One linear scan finds the contiguous region with the largest sum. Where an
article or main element holds most of the region's words, its other blocks join the region if their own words score
above zero; else the region is widened to whole blocks. What is no reading text inside (navigation, forms, adverts,
notices, reader comments, scripts) is left out. Parsing takes time in proportion to the page, however it is nested.

Blocks: character references are decoded, white space inside a block becomes one space, a line break ends a
block, empty blocks go, and the others are joined by a line feed in page order.

Edge cases: a null or empty html, or one without words, gives the empty text; unclosed and crossing tags are
closed as browsers do for block elements; a page cut off inside a tag keeps what came before; a page without
article or main element gets whole blocks of the best region; repeated rows stay.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.llm.common import tune

#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea title math canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "button", "option", "select", "td", "th", "tr", "html", "head", "body"}
SAME_CLOSES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
NO_TEXT = frozenset("nav footer aside form button select menu dialog head fieldset".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal "
    "nav navbar navigation newsletter notice notices pagination popup promo promoted related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: With a mark and only such words beside it, a class or id names what is no text ("ad-box", not "social-history").
FILLERS = frozenset("area bar block bottom box btn button buttons col container content fixed group inner item items left link links list main menu module outer page panel right section site sticky text top unit widget wrap wrapper zone".split())
#: An article may head itself by such an element.
HEADS = frozenset("header masthead".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]|=)*+)(?:>|\Z)|([^<]+|<)""", re.S)
_MARK = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_KNOWN = VOID | RAW | BLOCK | INLINE
_P_STOPS = frozenset({"table", "button", "td"})


@dataclass
class Page:
    """Pieces in page order: (word count, context, tag, block number, in the article, is reading text), and block texts."""

    pieces: list
    blocks: list[list[str]]
    #: Block range of each article or main element.
    containers: list[list[int]]


def _is_mark(name: str, attrs: str, inside: bool) -> bool:
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for m in _MARK.finditer(attrs):
        for value in (m[1] or m[2] or m[3] or "").lower().split():
            words = [x for x in re.split(r"[_-]+", value) if x]
            marks = [x for x in words if x in MARKS and not (inside and x in HEADS)]
            if marks and all(x in MARKS or x in FILLERS or x.isdigit() for x in words):
                return True
            if m[0][:4].lower() == "role" and value in ROLES:
                return True
    return False


@dataclass(slots=True)
class _Open:
    """An open element; the last three say what holds at this depth, so that no tag looks through all that are open."""

    name: str
    gone: bool
    box: int
    context: str
    #: A p would be closed by the next block; by an end tag of p.
    p_ends: bool
    p_near: bool


def parse(source: str) -> Page:
    pieces: list = []
    blocks: list[list[str]] = [[]]
    containers: list[list[int]] = []
    stack: list[_Open] = []
    count: Counter = Counter()
    out_depth = inside = 0

    def pop() -> None:
        nonlocal out_depth, inside
        top = stack.pop()
        count[top.name] -= 1
        out_depth -= top.gone
        if top.box >= 0:
            inside -= 1
            containers[top.box][1] = len(blocks) - 1

    def close(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k].name in stop:
                return

    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        at = m.end()
        if m[4] is not None:
            n = len(m[4].split())
            if n:
                pieces.append((n, stack[-1].context if stack else "body", "", len(blocks) - 1, inside > 0, out_depth == 0))
            if out_depth == 0:
                blocks[-1].append(m[4])
            continue
        if m[2] is None:
            continue
        name, attrs, end = m[2].lower(), m[3], bool(m[1])
        if name in BLOCK and blocks[-1]:
            blocks.append([])
        pieces.append((0, "", name, len(blocks) - 1, inside > 0, out_depth == 0))
        if end:
            if name == "p":
                if stack and stack[-1].p_near:
                    close({"p"}, frozenset())
            elif count[name] > 0:
                close({name}, frozenset())
        elif name in RAW:
            found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
            at = found.end() if found else len(source)
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            if name in CLOSES_P and stack and stack[-1].p_ends:
                close({"p"}, frozenset())
            if name in SAME_CLOSES:
                own = {"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th") else {name}
                if any(count[x] > 0 for x in own):
                    close(own, frozenset(SAME_CLOSES[name]))
            box = -1
            if name in ("article", "main"):
                box = len(containers)
                containers.append([len(blocks) - 1 + bool(blocks[-1]), -1])
                inside += 1
            gone = name in NO_TEXT or _is_mark(name, attrs, inside > 0) or (name == "header" and not inside)
            out_depth += gone
            up = stack[-1] if stack else _Open("", False, -1, "body", False, False)
            context = name + "!" * gone if name in BLOCK or name == "a" else up.context
            stack.append(_Open(name, gone, box, context, name == "p" or (up.p_ends and name not in _P_STOPS), name == "p" or (up.p_near and name not in BLOCK)))
            count[name] += 1
    while stack:
        pop()
    return Page(pieces, blocks, containers)


def fit(pages: DataFrame) -> dict[str, float]:
    """Log odds of standing inside the article, for words by their context and for tags by their name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for h in b.column(0).to_pylist():
                p = parse(h or "")
                if len(p.containers) == 1:
                    for n, ctx, tag, _, inside, _ in p.pieces:
                        c["w" + ctx if n else "t" + (tag if tag in _KNOWN else "other"), inside] += n or 1
            keys = {k for k, _ in c}
            rows = [(k, c[k, True], c[k, False]) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["k", "i", "o"])

    sums = pages.select("html").mapInArrow(count, "k string, i long, o long").groupBy("k").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    rows = sums.collect()  # names of HTML, with and without a mark
    weights = {}
    for kind in "wt":
        own = [r for r in rows if r.k[0] == kind]
        ins, outs = sum(r.i for r in own) + 1, sum(r.o for r in own) + 1
        for r in own:
            weights[r.k] = max(-4.0, min(4.0, math.log((r.i + 0.5) / ins) - math.log((r.o + 0.5) / outs)))
    return weights


def score(piece: tuple, weights: dict[str, float]) -> float:
    """Words score by context, a reader's text 1 if nothing is known; a tag costs what speaks against it, and a little."""
    n, ctx, tag = piece[:3]
    if n:
        return n * weights.get("w" + ctx, 1.0 if piece[5] and not ctx.startswith("a") else -1.0)
    return min(0.0, weights.get("t" + (tag if tag in _KNOWN else "other"), 0.0)) - 0.05


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region with the largest sum (the first of the longest such); empty if none is positive."""
    best, at, best_at, run = 0.0, 0, (0, 0), 0.0
    for i, s in enumerate(scores):
        if run <= 0:
            run, at = 0.0, i
        run += s
        if run > best:
            best, best_at = run, (at, i + 1)
    return best_at


def extract(source: str | None, weights: dict[str, float]) -> str:
    p = parse(source or "")
    scores = [score(x, weights) for x in p.pieces]
    a, b = best_region(scores)
    if a == b:
        return ""
    lo, hi = p.pieces[a][3], p.pieces[b - 1][3]
    wanted = set(range(lo, hi + 1))
    held: Counter = Counter()
    for n, _, _, block, _, text in p.pieces[a:b]:
        if n and text:
            held[block] += n
    if box := _container(p.containers, held):
        lo, hi = box
        own: Counter = Counter()
        for x, s in zip(p.pieces, scores, strict=True):
            if x[0] and x[5]:
                own[x[3]] += s
        wanted |= {k for k, s in own.items() if s > 0}
    out = (" ".join(entities.unescape("".join(p.blocks[k])).split()) for k in range(lo, hi + 1) if k in wanted)
    return "\n".join(x for x in out if x)


def _container(containers: list[list[int]], held: Counter) -> list[int] | None:
    """Of the article and main elements, that with most of the words held by block; the innermost of equals."""
    total = np.concatenate([[0], np.cumsum([held[k] for k in range(max([*held, *(y for _, y in containers)], default=0) + 1)])])
    best, found = 0, None
    for x, y in containers:
        n = int(total[y + 1] - total[x]) if y >= x else 0
        if n and n >= best:
            best, found = n, [x, y]
    return found


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None, column: str = "text") -> DataFrame:
    """Adds the main text of each page; the weights are fitted on these pages unless given."""
    tune(pages.sparkSession)
    weights = fit(pages) if weights is None else weights
    kept = pages.drop(column)
    at = kept.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([extract(h, weights) for h in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.StringType())]))


def main_texts(pages: DataFrame) -> DataFrame:
    out = extract_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
